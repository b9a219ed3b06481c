"""Near-duplicates by SimHash fingerprints and a binary trie self-join.

Fingerprints that differ in at most ``BITS`` bits are linked. The trie is shared out by
agreement: four equal parts of the 64 bits cannot all hold one of three differences, so
linked fingerprints agree on at least one part, and each fingerprint joins one group for each
part. A group with more than ``GROUP`` members is split in the same way by four parts of the
bits in which its members differ, until groups are small: as members are distinct, a group of
more than ``GROUP`` differs in at least eleven bits. No group, however many near copies it
gathers, lands in one task, and nothing is capped.

Inside a task the sorted members of many groups are tries whose nodes are index ranges. Pairs
of nodes are walked together, bit by bit, with the bits in which they differ counted; a pair
is dropped once that exceeds the budget, and pairs of few members are compared directly. Each
group gives links of a spanning forest only, not all its pairs. Components over all groups
then come from large-star and small-star steps on stored link tables.

Rules: null and blank texts have the fingerprint zero and link like any other. Repeated rows
keep one row each. Null document ids get their component's id, which only counts ids that are
not null. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import batched, free_names, text_column, to_arrow
from panelspark.session import stored

SHINGLE = 3
SEED = 42
BITS = 3
#: Members of a group that one task compares.
GROUP = 2048
#: Members that a task holds at once, whole groups of them.
HELD = 50_000
#: Node pairs with at most so many member pairs are compared directly.
FEW = 16
#: Member pairs compared at once.
AT_ONCE = 1 << 20


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Each bit is the majority of that bit over the hashes of all word shingles."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(s, SEED) for s in shingles], "<u8")
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., fp long``: one row per document."""
    names = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{names}, fp long"
    arrow = to_arrow(docs.sparkSession, schema)

    def run(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield from batched(((*row[:-1], fingerprint(row[-1])) for row in rows), arrow)

    return docs.select(*keys, text_column().alias("text")).mapInArrow(run, schema)


def _components(size: int, left: np.ndarray, right: np.ndarray, label: np.ndarray) -> np.ndarray:
    """``label`` (of members, the smallest index reached) after adding links."""
    while True:
        a, b = label[left], label[right]
        open_ = a != b
        if not open_.any():
            return label
        left, right = left[open_], right[open_]
        low, high = np.minimum(a, b)[open_], np.maximum(a, b)[open_]
        np.minimum.at(label, high, low)
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def trie_links(members: np.ndarray, group: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of members within ``bits`` bits of each other in a group.

    ``members`` (unsigned) are ordered by group and value, and distinct in a group.
    """
    size = len(members)
    label = np.arange(size)
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    low, high = edge, np.r_[edge[1:], size]
    on = high - low > 1
    # Node pairs: two index ranges and the bits in which their paths differ.
    pairs = np.stack([low[on], high[on], low[on], high[on], np.zeros(on.sum(), np.int64)])
    for depth in range(64):
        n_a, n_b = pairs[1] - pairs[0], pairs[3] - pairs[2]
        few = n_a * n_b <= FEW
        if few.any():
            label = _compare(members, pairs[:, few], label, bits)
            pairs = pairs[:, ~few]
        if not pairs.shape[1]:
            break
        ones = np.r_[0, np.cumsum(members >> np.uint64(63 - depth) & np.uint64(1), dtype=np.int64)]
        a_low, a_high, b_low, b_high, apart = pairs
        a_mid = a_high - (ones[a_high] - ones[a_low])
        b_mid = b_high - (ones[b_high] - ones[b_low])
        same = (a_low == b_low) & (a_high == b_high)
        children = [
            np.stack([a_low, a_mid, b_low, b_mid, apart]),
            np.stack([a_mid, a_high, b_mid, b_high, apart]),
            np.stack([a_low, a_mid, b_mid, b_high, apart + 1]),
            np.stack([a_mid, a_high, b_low, b_mid, apart + 1])[:, ~same],
        ]
        pairs = np.concatenate(children, axis=1)
        alone = (pairs[0] == pairs[2]) & (pairs[1] - pairs[0] < 2)
        pairs = pairs[:, (pairs[4] <= bits) & (pairs[0] < pairs[1]) & (pairs[2] < pairs[3]) & ~alone]
    else:
        label = _compare(members, pairs, label, bits)
    linked = np.flatnonzero(label != np.arange(size))
    return linked, label[linked]


def _compare(members: np.ndarray, pairs: np.ndarray, label: np.ndarray, bits: int) -> np.ndarray:
    """Compare all members of the paired nodes, a bounded number at once."""
    n_b = pairs[3] - pairs[2]
    sizes = (pairs[1] - pairs[0]) * n_b
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        before = ends[begin] - sizes[begin]
        end = max(begin + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
        some = slice(begin, end)
        which = np.repeat(np.arange(begin, end), sizes[some])
        place = np.arange(len(which)) - np.repeat(ends[some] - sizes[some] - before, sizes[some])
        left = pairs[0][which] + place // n_b[which]
        right = pairs[2][which] + place % n_b[which]
        near = (left < right) | (pairs[0][which] != pairs[2][which])
        near &= label[left] != label[right]
        left, right = left[near], right[near]
        near = np.bitwise_count(members[left] ^ members[right]) <= bits
        label = _components(len(members), left[near], right[near], label)
        begin = end
    return label


#: The bits in four parts, as masks.
QUARTERS = tuple(0xFFFF << 16 * i for i in range(4))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _further(either: str, both: str) -> Column:
    """Four masks for a group from the or and the and of its members: the bits in which they
    agree, and a quarter of those in which they differ."""
    bits = F.expr(f"filter(sequence(0, 63), b -> (shiftrightunsigned({either} & ~{both}, b) & 1L) = 1L)")

    def mask(quarter: int) -> Column:
        low = F.floor(F.size(bits) * quarter / 4).cast("int")
        some = F.slice(bits, low + 1, F.floor(F.size(bits) * (quarter + 1) / 4).cast("int") - low)
        own = F.aggregate(some, F.lit(0).cast("long"), lambda m, b: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
        return own.bitwiseOR(F.expr(f"~({either} & ~{both})"))

    return F.array(*map(mask, range(4)))


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: links of spanning forests whose components are those of all links.

    ``distinct`` has the fingerprints (``fp``) without repetition.
    """
    schema = "a long, b long"
    arrow = to_arrow(distinct.sparkSession, schema)

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= HELD:
                out, rest = linked(held, last=False)
                yield out
                held, rows = [rest], rest.num_rows
        if rows:
            yield linked(held, last=True)[0]

    def linked(held, last):
        whole = pa.Table.from_batches(held).combine_chunks()
        mask, value, fp = (whole.column(i).to_numpy() for i in range(3))
        edge = np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]
        # The last group may go on in the next batch.
        done = len(fp) if last else int(np.flatnonzero(edge)[-1])
        members, group = fp[:done].view(np.uint64), np.cumsum(edge[:done])
        order = np.lexsort((members, group))
        members, group = members[order], group[order]
        a, b = trie_links(members, group)
        out = pa.RecordBatch.from_arrays(
            [pa.array(members[a].view(np.int64)), pa.array(members[b].view(np.int64))], schema=arrow
        )
        rest = whole.slice(done).to_batches()
        return out, rest[0] if rest else held[0].slice(0, 0)

    quarters = F.array(*(F.lit(_signed(q)).cast("long") for q in QUARTERS))
    frame = distinct.select(quarters.alias("further"), "fp")
    found = None
    while True:
        # Groups that hold the same members by different ways become one.
        frame = frame.select(F.explode("further").alias("mask"), "fp").distinct()
        frame = frame.withColumn("value", F.col("mask").bitwiseAND(F.col("fp")))
        sizes = (
            frame.groupBy("mask", "value")
            .agg(F.count(F.lit(1)).alias("n"), F.bit_or("fp").alias("either"), F.bit_and("fp").alias("both"))
            .where("n > 1")
        )
        sizes = sizes.select("mask", "value", F.when(F.col("n") > GROUP, _further("either", "both")).alias("further"))
        # Groups of one have no links. One key's rows are split by adaptive execution.
        frame = stored(frame.join(sizes, ["mask", "value"]))
        small = frame.where("further IS NULL").select("mask", "value", "fp")
        part = small.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
        frame = frame.where("further IS NOT NULL")
        if frame.isEmpty():
            return found


def components(found: DataFrame) -> DataFrame:
    """``fp, root``: for every linked fingerprint the smallest of its component.

    Large-star and small-star steps in turn; each round's links are stored, so a lost executor
    costs one round. Minima combine before the shuffle, and a hub's joins can be split.
    """
    now = found.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    before = None
    while True:
        now = stored(now)
        # Equal sets of links have equal counts and equal sums of two hashes.
        mark = now.agg(
            F.count(F.lit(1)),
            F.bit_xor(F.xxhash64("u", "v")),
            F.bit_xor(F.xxhash64("v", "u", F.lit(1))),
        ).first()
        if mark == before or mark[0] == 0:
            return now.select(F.col("u").alias("fp"), F.col("v").alias("root"))
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """``id, keys..., fp, root, component_id``: one row per document. ``root`` is its
    component's smallest fingerprint, ``component_id`` its smallest document id."""
    rows = stored(fingerprints(docs, [id_column, *keys]))
    distinct = rows.groupBy("fp").agg(F.min(id_column).alias("first"))
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # One row per fingerprint from here on: copies have been combined.
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    whole = stored(rooted.select("fp", "root").join(least, "root"))
    return rows.join(whole, "fp").select(id_column, *keys, "fp", "root", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` with the fingerprint as 16 hexadecimal digits."""
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without their near duplicates: of each component the document with the
    smallest id stays (of equal ids, that with the smallest text hash). All columns are kept."""
    (digest,) = free_names(docs, "text")
    docs = docs.withColumn(digest, F.xxhash64(text_column()))
    found = near_duplicates(docs, keys=(digest,))
    # Null ids come last.
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col(digest).alias("t"))
    kept = found.groupBy("root").agg(F.min(order).alias("o")).select("o.id", "o.t")
    same = docs["doc_id"].eqNullSafe(kept["id"]) & (docs[digest] == kept["t"])
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", digest]).drop(digest)
