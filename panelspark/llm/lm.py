"""Language-model scoring with a weighted backoff automaton over words.

Training documents are those whose ``crc32(doc_id) mod 10`` is not 0. The automaton's root
holds the smoothed probability of every token. Each word that has kept successors is a state;
its arcs are the pairs seen at least twice, discounted absolutely and interpolated with the
root, and its failure arc leads to the root with the mass that its arcs leave. A text is read
once from left to right: the state is the last token's, a token follows the state's arc or
falls to the root at the failure arc's weight.

Scale: a task numbers the words of its documents in blocks, so that from then on a block is
one row of token numbers, its word list and the list's training counts. Word counts over all
blocks are joined back to the blocks' word lists. Pairs of all words are counted per block,
keyed by a 64-bit hash and dealt by it into buckets whose number grows with the corpus; a
bucket adds them up and gives each block the counts of its arcs, and each word the mass of its
arcs. A block then meets the counts it needs, and nothing but these, in one task. Nothing that
grows with the corpus is broadcast or collected.

Rules: a null text is empty and has the end token only. A null document id counts as the
empty text for the split. Repeated rows are counted, and scored, as often as they come.
Without training documents the base score is 0 a token, and so is the score.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import text_column, to_arrow
from panelspark.session import relieved, stored

ADD = 0.1
#: Least share of the training tokens that a state needs: none.
SHARE = 0.0
#: Pairs seen less often are no arcs, and each arc's count is discounted by so much.
PAIR_COUNT, DISCOUNT = 2, 0.75
#: Characters of a block, and its documents.
BLOCK_CHARS, BLOCK_DOCS = 10_000_000, 20_000
#: Training tokens for each bucket of pairs.
BUCKET = 1 << 18
#: A word's place in all blocks is its block's number times this, plus its place in the block,
#: and a block's number its partition's times ``BLOCKS``, plus a running number.
WORDS, BLOCKS = 1 << 25, 1 << 10
#: Stands for the end token in word lists; no word holds a space.
END = " "


def held_out():
    """Whether a document is kept from training."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def blocks(docs: DataFrame) -> DataFrame:
    """Stored rows ``block, doc_ids, held, sizes, tokens, words, counts``: the token numbers of
    some documents one after the other (32 bits each, deflated), and how often each of their
    words stands in training documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"block long, doc_ids array<{kind}>, held array<boolean>, sizes array<int>, tokens binary, "
        "words array<string>, counts array<long>"
    )
    arrow = to_arrow(docs.sparkSession, schema)

    def run(batches):
        number = TaskContext.get().partitionId() * BLOCKS
        ids, held, tokens, size, words = [], [], [], 0, _Numbers()

        def closed():
            if len(words) >= WORDS or number % BLOCKS == BLOCKS - 1:
                raise ValueError("a partition or a text too large for the numbering of words")
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            flat = np.concatenate(tokens)
            learnt = np.repeat(~np.array(held, bool), sizes)
            counts = np.bincount(flat[learnt], minlength=len(words))
            row = [number, ids, held, sizes, zlib.compress(flat.tobytes(), 1), [w.decode() for w in words], counts]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, arrow)], schema=arrow)

        for batch in batches:
            for key, out, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = text.encode().lower().split()
                found.append(END.encode())
                tokens.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                ids.append(key)
                held.append(out)
                size += len(text)
                if size >= BLOCK_CHARS or len(ids) >= BLOCK_DOCS:
                    yield closed()
                    number += 1
                    ids, held, tokens, size, words = [], [], [], 0, _Numbers()
        if ids:
            yield closed()

    rows = docs.select("doc_id", held_out().alias("held"), text_column().alias("text"))
    return stored(rows.mapInArrow(run, schema))


def _key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A pair's hash from those of its words."""
    key = (first ^ (first >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + second
    key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return key ^ (key >> np.uint64(31))


def _dealt(block, buckets: int) -> tuple[np.ndarray, ...]:
    """Bucket, hash, first word's hash and number in training documents of a block's pairs, in
    the order in which they are sent and their totals come back."""
    hashes = _hashes(block)
    tokens, state, document = _states(block)
    inside = state >= 0
    local = state[inside] * len(hashes) + tokens[inside]
    learnt = ~_cell(block, "held").to_numpy(zero_copy_only=False).astype(bool)[document[inside]]
    once, back = np.unique(local, return_inverse=True)
    n = np.bincount(back[learnt], minlength=len(once)).astype(np.uint32)
    first = hashes[once // len(hashes)]
    key = _key(first, hashes[once % len(hashes)])
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((first, bucket))
    return bucket[order], key[order], first[order], n[order]


def pairs(some: DataFrame, buckets: int) -> DataFrame:
    """``bucket, block, pairs, firsts, counts``: the pairs of each block by bucket, as hashes,
    with their first words' hashes and their numbers in the block's training documents."""
    schema = "bucket long, block long, pairs binary, firsts binary, counts binary"
    arrow = to_arrow(some.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.slice(row, 1)
                bucket, key, first, n = _dealt(block, buckets)
                which, start = np.unique(bucket, return_index=True)
                parts = list(zip(start, np.r_[start[1:], len(bucket)]))
                number = np.full(len(which), block.column("block")[0].as_py(), np.int64)
                packed = ([x[low:high].tobytes() for low, high in parts] for x in (key, first, n))
                columns = which, number, *packed
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return some.select("block", "held", "sizes", "tokens", "hashes").mapInArrow(run, schema)


def arcs_of(packed: DataFrame) -> DataFrame:
    """``block, bucket, totals, first, mass`` from packed pairs: for every block the counts of
    its pairs in the order in which they came, 0 for those that are no arcs (64 bits each,
    deflated: a block knows the hashes); and in rows without a block, the hashes of first words
    with the mass of their arcs."""
    schema = "block long, bucket long, totals binary, first array<long>, mass array<double>"
    arrow = to_arrow(packed.sparkSession, schema)

    def one_bucket(rows: pa.Table) -> pa.Table:
        found = [rows.column(c).to_pylist() for c in ("pairs", "firsts", "counts")]
        key, first, n = (np.frombuffer(b"".join(f), t) for f, t in zip(found, (np.uint64, np.uint64, np.uint32)))
        ends = np.cumsum([len(f) // 8 for f in found[0]])
        once, where, back = np.unique(key, return_index=True, return_inverse=True)
        total = np.zeros(len(once), np.int64)
        np.add.at(total, back, n.astype(np.int64))
        kept = total >= PAIR_COUNT
        arcs, bucket = np.where(kept, total, 0), rows.column("bucket")[0].as_py()
        words, word = np.unique(first[where[kept]], return_inverse=True)
        mass = np.bincount(word, weights=total[kept] - DISCOUNT, minlength=len(words))
        out = [(None, None, None, words.view(np.int64), mass)]
        for block, low, high in zip(rows.column("block").to_pylist(), np.r_[0, ends[:-1]], ends):
            out.append((block, bucket, zlib.compress(arcs[back[low:high]].tobytes(), 1), None, None))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return packed.groupBy("bucket").applyInArrow(one_bucket, schema)


def _cell(block, name: str) -> pa.Array:
    """The list in a column of a single row."""
    column = block.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten()


def _tokens(block) -> np.ndarray:
    return np.frombuffer(zlib.decompress(block.column("tokens")[0].as_py()), np.int32)


def _hashes(block) -> np.ndarray:
    return _cell(block, "hashes").to_numpy().view(np.uint64)


def _states(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every token: its word's place in the block, that of the word before it (-1, the
    root, if none), and its document's place in the block."""
    sizes = _cell(block, "sizes").to_numpy().astype(np.int64)
    tokens = _tokens(block).astype(np.int64)
    state = np.r_[-1, tokens[:-1]]
    state[np.cumsum(sizes) - sizes] = -1  # a document begins at the root
    return tokens, state, np.repeat(np.arange(len(sizes)), sizes)


def scored(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, logarithms to
    base 10. ``base_score`` is that of single tokens."""
    spark = docs.sparkSession
    some = blocks(docs)
    listed = some.select("block", F.posexplode(F.arrays_zip("words", "counts"))).select(
        (F.col("block") * WORDS + F.col("pos")).alias("place"),
        F.col("col.words").alias("word"),
        F.col("col.counts").alias("n"),
    )
    # Counts have been combined in each block, and combine again before the shuffle.
    counts = stored(listed.where("n > 0").groupBy("word").agg(F.sum("n").alias("total")))
    sums = counts.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, n_words = sums["n"], sums["v"]

    some = some.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    buckets = n_train // BUCKET + 1
    arcs = stored(arcs_of(pairs(some, buckets)))
    relieved(spark, always=True)  # the pairs' shuffle is the largest, and is not read again
    masses = arcs.where("block IS NULL").select(F.explode(F.arrays_zip("first", "mass")).alias("m"))
    masses = masses.groupBy(F.col("m.first").alias("first")).agg(F.sum("m.mass").alias("mass"))

    # A block knows the count of a word that no other block has, and all arcs of its state:
    # only the rest goes back.
    shared = listed.join(counts, "word").where("n <> total").select("place", "total", F.xxhash64("word").alias("first"))
    known = stored(
        shared.join(masses, "first", "left").select(
            F.expr(f"place div {WORDS}").alias("block"),
            (F.col("place") % WORDS).alias("key"),
            "total",
            F.coalesce("mass", F.lit(0.0)).alias("mass"),
        )
    )
    relieved(spark, always=True)  # nor are the shuffles of all blocks' words
    known = known.withColumns({"bucket": F.lit(None).cast("long"), "totals": F.lit(None).cast("binary")})
    nothing = F.lit(None).cast("long")
    known = known.unionByName(
        arcs.where("block IS NOT NULL").select(
            "block", nothing.alias("key"), nothing.alias("total"), F.lit(None).cast("double").alias("mass"), "bucket", "totals"
        )
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double"
    )
    arrow = to_arrow(spark, schema)

    def one_block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        return pa.table(_score(left, right, n_train, n_words, buckets), schema=arrow)

    return (
        some.select("block", "doc_ids", "held", "sizes", "tokens", "counts", "hashes")
        .groupBy("block")
        .cogroup(known.toDF(*known.columns).groupBy("block"))
        .applyInArrow(one_block, schema)
    )


def _score(block: pa.Table, known: pa.Table, n_train: int, n_words: int, buckets: int) -> list[pa.Array]:
    """The result columns of one block. ``known`` has the training counts and the arcs' mass of
    words that other blocks have too, and the arcs that its pairs follow."""
    packed = known.filter(pc.is_valid(known.column("totals"))).sort_by("bucket")
    weight = np.frombuffer(b"".join(map(zlib.decompress, packed.column("totals").to_pylist())), np.int64)
    arc = _dealt(block, buckets)[1]
    if len(arc) != len(weight):
        raise ValueError("a block's pairs and their totals do not match")
    arc, weight = arc[weight > 0], weight[weight > 0]
    order = np.argsort(arc)
    arc, weight = arc[order], weight[order]
    known = known.filter(pc.is_valid(known.column("key")))
    key, total, given = (known.column(c).to_numpy() for c in ("key", "total", "mass"))
    count = _cell(block, "counts").to_numpy().astype(np.float64)
    count[key] = total
    sizes = _cell(block, "sizes").to_numpy().astype(np.int64)
    start = np.cumsum(sizes) - sizes
    tokens, state, _ = _states(block)
    single = ((count + ADD) / (n_train + ADD * (n_words + 1)))[tokens]
    n_known = np.add.reduceat(count[tokens] > 0, start, dtype=np.int64)
    base = np.add.reduceat(np.log10(single), start)
    # Arcs of the states: the pair's place in the sorted list, if it is there.
    hashes = _hashes(block)
    pair = _key(hashes[state], hashes[tokens])
    at = np.searchsorted(arc, pair)
    follows = state >= 0
    follows[follows] = np.r_[arc, np.uint64(0)][at[follows]] == pair[follows]
    follows &= at < len(arc)
    at, first = at[follows], state[follows]
    place = np.zeros(len(arc), np.int64)
    place[at] = first
    mass = np.bincount(place, weights=weight - DISCOUNT, minlength=len(count))
    mass[key] = given
    rest = 1 - mass / np.maximum(count, 1)
    # A token at the root, or past a failure arc of weight ``rest``, has its own probability.
    chance = np.where(state >= 0, rest[state], 1.0) * single
    chance[follows] += (weight[at] - DISCOUNT) / count[first]
    score = np.add.reduceat(np.log10(chance), start)
    out = _cell(block, "doc_ids"), _cell(block, "held")
    train = np.full(len(sizes), n_train, np.int64)
    return [*out, *map(pa.array, (sizes, n_known, train, base, score))]
