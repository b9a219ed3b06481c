"""Source divergence audit: which sources of a language differ, and by which terms.

Partial counts come from an Arrow compute pipeline inside each task: texts are lowered
(``ascii_lower``), split at what is no term (``split_pattern_regex``), coded
(``dictionary_encode``), and counted by hash ``group_by``, first per document and then per
language, source and term. Partial tables are merged by one shuffle on (language, term), which
also tells in how many documents a term stands. The kept counts are dealt to shards by a hash
of the term; a shard holds its terms for all sources as columns, and adds up its part of every
divergence in whole numbers. A last sum over shards and a ranking finish the job.

A shard holds about ``SHARD_ROWS`` counts at any size of the corpus, and a hot source or term
is already one row per task and flush when it is shuffled.

Rules: null text, language and source are empty strings. Only A-Z are lowered. A term is kept
in a language if it stands in ``LEAST_DOCUMENTS`` of its rows (repeated rows count as rows).
A source without kept terms still has its pairs; a language with one source has none. Without
kept terms all pairs are worth 0. Ties go to the item that is smaller in UTF-8 order. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import spans_of, text_column, to_arrow
from panelspark.session import stored

#: What separates terms (fixed value): all ASCII characters but letters.
BREAK = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS = 3
#: Shares are whole numbers of this part (fixed value), worked out by two steps of long division
#: so that products stay within 64 bits up to 9 x 10^13 occurrences.
UNIT, FIRST_STEP, SECOND_STEP = 10**9, 10**5, 10**4
#: Terms reported for each source.
TOP = 200
#: Bytes of text counted at once, and counts that a task holds before it sends them on.
TEXT_BYTES = 4 << 20
HELD_ROWS = 600_000
#: Counts in a shard, and cells of the table that a shard works on at once.
SHARD_ROWS = 400_000
CELLS = 1 << 20

PARTIAL = "lang string, source string, term string, n long, docs long"
PARTS = "lang string, source string, part string, item string, value long"


def _counted(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.Table:
    """Occurrences and documents of every (language, source, term) of some rows."""
    terms = pc.split_pattern_regex(pc.ascii_lower(texts), BREAK)
    coded = pc.list_flatten(terms).dictionary_encode()
    table = pa.table({"row": pc.list_parent_indices(terms), "code": coded.indices})
    # Breaks at either end of a text leave an empty string there.
    nothing = pc.index(coded.dictionary, "").as_py()
    table = table.filter(pc.not_equal(table["code"], nothing))
    table = table.group_by(["row", "code"]).aggregate([([], "count_all")])
    by_row = pa.table(
        {
            "lang": langs.take(table["row"].combine_chunks()),
            "source": sources.take(table["row"].combine_chunks()),
            "code": table["code"],
            "n": table["count_all"],
        }
    )
    found = by_row.group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    return pa.table(
        {
            "lang": found["lang"],
            "source": found["source"],
            "term": coded.dictionary.take(found["code"].combine_chunks()),
            "n": found["n_sum"],
            "docs": found["count_all"],
        }
    )


def _merged(tables: list[pa.Table], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    whole = pa.concat_tables(tables).group_by(["lang", "source", "term"])
    whole = whole.aggregate([("n", "sum"), ("docs", "sum")])
    yield from whole.rename_columns(schema.names).cast(schema).to_batches(max_chunksize=50_000)


def partial_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` for every task (and flush); not yet merged."""
    schema = to_arrow(docs.sparkSession, PARTIAL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for low, high in spans_of(batch.column(2), TEXT_BYTES):
                part = batch.slice(low, high - low)
                held.append(_counted(*part.columns))
                if sum(t.num_rows for t in held) >= HELD_ROWS:
                    yield from _merged(held, schema)
                    held = []
        if held:
            yield from _merged(held, schema)

    return docs.select(*(text_column(c).alias(c) for c in ("lang", "source", "text"))).mapInArrow(run, PARTIAL)


def kept_counts(docs: DataFrame) -> DataFrame:
    """``lang, term, source, n, head`` of kept terms, stored; ``head`` is 1 in one row of each
    (language, term). The one shuffle serves the merge and the count of documents."""
    counts = partial_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source")
    counts = counts.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    counts = counts.withColumn("spread", F.sum("docs").over(term))
    counts = counts.withColumn("head", F.when(F.row_number().over(term.orderBy("source")) == 1, 1).otherwise(0))
    kept = counts.where(F.col("spread") >= LEAST_DOCUMENTS)
    return stored(kept.select("lang", "term", "source", "n", "head"))


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source, total, lang_total, terms``: one row per group of the table, with the
    occurrences of kept terms in it and in its language, and the language's kept terms."""
    groups = docs.select(text_column("lang").alias("lang"), text_column("source").alias("source")).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("head").alias("heads"))
    lang = Window.partitionBy("lang")
    return groups.join(sums, ["lang", "source"], "left").select(
        "lang",
        "source",
        F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce(F.sum("total").over(lang), F.lit(0)).alias("lang_total"),
        F.coalesce(F.sum("heads").over(lang), F.lit(0)).alias("terms"),
    )


def shares(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """``1 + floor(UNIT * (count + 1) / (total + terms))``, exact."""
    whole = totals + terms
    first, rest = np.divmod((counts + 1) * FIRST_STEP, whole)
    return 1 + first * SECOND_STEP + rest * SECOND_STEP // whole


def _of_language(rows: pa.Table, groups: pa.Table, every_pair: bool) -> Iterator[tuple]:
    """One language's part of a shard: pair sums, and the best terms of each source."""
    sources = groups["source"].combine_chunks()
    size, terms = len(sources), groups["terms"][0].as_py()
    totals = groups["total"].to_numpy()[:, None]
    lang_total = groups["lang_total"].to_numpy()[0]
    names = pc.unique(rows["term"])
    names = names.take(pc.sort_indices(names))
    term = pc.index_in(rows["term"], names).to_numpy()
    order = np.argsort(term, kind="stable")
    term = term[order]
    source = pc.index_in(rows["source"], sources).to_numpy()[order]
    n = rows["n"].to_numpy()[order]
    sums = np.zeros((size, size), np.int64)
    best: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(size)]
    width = max(1, CELLS // size)
    for low in range(0, len(names), width):
        high = min(low + width, len(names))
        a, b = np.searchsorted(term, [low, high])
        counts = np.zeros((size, high - low), np.int64)
        counts[source[a:b], term[a:b] - low] = n[a:b]
        p = shares(counts, totals, terms)
        q = shares(counts.sum(axis=0), lang_total, terms)
        value = (p - q) ** 2 // q
        telling = (counts > 0) & (p > q)
        for one in range(size):
            sums[one] += ((p[one] - p) ** 2 // p).sum(axis=1)
            here = np.flatnonzero(telling[one])
            best[one].append((value[one, here], here + low))
    lang, sources = groups["lang"][0].as_py(), sources.to_pylist()
    for one, source_name in enumerate(sources):
        for other, item in enumerate(sources):
            if one != other and (every_pair or sums[one, other]):
                yield lang, source_name, "pair", item, int(sums[one, other])
        if best[one]:
            values, places = (np.concatenate(c) for c in zip(*best[one]))
            # Places follow the terms' UTF-8 order, so the cut is that of the final ranking.
            top = np.lexsort((places, -values))[:TOP]
            for value, place in zip(values[top].tolist(), places[top].tolist()):
                yield lang, source_name, "term", names[place].as_py(), value


def audit(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``; see the module's notes."""
    spark = docs.sparkSession
    kept = kept_counts(docs)
    groups = stored(group_totals(docs, kept))
    shards = max(1, -(-kept.count() // SHARD_ROWS))
    dealt = kept.select("lang", "term", "source", "n", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).alias("shard"))
    # Every shard needs the totals of all groups, also of those without a term in it.
    known = groups.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    schema = to_arrow(spark, PARTS)

    def compare(rows: pa.Table, known: pa.Table) -> pa.Table:
        first = known.num_rows > 0 and known["shard"][0].as_py() == 0
        out: list[tuple] = []
        for lang in pc.unique(known["lang"]).to_pylist():
            here = rows.filter(pc.equal(rows["lang"], lang))
            groups = known.filter(pc.equal(known["lang"], lang)).combine_chunks()
            if first or here.num_rows:
                out.extend(_of_language(here, groups, first))
        columns = list(zip(*out)) or [[]] * len(schema)
        return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    parts = stored(dealt.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(compare, PARTS))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(ranked)
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # A term lies in one shard. Each task cuts its terms to the top before they are shuffled.
    terms = parts.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", rank).unionByName(terms)


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM documents
), counted AS (
    SELECT r, lang, source, term, count(*) AS n
    FROM (SELECT r, lang, source, unnest(words) AS term FROM docs) GROUP BY ALL
), kept AS (
    SELECT lang, term, sum(n) AS lang_n FROM counted GROUP BY ALL HAVING count(*) >= {LEAST_DOCUMENTS}
), sizes AS (
    SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY ALL
), counts AS (
    SELECT c.lang, c.source, c.term, sum(c.n) AS n FROM counted c SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
    SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c USING (lang, source) GROUP BY ALL
), cells AS (
    SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
        1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 1)::HUGEINT) // (t.total + s.v)::HUGEINT AS p,
        1 + ({UNIT}::HUGEINT * (k.lang_n + 1)::HUGEINT) // (s.lang_total + s.v)::HUGEINT AS q
    FROM totals t JOIN kept k USING (lang) JOIN sizes s USING (lang)
    LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), pair_sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
    SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value
    FROM cells WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
