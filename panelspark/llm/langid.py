"""Language identification in two levels with one-versus-one linear support vector machines.

A first level separates language families, a second one the languages of the predicted
family; each level votes over one machine for each pair of its classes. Features are square
roots of hashed counts of two and three neighbouring bytes of the lower-cased text, with runs
of ASCII characters that are no letters as one space, scaled to length one.

The machines are trained on a bounded sample of the labelled documents whose
``crc32(doc_id) mod 4`` is not 2: at most ``per_language`` documents of a language, those of
smallest hash, each with its whole text. Only their feature vectors (``DIMENSIONS`` numbers
each) reach the driver. Prediction reads the text alone.

Rules: ``und`` with score 0 if the text is null or has no letter, or if there is nothing to
learn from. With a single language every text with a letter gets it. Ties go to the language
first in order. A null document id counts as the empty text for the split. Repeated rows get
equal predictions.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from panelspark.llm.common import batched, free_names, text_column, to_arrow

#: Bits of a feature's number, and the features.
BITS = 12
DIMENSIONS = 1 << BITS
#: The bound of the training sample: documents of one language.
PER_LANGUAGE = 800
UNKNOWN = "und"
#: Families of some languages (fixed values); any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
_LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that are no letters become spaces.
_TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Bytes of a text handled at once.
_STEP = 1 << 20


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), language)


def held_out():
    """Whether a document is kept from training."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def vector(text: str) -> np.ndarray:
    """The features of a whole text."""
    data = text.lower().encode().translate(_TABLE)
    counts = np.zeros(DIMENSIONS, np.int64)
    for start in range(0, len(data), _STEP):
        codes = np.frombuffer(data[max(0, start - 2) : start + _STEP], np.uint8).astype(np.uint32)
        if len(codes) < 3:
            codes = np.r_[codes, np.full(3 - len(codes), 32, np.uint32)]
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        inside = ((a != 32) | (b != 32)) & ((b != 32) | (c != 32))
        a, b, c = a[inside], b[inside], c[inside]
        two = (b * np.uint32(40503) + c) * np.uint32(2654435761)
        three = two + a * np.uint32(2246822519) + np.uint32(374761393)
        three ^= three >> np.uint32(15)
        counts += np.bincount(three * np.uint32(2654435761) >> np.uint32(32 - BITS), minlength=DIMENSIONS)
        counts += np.bincount(two >> np.uint32(32 - BITS), minlength=DIMENSIONS)
    out = np.sqrt(counts).astype(np.float32)
    return out / max(float(np.linalg.norm(out)), 1e-9)


def separate(rows: np.ndarray, left: np.ndarray, right: np.ndarray, cost: float = 10.0, rounds: int = 12) -> np.ndarray:
    """A linear machine that is positive on the rows numbered ``left`` and negative on those
    numbered ``right``; weights, the last of them for the column of ones.

    Dual coordinate descent for the squared hinge loss, rows in a fixed shuffled order; each
    side weighs the same in all. The matrix is read in place, whatever pairs share it.
    """
    chosen = np.r_[left, right]
    sign = np.r_[np.ones(len(left)), -np.ones(len(right))]
    share = np.where(sign > 0, len(chosen) / (2 * len(left)), len(chosen) / (2 * len(right)))
    diagonal = 1 / (2 * cost * share)
    square = np.einsum("ij,ij->i", rows, rows)[chosen] + diagonal
    weights, alpha = np.zeros(rows.shape[1], np.float32), np.zeros(len(chosen))
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(chosen)):
            row = rows[chosen[i]]
            step = (sign[i] * (row @ weights) - 1 + diagonal[i] * alpha[i]) / square[i]
            new = max(0.0, alpha[i] - step)
            if new != alpha[i]:
                weights += np.float32((new - alpha[i]) * sign[i]) * row
                alpha[i] = new
    return weights


class Level:
    """One-versus-one machines over some classes, given as numbers of rows of a matrix."""

    def __init__(self, rows: np.ndarray, classes: dict[str, np.ndarray]):
        self.names = sorted(classes)
        self.pairs = list(itertools.combinations(range(len(self.names)), 2))
        found = [separate(rows, classes[self.names[a]], classes[self.names[b]]) for a, b in self.pairs]
        self.weights = np.array(found).reshape(len(found), DIMENSIONS + 1).astype(np.float32)

    def predict(self, features: np.ndarray) -> tuple[str, float]:
        """The class with most votes, and the chance given to it by its closest rival."""
        if not self.pairs:
            return self.names[0], 1.0
        margins = self.weights[:, :-1] @ features + self.weights[:, -1]
        chances = 1 / (1 + np.exp(-np.clip(3 * margins, -50, 50)))
        votes = np.zeros(len(self.names))
        closest = np.ones(len(self.names))
        for (a, b), chance in zip(self.pairs, chances):
            votes[a if chance >= 0.5 else b] += 1
            closest[a] = min(closest[a], chance)
            closest[b] = min(closest[b], 1 - chance)
        best = int(np.lexsort((np.arange(len(votes)), -closest, -votes))[0])
        return self.names[best], float(closest[best])


class Model:
    """Both levels, trained one pair after the other on one matrix."""

    def __init__(self, samples: dict[str, Sequence[np.ndarray]]):
        sizes = [len(samples[language]) for language in sorted(samples)]
        rows = np.ones((sum(sizes), DIMENSIONS + 1), np.float32)
        families: dict[str, dict[str, np.ndarray]] = {}
        start = 0
        for language, size in zip(sorted(samples), sizes):
            for place, features in enumerate(samples[language], start):
                rows[place, :-1] = features
            families.setdefault(family_of(language), {})[language] = np.arange(start, start + size)
            start += size
        self.families = Level(rows, {f: np.concatenate(list(m.values())) for f, m in families.items()})
        self.languages = {f: Level(rows, m) for f, m in families.items()}

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not _LETTER.search(text) or not self.languages:
            return UNKNOWN, 0.0
        features = vector(text)
        family, sure = self.families.predict(features)
        language, within = self.languages[family].predict(features)
        return language, sure * within


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The bounded training sample: ``lang, text``."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    order = F.xxhash64(F.col("doc_id").cast("string"), "text")
    # A share of each language by hash, somewhat above the bound; the exact bound follows.
    share = F.lit(0)
    for language, count in counts.items():
        enough = int(min(1.0, (per_language + 8 * per_language**0.5) / count) * (1 << 30))
        share = F.when(F.col("lang") == language, F.lit(enough)).otherwise(share)
    some = known.select("lang", "text", order.alias("__order")).where(
        F.pmod(F.col("__order"), F.lit(1 << 30)) < share
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy("__order", "text"))
    return some.withColumn("__place", place).where(F.col("__place") <= per_language).select("lang", "text")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    schema = "lang string, features binary"
    arrow = to_arrow(docs.sparkSession, schema)

    def run(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            found = ((lang, vector(text).tobytes()) for lang, text in rows if _LETTER.search(text))
            yield from batched(found, arrow, size=256)

    rows = sample(docs, per_language).mapInArrow(run, schema).toArrow().sort_by([("lang", "ascending"), ("features", "ascending")])
    samples: dict[str, list[np.ndarray]] = {}
    for language, features in zip(rows["lang"].to_pylist(), rows["features"].to_pylist()):
        samples.setdefault(language, []).append(np.frombuffer(features, np.float32))
    return Model(samples)


def predict(docs: DataFrame, model: Model, language: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score, in two added columns."""
    schema = StructType([*docs.schema, StructField(language, StringType()), StructField(score, DoubleType())])
    added = [pa.string(), pa.float64()]
    names = schema.fieldNames()
    text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            found = list(zip(*map(model.predict, batch.column(text).to_pylist()))) or [(), ()]
            columns = [*batch.columns, *(pa.array(list(f), type=t) for f, t in zip(found, added))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, minimum: float = 0.0) -> DataFrame:
    """The documents whose language could be told, with the columns they had. Rejected are
    texts without a letter and, if asked, those whose score is below a minimum. A null
    language is filled with the predicted one."""
    told, score = free_names(docs, "lang", "score")
    found = predict(docs, train(docs), told, score)
    kept = found.where((F.col(told) != UNKNOWN) & (F.col(score) >= minimum))
    return kept.withColumn("lang", F.coalesce("lang", told)).select(*docs.columns)
