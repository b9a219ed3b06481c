"""Secret scan: patterns, and a battery of randomness tests, in DataFrame operations only.

Base spans are found by pattern. Besides them, every run of ``LEAST_LENGTH`` or more letters of
an encoding is a candidate. Its encoding is the smallest alphabet that holds it, and three
statistics are taken in that alphabet: the chi-squared distance of its letters from uniform, the
number of runs of one class (lower, upper, digit, other), and the serial correlation of
neighbouring letters.

Each statistic is held against two models. Under the *random* model letters are drawn evenly
from the alphabet; a candidate that any of the three tests rejects (``RANDOM_LIMIT`` standard
deviations) is no secret. Under the *ordinary* model they are drawn as in the corpus's own words
of 8 to 15 such letters: how often letters agree, classes change and neighbours correlate is
counted per alphabet. The three scores against it, none above ``SCORE_LIMIT`` so that no test
decides alone, are summed to one p-value. A longer candidate moves further from the ordinary
model, so lengths are families of their own: in each class of lengths the Benjamini-Hochberg
rule over all distinct candidates holds the share of false finds at ``FALSE_SHARE``. P-values
are rounded up to sixteenths of a bit, so the rule needs counts per step only.

Digits alone (numbers) and letters of one case alone (words) are never candidates' encodings,
or fail the runs test; see the README for what that leaves out.

Rules: a null text is empty and has no spans. Patterns are matched as leftmost, non-overlapping
matches, and failing ones are dropped. A random span inside a base span is not reported again.
Repeated rows repeat their spans and count once among the candidates. An empty table gives no
rows.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import text_column
from panelspark.session import stored

#: Kinds in the order of ties, with their patterns and a cheap sign that one can be there.
ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]+)"
)
KINDS: tuple[tuple[str, str, str], ...] = (
    ("assign", ASSIGN, r"(?i:password|passwd|secret|token|api_?key)"),
    ("access", r"AKIA[A-Z0-9]++", "AKIA"),
    ("hex", r"[0-9a-f]{24,}+", r"[0-9a-f]{24}"),
)
RANDOM = "random"
NAMES = (*(kind for kind, _, _ in KINDS), RANDOM)
#: Least length of the value of an assignment, and of an access key (fixed values).
ASSIGNED, ACCESS = 6, 20
#: Encodings and their alphabets, the smallest first.
_DIGITS, _LOWER, _UPPER = string.digits, string.ascii_lowercase, string.ascii_uppercase
ENCODINGS: dict[str, str] = {
    "hex_lower": _DIGITS + _LOWER[:6],
    "hex_upper": _DIGITS + _UPPER[:6],
    "base32": _UPPER + _DIGITS[2:8],
    "base36_lower": _DIGITS + _LOWER,
    "base36_upper": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64_url": _UPPER + _LOWER + _DIGITS + "-_",
}
LEAST_LENGTH = 16
#: Padding is part of a candidate's span, not of its letters.
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST_LENGTH},}}+={{0,2}}"
#: Words that show what is ordinary; too short to be candidates.
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{8,15}(?![A-Za-z0-9+/_=-])"
#: Classes of lengths: a class reaches to the next one's least length.
LENGTHS = (16, 24, 32, 48, 64, 128)
RANDOM_LIMIT, SCORE_LIMIT = 3.29, 4.0
FALSE_SHARE = 0.05
#: Steps of a bit in which p-values are counted.
STEPS = 16
#: Matches whose places are added up at once.
_BLOCK = 128


def matches(text: Column, pattern: str, sign: str) -> Column:
    """``struct<between, found>``: a pattern's matches and what stands before each, or null
    without the sign. Select it before ``located``, which refers to it many times."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(sign), F.struct(F.split(text, pattern, -1).alias("between"), found.alias("found")))


def located(match: Column) -> Column:
    """``array<struct<start, end, value>>`` of matches, in code points. Sizes are added up per
    block and then within each, since a list that grows by one is copied."""
    found, between = match["found"], match["between"]
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(found) - 1), F.lit(_BLOCK))
    pieces = F.transform(
        at,
        lambda a: F.arrays_zip(
            F.slice(between, a + 1, F.least(F.lit(_BLOCK), F.size(found) - a)).alias("between"),
            F.slice(found, a + 1, F.lit(_BLOCK)).alias("value"),
        ),
    )

    def size(piece: Column) -> Column:
        return F.length(piece["between"]) + F.length(piece["value"])

    def begin(so_far: Column, block: Column) -> Column:
        here = F.struct(so_far["at"].alias("at"), block.alias("block"))
        end = F.aggregate(block, so_far["at"], lambda total, piece: total + size(piece))
        return F.struct(end.alias("at"), F.concat(so_far["out"], F.array(here)).alias("out"))

    def place(so_far: Column, piece: Column) -> Column:
        end = so_far["at"] + size(piece)
        span = F.struct((end - F.length(piece["value"])).alias("start"), end.alias("end"), piece["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(so_far["out"], F.array(span)).alias("out"))

    placed = "array<struct<start:int,end:int,value:string>>"
    no_blocks = F.array().cast("array<struct<at:int,block:array<struct<between:string,value:string>>>>")
    blocks = F.aggregate(
        pieces, F.struct(F.lit(0).alias("at"), no_blocks.alias("out")), begin, lambda s: s["out"]
    )

    def inside(block: Column) -> Column:
        start = F.struct(block["at"].alias("at"), F.array().cast(placed).alias("out"))
        return F.aggregate(block["block"], start, place, lambda s: s["out"])

    return F.when(F.size(found) > 0, F.flatten(F.transform(blocks, inside))).otherwise(F.array().cast(placed))


def _sound(kind: str, value: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(value, ASSIGN, 1)) >= ASSIGNED
    return F.length(value) >= ACCESS if kind == "access" else F.lit(True)


def base_spans() -> Column:
    """All base spans as ``array<struct<start, kind, end>>`` in order, from the matches in the
    columns named by kind; ``kind`` is the place in ``NAMES``, ends are exclusive."""

    def of_kind(number: int, kind: str) -> Column:
        return F.transform(
            F.filter(located(F.col(kind)), lambda s: _sound(kind, s["value"])),
            lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end")),
        )

    return F.sort_array(F.concat(*(of_kind(number, kind) for number, (kind, _, _) in enumerate(KINDS))))


def _class(letter: Column) -> Column:
    return (
        F.when(letter.between("a", "z"), 1)
        .when(letter.between("A", "Z"), 2)
        .when(letter.between("0", "9"), 3)
        .otherwise(4)
    )


def _class_sizes(alphabet: str) -> list[int]:
    groups = (_LOWER, _UPPER, _DIGITS, "+/-_")
    return [sum(letter in group for letter in alphabet) for group in groups]


def ordinary_model(docs: DataFrame) -> DataFrame:
    """One row per encoding: ``pairs``, and from neighbouring letters of the corpus's distinct
    words the chance that two and three drawn letters agree (``s2, s3``), that the class changes
    (``change``), and the serial correlation (``rho``)."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(text_column(), F.lit(ORDINARY), F.lit(0)))).alias("word"))
    pair = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    pairs = words.distinct().select(F.explode(pair).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("c"))
    # At most 66 x 66 pairs from here on.
    known = F.array(
        *(F.struct(F.lit(e).alias("encoding"), F.lit(a).alias("alphabet")) for e, a in ENCODINGS.items())
    )
    # An alphabet of one case sees the words in that case, so that it has some to compare with.
    alphabet = F.col("e.alphabet")
    cased = (
        F.when(~alphabet.contains("a"), F.upper("pair")).when(~alphabet.contains("A"), F.lower("pair")).otherwise(F.col("pair"))
    )
    rows = pairs.select("c", "pair", F.explode(known).alias("e")).select(
        "c", "e.encoding", alphabet.alias("alphabet"), F.substring(cased, 1, 1).alias("a"), F.substring(cased, 2, 1).alias("b")
    )
    rows = rows.select(
        "c",
        "encoding",
        "a",
        F.position("a", "alphabet").cast("double").alias("x"),
        F.position("b", "alphabet").cast("double").alias("y"),
        (_class(F.col("a")) != _class(F.col("b"))).alias("changed"),
        F.length("alphabet").alias("k"),
    )
    rows = rows.where("x > 0 AND y > 0")
    c, x, y = F.col("c"), F.col("x"), F.col("y")
    sums = rows.groupBy("encoding", "k").agg(
        F.sum("c").alias("pairs"),
        F.sum(F.when(F.col("changed"), c).otherwise(0)).alias("changes"),
        *(F.sum(c * v).alias(n) for n, v in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))),
    )
    letters = rows.groupBy("encoding", "a").agg(F.sum("c").alias("m"))
    whole = F.col("pairs") + F.col("k")
    # Every letter of an alphabet counts once more than it was seen, also those never seen.
    own = letters.join(sums, "encoding").groupBy("encoding").agg(
        F.sum(((F.col("m") + 1) / whole) ** 2 - (1 / whole) ** 2).alias("p2"),
        F.sum(((F.col("m") + 1) / whole) ** 3 - (1 / whole) ** 3).alias("p3"),
    )
    n = F.col("pairs")
    spread = (n * F.col("sxx") - F.col("sx") ** 2) * (n * F.col("syy") - F.col("sy") ** 2)
    return sums.join(own, "encoding").select(
        "encoding",
        "pairs",
        (F.col("p2") + F.col("k") / whole**2).alias("s2"),
        (F.col("p3") + F.col("k") / whole**3).alias("s3"),
        ((F.col("changes") + 1) / (n + 2)).alias("change"),
        F.when(spread > 0, (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread)).otherwise(0.0).alias("rho"),
    )


def _models(docs: DataFrame) -> dict[str, dict[str, float]]:
    """The ordinary model of every encoding (eight rows), even where the corpus shows none."""
    seen = {row["encoding"]: row.asDict() for row in ordinary_model(docs).collect()}
    even = lambda k: {"s2": 1 / k, "s3": 1 / k**2, "change": 0.5, "rho": 0.0}
    return {e: seen.get(e, even(len(a))) for e, a in ENCODINGS.items()}


def encoding_of(letters: Column) -> Column:
    """The smallest alphabet that holds all letters; null for numbers, and if there is none."""
    found = F.when(letters.rlike("^[0-9]*$"), F.lit(None))
    for name, alphabet in ENCODINGS.items():
        inside = "".join("\\" + c if c in "+/-_" else c for c in alphabet).replace("\\_", "_").replace("\\/", "/")
        found = found.when(letters.rlike(f"^[{inside}]+$"), name)
    return found


def _statistics(letters: Column, alphabet: Column) -> Column:
    """``squares`` (sum of squared counts), ``changes`` of class, and lag-one ``serial``
    correlation of the letters' places in the alphabet (null for a constant)."""
    chars = F.filter(F.split(letters, ""), lambda c: F.length(c) > 0)
    no = F.lit(0).cast("long")

    def count(so_far: Column, c: Column) -> Column:
        again = so_far["last"] == c
        run = F.when(again, so_far["run"] + 1).otherwise(F.lit(1).cast("long"))
        # One more of r equal letters adds (r + 1)^2 - r^2.
        return F.struct(c.alias("last"), run.alias("run"), (so_far["sum"] + 2 * run - 1).alias("sum"))

    start = F.struct(F.lit("").alias("last"), no.alias("run"), no.alias("sum"))
    squares = F.aggregate(F.sort_array(chars), start, count, lambda s: s["sum"])

    def walk(so_far: Column, c: Column) -> Column:
        x, kind = F.position(c, alphabet).cast("long"), _class(c)
        moved = (so_far["kind"] != 0) & (so_far["kind"] != kind)
        return F.struct(
            kind.alias("kind"),
            x.alias("x"),
            F.when(so_far["kind"] == 0, x).otherwise(so_far["first"]).alias("first"),
            (so_far["changes"] + moved.cast("long")).alias("changes"),
            (so_far["sx"] + x).alias("sx"),
            (so_far["sxx"] + x * x).alias("sxx"),
            (so_far["sxy"] + x * so_far["x"]).alias("sxy"),
        )

    fields = ("x", "first", "changes", "sx", "sxx", "sxy")
    walked = F.aggregate(chars, F.struct(F.lit(0).alias("kind"), *(no.alias(f) for f in fields)), walk)
    n = F.length(letters)
    # Sums of products about the mean, all times n.
    total = n * walked["sxx"] - walked["sx"] * walked["sx"]
    crossed = (
        n * walked["sxy"]
        - walked["sx"] * (2 * walked["sx"] - walked["first"] - walked["x"])
        + (n - 1) * (walked["sx"] * walked["sx"] / n)
    )
    serial = F.when(total > 0, crossed / total)
    return F.struct(squares.alias("squares"), walked["changes"].alias("changes"), serial.alias("serial"))


def _by_encoding(encoding: Column, value) -> Column:
    """A number for each encoding, from ``value(name, alphabet)``."""
    found = F.when(F.lit(False), F.lit(0.0))
    for name, alphabet in ENCODINGS.items():
        found = found.when(encoding == name, F.lit(float(value(name, alphabet))))
    return found


def _scores(c: Column, models: dict[str, dict[str, float]]) -> tuple[Column, Column]:
    """Whether the random model stands, and the summed score against the ordinary one, of a
    candidate ``c`` with ``encoding, n, squares, changes, serial``."""
    of = lambda value: _by_encoding(c["encoding"], value)
    n = c["n"].cast("double")
    k = of(lambda e, a: len(a))
    triples = n * (n - 1) * (n - 2)
    # Agreeing pairs among n letters: chi-squared is 2k/n times them, and a constant.
    agreeing = (c["squares"] - n) / 2

    def agreement(s2: Column, s3: Column) -> tuple[Column, Column]:
        return n * (n - 1) / 2 * s2, n * (n - 1) / 2 * (s2 - s2 * s2) + triples * (s3 - s2 * s2)

    even_mean, even_var = agreement(1 / k, 1 / (k * k))
    here_mean, here_var = agreement(of(lambda e, a: models[e]["s2"]), of(lambda e, a: models[e]["s3"]))
    same = of(lambda e, a: sum(s * s for s in _class_sizes(a)) / len(a) ** 2)
    thrice = of(lambda e, a: sum(s**3 for s in _class_sizes(a)) / len(a) ** 3)
    even_runs = (n - 1) * same * (1 - same) + 2 * (n - 2) * (thrice - same * same)
    change = of(lambda e, a: models[e]["change"])
    rho = of(lambda e, a: models[e]["rho"])
    random_scores = (
        (agreeing - even_mean) / F.sqrt(even_var),
        (c["changes"] - (n - 1) * (1 - same)) / F.sqrt(even_runs),
        (c["serial"] + 1 / n) * F.sqrt(n),
    )
    ordinary_scores = (
        (here_mean - agreeing) / F.sqrt(here_var),
        (c["changes"] - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change)),
        (rho - c["serial"]) * F.sqrt(n / (1 - rho * rho + 1 / n)),
    )
    stands = F.lit(True)
    for score in random_scores:
        stands = stands & (F.abs(score) <= RANDOM_LIMIT)
    limit = F.lit(SCORE_LIMIT)
    total = sum((F.greatest(-limit, F.least(limit, s)) for s in ordinary_scores[1:]), F.greatest(-limit, F.least(limit, ordinary_scores[0])))
    return F.coalesce(stands, F.lit(False)), total / math.sqrt(len(ordinary_scores))


def _bits(score: Column) -> Column:
    """Whole steps of -log2 of the upper normal tail beyond a score, rounded down; 0 below the
    middle. The tail's formula is good to 7.5e-8 of the density (fixed coefficients)."""
    t = 1 / (1 + 0.2316419 * score)
    series = F.lit(1.330274429)
    for coefficient in (-1.821255978, 1.781477937, -0.356563782, 0.319381530):
        series = series * t + coefficient
    tail = F.exp(-score * score / 2) / math.sqrt(2 * math.pi) * series * t
    return F.when(score > 0, F.floor(-F.log2(tail) * STEPS)).otherwise(0).cast("int")


def _length_class(n: Column) -> Column:
    found = F.lit(0)
    for number, least in enumerate(LENGTHS):
        found = F.when(n >= least, number).otherwise(found)
    return found


def _candidates(models: dict[str, dict[str, float]]) -> Column:
    """``array<struct<start, end, family, bits, token>>`` from the matches in ``candidate``."""

    def coded(s: Column) -> Column:
        letters = F.rtrim(s["value"], F.lit("="))
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), letters.alias("letters"), encoding_of(letters).alias("encoding")
        )

    def alphabet(encoding: Column) -> Column:
        found = F.lit("")
        for name, letters in ENCODINGS.items():
            found = F.when(encoding == name, letters).otherwise(found)
        return found

    def tested(s: Column) -> Column:
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["encoding"].alias("encoding"),
            F.length(s["letters"]).alias("n"),
            F.xxhash64(s["letters"]).alias("token"),
            _statistics(s["letters"], alphabet(s["encoding"])).alias("t"),
        )

    def scored(s: Column) -> Column:
        flat = {"encoding": s["encoding"], "n": s["n"], **{f: s["t"][f] for f in ("squares", "changes", "serial")}}
        stands, score = _scores(flat, models)
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            _length_class(s["n"]).alias("family"),
            stands.alias("stands"),
            score.alias("score"),
            s["token"].alias("token"),
        )

    def judged(s: Column) -> Column:
        bits = F.when(s["stands"], _bits(s["score"])).otherwise(0)
        return F.struct(*(s[f].alias(f) for f in ("start", "end", "family")), bits.alias("bits"), s["token"].alias("token"))

    inside = F.filter(F.transform(located(F.col("candidate")), coded), lambda s: s["encoding"].isNotNull())
    return F.transform(F.transform(F.transform(inside, tested), scored), judged)


def found_in(docs: DataFrame) -> DataFrame:
    """``doc_id, base, candidates``, stored."""
    models = _models(docs)
    texts = docs.select("doc_id", text_column().alias("text"))
    text = F.col("text")
    texts = texts.select(
        "doc_id",
        *(matches(text, pattern, sign).alias(kind) for kind, pattern, sign in KINDS),
        matches(text, CANDIDATE, CANDIDATE).alias("candidate"),
    )
    return stored(texts.select("doc_id", base_spans().alias("base"), _candidates(models).alias("candidates")))


def thresholds(found: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """``family, least``: the steps of bits from which a candidate of a class of lengths is a
    find. Counted are distinct candidates; a family has a few hundred steps."""
    seen = found.select(F.explode("candidates").alias("c")).select("c.family", "c.bits", "c.token").distinct()
    steps = seen.groupBy("family", "bits").agg(F.count(F.lit(1)).alias("n"))
    family = Window.partitionBy("family")
    steps = steps.withColumn("all", F.sum("n").over(family))
    steps = steps.withColumn("beyond", F.sum("n").over(family.orderBy(F.desc("bits"))))
    passed = F.pow(F.lit(2.0), -F.col("bits") / STEPS) * F.col("all") <= false_share * F.col("beyond")
    return steps.where(passed).groupBy("family").agg(F.min("bits").alias("least"))


def _listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """Counts and spans of every document; see the module's notes."""
    found = found_in(docs)
    least = {row["family"]: row["least"] for row in thresholds(found, false_share).collect()}
    base = F.col("base")

    def find(c: Column) -> Column:
        enough = F.lit(False)
        for family, bits in sorted(least.items()):
            enough = enough | (c["family"] == family) & (c["bits"] >= bits)
        return enough & ~F.exists(base, lambda s: (s["start"] <= c["start"]) & (c["end"] <= s["end"]))

    extra = F.transform(
        F.filter("candidates", find),
        lambda c: F.struct(c["start"].alias("start"), F.lit(NAMES.index(RANDOM)).alias("kind"), c["end"].alias("end")),
    )
    spans = F.sort_array(F.concat(base, extra))

    def count(number: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")

    return found.select(
        "doc_id",
        *(count(number).alias(f"n_{kind}") for number, kind in enumerate(NAMES[:-1])),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
        count(NAMES.index(RANDOM)).alias(f"n_{RANDOM}"),
    )
