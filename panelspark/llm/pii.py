"""Information-theoretic sanitisation, in DataFrame operations only.

Base spans are personal data found by pattern: addresses, card and phone numbers. Their
values are the protected entities. What stands around them can give them away, so the corpus
is asked how strongly each term does: with c(t) occurrences of a term, of which n(t, e) are in
a window around entity e, IC(e) - PMI(t; e) = -log2(n(t, e) / c(t)) bits about the entity
remain unknown to a reader of the term. Terms that leave at most ``REMOVE_BITS`` are removed
and those that leave at most ``GENERALISE_BITS`` generalised, near the entity.

With ``whole``, as the query and the pipeline ask for, the window is the whole document: all
words of a text with base spans are judged, and changed wherever they stand in it. Every pair of
an entity and a term is judged, however few contexts it has. n(t, e) and c(t) count documents,
with copies of a text with base spans as one, and c(t) is smoothed by ``SMOOTH`` unseen ones.
Entities that stand in the same texts are judged once. Without ``whole`` a term counts only
with ``SUPPORT`` different windows, and by its unsmoothed counts.

Patterns run over whole texts. They are the plain ones with possessive repeats and with starts
only where a run begins, which finds the same leftmost matches in linear time.

Rules: a null text is empty: no spans. Entities are equal if their kind and their lower-cased
letters, digits and dots are. Repeated rows are repeated observations of one window. A text
without base spans is never changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import free_names, text_column
from panelspark.session import stored

#: Kinds in the order of ties, with their patterns and a cheap sign that one can be there.
KINDS: tuple[tuple[str, str, str], ...] = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    ("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+", r"[0-9][ -]?[0-9]"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
)
REMOVED, GENERALISED = "term_removed", "term_generalised"
NAMES = (*(kind for kind, _, _ in KINDS), REMOVED, GENERALISED)
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Code points on either side of a span that make up its window.
WINDOW = 64
WORD = r"\p{L}[\p{L}\p{M}\p{N}]*+"
#: Shorter words are no terms.
TERM_LETTERS = 3
SUPPORT = 3
#: Documents elsewhere that a term is taken to stand in besides those of the corpus.
SMOOTH = 1.0
#: Words whose places are added up at once.
_STEP = 128
REMOVE_BITS, GENERALISE_BITS = 0.5, 2.0


def _placed(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, value>>`` of a pattern's matches: what stands between them
    gives their places."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(so_far: Column, pair: Column) -> Column:
        start = so_far["at"] + F.length(pair["between"])
        end = start + F.length(pair["found"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["found"].alias("value"))
        return F.struct(end.alias("at"), F.concat(so_far["out"], F.array(span)).alias("out"))

    pairs = F.arrays_zip(
        F.slice(between, F.lit(1), F.size(found)).alias("between"), found.alias("found")
    )
    nothing = F.struct(F.lit(0).alias("at"), _none("start int, end int, value string").alias("out"))
    return F.aggregate(pairs, nothing, step, lambda s: s["out"])


def _none(fields: str) -> Column:
    return F.array().cast(f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>>")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(place: Column) -> Column:
        d = F.substring(digits, F.length(digits) - place, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(place % 2 == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    places = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), worth)
    return F.aggregate(places, F.lit(0), lambda a, b: a + b) % 10 == 0


def _sound(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    count = F.length(_digits(value))
    if kind == "card":
        return F.when(count.between(14, 19), _luhn(_digits(value))).otherwise(False)
    return count.between(10, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans as ``array<struct<start, kind, end, value>>`` in order; ``kind`` is the
    place in ``NAMES``, places are code points, and ends are exclusive."""

    def of_kind(number: int, kind: str, pattern: str, sign: str) -> Column:
        spans = F.transform(
            F.filter(_placed(text, pattern), lambda s: _sound(kind, s["value"])),
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), s["value"].alias("value")
            ),
        )
        possible = F.contains(text, F.lit(sign)) if sign == "@" else text.rlike(sign)
        return F.when(possible, spans).otherwise(_none("start int, kind int, end int, value string"))

    return F.sort_array(F.concat(*(of_kind(number, *kind) for number, kind in enumerate(KINDS))))


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], F.regexp_replace(F.lower(span["value"]), "[^a-z0-9.@]", ""))


def _window_words(text: Column, spans: Column) -> Column:
    """For every span its entity, a hash of its window, and the window's words with places.
    A window ends at the spans beside it, and a word cut by its edge is none of its words."""

    def words_of(passage: Column, start: Column, size: Column, cut_left: Column, cut_right: Column) -> Column:
        def whole(word: Column) -> Column:
            cut = cut_left & (word["start"] == 0) | cut_right & (word["end"] == size)
            return (word["end"] - word["start"] >= TERM_LETTERS) & ~cut

        return F.transform(
            F.filter(_placed(passage, WORD), whole),
            lambda w: F.struct(
                F.lower(w["value"]).alias("term"), (w["start"] + start).alias("start"), (w["end"] + start).alias("end")
            ),
        )

    def one(span: Column, at: Column) -> Column:
        before = F.when(at > 0, F.get(spans, at - 1)["end"]).otherwise(0)
        after = F.coalesce(F.get(spans, at + 1)["start"], F.length(text))
        left = F.greatest(before, span["start"] - WINDOW)
        right = F.least(after, span["end"] + WINDOW)
        sizes = F.greatest(F.lit(0), span["start"] - left), F.greatest(F.lit(0), right - span["end"])
        passages = F.substring(text, left + 1, sizes[0]), F.substring(text, span["end"] + 1, sizes[1])
        words = (
            words_of(passages[0], left, sizes[0], left > before, F.lit(False)),
            words_of(passages[1], span["end"], sizes[1], F.lit(False), right < after),
        )
        return F.struct(
            _entity(span).alias("entity"), F.xxhash64(*passages).alias("window"), F.concat(*words).alias("words")
        )

    return F.transform(spans, one)


def found_in(docs: DataFrame) -> DataFrame:
    """``doc_id, base, key, windows``, stored. ``key`` (a digest of the text) and ``windows``
    are null without base spans."""
    spanned = docs.select("doc_id", text_column().alias("text")).withColumn("base", base_spans(F.col("text")))
    some = F.size("base") > 0
    return stored(
        spanned.select(
            "doc_id",
            "base",
            F.when(some, F.sha2("text", 256)).alias("key"),
            F.when(some, _window_words(F.col("text"), F.col("base"))).alias("windows"),
        )
    )


def _counts(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``term, total`` over the whole corpus, of occurrences or of documents (``whole``); counts
    combine before the shuffle."""
    words = F.regexp_extract_all(F.lower(text_column()), F.lit(WORD), F.lit(0))
    words = docs.select(F.explode(F.array_distinct(words) if whole else words).alias("term"))
    return words.where(F.length("term") >= TERM_LETTERS).groupBy("term").agg(F.count(F.lit(1)).alias("total"))


def _kind(bits: Column) -> Column:
    return F.when(bits <= REMOVE_BITS, NAMES.index(REMOVED)).otherwise(NAMES.index(GENERALISED))


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``key, terms``: for texts with any, the spans of terms that disclose an entity near
    them, as ``array<struct<start, kind, end>>``."""
    near = found.where("key IS NOT NULL").select("key", F.explode("windows").alias("w"))
    near = near.select("key", "w.entity", "w.window", F.explode("w.words").alias("word"))
    near = near.select("key", "entity", "window", "word.term", "word.start", "word.end")
    # Copies combine before each shuffle: first equal windows, then a term's windows.
    seen = (
        near.groupBy("entity", "term", "window")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("entity", "term")
        .agg(F.sum("n").alias("together"), F.count(F.lit(1)).alias("support"))
        .where(F.col("support") >= SUPPORT)
    )
    unknown = -F.log2(F.least(F.lit(1.0), F.col("together") / F.col("total")))
    told = (
        seen.join(_counts(docs), "term")
        .select("entity", "term", unknown.alias("bits"))
        .where(F.col("bits") <= GENERALISE_BITS)
    )
    spans = near.select("key", "entity", "term", "start", "end").distinct().join(told, ["entity", "term"])
    return (
        spans.groupBy("key", "start", "end")
        .agg(F.min(_kind(F.col("bits"))).alias("kind"))
        .groupBy("key")
        .agg(F.collect_list(F.struct("start", "kind", "end")).alias("terms"))
    )


def whole_found_in(docs: DataFrame) -> DataFrame:
    """``doc_id, base, key, entities, gaps, words``, stored: as ``found_in``, but with the
    text's entities, all its words outside base spans, and the code points before each word
    since the one before it."""
    spanned = docs.select("doc_id", text_column().alias("text")).withColumn("base", base_spans(F.col("text")))
    some = F.size("base") > 0
    spanned = spanned.withColumn("blank", F.when(some, _blanked(F.col("text"), F.col("base"))))
    return stored(
        spanned.select(
            "doc_id",
            "base",
            F.when(some, F.sha2("text", 256)).alias("key"),
            F.when(some, F.array_distinct(F.transform("base", _entity))).alias("entities"),
            F.transform(F.split("blank", WORD, -1), F.length).alias("gaps"),
            F.regexp_extract_all("blank", F.lit(WORD), F.lit(0)).alias("words"),
        )
    )


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of spans."""

    def step(so_far: Column, span: Column) -> Column:
        kept = F.substring(text, so_far["at"] + 1, F.greatest(F.lit(0), span["start"] - so_far["at"]))
        size = F.greatest(F.lit(0), span["end"] - F.greatest(so_far["at"], span["start"]))
        return F.struct(
            F.greatest(so_far["at"], span["end"]).alias("at"),
            F.concat(so_far["out"], kept, F.repeat(F.lit(" "), size)).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text) - s["at"]))
    )


def _placed_words(texts: DataFrame) -> DataFrame:
    """``key, copies, term, start, end`` of all words long enough. Sizes are added up in steps of
    ``_STEP`` words, and then within each, since a list that grows word by word is copied."""
    sizes = F.transform("words", lambda word, at: F.get(F.col("gaps"), at) + F.length(word))
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 1), F.lit(_STEP))
    steps = F.transform(
        at,
        lambda a: F.struct(
            F.slice("sizes", a + 1, F.lit(_STEP)).alias("sizes"), F.slice("words", a + 1, F.lit(_STEP)).alias("words")
        ),
    )
    add = lambda a, b: a + b

    def begin(so_far: Column, step: Column) -> Column:
        here = F.struct(so_far["at"].alias("at"), step["sizes"].alias("sizes"), step["words"].alias("words"))
        return F.struct(
            F.aggregate(step["sizes"], so_far["at"], add).alias("at"), F.concat(so_far["out"], F.array(here)).alias("out")
        )

    nothing = F.struct(F.lit(0).alias("at"), _none("at int, sizes array<int>, words array<string>").alias("out"))
    parts = (
        texts.where(F.size("words") > 0)
        .withColumn("sizes", sizes)
        .withColumn("steps", steps)
        .select("key", "copies", F.explode(F.aggregate("steps", nothing, begin, lambda s: s["out"])).alias("part"))
    )

    def placed(so_far: Column, pair: Column) -> Column:
        end = so_far["at"] + pair["sizes"]
        word = F.struct(
            F.lower(pair["words"]).alias("term"), (end - F.length(pair["words"])).alias("start"), end.alias("end")
        )
        return F.struct(end.alias("at"), F.concat(so_far["out"], F.array(word)).alias("out"))

    start = F.struct(F.col("part.at").alias("at"), _none("term string, start int, end int").alias("out"))
    words = F.aggregate(F.arrays_zip("part.sizes", "part.words"), start, placed, lambda s: s["out"])
    out = parts.select("key", "copies", F.explode(words).alias("word")).select("key", "copies", "word.*")
    return out.where(F.col("end") - F.col("start") >= TERM_LETTERS)


def whole_disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``key, terms`` as from ``disclosing_terms``: all words of a text that disclose one of its
    entities, by the texts that they stand in."""
    copies = found.where("key IS NOT NULL").groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("entities", "gaps", "words"))
    )
    texts = stored(copies)
    words = _placed_words(texts)
    occurring = words.select("key", "term", "copies").distinct()
    # Only terms can pass of which enough texts have any entity.
    inside = occurring.groupBy("term").agg(F.count(F.lit(1)).alias("most"), F.sum(F.expr("copies - 1")).alias("repeated"))
    judged = (
        inside.join(_counts(docs, whole=True), "term")
        .select("term", "most", (F.col("total") - F.col("repeated") + SMOOTH).alias("total"))
        .where(_unknown("most") <= GENERALISE_BITS)
    )
    terms = stored(occurring.join(judged, "term").select("key", "term", "total"))
    # Entities that stand in the same texts are one group: their count and two fingerprints.
    entities = texts.select("key", F.explode("entities").alias("entity"))
    groups = entities.groupBy("entity").agg(
        F.concat_ws(
            ":", F.count(F.lit(1)), F.bit_xor(F.xxhash64("key")), F.bit_xor(F.xxhash64(F.lit(1), F.col("key")))
        ).alias("group")
    )
    members = entities.join(groups, "entity").select("key", "group").distinct()
    pairs = stored(members.join(terms, "key"))
    told = pairs.groupBy("group", "term").agg(F.count(F.lit(1)).alias("together"), F.first("total").alias("total"))
    told = told.select("group", "term", _unknown("together").alias("bits")).where(F.col("bits") <= GENERALISE_BITS)
    telling = pairs.select("group", "key", "term").join(told, ["group", "term"])
    telling = telling.groupBy("key", "term").agg(F.min(_kind(F.col("bits"))).alias("kind"))
    return (
        words.join(telling, ["key", "term"])
        .groupBy("key")
        .agg(F.collect_list(F.struct("start", "kind", "end")).alias("terms"))
    )


def _unknown(together: str) -> Column:
    return -F.log2(F.least(F.lit(1.0), F.col(together) / F.col("total")))


def _with_terms(found: DataFrame, terms: DataFrame) -> DataFrame:
    """``found`` with ``spans``: base spans and terms in order."""
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    # Texts without spans stay out of the join: null keys would gather in one task.
    clean = found.where("key IS NULL").withColumn("spans", base)
    marked = found.where("key IS NOT NULL").join(terms, "key", "left")
    marked = marked.withColumn("spans", F.sort_array(F.concat(base, F.coalesce("terms", _none("start int, kind int, end int")))))
    return clean.unionByName(marked.drop("terms"))


def _listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def _found(docs: DataFrame, whole: bool) -> tuple[DataFrame, DataFrame]:
    """What was found in the documents, and the disclosing terms of their texts."""
    found = whole_found_in(docs) if whole else found_in(docs)
    return found, whole_disclosing_terms(docs, found) if whole else disclosing_terms(docs, found)


def report(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Counts and spans of every document; see the module's notes for terms."""
    found, terms = _found(docs, whole)
    spanned = _with_terms(found.select("doc_id", "base", "key"), terms)

    def count(*numbers: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"].isin(*numbers))).cast("long")

    return spanned.select(
        "doc_id",
        *(count(number).alias(f"n_{kind}") for number, (kind, _, _) in enumerate(KINDS)),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        count(NAMES.index(REMOVED), NAMES.index(GENERALISED)).alias("n_term"),
    )


def _masked(text: Column, spans: Column) -> Column:
    """The text with spans replaced by their kind's name, and removed terms by nothing. Of
    overlapping spans the first names the mask, which covers them all."""
    masks = F.array(*(F.lit("" if name == REMOVED else "[WORD]" if name == GENERALISED else f"[{name.upper()}]") for name in NAMES))

    def step(so_far: Column, span: Column) -> Column:
        fresh = span["start"] >= so_far["at"]
        kept = F.substring(text, so_far["at"] + 1, span["start"] - so_far["at"])
        out = F.when(fresh, F.concat(so_far["out"], kept, F.get(masks, span["kind"]))).otherwise(so_far["out"])
        return F.struct(F.greatest(so_far["at"], span["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text) - s["at"]))
    )


def sanitised(docs: DataFrame, whole: bool = False) -> DataFrame:
    """The documents with base spans masked and disclosing terms removed or generalised. Texts
    without base spans, and all other columns, are as they were (``n_chars`` follows)."""
    # The documents may have columns of any name.
    base, key, of, terms, spans = free_names(docs, "base", "key", "of", "terms", "spans")
    told = _found(docs, whole)[1].select(F.col("key").alias(of), F.col("terms").alias(terms))
    names = docs.columns
    text = text_column()
    marked = docs.withColumn(base, base_spans(text))
    marked = marked.withColumn(key, F.when(F.size(base) > 0, F.sha2(text, 256)))
    clean = marked.where(F.col(key).isNull()).select(names)
    plain = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    every = F.sort_array(F.concat(plain, F.coalesce(terms, _none("start int, kind int, end int"))))
    changed = (
        marked.where(F.col(key).isNotNull())
        .join(told, F.col(key) == F.col(of), "left")
        .withColumn(spans, every)
        .withColumn("text", _masked(F.col("text"), F.col(spans)))
    )
    if "n_chars" in names:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.unionByName(changed.select(names))
