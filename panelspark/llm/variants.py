"""Spelling variants: words one edit apart, grouped under their most frequent form.

Words are compared inside blocks. If two words differ by one edit, and the shorter has m
letters, then either their first m // 2 letters agree or their last m // 2 do. So a word of
length L goes to the blocks of its ends for m = L and for m = L - 1, without the letters that
all words of the block share. The rest of two words of a block is again one edit apart, so a
block beyond ``BLOCK_WORDS`` words is split by the halves of that rest, and so on; a block
whose rest is one letter has a few thousand words at most. Every pair that is one edit apart
is met, and no block grows with the corpus.

Inside a block a bit-sliced position index has one bit set per (position, letter), with a bit
for every word of the block. A word is run along the index: one set holds the words that agree
so far, one those with one replaced letter, and one those with one more letter, whose positions
are shifted by one. Each letter moves all words of the block at once. Pairs that agree at both
ends would be met twice; they count where the first ends agree.

Roots follow the forms. The count grows tenfold with every step, so chains are short, and
following the form of the form halves them.

Rules: a null text has no words; a null ``doc_id`` is an empty string in the checksum. Words
of fewer than ``LEAST_LETTERS`` letters, and those met once, are no words. Of near words with
equal counts the first in code-point order is the form. Repeated rows count as they are. An
empty table gives no rows.
"""

from __future__ import annotations

import functools
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import batched, text_column, to_arrow
from panelspark.session import stored

LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A form is at least so many times as frequent.
TIMES = 10
#: One of so many runs loses a letter (fixed value).
CHANGED = 31
#: Runs that can give a word: shorter ones cannot (fixed character ranges).
RUN = f"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}"
#: Words that are compared in one go.
BLOCK_WORDS = 16_384
NEAR = "word string, n_near long, near_n long, near string"


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of the corpus; counts combine before the shuffle."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(key.alias("id"), F.explode(F.regexp_extract_all(text_column(), F.lit(RUN), F.lit(0))).alias("run"))
    run = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    runs = runs.select(run.alias("run"), F.crc32(F.concat("id", F.lit(":"), run).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % CHANGED == 0, cut).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS)
    return counts.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _ends(key: Column, core: Column, shortest: Column, left: Column, tests: Column) -> Column:
    """The two blocks of a core in which the shortest has ``shortest`` letters: by its first and
    by its last half. ``left`` letters were cut off before the core; ``tests`` lists the starts
    (``place:size``) that must differ lest the pair is met elsewhere."""
    half = F.floor(shortest / 2).cast("int")
    rest = F.length(core) - half
    first, last = F.substring(core, F.lit(1), half), F.substring(core, rest + 1, half)

    def block(side: str, shared: Column, core: Column, left: Column, tests: Column) -> Column:
        return F.struct(
            F.concat(key, F.lit(side), shared).alias("key"),
            core.alias("core"),
            (shortest - half).cast("int").alias("shortest"),
            left.cast("int").alias("left"),
            tests.alias("tests"),
        )

    met = F.concat(tests, F.concat_ws(":", left, half), F.lit(" "))
    return F.array(
        block("<", first, F.substring(core, half + 1, rest), left + half, tests),
        block(">", last, F.substring(core, F.lit(1), rest), left, met),
    )


def blocks(words: DataFrame) -> DataFrame:
    """``word, n, key, core, shortest, left, tests``: every word in its four blocks."""
    size = F.length("word")
    nothing, zero = F.lit(""), F.lit(0)
    of = [
        _ends(F.concat(m.cast("string"), F.lit(":")), F.col("word"), m, zero, nothing)
        for m in (size, size - 1)
    ]
    # The shortest words are nobody's longer mate.
    own = F.when(size > LEAST_LETTERS, F.concat(*of)).otherwise(of[0])
    return words.select("word", "n", F.explode(own).alias("b")).select("word", "n", "b.*")


def _split(rows: DataFrame) -> DataFrame:
    """Blocks split by the halves of their cores."""
    b = F.explode(_ends(*(F.col(c) for c in ("key", "core", "shortest", "left", "tests")))).alias("b")
    return rows.select("word", "n", b).select("word", "n", "b.*")


def bounded_blocks(words: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """The blocks of all words, split until none that can be split exceeds ``most`` words."""
    done, level = [], blocks(words)
    while True:
        big = level.where("shortest > 1").groupBy("key").agg(F.count(F.lit(1)).alias("size"))
        big = stored(big.where(F.col("size") > most).select("key"))
        if big.isEmpty():
            done.append(level)
            return functools.reduce(DataFrame.unionByName, done)
        done.append(level.join(big, "key", "left_anti"))
        level = stored(_split(level.join(big, "key", "left_semi")))


def near_in_block(block: list[tuple[str, int, str]], shortest: int, tests: list[tuple[int, int]]) -> Iterator[tuple]:
    """``(word, near words, count of the best, best)`` for the words of a block that have any;
    ``block`` has ``(word, n, core)``, with cores of ``shortest`` letters or one more."""
    index: dict[tuple[int, str], int] = {}
    short = long = 0
    for number, (_, _, core) in enumerate(block):
        bit = 1 << number
        for place, letter in enumerate(core):
            index[place, letter] = index.get((place, letter), 0) | bit
        if len(core) == shortest:
            short |= bit
        else:
            long |= bit
    if not short or len(block) < 2:
        return
    every = short | long
    found: dict[int, tuple[int, int, str]] = {}

    def add(number: int, other: int) -> None:
        count, key = found.get(number, (0, (0, "")))
        word, n, _ = block[other]
        found[number] = count + 1, min(key, (-n, word)) if count else (-n, word)

    for number, (word, _, core) in enumerate(block):
        if len(core) != shortest:
            continue
        same, replaced, longer = every, 0, every
        for place, letter in enumerate(core):
            here, shifted = index.get((place, letter), 0), index.get((place + 1, letter), 0)
            replaced = replaced & here | same & ~here
            same &= here
            longer = longer & shifted | same
        replaced &= short
        longer &= long
        met = replaced | longer
        while met:
            lowest = met & -met
            met ^= lowest
            other = lowest.bit_length() - 1
            mate = block[other][0]
            if any(word[a : a + size] == mate[a : a + size] for a, size in tests):
                continue
            add(number, other)
            # A word as long is run itself and finds this one then.
            if lowest & longer:
                add(other, number)
    for number, (count, (less, mate)) in found.items():
        yield block[number][0], count, -less, mate


def near_words(rows: DataFrame) -> DataFrame:
    """``word, n_near, near_n, near``: what each block knows of its words. Blocks stream by in
    order of their keys, so a task holds one of them."""
    schema = to_arrow(rows.sparkSession, NEAR)

    def of_block(key_rows: list[tuple]) -> Iterator[tuple]:
        _, _, _, shortest, tests = key_rows[0]
        pairs = [tuple(map(int, t.split(":"))) for t in tests.split()]
        yield from near_in_block([r[:3] for r in key_rows], shortest, pairs)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple] = []
        now = None
        for batch in batches:
            keys, *columns = (c.to_pylist() for c in batch.columns)
            for key, *row in zip(keys, *columns):
                if key != now:
                    if len(held) > 1:
                        yield from of_block(held)
                    now, held = key, []
                held.append(tuple(row))
        if len(held) > 1:
            yield from of_block(held)

    dealt = rows.select("key", "word", "n", "core", "shortest", "tests")
    dealt = dealt.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda batches: batched(found(batches), schema), NEAR)


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for words with a form, from ``word, form``: each round takes the root of
    the root, so a chain of 10^18 counts takes five."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(now.join(onward, "root", "left").select("word", "root", "further"))
        now = step.select("word", F.coalesce("further", "root").alias("root"))
        if step.where("further IS NOT NULL").isEmpty():
            return now


def variants(docs: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the corpus."""
    words = stored(word_counts(docs))
    near = near_words(bounded_blocks(words, most)).groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"),
    )
    much = -F.col("best.less") >= TIMES * F.col("n")
    known = stored(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(much, F.col("best.near")).alias("form"),
            F.when(much, -F.col("best.less")).alias("form_n"),
        )
    )
    ends = roots(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
