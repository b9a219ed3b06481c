"""The encoder against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from panelspark.llm import bpe
from tests.llm.helpers import FOLDER, ODD, empty, odd, rows_of

PATH = bpe.word_bpe_path()
LIBRARY = Tokenizer.from_file(PATH)


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(PATH)


def test_encodes_every_token_doubled(coder):
    texts = [t.replace("</w>", "") * 2 for t in list(LIBRARY.get_vocab())[:49_000:7]]
    got = coder.encode_many(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [expected(t) for t in texts]


def test_encodes_strange_characters(coder):
    letters = "abcdefgh istonreΣσς'İıß́éñ中文 \x1c\x1f  ​٣½\n\t🎉가ǅ\x00\x7f"
    choose = random.Random(1)
    texts = []
    for _ in range(3000):
        text = "".join(choose.choice(letters) for _ in range(choose.randint(0, 30)))
        if choose.random() < 0.2:
            text += choose.choice(["<|startoftext|>", "<|endoftext|>x", "a<|endoftext|>", "<|"]) + text[:4]
        texts.append(text)
    assert [coder.encode(t) for t in texts] == [expected(t) for t in texts]


def test_punctuation_before_white_space(coder):
    choose = random.Random(5)
    texts = ["".join(choose.choice("ab1.,_!' \n\u0301é") for _ in range(choose.randint(0, 14))) for _ in range(6000)]
    texts += ["A. B, c.\nd", "a.. b", "a., b", "_. x", "é. x", "e\u0301. x", "1. 2, 3.", ".", " . , ", "x.\x0by"]
    assert [coder.encode(t) for t in texts] == [expected(t) for t in texts]


def test_long_words_take_the_other_path(coder):
    choose = random.Random(2)
    for size in (63, 64, 65, 66, 500):
        text = "".join(choose.choice("etaoinsr") for _ in range(size))
        assert coder.encode(text) == expected(text)


@pytest.mark.parametrize("entries", [1, 50, 3000])
def test_a_full_memo_changes_nothing(entries):
    small = bpe.Encoder(PATH, entries=entries)
    texts = [t for (t,) in rows_of("documents", "text")][:60]
    want = [expected(t) for t in texts]
    for size in (60, 7, 1):
        for start in range(0, 60, size):
            got = small.encode_many(texts[start : start + size])
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == want[start : start + size]
        small.encode("a short text")
        assert len(small.chunks) <= entries + 3


def test_long_chunks_do_not_fill_the_memo():
    small = bpe.Encoder(PATH, entries=50)
    text = " ".join("abcde"[i % 5] * (700 + i) for i in range(9))
    for _ in range(3):
        assert small.encode(text) == expected(text)
    small.encode("a")
    assert small.characters <= 50 * bpe.CACHE_CHARS
    assert small.characters == sum(map(len, small.chunks))


def test_decodes_like_the_library(coder):
    for (text,) in rows_of("documents", "text")[:50]:
        ids = coder.encode(text)
        assert coder.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_documents_and_odd_rows(spark):
    got = {tuple(r) for r in bpe.encode(odd(spark), PATH).selectExpr("doc_id", "cast(ids as string)").collect()}
    assert got == {(r[0], str(expected(r[1]))) for r in ODD}
    assert bpe.encode(empty(spark), PATH).count() == 0
    back = bpe.decode(bpe.encode(odd(spark), PATH), PATH).collect()
    assert sorted((r[0] or 0, r[1]) for r in back) == sorted(
        (r[0] or 0, LIBRARY.decode(expected(r[1]), skip_special_tokens=False)) for r in ODD
    )


def test_digests(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.round_trip_digests(docs, PATH).collect()}
    for key, text in rows_of("documents", "doc_id, text"):
        ids = expected(text)
        numbers = " ".join(map(str, ids)).encode()
        back = LIBRARY.decode(ids, skip_special_tokens=False).encode()
        assert got[key] == (len(ids), hashlib.sha256(numbers).hexdigest(), hashlib.sha256(back).hexdigest())
