"""BPE encoding by dynamic programming over prefixes, and decoding.

A word's merge result is found without replaying merges. For every prefix of the word
there is exactly one token that ends the prefix's encoding. An automaton over the
vocabulary lists the tokens that are suffixes of the prefix; a candidate is the last
token if it is compatible with the last token of the prefix before it, that is, if
merging the two tokens' characters gives just these two tokens. Back-pointers (the last
token of every prefix) then spell the exact ids.

Rules: a null text is empty and encodes to no ids. The strings of special tokens inside a
text become their ids, as the tokenizer file asks. Repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from operator import itemgetter

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from panelspark.llm.common import batched, map_rows, spans_of, text_column, to_arrow

#: Code points that the tokenizer files' regular expressions call white space (fixed values).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The word pattern of the tokenizer file (fixed value), with its white space spelled out.
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
#: str.split() also splits at these, which are no white space to the tokenizer.
ODD = re.compile("[\x1c-\x1f]")
BLANK = regex.compile(f"[{SPACE}]+")
#: A full stop or comma after other punctuation, with which it makes one word.
JOINED = re.compile(r"[.,](?<=[^\w\s].|_.)\s")
#: Marks a word's end inside the automaton; it is no byte-level character.
END = "\n"
#: Chunks of text whose ids a worker remembers, and characters of these for each.
CACHE_ENTRIES, CACHE_CHARS = 1_000_000, 16
#: Slots of the table of compatibility answers (a power of two).
PAIR_SLOTS = 1 << 20
#: Words beyond this length are encoded one by one.
LONG_WORD = 64
#: Words encoded together, and characters of text handled together.
WORDS_AT_ONCE = 10_000
CHARS_AT_ONCE = 500_000


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Bytes, as Latin-1 characters, that byte-level vocabularies show as other characters.
REPLACED = re.compile("[\x00-\x20\x7f-\xa0\xad]")


def byte_characters() -> dict[int, int]:
    """The character that stands for each replaced byte: from 256 on, in order."""
    replaced = [b for b in range(256) if REPLACED.match(chr(b))]
    return {b: 256 + i for i, b in enumerate(replaced)}


def base_characters() -> list[str]:
    """The characters that stand for the 256 bytes."""
    return [chr(c) for c in (byte_characters().get(b, b) for b in range(256))]


class Vocabulary:
    """Tokens of one tokenizer file, how each arises, and which may stand side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token = [""] * size
        for text, number in [*ids.items(), *self.special.items()]:
            self.token[number] = text
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.automaton = ahocorasick.Automaton()
        self.length = np.zeros(size, np.int64)
        for text, number in ids.items():
            key = text[: -len(suffix)] + END if text.endswith(suffix) and text != suffix else text
            self.length[number] = len(key)
            self.automaton.add_word(key, number)
        self.automaton.make_automaton()
        # The shortest token that ends at a place of a word: a single character, or the last
        # one with the word's end. The automaton lists it last, and there is always one.
        self.shortest = np.zeros(size, bool)
        for number in (ids.get(c + end) for c in base_characters() for end in ("", suffix)):
            if number is None:
                raise ValueError("the vocabulary lacks a byte")
            self.shortest[number] = True
        # How a token arises: the rank of its merge, and its two parts (-1 for base tokens).
        self.rank = np.full(size, -1, np.int64)
        self.parts = np.full((2, size), -1, np.int64)
        self.never = len(model["merges"])
        pairs = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            whole = ids[left + right]
            self.rank[whole] = rank
            self.parts[:, whole] = ids[left], ids[right]
            pairs.append(ids[left] << 32 | ids[right])
        order = np.argsort(pairs)
        self.pair_key, self.pair_rank = np.array(pairs)[order], order
        self.left_spine, self.left_depth = self._spines(0)
        self.right_spine, self.right_depth = self._spines(1)
        self.alone = self._alone()

    def _spines(self, side: int) -> tuple[np.ndarray, np.ndarray]:
        """For every token the tokens at its left (0) or right (1) end, from itself down to the
        base token, and their number."""
        levels = [np.arange(len(self.rank))]
        while (levels[-1] >= 0).any():
            now = levels[-1]
            levels.append(np.where(now >= 0, self.parts[side][now], -1))
        spine = np.stack(levels, axis=1)
        return spine, (spine >= 0).sum(axis=1)

    def meets(self, left: np.ndarray, right: np.ndarray, inside: bool = False) -> np.ndarray:
        """Whether some merge joins a piece of ``left`` with a piece of ``right`` while both
        are being built; of equal merges the leftmost goes first. ``inside``: the merge of the
        two whole tokens does not count."""
        out = np.zeros(len(left), bool)
        open_ = np.arange(len(left))
        i, j = self.right_depth[left] - 1, self.left_depth[right] - 1
        while len(open_):
            a, b = left[open_], right[open_]
            x, y = self.right_spine[a, i], self.left_spine[b, j]
            # The rank of the merge that takes a piece up into the next larger one.
            x_gone = np.where(i > 0, self.rank[self.right_spine[a, i - 1]], self.never)
            y_gone = np.where(j > 0, self.rank[self.left_spine[b, j - 1]], self.never)
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            rank = np.where(self.pair_key[at] == key, self.pair_rank[at], self.never)
            top = (i == 0) & (j == 0)
            joined = (rank < x_gone) & (rank <= y_gone) & (rank < self.never)
            if inside:
                joined &= ~top
            out[open_[joined]] = True
            on = ~joined & ~top
            left_next = on & (i > 0) & ((x_gone <= y_gone) | (j == 0))
            i, j = np.where(left_next, i - 1, i)[on], np.where(on & ~left_next, j - 1, j)[on]
            open_ = open_[on]
        return out

    def _alone(self) -> np.ndarray:
        """Whether a token's own characters encode to it."""
        made = np.flatnonzero(self.rank >= 0)
        fine = np.ones(len(self.rank), bool)
        fine[made] = ~self.meets(self.parts[0][made], self.parts[1][made], inside=True)
        for token in made[np.argsort(self.rank[made])].tolist():
            fine[token] &= fine[self.parts[0][token]] and fine[self.parts[1][token]]
        return fine


class Encoder:
    """Encodes and decodes with one tokenizer file; remembers the words it has met."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.vocabulary = Vocabulary(path)
        self.token = self.vocabulary.token
        self.byte = byte_characters()
        self.entries = entries
        self.chunks: dict[str, bytes] = {}
        self.characters = 0
        # A direct-mapped table of compatibility answers: bounded, and exact as keys are kept.
        self.asked = np.full(PAIR_SLOTS, -1, np.int64)
        self.answer = np.zeros(PAIR_SLOTS, bool)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether ``left`` then ``right`` is the encoding of their joint characters."""
        key = left << 32 | right
        slot = (key * 0x9E3779B97F4A7C1) >> 20 & PAIR_SLOTS - 1
        out = self.answer[slot]
        new = np.flatnonzero(self.asked[slot] != key)
        if len(new):
            once, back = np.unique(key[new], return_inverse=True)
            found = ~self.vocabulary.meets(once >> 32, once & 0xFFFFFFFF)
            out[new] = found[back]
            at = (once * 0x9E3779B97F4A7C1) >> 20 & PAIR_SLOTS - 1
            # Of several keys for one slot any may stay, with its own answer.
            at, first = np.unique(at, return_index=True)
            self.asked[at], self.answer[at] = once[first], found[first]
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of byte-level characters, each as little-endian 32-bit numbers.

        All words take part in one programme: position after position, the last token of the
        prefixes of that length of all words is found at once.
        """
        joined = END.join(words) + END
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        starts = ends - sizes
        found = map(itemgetter(1), self.vocabulary.automaton.iter(joined))
        token = np.fromiter(found, np.int64)
        # Matches come place by place, the shortest of each place last.
        at = np.cumsum(self.vocabulary.shortest[token])
        at = np.r_[0, at[:-1]]
        place = at - np.repeat(starts, sizes)[at]
        before = at - self.vocabulary.length[token]
        order = np.argsort(place, kind="stable")
        at, token, before, place = at[order], token[order], before[order], place[order]
        whole = before < at - place  # the token is the whole prefix
        last = np.full(len(joined), -1, np.int64)
        edges = np.searchsorted(place, np.arange(place[-1] + 2))
        for low, high in zip(edges[:-1], edges[1:]):
            t, b, fine = token[low:high], before[low:high], np.zeros(high - low, bool)
            w = whole[low:high]
            fine[w] = self.vocabulary.alone[t[w]]
            rest = np.flatnonzero(~w & (last[b] >= 0))
            fine[rest] = self.compatible(last[b[rest]], t[rest])
            last[at[low:high][fine]] = t[fine]
        # Back-pointers, for all words at once.
        here, number = ends - 1, np.arange(len(words))
        steps = []
        while len(here):
            t = last[here]
            steps.append((number, here, t))
            here = here - self.vocabulary.length[t]
            on = here >= starts[number]
            here, number = here[on], number[on]
        number, here, t = (np.concatenate(x) for x in zip(*steps))
        order = np.argsort(here)
        flat = t[order].astype("<u4").tobytes()
        cut = (np.cumsum(np.bincount(number, minlength=len(words))) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *cut[:-1]], cut)]

    def encode_long(self, word: str) -> bytes:
        """The same programme for one very long word, candidate by candidate."""
        length, alone = self.vocabulary.length, self.vocabulary.alone
        last = [-1] * (len(word) + 2)
        known: dict[tuple[int, int], bool] = {}
        for at, token in self.vocabulary.automaton.iter(word + END):
            if last[at + 1] < 0:
                before = at + 1 - int(length[token])
                if before == 0:
                    fine = alone[token]
                elif last[before] < 0:
                    fine = False
                else:
                    pair = last[before], token
                    if pair not in known:
                        if len(known) > PAIR_SLOTS:
                            known.clear()
                        known[pair] = self.compatible(*(np.array([x], np.int64) for x in pair))[0]
                    fine = known[pair]
                if fine:
                    last[at + 1] = token
        ids, at = [], len(word) + 1
        while at:
            ids.append(last[at])
            at -= int(length[last[at]])
        return np.array(ids[::-1], "<u4").tobytes()

    def _words(self, chunk: str) -> list[str]:
        """The words of normalised text without white space, in byte-level characters."""
        if chunk.isalpha():
            if chunk.isascii():
                return [chunk]
            words = [chunk]
        else:
            words = WORD.findall(chunk)
        words = [w.encode().decode("latin-1") for w in words]
        return [w.translate(self.byte) if REPLACED.search(w) else w for w in words]

    def _learn(self, chunks: list[str]) -> None:
        """Add chunks to the memo, by way of their words."""
        parts = [self._words(c) for c in chunks]
        once: dict[str, bytes | None] = dict.fromkeys(w for p in parts for w in p)
        usual = [w for w in once if len(w) <= LONG_WORD]
        for low in range(0, len(usual), WORDS_AT_ONCE):
            some = usual[low : low + WORDS_AT_ONCE]
            once.update(zip(some, self.encode_words(some)))
        once.update((w, self.encode_long(w)) for w in once if len(w) > LONG_WORD)
        self.characters += sum(map(len, chunks))
        for chunk, words in zip(chunks, parts):
            self.chunks[chunk] = once[words[0]] if len(words) == 1 else b"".join([once[w] for w in words])

    def _trim(self) -> None:
        """Frequent entries come early, so the late half goes when the memo is full."""
        limit = CACHE_CHARS * self.entries
        if len(self.chunks) > self.entries or self.characters > limit:
            for key in list(self.chunks)[self.entries // 2 :]:
                del self.chunks[key]
            self.characters = sum(map(len, self.chunks))
            if self.characters > limit:
                self.chunks.clear()
                self.characters = 0

    def _pieces(self, text: str) -> list[str]:
        """Chunks of the normalised text. White space ends a chunk, and no word crosses it."""
        if text.isascii():
            text = text.lower()
        else:
            text = unicodedata.normalize("NFC", text)
            # Letter by letter if there is a sigma, which str.lower() treats by its context.
            text = "".join([c.lower() for c in text]) if "\u03a3" in text else text.lower()
        if ODD.search(text):
            return [p for p in BLANK.split(text) if p]
        # A full stop or comma is a word of its own, unless punctuation stands before it. Cut
        # off here, it leaves fewer different chunks to remember.
        if not JOINED.search(text):
            text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " . ")
        return text.split()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        # Only here, as what these texts need has to stay until they are done.
        self._trim()
        runs: list[list[list[str] | str]] = []
        met: set[str] = set()
        for text in texts:
            run: list[list[str] | str] = []
            plain = [text] if "<|" not in text else self.vocabulary.special_pattern.split(text)
            for part in plain:
                if part in self.vocabulary.special:
                    run.append(part)
                else:
                    run.append(pieces := self._pieces(part))
                    met.update(pieces)
            runs.append(run)
        if new := met.difference(self.chunks):
            self._learn(list(new))
        special = self.vocabulary.special
        out = []
        for run in runs:
            got = [
                np.array(special[p], "<u4").tobytes() if isinstance(p, str) else b"".join(map(self.chunks.__getitem__, p))
                for p in run
            ]
            out.append(got[0] if len(got) == 1 else b"".join(got))
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by spaces, word ends shown."""
        return " ".join([self.token[i] for i in ids])


@functools.lru_cache(maxsize=2)
def encoder(path: str, entries: int = CACHE_ENTRIES) -> Encoder:
    return Encoder(path, entries)


def encoded_rows(batches, path: str, entries: int = CACHE_ENTRIES):
    """``(other columns..., text, ids as bytes)`` of Arrow batches whose last column is the
    text, some texts at a time. ``entries`` bounds the memory, not the result."""
    coder = encoder(path, entries)
    for batch in batches:
        for low, high in spans_of(batch.column(batch.num_columns - 1), CHARS_AT_ONCE):
            columns = [c.slice(low, high - low).to_pylist() for c in batch.columns]
            yield from zip(*columns, coder.encode_many(columns[-1]))


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column, ids array<int>``: one row per document, in no order."""
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, ids array<int>"
    arrow = to_arrow(docs.sparkSession, schema)

    def run(batches):
        rows = ((key, np.frombuffer(ids, "<i4")) for key, _, ids in encoded_rows(batches, path))
        yield from batched(rows, arrow, size=200)

    return docs.select(id_column, text_column(text).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """``id_column, text``: the decoded text of every row of ids; null ids are none."""

    def make():
        coder = encoder(path)
        return lambda key, ids: (key, coder.decode(ids or []))

    kind = encoded.schema[id_column].dataType.simpleString()
    return map_rows(encoded.select(id_column, "ids"), f"`{id_column}` {kind}, text string", make)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every document in one pass and digest both.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    arrow = to_arrow(docs.sparkSession, schema)

    def run(batches):
        coder = encoder(path)
        decimal = [str(i) for i in range(len(coder.token))]

        def rows():
            for key, _, packed in encoded_rows(batches, path):
                ids = np.frombuffer(packed, "<u4").tolist()
                numbers = " ".join([decimal[i] for i in ids]).encode()
                back = coder.decode(ids).encode()
                yield key, len(ids), hashlib.sha256(numbers).hexdigest(), hashlib.sha256(back).hexdigest()

        yield from batched(rows(), arrow)

    return docs.select("doc_id", text_column().alias("text")).mapInArrow(run, schema)
