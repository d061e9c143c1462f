"""BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring byte symbols that occurs inside no vocabulary token can
never be bridged by a merge, so a word may be cut there.  Fragments between
cuts are encoded independently (and cached, since prose repeats them), then
their ids are concatenated; the result equals encoding the whole word.

Defined results: a null text counts as empty (no ids, empty decoded text);
empty tables give empty results; repeated rows give repeated results; texts and
words of any length are encoded whole, long fragments by a heap in n log n.
Letters and numbers are those of the library's Unicode version (16), whatever
that of the running Python; texts with code points whose composition or lower
case depends on the version are normalised by the library's own normaliser.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import sys
import unicodedata
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandgraph.llm.common import keeps, map_rows, texts_of

END = "</w>"
#: Unicode White_Space, spelled out so that no library's reading of \s matters.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Code points beyond the first plane.
HIGH = "\U00010000-\U0010ffff"
#: Entries of one cache generation; caching never changes a result.
CACHE = 200_000
NEVER = 1 << 60
#: White space to Python alone.
NO_SPACE = "\x1c\x1d\x1e\x1f"
# Letters and numbers that Unicode 16 adds to 15.1.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies, by its public rule."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def char_class(initial: str, added: tuple = ()) -> tuple[str, str]:
    """The ranges of regex character classes: code points of one general category group of Unicode 15.1, and those ``added``."""
    inside = [unicodedata.category(chr(c))[0] == initial for c in range(sys.maxunicode + 1)]
    for a, b in added:
        inside[a : b + 1] = [True] * (b + 1 - a)
    return planes(inside)


def planes(inside: list[bool]) -> tuple[str, str]:
    """The ranges below U+10000 and those from there on.

    Python's regex engine looks the former up in a table, but goes through the
    latter one by one, so a class of both costs hundreds of steps for each code
    point that is in neither.
    """
    return ranges(inside[:0x10000]), ranges(inside[0x10000:], 0x10000)


def ranges(inside: list[bool], base: int = 0) -> str:
    out, start = [], None
    for c, x in enumerate([*inside, False], base):
        if x and start is None:
            start = c
        elif not x and start is not None:
            out.append(re.escape(chr(start)) + "-" + re.escape(chr(c - 1)))
            start = None
    return "".join(out)


@lru_cache(maxsize=1)
def rare() -> tuple[re.Pattern, re.Pattern]:
    """Code points whose composition or lower case Python and the library may see differently.

    Those that Python takes for unassigned, marks outside the oldest block (the
    library orders later ones as if they were none), and the one script whose
    pairs were given compositions in between.  Texts with any take a longer way.
    """
    inside = [unicodedata.category(c) == "Cn" or i > 0x36F and unicodedata.combining(c) > 0 or 0x11930 <= i <= 0x11938 for i, c in enumerate(map(chr, range(sys.maxunicode + 1)))]
    below, above = planes(inside)
    return re.compile(f"[{below}]"), re.compile(f"[{above}]")


class Memo(dict):
    """A bounded cache of a function of one key: when it is full, it becomes the old generation, which is looked at once more."""

    def __init__(self, fill):
        super().__init__()
        self.fill, self.old = fill, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fill(key)
        if len(key) <= 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordBpe:
    """Encoder and decoder of a word-end byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.space, self.high = re.compile(f"[{SPACE}]+"), re.compile(f"[{HIGH}]")
        (letters, high_letters), (numbers, high_numbers) = char_class("L", NEW_LETTERS), char_class("N", NEW_NUMBERS)
        self.rare, self.path = rare(), path
        # The classes of high code points are only tried on one.
        self.words = re.compile(
            rf"(?:[{letters}]++|(?=[{HIGH}])[{high_letters}]++)++|'s|'t|'re|'ve|'m|'ll|'d|[{numbers}]|(?=[{HIGH}])[{high_numbers}]"
            rf"|(?:[^{SPACE}{letters}{numbers}{HIGH}]++|(?=[{HIGH}])[^\0-\uffff{high_letters}{high_numbers}]++)++"
        )
        self.alphabet = byte_alphabet()
        bodies = (t.removesuffix(END) for t in self.vocab)
        self.joined = {t[i : i + 2] for t in bodies for i in range(len(t) - 1)}
        self.cache = Memo(self.chunk_piece)
        self.fragments = Memo(lambda key: self.merge(key[1:], key[0] == "$"))

    def normalize(self, text: str) -> str:
        """The library's normal form, but for white space, which is kept as it is unless the library's normaliser is asked."""
        if not text.isascii():
            low, high = self.rare
            if low.search(text) or self.high.search(text) and high.search(text):
                return library(self.path).normalizer.normalize_str(text)
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        return text.lower()

    def chunks(self, text: str) -> list[str]:
        """What white space separates in a text; no word reaches over it."""
        if any(c in text for c in NO_SPACE):
            return [c for c in self.space.split(text) if c]
        return text.split()

    def cut(self, symbols: str) -> list[str]:
        """The fragments of a word between its forced boundaries."""
        at = [i for i in range(1, len(symbols)) if symbols[i - 1 : i + 1] not in self.joined]
        return [symbols[a:b] for a, b in zip([0, *at], [*at, len(symbols)], strict=True)]

    def merge(self, fragment: str, last: bool) -> tuple[int, ...]:
        """Ids of one fragment: lowest rank first, leftmost among equals."""
        parts = list(fragment)
        if last:
            parts[-1] += END
        ranks = self.ranks
        if len(parts) > 40:
            parts = self._merge_long(parts)
        costs = [ranks.get(p, NEVER) for p in zip(parts, parts[1:], strict=False)]
        while costs and (best := min(costs)) < NEVER:
            at = costs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = ranks.get((parts[at - 1], parts[at]), NEVER)
            if at < len(costs):
                costs[at] = ranks.get((parts[at], parts[at + 1]), NEVER)
        return tuple(self.vocab[p] for p in parts)

    def _merge_long(self, parts: list[str]) -> list[str]:
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        live: list[str | None] = list(parts)
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if live[i] != a or j < 0 or live[j] != b:
                continue
            live[i], live[j], after[i] = a + b, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (r := self.ranks.get((live[left], live[right]))) is not None:
                    heapq.heappush(heap, (r, left, live[left], live[right]))
        return [p for p in live if p is not None]

    def word_ids(self, word: str) -> list[int]:
        """The ids of a word's fragments, each encoded on its own."""
        *head, last = self.cut("".join(self.alphabet[b] for b in word.encode("utf-8")))
        if not head:
            return list(self.merge(last, True))
        return [i for fragment in head for i in self.fragments["-" + fragment]] + list(self.fragments["$" + last])

    def word_piece(self, word: str) -> tuple[bytes, bytes]:
        ids = self.word_ids(word)
        return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids).encode("utf-8")

    def chunk_piece(self, chunk: str) -> tuple[bytes, bytes]:
        """The piece of a chunk; its words, if it has several, are chunks of their own."""
        words = self.words.findall(chunk)
        if len(words) == 1:
            return self.word_piece(chunk)
        ids, decoded = zip(*map(self.cache.__getitem__, words), strict=True)
        return b"".join(ids), b" ".join(decoded)

    def pieces(self, text: str) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, their decoded tokens in UTF-8) of each chunk and special token."""
        parts = self.split_special.split(text) if self.split_special else [text]
        out = list(map(self.cache.__getitem__, self.chunks(self.normalize(parts[0]))))
        for special, part in zip(parts[1::2], parts[2::2], strict=True):
            out.append((struct.pack("<I", self.special[special]), special.encode()))
            out += map(self.cache.__getitem__, self.chunks(self.normalize(part)))
        return out

    def encode(self, text: str) -> list[int]:
        data = b"".join([p[0] for p in self.pieces(text)])
        return np.frombuffer(data, dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by one space; unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


@lru_cache(maxsize=2)
def library(path: str):
    """The tokenizers library's reading of the file; only its normaliser is used."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


keeps(__name__, encoder.cache_clear, library.cache_clear, rare.cache_clear)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per input row: id, token count, digests of the ids and of the decoded text."""
    path = vocabulary or vocabulary_path()

    def build():
        bpe = encoder(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, ids, decoded = [], [], []
            for text in texts_of(batch):
                pieces = bpe.pieces(text)
                data = b"".join([p[0] for p in pieces])
                counts.append(len(data) // 4)
                ids.append(sha256(data).hexdigest())
                decoded.append(sha256(b" ".join([p[1] for p in pieces])).hexdigest())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return step

    narrow = docs.select(id_col, text_col)
    kind = narrow.schema[0].dataType.simpleString()
    return map_rows(narrow, build, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per input row: id and its token ids (array of int)."""
    path = vocabulary or vocabulary_path()

    def build():
        bpe = encoder(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [bpe.encode(t) for t in texts_of(batch)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

        return step

    narrow = docs.select(id_col, text_col)
    return map_rows(narrow, build, f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """One row per input row: id and the decoded text; null ids give an empty text."""
    path = vocabulary or vocabulary_path()

    def build():
        bpe = encoder(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            text = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], [id_col, "text"])

        return step

    narrow = encoded.select(id_col, ids_col)
    return map_rows(narrow, build, f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, text string")
