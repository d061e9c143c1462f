"""Secret scan: fixed credential patterns plus a token-efficiency test.

The base kinds are regular expressions (``assign``, ``access``, ``hex``).  The
method adds spans of kind ``random``: a long run of credential characters whose
characters-per-token ratio under a public tiktoken vocabulary is low, because
byte-pair merges learned from prose do not apply to random strings.  A run ends
at a dot, so each dotted part of a token is tested by itself; hosts of URLs are
left out, and what follows them is tested part by part.  Known digests (hexadecimal
runs of digest length that the words before them name as such: a commit, a
checksum, an etag), UUIDs, dates and numbers are excluded.  Words and names joined
by separators count as identifiers only if their letters cost few tokens.

Defined results: a null text counts as empty (no spans, digest of the empty
string); empty tables give empty results; repeated rows give repeated results;
texts of any length are scanned whole; only the id and text columns are read,
so other columns may have any name.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from strandgraph.llm.common import keeps, map_rows, texts_of

KINDS = ("assign", "access", "hex", "random")
BASE_KINDS = KINDS[:3]

# The base patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
MIN_ASSIGNED = 6

RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
#: What names a digest right before it; behind a credential's name it is none.
NAMED = re.compile(r"(?i)(?:commit|revision|\brev|\bsha-?[0-9]*|\bmd5|checksum|digest|etag|\bhash|fingerprint|integrity|\bblob|\btree|\bparent|\bmerge|\bgit)(?:sum|id|[-_]id)?(?:\s+(?:is|of|at|id|the))?[\s\"'`:=(\[<@-]{1,4}(?:W/\")?\Z")
#: Words, or a word with a number behind it, joined by single separators.
IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[-_/+=]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[-_/=]*")
URL = re.compile(r"""://(?:[^\s/?#@"'<>]*+@)?([^\s/?#"'<>]*)[^\s"'<>]*""")
PART = re.compile(r"[A-Za-z0-9+_-]{16,}")
LETTERS = re.compile(r"[A-Za-z]+")
#: Letters of words have more characters per token than this, random ones about 1.3; fewer than LEAST_LETTERS decide nothing.
WORD_RATIO, LEAST_LETTERS = 1.75, 8
CAMEL = re.compile(r"[A-Za-z]?[a-z]*(?:[A-Z][a-z]{2,})+[0-9]{0,4}")


@lru_cache(maxsize=2)
def encoding(path: str):
    """A tiktoken encoding of the rank file at ``path``, one per worker process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


keeps(__name__, encoding.cache_clear)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base kinds, unsorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def excluded(run: str, before: str, enc) -> bool:
    """Digests that the text ``before`` names, numbers, and identifiers whose letters are not random."""
    if run.isdigit() or UUID.fullmatch(run) or DIGEST.fullmatch(run) and NAMED.search(before):
        return True
    if not (IDENTIFIER.fullmatch(run) or CAMEL.fullmatch(run)):
        return False
    words = LETTERS.findall(run)
    size = sum(map(len, words))
    return size < LEAST_LETTERS or size > WORD_RATIO * sum(len(enc.encode_ordinary(w)) for w in words)


def runs(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each run; of a URL, those of its parts outside the host."""
    urls = URL.finditer(text) if "://" in text else iter(())
    url = next(urls, None)
    for m in RUN.finditer(text):
        start, end = m.span()
        while url and url.end() <= start:
            url = next(urls, None)
        if not url or start < url.start():
            yield start, end
        else:
            host, stop = url.span(1)
            for a, b in ((start, min(end, host)), (max(start, stop), end)):
                if b - a >= 16:
                    yield from (p.span() for p in PART.finditer(text, a, b))


def random_spans(text: str, enc, max_ratio: float) -> list[tuple[int, int, int]]:
    """Runs that cost many tokens for their length."""
    found = []
    for start, end in runs(text):
        run = text[start:end]
        if not excluded(run, text[max(0, start - 40) : start], enc) and len(run) <= max_ratio * len(enc.encode_ordinary(run)):
            found.append((start, 3, end))
    return found


def digest(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def spans_of(text: str, enc, max_ratio: float) -> tuple[list, list]:
    """(base spans, all spans), each sorted by start, then kind as listed."""
    base = sorted(base_spans(text))
    return base, sorted({*base, *random_spans(text, enc, max_ratio)})


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = 2.4, vocabulary: str | None = None) -> DataFrame:
    """One row per input row: id, counts of the base kinds, base digest, all spans.

    ``max_ratio`` is the highest characters-per-token ratio that counts as
    random; prose runs near 4, hexadecimal and base64 below 2.
    """
    path = vocabulary or vocabulary_path()

    def build():
        enc = encoding(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, hashes, spans = ([], [], []), [], []
            for text in texts_of(batch):
                base, every = spans_of(text, enc, max_ratio)
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                hashes.append(sha256(digest(base, KINDS).encode()).hexdigest())
                spans.append(digest(every, KINDS))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())],
                [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

        return step

    narrow = docs.select(id_col, text_col)
    kind = narrow.schema[0].dataType.simpleString()
    return map_rows(narrow, build, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with every span, or group of overlapping spans, replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", max_ratio: float = 2.4, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with the secrets in its texts masked; other columns pass unchanged.

    Null texts stay null; ``length_col``, if the table has it, gets the new
    length in code points of each changed text.
    """
    path = vocabulary or vocabulary_path()
    names = docs.columns
    at = names.index(text_col)
    length = names.index(length_col) if length_col in names else None

    def build():
        enc = encoding(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns, texts = list(batch.columns), batch.column(at).to_pylist()
            new = {}
            for i, text in enumerate(texts):
                if text and (every := spans_of(text, enc, max_ratio)[1]):
                    new[i] = redact(text, every)
            if new:
                columns[at] = pa.array([new.get(i, t) for i, t in enumerate(texts)], batch.schema.field(at).type)
                if length is not None:
                    old = columns[length].to_pylist()
                    columns[length] = pa.array([len(new[i]) if i in new else n for i, n in enumerate(old)], batch.schema.field(length).type)
            return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return step

    return map_rows(docs, build, docs.schema)
