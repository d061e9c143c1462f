"""Personal data: fixed patterns plus offset-preserving deobfuscation.

Base kinds (``email``, ``ip``, ``card``, ``phone``) are found in the text as it
stands.  The method then runs three transducers over texts that show a trigger:
look-alike characters to ASCII, spelled digits to digits, and at/dot disguises
to ``@`` and ``.``.  The normalised text keeps a segment table, so identifiers
found in it map back to source code points; a span is added if it covers a
rewritten segment and is not a base span already.

Defined results: a null text counts as empty; empty tables give empty results;
repeated rows give repeated results; texts of any length are scanned whole;
only the id and text columns are read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from strandgraph.llm.common import map_rows, texts_of

KINDS = ("email", "ip", "card", "phone")

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Digit words of the four corpus languages.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9", "oh": "0",
}
# Cyrillic and Greek letters that look like ASCII ones.
LOOKALIKES = dict(zip("аеорсухіјѕԁһАВЕКМНОРСТХІЈЅοανρτικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhABEKMHOPCTXIJSoavptikABEZHIKMNOPTYX", strict=True))
HIDDEN = "\u200b\u200c\u200d\u2060\ufeff\u00ad"


def lookalikes() -> dict[str, str]:
    """Compatibility forms of ASCII letters, digits and identifier signs, the table above, and invisible characters."""
    wanted = re.compile(r"[A-Za-z0-9@.+_-]")
    blocks = [*range(0xB2, 0xBA), *range(0x2070, 0x2090), *range(0x2100, 0x2140), *range(0x2460, 0x24EB), *range(0xFE50, 0xFE70), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), 0x2024]
    table = {chr(c): n for c in blocks if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and wanted.fullmatch(n)}
    table |= {chr(c): str(d) for c in [*range(0x660, 0x66A), *range(0x6F0, 0x6FA), *range(0x966, 0x970)] if (d := unicodedata.digit(chr(c), None)) is not None}
    return table | LOOKALIKES | {"\u2010": "-", "\u2011": "-", "\u2013": "-"} | dict.fromkeys(HIDDEN, "")


TABLE = lookalikes()
ALIKE = re.compile("[" + "".join(map(re.escape, TABLE)) + "]+")
_DIGIT = r"(?:\b(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + r")\b|[0-9])"
#: Seven or more digits in a row; at least MIN_WORDS must be words.
MIN_WORDS = 3
SPELLED = re.compile(rf"(?i:(?<![\w])(?:plus\x20)?{_DIGIT}(?:[\x20,.-]{{0,2}}{_DIGIT}){{6,}})(?![\w])")
WORD_OR_DIGIT = re.compile(rf"(?i:{_DIGIT})")
AT_WORDS = r"(?:at|arroba|arobase|klammeraffe)"
DOT_WORDS = r"(?:dot|punkt|point|punto)"
_FRAMED = r"\s*[\[({{<]\s*(?:{0}|\{1})\s*[\])}}>]\s*|\s+{0}\s+|[_-]{0}[_-]"
_DOT = f"(?:{_FRAMED.format(DOT_WORDS, '.')})"
_ENGLISH_DOT = f"(?:{_FRAMED.format('dot', '.')})"
# Last labels that a host of bare words may have behind any word for a dot; such as are common words are left out.
TOP = "com|org|net|edu|gov|int|mil|info|biz|io|co|ai|app|dev|de|fr|es|uk|eu|ca|au|ch|nl|pl|ru|cn|jp|br|mx|ar|example|test|invalid|local"
#: Behind a word that means nothing else: any label of two letters, and more known ones.
MORE_TOP = f"{TOP}|[A-Za-z]{{2}}|name|pro|museum|coop|aero|jobs|mobi|tel|travel|cat|asia|post|online|site|shop|xyz|tech|cloud|blog|news|store|email|page|top|club|live|world|group|team|agency|academy|digital|media|wiki|localhost"
#: Words that make "at ... dot" prose.
PROSE = r"(?:the|an?|this|that|these|those|each|every|which|what|some|any|no|one|my|your|his|her|its|our|their|another)"
_LABEL = rf"[A-Za-z0-9]++(?:-++(?!{DOT_WORDS}[_-])[A-Za-z0-9]++)*+"
_LABELS = rf"{_LABEL}(?:(?:\.|{_DOT}){_LABEL}){{0,125}}"
_BARE_AT = r"(?:\s+{0}\s+|[_-]{0}[_-])"
#: A bracketed "at", or a bare one that a disguised dot follows within the host.
DISGUISED = re.compile(
    rf"(?i:(?<=[A-Za-z0-9_%+-])(?P<at>\s*[\[({{<]\s*(?:{AT_WORDS}|@)\s*[\])}}>]\s*(?=[A-Za-z0-9-]+(?:\.|{_DOT})[A-Za-z0-9])"
    rf"|{_BARE_AT.format(AT_WORDS)}(?={_LABELS}{_DOT}(?:{TOP})(?![\w]))"
    rf"|{_BARE_AT.format('at')}(?!{PROSE}\s)(?={_LABELS}{_ENGLISH_DOT}(?:{MORE_TOP})(?![\w]))"
    rf"|{_BARE_AT.format('(?:arroba|arobase|klammeraffe)')}(?={_LABELS}{_DOT}(?:{MORE_TOP})(?![\w]))"
    rf"|@(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*{_DOT}[A-Za-z0-9])))"
)
DOT = re.compile(rf"(?i:(?<=[A-Za-z0-9-]){_DOT}(?=[A-Za-z0-9]))")
_GROUP = rf"{_DIGIT}(?:[\x20-]?{_DIGIT}){{0,2}}"
#: Four groups of digits or digit words between dots of any form.
DOTTED = re.compile(rf"(?i:(?<![\w]){_GROUP}(?:(?:\.|{_DOT}){_GROUP}){{3}})(?![\w])")
ANY_DOT = re.compile(rf"(?i:{_DOT}|\.)")
HOST_TAIL = re.compile(rf"(?i:[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)*)")
BRACKETED = re.compile(rf"(?i:[\[({{<]\s*(?:{AT_WORDS}|{DOT_WORDS}|[@.])\s*[\])}}>])")
DOT_STEMS = ("dot", "punkt", "point", "punto")
BARE = re.compile(rf"[\s_-]{DOT_WORDS}[\s_-]")


def maybe_spelled(low: str) -> bool:
    """Whether two digit words, or a digit word and a digit, may stand side by side."""
    words = low.replace("-", " ").replace(",", " ").replace(".", " ").split()
    hits = [w in DIGIT_WORDS or w.isdigit() for w in words]
    return any(a and b for a, b in zip(hits, hits[1:], strict=False))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end), unsorted; leftmost and non-overlapping within a kind."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            last = m.end()
            found.append((start, 0, last))
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return found


def rewrite(text: str, edits: list[tuple[int, int, str]], segments: list[tuple[int, int, int]] | None) -> tuple[str, list[tuple[int, int, int, int]]]:
    """Apply sorted, disjoint edits; segments are (new start, new end, old start, old end) of the edits."""
    out, at, size, table = [], 0, 0, []
    for start, end, new in edits:
        out += [text[at:start], new]
        size += start - at
        table.append((size, size + len(new), start, end))
        size += len(new)
        at = end
    return "".join([*out, text[at:]]), table


class Trace:
    """A normalised text with the way back to its source."""

    def __init__(self, text: str):
        self.text, self.tables = text, []

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        if edits:
            self.text, table = rewrite(self.text, edits, None)
            self.tables.append((table, [s[0] for s in table], [s[2] for s in table]))

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of a span of the normalised text, and whether it covers an edit."""
        edited = False
        for table, starts, olds in reversed(self.tables):
            start, _, e1 = self._back(table, starts, start, False)
            _, end, e2 = self._back(table, starts, end - 1, True)
            lo, hi = bisect_right(olds, start - 1), bisect_right(olds, end - 1)
            edited |= e1 or e2 or hi > lo
        return start, end, edited

    @staticmethod
    def _back(table, starts, at: int, closing: bool) -> tuple[int, int, bool]:
        k = bisect_right(starts, at) - 1
        while k >= 0 and table[k][0] == table[k][1] and table[k][0] == at and not closing:
            k -= 1
        if k < 0:
            return at, at + 1, False
        new0, new1, old0, old1 = table[k]
        if at < new1:
            if new1 - new0 == old1 - old0:
                return old0 + at - new0, old0 + at - new0 + 1, True
            return old0, old1, True
        moved = at - new1 + old1
        return moved, moved + 1, False


def disguise_edits(text: str) -> list[tuple[int, int, str]]:
    """``@`` and ``.`` for the at/dot disguises around each disguised address."""
    edits: dict[tuple[int, int], str] = {}
    dots, floor = None, 0
    for m in DISGUISED.finditer(text):
        if m["at"] != "@":
            edits[m.start("at"), m.end("at")] = "@"
        tail = HOST_TAIL.match(text, m.end("at"))
        for d in DOT.finditer(text, m.end("at"), tail.end() if tail else m.end("at")):
            edits[d.span()] = "."
        if dots is None:
            dots = {d.end(): d.start() for d in DOT.finditer(text)}
        # The whole local part, back to the address before.
        start, found = m.start("at"), []
        while start > floor:
            if start in dots and dots[start] > floor and text[dots[start] - 1] in LOCAL:
                found.append((dots[start], start))
                start = dots[start]
            elif text[start - 1] in LOCAL:
                start -= 1
            else:
                break
        edits.update(dict.fromkeys(found, "."))
        floor = m.end("at")
    out, last = [], 0
    for (a, b), new in sorted(edits.items()):
        if a >= last:
            out.append((a, b, new))
            last = b
    return out


def spelled_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in SPELLED.finditer(text):
        parts = [w[0].lower() for w in WORD_OR_DIGIT.finditer(m[0])]
        if sum(p in DIGIT_WORDS for p in parts) < MIN_WORDS:
            continue
        digits = "".join(DIGIT_WORDS.get(p, p) for p in parts)
        edits.append((m.start(), m.end(), "+" * m[0].lower().startswith("plus") + digits))
    return edits


def dotted_edits(text: str) -> list[tuple[int, int, str]]:
    """Plain numbers and dots for addresses with disguised dots or spelled digits."""
    edits = []
    for m in DOTTED.finditer(text):
        parts = ["".join(DIGIT_WORDS.get(w[0].lower(), w[0]) for w in WORD_OR_DIGIT.finditer(p)) for p in ANY_DOT.split(m[0])]
        if (plain := ".".join(parts)) != m[0]:
            edits.append((m.start(), m.end(), plain))
    return edits


def added_spans(text: str, base: set[tuple[int, int, int]]) -> set[tuple[int, int, int]]:
    """Spans that only deobfuscation shows."""
    alike = not text.isascii() and ALIKE.search(text)
    low = text.lower()
    spelled = maybe_spelled(low)
    disguised = any(w in low for w in DOT_STEMS) and BARE.search(low) or BRACKETED.search(text)
    if not (alike or spelled or disguised):
        return set()
    trace = Trace(text)
    if alike:
        trace.apply([(m.start() + i, m.start() + i + 1, TABLE[c]) for m in ALIKE.finditer(text) for i, c in enumerate(m[0])])
    if spelled or alike:
        trace.apply(spelled_edits(trace.text))
    if disguised or alike:
        trace.apply(dotted_edits(trace.text))
        trace.apply(disguise_edits(trace.text))
    found = set()
    if trace.tables:
        for start, kind, end in base_spans(trace.text):
            a, b, edited = trace.source(start, end)
            if edited and (a, kind, b) not in base:
                found.add((a, kind, b))
    return found


def spans_of(text: str) -> tuple[list, list]:
    base = sorted(base_spans(text))
    return base, sorted({*base, *added_spans(text, set(base))})


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts of the base kinds, base digest, all spans."""

    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, hashes, spans = ([], [], [], []), [], []
            for text in texts_of(batch):
                base, every = spans_of(text)
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in base))
                hashes.append(sha256(digest(base).encode()).hexdigest())
                spans.append(digest(every))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())],
                [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

        return step

    narrow = docs.select(id_col, text_col)
    kind = narrow.schema[0].dataType.simpleString()
    return map_rows(narrow, build, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
