"""Main text of web pages: structure first, then the host's suffix array.

Structure: a page that declares its main element (``article``, ``main`` or that
role) says what is content; menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments are dropped by element and by
class, id or role.

Suffix array: the token streams that are left of all pages of a host are
concatenated, each page with an end of its own, and their suffixes sorted by
prefix doubling; longest common prefixes come from the ranks of the rounds.
For every place this gives the longest substring that begins there and stands
on at least ``LEAST_PAGES`` distinct pages, whatever the size of the host.
Substrings of at least ``WINDOW`` tokens are repeats.

* On a page without a main element the tokens that repeats cover go, unique
  runs stay; a repeat that runs on into a block it covers by fewer than
  ``WINDOW`` tokens, and not whole, takes nothing of that block.
* In a declared article a repeat may be a quotation or a copy, so its position
  counts too.  There only whole blocks that repeats cover go, from the first or
  the last block of the page inwards, within ``EDGE`` tokens of the page's end,
  if the block stands on ``NOTICE_PAGES`` pages of the host and always as many
  blocks from the first, or always as many from the last (calls to subscribe,
  notices), and only if repeats cover at most ``COPIED`` of the article.

A host of at most ``SHARD_BYTES`` of html is one group.  A larger one is not
sent to one task: each input split sorts the suffixes of its own pages, gives
out the fingerprints (48 bits) of their first ``WINDOW`` tokens, once for each
of up to LEAST_PAGES pages, and these are added up over the splits, dealt by
value, and so are the places of short blocks, from the same read.  A token lies in a repeat exactly if it lies in one of WINDOW tokens,
so the result is the same, but for fingerprints that agree by chance.

Defined results: null html counts as empty and gives an empty text; a null url
has the empty host; empty tables give empty results; repeated rows are pages of
their own; pages of any length or depth are read whole; only page_id, url and
html are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from hashlib import blake2b
from html import unescape
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandgraph.llm.common import WorkTables, map_batches, map_rows, slices
from strandgraph.llm.url_filter import host_of

WINDOW, LEAST_PAGES = 5, 3
EDGE, NOTICE_PAGES, COPIED = 40, 8, 0.5
SHARD_BYTES = 8 << 20
#: Fingerprints of repeats in large hosts are broadcast up to so many bytes; beyond that they are joined.
BROADCAST_BYTES = 32 << 20

# Elements by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROPPED = frozenset("nav footer aside form script style textarea title xmp iframe noembed noframes noscript head template svg math canvas button select option dialog menu object audio video".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: What an opening tag closes implicitly, as far as the nearest of the elements behind it.
CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
ENDS_P = BLOCKS - frozenset("body caption dd dt frameset head html legend li optgroup option summary tbody td tfoot th thead title tr".split())
NAMES = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adbox|adslot|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup"
    r"|sidebar|side-bar|rail|widget|menu|navbar|navigation|nav|breadcrumbs?|pagination|pager|share|sharing|social|related|recommended|comments?|commentlist|replies|disqus|respond|masthead|toolbar|footer|site-header|page-header|topbar)(?:$|[\s_-])"
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:[!?])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?i)(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW_END = {name: re.compile(rf"(?i)</{name}(?=[\s/>]|\Z)") for name in RAW}


def marks(attributes: str) -> tuple[bool, bool]:
    """(whether the attributes mark boilerplate, whether they mark the main element)."""
    drop = main = False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role":
            drop |= value.strip().lower() in ROLES
            main |= value.strip().lower() in ("main", "article")
        elif name == "hidden":
            drop = True
        elif name == "aria-hidden":
            drop |= value.strip().lower() == "true"
        elif NAMES.search(value):
            drop = True
    return drop and not main, main


class Page:
    """One pass over a page's tags: the text blocks inside its main elements and all blocks outside boilerplate."""

    def __init__(self, html: str):
        self.inside: list[str] = []
        self.blocks: list[str] = []
        self.buffer: list[str] = []
        self.stack: list[str] = []
        #: Depths of the open elements of each name, and of those that are blocks.
        self.depths: dict[str, list[int]] = defaultdict(list)
        self.open_blocks: list[int] = []
        self.drop = self.main = 0  # depth of the stack at which the mode began; 0: off
        self.read(html)

    def flush(self) -> None:
        if self.buffer:
            text = " ".join(unescape("".join(self.buffer)).split())
            self.buffer = []
            if text:
                self.blocks.append(text)
                if self.main:
                    self.inside.append(text)

    def push(self, name: str) -> None:
        self.depths[name].append(len(self.stack))
        if name in BLOCKS:
            self.open_blocks.append(len(self.stack))
        self.stack.append(name)

    def pop(self, size: int) -> None:
        while len(self.stack) > size:
            name = self.stack.pop()
            self.depths[name].pop()
            if name in BLOCKS:
                self.open_blocks.pop()
        if self.drop and size < self.drop:
            self.drop = 0
        if self.main and size < self.main:
            self.main = 0

    def innermost(self, names) -> int:
        """Depth of the innermost open element of ``names``, or -1."""
        return max((self.depths[n][-1] for n in names if self.depths.get(n)), default=-1)

    def close(self, name: str) -> None:
        if open_ := self.depths.get(name):
            if self.open_blocks and self.open_blocks[-1] >= open_[-1] and not self.drop:
                self.flush()
            self.pop(open_[-1])

    def implied(self, name: str) -> None:
        if name in ENDS_P:
            open_ = self.depths.get("p")
            if open_ and self.open_blocks[-1] == open_[-1]:
                self.pop(open_[-1])
        elif name in CLOSES:
            ends, until = CLOSES[name]
            at = self.innermost(ends)
            if at > self.innermost(until):
                self.pop(at)

    def read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            m = TAG.search(html, at)
            end = m.start() if m else size
            if end > at and not self.drop:
                self.buffer.append(html[at:end])
            if not m:
                break
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                if name in BLOCKS and not self.drop:
                    self.flush()
                self.close(name)
                continue
            attributes = m[3] or m[6] or ""
            if name in BLOCKS:
                if not self.drop:
                    self.flush()
                self.implied(name)
            if name in VOID:
                if name == "br" and not self.drop:
                    self.buffer.append(" ")
                continue
            if name in RAW:
                stop = RAW_END[name].search(html, at)
                at = stop.start() if stop else size
                if stop:
                    at = html.find(">", stop.end()) + 1 or size
                continue
            drop, main = marks(attributes) if attributes else (False, False)
            drop |= name in DROPPED or name == "header" and not self.main
            self.push(name)
            if name in ("article", "main") or main:
                if not self.main and not self.drop:
                    self.main = len(self.stack)
            if drop and not self.drop and not (name in ("article", "main", "body", "html")):
                self.drop = len(self.stack)
        if not self.drop:
            self.flush()


def content(html: str) -> tuple[list[str], bool]:
    """(the text blocks that structure leaves, whether the page declares its main element)."""
    page = Page(html)
    return (page.inside, True) if page.inside else (page.blocks, False)


def declared_text(html: str) -> str:
    return "\n".join(content(html)[0])


class SuffixArray:
    """The sorted suffixes of a token stream and the longest common prefixes of neighbours."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        order = np.argsort(tokens)
        here = tokens[order]
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = here[1:] != here[:-1]
        # A rank is the place of its group's first member.
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        ranks, step = [rank], 1
        shared = (~fresh).astype(np.int64)  # in how many rounds a place shares its rank with the one before
        places = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))  # of suffixes that still share their rank
        while step < n and len(places):
            at = order[places]
            after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
            # Groups keep their place in the order; only their members are sorted again.
            key = rank[at] * (n + 1) + after
            again = np.argsort(key)
            at, key = at[again], key[again]
            order[places] = at
            new = np.ones(len(places), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            shared[places[~new]] += 1
            rank = rank.copy()
            rank[at] = places[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            ranks.append(rank)
            places = places[~(new & np.append(new[1:], True))]
            step *= 2
        self.order = order
        # Neighbours that share their rank in k rounds, no more, have at least 2 ** (k - 1) tokens in common and fewer than 2 ** k.
        shared = shared[1:]
        common = np.where(shared > 0, 1 << np.maximum(shared - 1, 0), 0)
        for k in range(len(ranks) - 2, -1, -1):
            i = np.flatnonzero(shared > k + 1)
            a, b = order[i] + common[i], order[i + 1] + common[i]
            inside = (a < n) & (b < n)
            same = inside & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
            common[i] += same.astype(np.int64) << k
        self.common = common


class RangeMin:
    """Minimum of values[a..b) for arrays of a and b, a < b."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.rows = np.zeros((max(1, n.bit_length()), n), dtype=np.int32)
        self.rows[0] = values
        for k in range(1, len(self.rows)):
            half = 1 << (k - 1)
            np.minimum(self.rows[k - 1, : n - 2 * half + 1], self.rows[k - 1, half : n - half + 1], out=self.rows[k, : n - 2 * half + 1])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = np.frexp((b - a).astype(float))[1] - 1
        return np.minimum(self.rows[level, a], self.rows[level, b - (1 << level.astype(np.int64))])


def two_before(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the last one before it of another owner, and the last before that of a third; -1: none."""
    n = len(owner)
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = owner[1:] != owner[:-1]
    run = np.cumsum(fresh) - 1
    q = owner[fresh]
    last = np.append(np.flatnonzero(fresh)[1:], n) - 1
    j = np.arange(len(q))
    third = np.full(len(q), -1)
    if len(q) > 2:
        third[2:] = np.where(q[2:] != q[:-2], j[:-2], -1)
        third = np.maximum.accumulate(third)  # where two owners take turns, the third is that of the run before
    one = np.where(run > 0, last[np.maximum(run - 1, 0)], -1)
    two = np.where(third[run] >= 0, last[np.maximum(third[run], 0)], -1)
    return one, two


def repeat_lengths(tokens: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For every place of the stream the length of the longest substring from there on three or more owners."""
    n = len(tokens)
    best = np.zeros(n, dtype=np.int64)
    if n < 2:
        return best
    array = SuffixArray(tokens)
    order, least = array.order, RangeMin(array.common)
    who = owner[order]

    def reach(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at places a < b; 0 where either is missing."""
        out = np.zeros(n, dtype=np.int64)
        ok = (a >= 0) & (b >= 0)
        out[ok] = least(a[ok], b[ok])
        return out

    here = np.arange(n)
    left1, left2 = two_before(who)
    r1, r2 = two_before(who[::-1])
    right1, right2 = (np.where(x >= 0, n - 1 - x, -1)[::-1] for x in (r1, r2))
    apart = (left1 >= 0) & (right1 >= 0) & (who[left1] != who[right1])
    both = np.where(apart, np.minimum(reach(left1, here), reach(here, right1)), 0)
    best[order] = np.maximum(np.maximum(reach(left2, here), reach(here, right2)), both)
    return best


def word_id(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8"), digest_size=8).digest(), "little", signed=True)


class WordIds(dict):
    """The ids of words, each computed once."""

    def __missing__(self, word: str) -> int:
        self[word] = found = word_id(word)
        return found


def fingerprints(words: list[str], known: WordIds) -> np.ndarray:
    """48 bits of the WINDOW tokens that each suffix begins with; suffixes too short have none."""
    if len(words) < WINDOW:
        return np.zeros(0, dtype=np.uint64)
    ids = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)).view(np.uint64)
    h = np.zeros(len(ids) - WINDOW + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            h = (h ^ ids[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h >> np.uint64(16)


def standings(blocks: list[str]) -> dict[str, tuple[int, int, int, int]]:
    """Each short block's first and last place, counted from the first block of the page and from the last one."""
    out: dict[str, tuple[int, int, int, int]] = {}
    n = len(blocks)
    for i, b in enumerate(blocks):
        if len(b) <= EDGE * 16 and len(b.split()) <= EDGE:
            low, _, _, end = out.get(b, (i, i, n - i, n - i))
            out[b] = (low, i, n - i, end)
    return out


def is_notice(pages: int, first: int, last: int, nearest: int, farthest: int) -> bool:
    return pages >= NOTICE_PAGES and (first == last or nearest == farthest)


def cut_blocks(blocks: list[str], declared: bool, at: np.ndarray, notice) -> list[str]:
    """``blocks`` without their boilerplate.

    ``at`` are the token places where a repeat of WINDOW tokens begins;
    ``notice`` tells whether a block always stands at the same place.
    """
    if not len(at):
        return blocks
    words = [b.split() for b in blocks]
    size = np.array([len(w) for w in words])
    first = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(blocks)), size)
    whole = spread(at, len(owner))
    full = np.bincount(owner, weights=whole, minlength=len(blocks)) == size
    if declared:
        if whole.sum() > COPIED * len(owner):
            return blocks
        a, b = 0, len(blocks)
        while a < b and full[a] and first[a + 1] <= EDGE and notice(blocks[a]):
            a += 1
        while b > a and full[b - 1] and first[-1] - first[b - 1] <= EDGE and notice(blocks[b - 1]):
            b -= 1
        return blocks[a:b]
    within = spread(at[owner[at] == owner[at + WINDOW - 1]], len(owner))
    stays = ~(within | full[owner])
    left = (b if stays[x:y].all() else " ".join(w for w, k in zip(ws, stays[x:y], strict=True) if k) for b, ws, x, y in zip(blocks, words, first[:-1], first[1:], strict=True))
    return [b for b in left if b]


def spread(at: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` tokens lie in a window that starts at one of ``at``."""
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return np.cumsum(edge)[:size] > 0


def host_texts(pages: list[tuple[list[str], bool]]) -> list[str]:
    """The texts of one host's pages, by the suffix array of their concatenated streams."""
    numbers: dict[str, int] = defaultdict(count().__next__)
    stream, lengths = [], []
    for blocks, _ in pages:
        words = " ".join(blocks).split()
        stream.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)))
        stream.append(np.array([-1 - len(lengths)]))  # an end that no other page shares
        lengths.append(len(words) + 1)
    best = repeat_lengths(np.concatenate(stream), np.repeat(np.arange(len(pages)), lengths))
    places: dict[str, list[int]] = {}
    for blocks, _ in pages:
        for b, (low, high, near, far) in standings(blocks).items():
            n, low0, high0, near0, far0 = places.get(b, (0, low, high, near, far))
            places[b] = [n + 1, min(low, low0), max(high, high0), min(near, near0), max(far, far0)]
    notices = {b for b, p in places.items() if is_notice(*p)}
    out, at = [], 0
    for (blocks, declared), size in zip(pages, lengths, strict=True):
        out.append("\n".join(cut_blocks(blocks, declared, np.flatnonzero(best[at : at + size] >= WINDOW), notices.__contains__)))
        at += size
    return out


def one_group(pages: pa.Table) -> pa.Table:
    texts = host_texts(list(zip(pages.column("blocks").to_pylist(), pages.column("declared").to_pylist(), strict=True)))
    return pa.table({"page_id": pages.column("page_id"), "url": pages.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def at_most(keys: np.ndarray, times: int) -> np.ndarray:
    """Sorted keys without what goes beyond ``times`` copies of one."""
    return keys[np.append(np.ones(min(times, len(keys)), dtype=bool), keys[times:] != keys[:-times])]


#: The places of a short block over some pages: its key, the pages, and the bounds that ``standings`` names.
PLACES = np.dtype([("block", "<i8"), *((f, "<i4") for f in ("pages", "first", "last", "nearest", "farthest"))])


def merged_places(rows: np.ndarray) -> np.ndarray:
    """One row for each block."""
    rows = rows[np.argsort(rows["block"])]
    begin = np.flatnonzero(np.append(True, rows["block"][1:] != rows["block"][:-1])[: len(rows)])
    out = rows[begin]
    if len(rows):
        for field, fold in (("pages", np.add), ("first", np.minimum), ("last", np.maximum), ("nearest", np.minimum), ("farthest", np.maximum)):
            out[field] = fold.reduceat(rows[field], begin)
    return out


def split_beginnings(batches):
    """(host, part, keys, places) of a split of large hosts, read once.

    keys: each suffix's beginning, once for each of up to LEAST_PAGES pages;
    places: those of the short blocks, which are named by a 64-bit key.
    """
    known = WordIds()
    for batch in slices(batches):
        if len(known) > 1_000_000:
            known.clear()
        found: dict[tuple, tuple[list[np.ndarray], list[tuple]]] = defaultdict(lambda: ([], []))
        for host, parts, html in zip(*(batch.column(c).to_pylist() for c in ("host", "parts", "html")), strict=True):
            blocks = content(html)[0]
            keys, places = found[host, parts]
            keys.append(at_most(np.sort(fingerprints(" ".join(blocks).split(), known)), 1))
            places += [(word_id(b), 1, *place) for b, place in standings(blocks).items()]
        rows = []
        for (host, parts), (keys, places) in found.items():
            keys = at_most(np.sort(np.concatenate(keys)), LEAST_PAGES)
            places = merged_places(np.array(places, dtype=PLACES))
            part, of_place = keys % np.uint64(parts), places["block"].view(np.uint64) % np.uint64(parts)
            rows += [(host, int(k), packed(keys[part == k]), places[of_place == k].tobytes()) for k in np.union1d(part, of_place)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["host", "part", "keys", "places"])


def packed(keys: np.ndarray) -> bytes:
    """Six bytes a key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def repeated_keys(blobs: pa.Table) -> pa.Table:
    """Of one part the beginnings that stand on LEAST_PAGES pages or more, and the blocks that are notices."""
    keys, counts = np.unique(np.concatenate([unpacked(b) for b in blobs.column("keys").to_pylist()]), return_counts=True)
    keys = keys[counts >= LEAST_PAGES]
    places = merged_places(np.frombuffer(b"".join(blobs.column("places").to_pylist()), dtype=PLACES))
    notices = [block for block, *place in places[places["pages"] >= NOTICE_PAGES].tolist() if is_notice(*place)]
    found = pa.table({"host": pa.array([blobs.column("host")[0].as_py()], pa.string()), "keys": pa.array([packed(keys)], pa.binary()), "notices": pa.array([notices], pa.list_(pa.int64()))})
    return found.slice(0, min(1, len(keys) + len(notices)))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text and its length in code points."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    out = f"page_id {kind}, url string, text string, n_chars long"
    rows = rows.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    work = WorkTables(spark, "html")
    # At most one row for each SHARD_BYTES of html.
    large, _ = work.save(rows.groupBy("host").agg(F.ceil(F.sum(F.octet_length("html")) / SHARD_BYTES).cast("int").alias("parts")).where("parts > 1"), files=1)
    dealt = rows.join(F.broadcast(large), "host", "left")

    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [content(h) for h in batch.column("html").to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array([b for b, _ in found], pa.list_(pa.string())), pa.array([d for _, d in found], pa.bool_())],
                ["page_id", "url", "host", "blocks", "declared"],
            )

        return step

    small = map_rows(dealt.where("parts IS NULL").drop("parts"), build, f"page_id {kind}, url string, host string, blocks array<string>, declared boolean")
    whole = small.groupBy("host").applyInArrow(one_group, out)
    if large.isEmpty():
        return whole
    big = dealt.where("parts IS NOT NULL")
    blobs = map_batches(big.select("host", "parts", "html"), split_beginnings, "host string, part int, keys binary, places binary")
    repeats, _ = work.save(blobs.groupBy("host", "part").applyInArrow(repeated_keys, "host string, keys binary, notices array<long>"))
    size = repeats.agg(F.sum(F.octet_length("keys") + 8 * F.size("notices"))).first()[0] or 0
    return whole.unionByName((_cut_by_broadcast if size <= BROADCAST_BYTES else _cut_by_join)(big, repeats, work, out))


def _cut_by_broadcast(big: DataFrame, repeats: DataFrame, work: WorkTables, out: str) -> DataFrame:
    found: dict[str, list[np.ndarray]] = {}
    named: dict[str, set[int]] = {}
    for r in repeats.collect():
        found.setdefault(r["host"], []).append(unpacked(bytes(r["keys"])))
        named.setdefault(r["host"], set()).update(r["notices"])
    sent = big.sparkSession.sparkContext.broadcast(({h: np.sort(np.concatenate(k)) for h, k in found.items()}, named))

    def build():
        (repeated, named), known = sent.value, WordIds()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            if len(known) > 1_000_000:
                known.clear()
            texts = []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                blocks, declared = content(html)
                hits = among(fingerprints(" ".join(blocks).split(), known), repeated.get(host))
                mine = named.get(host, ())
                texts.append("\n".join(cut_blocks(blocks, declared, np.flatnonzero(hits), lambda b, mine=mine: word_id(b) in mine)))
            return page_rows(batch, texts)

        return step

    return map_rows(big, build, out)


def among(keys: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """Which of ``keys`` stand in the sorted array ``known``."""
    if known is None or not len(known):
        return np.zeros(len(keys), dtype=bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def page_rows(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _cut_by_join(big: DataFrame, repeats: DataFrame, work: WorkTables, out: str) -> DataFrame:
    """The same by joins: a page's keys with the repeated ones of its host, then its hits back to the page."""

    def explode(batches):
        for batch in slices(batches):
            known = WordIds()
            for host, page, html in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
                blocks = content(html)[0]
                keys = np.concatenate([fingerprints(" ".join(blocks).split(), known).view(np.int64), np.array([word_id(b) for b in blocks], dtype=np.int64)])
                n = len(keys) - len(blocks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([host] * len(keys), pa.string()), pa.array([page] * len(keys), pa.int64()), pa.array([*range(n), *range(len(blocks))], pa.int32()), pa.array(np.arange(len(keys)) >= n), pa.array(keys)],
                    ["host", "page", "at", "of_block", "key"],
                )

    def unpack(batches):
        for batch in slices(batches):
            for host, data in zip(batch.column("host").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                keys = unpacked(data).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(keys), pa.string()), pa.array([False] * len(keys)), pa.array(keys)], ["host", "of_block", "key"])

    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = []
            for html, at, fixed in zip(*(batch.column(c).to_pylist() for c in ("html", "hits", "fixed")), strict=True):
                blocks, declared = content(html)
                named = {blocks[i] for i in fixed or []}
                texts.append("\n".join(cut_blocks(blocks, declared, np.array(sorted(at or []), dtype=np.int64), named.__contains__)))
            return page_rows(batch, texts)

        return step

    # Equal html of one host has equal hits, so a digest names a page.
    named = big.withColumn("page", F.xxhash64("host", "html"))
    once = named.groupBy("page").agg(F.first("host").alias("host"), F.first("html").alias("html"))
    notices = repeats.select("host", F.lit(True).alias("of_block"), F.explode("notices").alias("key"))
    keys = map_batches(repeats.select("host", "keys"), unpack, "host string, of_block boolean, key long").unionByName(notices)
    found = map_batches(once.select("host", "page", "html"), explode, "host string, page long, at int, of_block boolean, key long").join(keys, ["host", "of_block", "key"])
    at = F.col("at")
    hits, _ = work.save(found.groupBy("page").agg(F.collect_list(F.when(~F.col("of_block"), at)).alias("hits"), F.collect_list(F.when(F.col("of_block"), at)).alias("fixed")))
    return map_rows(named.join(hits, "page", "left"), build, out)
