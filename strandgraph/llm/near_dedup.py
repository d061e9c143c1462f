"""MinHash near-duplicates: universal hash minima, banding, verification, star components.

1. One pass makes each text's word sequence digest, the number of its distinct
   five-word shingles, ``BANDS`` band keys of ``ROWS`` universal hash minima
   each, and a sketch of one byte per minimum.
2. Texts with equal word sequences form a class; only one row of each class
   goes on, so a group of exact copies costs what one text costs.
3. Within each band bucket every class is compared with the bucket's hub, the
   class that shares the most bucket places with others (a star, linear in the
   bucket; the hub of a family of copies is the copy nearest to all).  The
   sketch estimate discards pairs far below the threshold, and the full shingle
   sets decide about the others.
4. Components of the confirmed links come from alternating large-star and
   small-star.  Buckets that still hold several components are searched again:
   each class outside the hub's component is held against the members of the
   other components.  A bound from their overlaps with the hub and the sketches
   leaves few pairs, each taken up in the first band whose key it shares; the full
   sets decide about them too.  So no link between different texts is lost to
   the star, and nothing inside a component is compared twice.  A large bucket
   is dealt in blocks of members; no pairs but the surviving ones are emitted.

Iterations are cut by tables in the shared checkpoint folder.  No list of
documents, links or components reaches the driver.

At similarity 0.75 a pair shares no band with probability (1 - 0.75^ROWS)^BANDS,
about 2e-6.

Defined results: a null or empty text, or one of white space only, has an empty
set and is linked with nothing; rows that share a doc_id are one node; a null
doc_id takes no part (component_id null, kept true); repeated rows give repeated
results; empty tables give empty results; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandgraph.llm.common import WorkTables, fresh, keeps, map_batches, map_rows, slices
from strandgraph.operators.component import star_components

SHINGLE, THRESHOLD = 5, 75
BANDS, ROWS = 48, 5
BANDED, HASHES = BANDS * ROWS, 960
#: Sketch estimates below this are no links: four and a half standard deviations under the threshold.
ESTIMATE, DEVIATION = 0.687, 0.073
BLOCK = 4096
SLICE = 1 << 20

_rng = np.random.default_rng(20240607)
BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
ORDER = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}
keeps(__name__, _powers.clear)


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n at least; kept per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, SLICE + 4096), dtype=np.uint64)
        with np.errstate(over="ignore"):
            have[1:] = np.cumprod(np.full(len(have) - 1, base, dtype=np.uint64))
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, its start) of a byte array, by one prefix sum over the bytes."""
    space = SPACES[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[data] * powers(BASE, len(data)))])
        h = (total[end] - total[start]) * powers(INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64)
    return mix(h), start


def words_of(data: bytes) -> np.ndarray:
    """Word hashes of one text, made slice by slice so that memory stays a few times the text."""
    if len(data) <= SLICE:
        return word_hashes(np.frombuffer(data, dtype=np.uint8))[0]
    out, at = [], 0
    array = np.frombuffer(data, dtype=np.uint8)
    while at < len(data):
        stop = min(len(data), at + SLICE)
        while stop < len(data) and not SPACES[array[stop]]:
            stop += 1
        out.append(word_hashes(array[at:stop])[0])
        at = stop
    return np.concatenate(out)


def shingles(words: np.ndarray) -> np.ndarray:
    """A hash of each run of SHINGLE words, or of all words if there are fewer."""
    n = len(words) - SHINGLE + 1
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        if n < 1:
            return mix((words * ORDER[: len(words)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(words)))
        h = words[:n] * ORDER[0]
        for k in range(1, SHINGLE):
            h = h + words[k : k + n] * ORDER[k]
    return mix(h)


def lowered(text: str) -> bytes:
    return text.encode("utf-8").translate(LOWER)


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingles(words_of(lowered(text))))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= THRESHOLD * union, over sorted sets."""
    if 100 * min(len(a), len(b)) < THRESHOLD * max(len(a), len(b)):
        return False
    both = int(np.isin(a, b, assume_unique=True).sum())
    return both > 0 and 100 * both >= THRESHOLD * (len(a) + len(b) - both)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The HASHES minima of each non-empty shingle array, as rows."""
    keys = np.concatenate(sets)
    keys = (keys >> np.uint64(32)).astype(np.uint32)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), HASHES), dtype=np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(keys * FACTORS[k] + SHIFTS[k], first)
    return out


def minima_of(s: np.ndarray) -> np.ndarray:
    """Minima of one long array, piece by piece."""
    rows = [minima([s[i : i + SLICE]]) for i in range(0, len(s), SLICE)]
    return np.minimum.reduce(rows)


def band_keys(rows: np.ndarray) -> np.ndarray:
    parts = rows[:, :BANDED].reshape(len(rows), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = np.broadcast_to(h, parts.shape[:2])
        for k in range(ROWS):
            h = mix(h ^ parts[:, :, k])
    return h.view(np.int64)


def sketch_of(row: np.ndarray) -> bytes:
    """One byte of each minimum, mixed first: minima of large sets are small, so their own bits take few values."""
    return ((row * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def describe(texts: list[str]) -> tuple[list, list, list, list, list]:
    """(digest halves, set sizes, band keys, sketches) of texts; empty sets have null digests."""
    low, high, sizes, bands, sketches = [], [], [], [None] * len(texts), [None] * len(texts)
    group, members, total = [], [], 0

    def finish():
        nonlocal group, members, total
        if group:
            rows = minima(group)
            keys = band_keys(rows)
            for i, key, row in zip(members, keys, rows, strict=True):
                bands[i] = key
                sketches[i] = sketch_of(row)
        group, members, total = [], [], 0

    for i, text in enumerate(texts):
        words = words_of(lowered(text))
        if not len(words):
            low.append(None), high.append(None), sizes.append(0)
            continue
        d = np.frombuffer(blake2b(words.tobytes(), digest_size=16).digest(), dtype=np.int64)
        low.append(int(d[0])), high.append(int(d[1]))
        s = shingles(words)
        sizes.append(len(np.unique(s)))
        if len(s) > SLICE:
            row = minima_of(s)
            bands[i], sketches[i] = band_keys(row)[0], sketch_of(row[0])
            continue
        group.append(s)
        members.append(i)
        total += len(s)
        if total > 200_000:
            finish()
    finish()
    return low, high, sizes, bands, sketches


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, low, high, n, bands, sketch) of every row."""

    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            low, high, sizes, bands, sketches = describe([t or "" for t in batch.column(1).to_pylist()])
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "low", "high", "n", "bands", "sketch"],
            )

        return step

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), build, "doc_id long, low long, high long, n long, bands array<long>, sketch binary")


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches do not rule out a link."""
    sketch = classes.select("node", "sketch")
    both = pairs.join(sketch.toDF("b", "sketch_b"), "b").join(sketch.toDF("a", "sketch_a"), "a")

    def build():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, HASHES) for c in ("sketch_a", "sketch_b"))
            keep = np.concatenate([(x[i : i + 4096] == y[i : i + 4096]).mean(axis=1) >= ESTIMATE for i in range(0, len(x), 4096)])
            return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

        return step

    return map_rows(both.select("a", "b", "sketch_a", "sketch_b"), build, "a long, b long")


#: Ids of the texts to fetch are broadcast to the documents if they are at most so many; beyond that both are shuffled.
BROADCAST_IDS = 1_000_000
#: Pairs of one first member that are compared in one place.
GROUP = 2000


def confirmed(pairs: DataFrame, docs: DataFrame, work: WorkTables) -> DataFrame:
    """The pairs (a, b) whose full shingle sets pass the threshold.

    A pair's second text travels to its first one's group; the first text is
    sent once a group, not once a pair, and large groups are salted.
    """
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts, _ = work.save(docs.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes, "node"))
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    members = (
        pairs.join(groups, "a")
        .select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
        .join(texts.withColumnRenamed("node", "b"), "b")
        .select("a", "salt", "b", "text")
    )
    heads = groups.join(texts.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    dealt = heads.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return map_batches(dealt, compared, "a long, b long")


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group; its rows come sorted, the first member's text, which has no b, in front."""
    now, heads = None, []
    for batch in slices(batches):
        lefts, rights = [], []
        for a, salt, b, text in zip(*(batch.column(k).to_pylist() for k in ("a", "salt", "b", "text")), strict=True):
            if (a, salt) != now:
                now, heads = (a, salt), []
            found = shingle_set(text)
            if b is None:
                heads.append(found)
            elif any(similar(h, found) for h in heads):
                lefts.append(a)
                rights.append(b)
        if lefts:
            yield pa.RecordBatch.from_arrays([pa.array(lefts, pa.int64()), pa.array(rights, pa.int64())], ["a", "b"])


def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that may link different components; rows come sorted by band, block of members and chunk of seekers.

    A group's rows are the bucket's hub, classes outside the hub's component as
    seekers and members (role 1), seekers only (2) or members only (4), and the
    other members (0); a hub that is no member of the block has role 3.
    """
    parts: list[dict] = []

    def finish() -> tuple[list[int], list[int]]:
        if not parts:
            return [], []
        g = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        parts.clear()
        return block_pairs(**g)

    last, lefts, rights = None, [], []
    for batch in slices(batches):
        cols = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("node", "c", "n", "role", "is_hub", "band", "block", "chunk")}
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, HASHES)
        bands = batch.column("bands").flatten().to_numpy().reshape(-1, BANDS)
        key = np.stack([cols.pop("band"), cols.pop("block"), cols.pop("chunk")])
        cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        for lo, hi in zip([0, *cut], [*cut, len(sketch)], strict=True):
            now = tuple(key[:, lo])
            if now != last:
                a, b = finish()
                lefts += a
                rights += b
                last = now
            parts.append({k: v[lo:hi] for k, v in cols.items()} | {"sketch": sketch[lo:hi], "bands": bands[lo:hi], "band_at": batch.column("at").to_numpy()[lo:hi]})
        if len(lefts) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(lefts, pa.int64()), pa.array(rights, pa.int64())], ["a", "b"])
            lefts, rights = [], []
    a, b = finish()
    if lefts or a:
        yield pa.RecordBatch.from_arrays([pa.array(lefts + a, pa.int64()), pa.array(rights + b, pa.int64())], ["a", "b"])


def block_pairs(node, c, n, role, is_hub, sketch, bands, band_at) -> tuple[list[int], list[int]]:
    """The pairs of one block that the bounds leave."""
    hub = int(np.flatnonzero(is_hub)[0])
    seek, held = np.flatnonzero((role == 1) | (role == 2)), np.flatnonzero((role < 2) | (role == 4))
    if not len(seek) or not len(held):
        return [], []
    band = int(band_at[0])
    # Overlap of each set with the hub's, as an interval around its estimate.
    j = (sketch == sketch[hub]).mean(axis=1)
    low, high = np.clip(j - DEVIATION, 0, 1), np.clip(j + DEVIATION, 0, 1)
    low[hub] = high[hub] = 1.0
    both = n + n[hub]
    low, high = low * both / (1 + low), np.minimum(high * both / (1 + high), np.minimum(n, n[hub]))
    lefts, rights = [], []
    for x in seek:
        other = held[(c[held] != c[x])]
        # Two seekers meet once, from the smaller one.
        other = other[(role[other] == 0) | (node[other] > node[x])]
        least, most = np.minimum(n[other], n[x]), np.maximum(n[other], n[x])
        shared = np.minimum(least, np.minimum(high[other], high[x]) + np.minimum(n[other] - low[other], n[x] - low[x]))
        other = other[(100 * least >= THRESHOLD * most) & (100 * shared >= THRESHOLD * (n[other] + n[x] - shared))]
        for at in range(0, len(other), 4096):
            part = other[at : at + 4096]
            part = part[(sketch[part] == sketch[x]).mean(axis=1) >= ESTIMATE]
            if len(part):
                # The pair belongs to the first band whose key it shares; bytes of the sketches may agree where keys do not.
                part = part[(bands[part] == bands[x]).argmax(axis=1) == band]
                lefts += np.minimum(node[part], node[x]).tolist()
                rights += np.maximum(node[part], node[x]).tolist()
    return lefts, rights


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, low and high (word sequence digest), n_shingles, component_id, kept."""
    work = WorkTables(docs.sparkSession, "near")
    rows, _ = work.save(signatures(docs, id_col, text_col))
    live = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    members, _ = work.save(live.groupBy("low", "high").agg(F.min("doc_id").alias("node"), F.ceil(F.count("*") / GROUP).cast("int").alias("salts")))
    classes, _ = work.save(live.groupBy("low", "high").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).drop("low", "high"))
    in_band = classes.select("node", F.col("n").cast("int").alias("n"), F.posexplode("bands").alias("at", "band"))
    sizes = in_band.groupBy("band").agg(F.count("*").cast("int").alias("size")).where("size > 1")
    shared, _ = work.save(in_band.join(sizes, "band"))
    standing = shared.groupBy("node").agg(F.sum("size").alias("standing"))
    ranked = shared.join(standing, "node")
    hubs = ranked.groupBy("band").agg(F.max(F.struct("standing", (-F.col("node")).alias("minus"), "n")).alias("h")).select("band", (-F.col("h.minus")).alias("hub"), F.col("h.n").alias("hub_n"))
    buckets = shared.join(hubs, "band")
    sizes_fit = 100 * F.least("n", "hub_n") >= THRESHOLD * F.greatest("n", "hub_n")
    stars = buckets.where((F.col("node") != F.col("hub")) & sizes_fit).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    text_of = docs.select(F.col(id_col).cast("long").alias("node"), F.coalesce(text_col, F.lit("")).alias("text")).where(F.col("node").isNotNull())
    likely, _ = work.save(estimated(stars, classes))
    links, _ = work.save(confirmed(likely, text_of, work).distinct())
    component = star_components(links, work)
    # Buckets that still hold several components.
    owner = component.select("node", "component")
    tagged = (
        buckets.join(owner.toDF("node", "c"), "node", "left")
        .join(owner.toDF("hub", "hub_c"), "hub", "left")
        .select("band", "at", "node", "n", "size", (F.col("node") == F.col("hub")).alias("is_hub"), F.coalesce("c", "node").alias("c"), F.coalesce("hub_c", "hub").alias("hub_c"))
    )
    outside = F.col("c") != F.col("hub_c")
    mixed = tagged.where(outside).groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    open_ = tagged.join(mixed, "band").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    open_ = open_.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int"))
    # A task sees one block of members and one chunk of seekers: members stand in their own block for every chunk,
    # seekers in their own chunk for every block, the hub everywhere.
    blocks, chunks = F.sequence(F.lit(0), F.col("blocks") - 1), F.sequence(F.lit(0), F.col("chunks") - 1)
    place = lambda block, chunk: F.struct(block.alias("block"), chunk.alias("chunk"))
    as_member = F.transform(chunks, lambda i: place(F.col("own"), i))
    as_seeker = F.transform(blocks, lambda j: place(j, F.col("mine")))
    everywhere = F.flatten(F.transform(blocks, lambda j: F.transform(chunks, lambda i: place(j, i))))
    at_home = F.col("place.block") == F.col("own")
    role = F.when(~outside, F.when(at_home, 0).otherwise(3)).when(at_home, F.when(F.col("place.chunk") == F.col("mine"), 1).otherwise(4)).otherwise(2)
    dealt = (
        open_.withColumn("place", F.explode(F.when(F.col("is_hub"), everywhere).when(outside, F.array_union(as_member, as_seeker)).otherwise(as_member)))
        .withColumn("role", role)
        .select("band", F.col("place.block").alias("block"), F.col("place.chunk").alias("chunk"), "at", "node", "c", "n", "role", "is_hub")
    )
    dealt = dealt.join(classes.select("node", "sketch", "bands"), "node")
    crossed = map_batches(dealt.repartition("band", "block", "chunk").sortWithinPartitions("band", "block", "chunk"), crossing, "a long, b long")
    more, _ = work.save(crossed.distinct().join(likely, ["a", "b"], "left_anti").join(likely.toDF("b", "a"), ["a", "b"], "left_anti"))
    if not more.isEmpty():
        links2, _ = work.save(links.union(confirmed(more, text_of, work)).distinct())
        component = star_components(links2, work)
    named = members.join(component, "node", "left").select("low", "high", F.coalesce("component", "node").alias("component"), "salts")
    # All copies of one text share a key: large groups, of which there are few, are salted.
    hot = members.where("salts > 1").select("low", "high", F.col("salts").alias("parts"))
    few = hot.count() <= BROADCAST_IDS
    marked = rows.join(F.broadcast(hot) if few else hot, ["low", "high"], "left").withColumn("salt", F.coalesce(F.floor(F.rand(5) * F.col("parts")), F.lit(0)).cast("int"))
    spread = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    joined = marked.select("doc_id", "low", "high", F.col("n").alias("n_shingles"), "salt").join(spread, ["low", "high", "salt"], "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "low", "high", "n_shingles", found.alias("component_id"), (F.col("doc_id").isNull() | F.coalesce(F.col("doc_id") == found, F.lit(False))).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that of the component's smallest id, and of its rows the first by digest."""
    names = docs.columns
    kept_id, row = fresh("kept_id", names), fresh("row", names)
    found = near_duplicates(docs, id_col, text_col).where(F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(kept_id)).distinct()
    kept = docs.join(found, docs[id_col].cast("long") == F.col(kept_id), "left_semi")
    first = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col), F.xxhash64(*[F.col(f"`{n}`") for n in names]))
    single = kept.withColumn(row, F.row_number().over(first)).where(F.col(row) == 1).select(*[F.col(f"`{n}`") for n in names])
    return single.union(docs.where(F.col(id_col).isNull()))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS sh FROM d WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
