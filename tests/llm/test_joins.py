"""Search, decontamination, near-duplicates against brute force."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandgraph.llm import decontam, near_dedup, topk

WORDS = [f"w{i}" for i in range(400)]


# -- top-k -------------------------------------------------------------------------------


def brute_top(rows, k=10, every=100):
    """Sorted (query_id, rank, vec_id, score) rows; a score beyond 64 bits is the nearest long."""
    vectors = [(i, [math.floor(Fraction(float(x)) * 1024) for x in v]) for i, v in rows if i is not None and v and not any(x is None or not np.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(vectors):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for n, (i, b) in enumerate(vectors) if n != at and len(a) == len(b))
            out += [(q, r + 1, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found_top(table, **more):
    return sorted(tuple(x) for x in topk.top_k(table, **more).select("query_id", "rank", "vec_id", "score").collect())


def test_topk(spark):
    r = random.Random(4)
    rows = [(i, [float(np.float32(r.gauss(0, 1))) for _ in range(8)]) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)]  # ties
    rows += [(2000, None), (2001, []), (2002, [None] + [0.1] * 7), (2003, [float("nan")] * 8), (2100, [float("inf")] * 8), (2200, [1.0, 2.0]), (2201, [1.0, 1.0]), (None, [0.1] * 8)]
    rows += rows[:5]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    assert found_top(table) == brute_top(rows)


def test_topk_of_any_finite_size(spark):
    r = random.Random(6)
    rows = [(i, [r.choice([3e6, -3e6, 1e13, -1e13, 0.25, 1e150, 1e305, -1.7e308, 5e-324, 1023.9, 1024.0]) * (1 if r.random() < 0.3 else r.random()) for _ in range(6)]) for i in range(300)]
    rows += [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(300, 600)]
    rows += [(1000, [3e6] * 64), (1100, [3e6] * 64), (1101, [1.0] * 64), (1100, [1.0] * 64)]  # vec_ids that rows share
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found_top(table) == brute_top(rows)
    keys = sorted([0, 1, -1, 255, 256, -255, -256, 1 << 70, -(1 << 70), 12345, -12345])
    assert sorted(keys, key=topk.order_key) == keys


def test_topk_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 2000)
    r = random.Random(5)
    rows = [(i, [r.random() for _ in range(4)]) for i in range(0, 2000, 20)]
    assert found_top(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3) == brute_top([(i, [float(np.float32(x)) for x in v]) for i, v in rows], k=3)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert topk.top_k(spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<float>")).count() == 0


# -- decontamination -----------------------------------------------------------------------


def word_list(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    out, word = [], ""
    for c in low + " ":
        if ord(c) < 0x30 or 0x3A <= ord(c) <= 0x60 or 0x7B <= ord(c) <= 0x7F:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def brute_hits(text, items):
    w, hit, found = word_list(text), set(), set()
    for item, t in items:
        b = word_list(t)
        k = min(8, len(b))
        for i in range(len(b) - k + 1 if b else 0):
            for s in range(len(w) - k + 1):
                if w[s : s + k] == b[i : i + k]:
                    hit |= set(range(s, s + k))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("small", [True, False])
def test_decontamination(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    r = random.Random(6)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.choice([3, 8, 12, 30])))) for i in range(25)] + [(90, None), (91, "!!"), (0, "extra text of item zero with more than eight words in it"), (92, "Ünï wörd")]
    docs = []
    for i in range(80):
        w = [r.choice(WORDS) for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 3)):
            b = r.choice([t for _, t in items if t]).split()
            a = r.randint(0, len(b))
            at = r.randint(0, len(w))
            w[at:at] = b[max(0, a - 9) : a] if r.random() < 0.3 else b
        docs.append((i, r.choice([" ", "  ", ", "]).join(w).upper() if r.random() < 0.3 else " ".join(w)))
    docs += [(200, None), (201, ""), (202, "ÜNÏ wörd und ünï WÖRD"), (0, docs[1][1]), (5, docs[5][1]), (None, items[3][1] + " . " + items[4][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("w", F.lit(2))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.find_contamination(d, b).collect())
    from hashlib import sha256

    want = []
    for i, t in docs:
        n, h, f = brute_hits(t, items)
        want.append((i if i is not None else -1, n, h, len(f), sha256(",".join(f).encode()).hexdigest(), len(f) >= 2))
    assert got == sorted(want)
    kept = decontam.drop_contaminated(d, b)
    assert kept.columns == d.columns and kept.count() == sum(not w[-1] for w in want)


def test_decontamination_empty(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_words"], r["n_items"]) for r in decontam.find_contamination(d, none).collect()] == [(3, 0)]
    assert decontam.find_contamination(d.where("false"), none).count() == 0


# -- near-duplicates ---------------------------------------------------------------------------


def plain_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(docs):
    sets = [plain_set(t) for _, t in docs]
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(docs[a][0]), find(docs[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for (i, _), s in zip(docs, sets, strict=True))


@pytest.mark.parametrize("block", [4096, 7])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    if block == 7:
        monkeypatch.setattr(near_dedup, "GROUP", 2)
    r = random.Random(7)
    docs, i = [], 0
    for _ in range(12):
        base = [r.choice(WORDS) for _ in range(r.choice([4, 20, 60, 150]))]
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5, 8])):
                w[r.randrange(len(w))] = r.choice(WORDS)
            docs.append((i, r.choice([" ", "\n", "  "]).join(w)))
            i += 1
    docs += [(i + 10 + k, "many copies of the very same short text") for k in range(9)]
    docs += [(i, None), (i + 1, ""), (i + 2, " \t "), (i + 3, "one"), (i + 4, "ONE"), (i + 5, "É x"), (i + 6, "é x")]
    r.shuffle(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("component_id", F.lit("clash")).withColumn("__row", F.lit(7)).withColumn("kept_id", F.lit(8)).withColumn("row", F.lit(9))
    got = sorted(tuple(x) for x in near_dedup.near_duplicates(table).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == brute_components(docs)
    kept = near_dedup.keep_one(table)
    assert kept.columns == table.columns
    assert {(x["__row"], x["kept_id"], x["row"]) for x in kept.collect()} == {(7, 8, 9)}
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(i for i, _, _, k in brute_components(docs) if k)


def test_near_duplicates_edges(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(0, None, True), (1, 1, True), (3, 1, False), (3, 1, False)]
    assert sorted(r["doc_id"] or 0 for r in near_dedup.keep_one(docs).collect()) == [0, 1]


def test_sketch_estimates(spark):
    base = " ".join(WORDS[:300])
    texts = [base, base.replace("w10 ", "q "), " ".join(WORDS[100:400])]
    _, _, _, bands, sketches = near_dedup.describe(texts)
    e = lambda a, b: np.mean(np.frombuffer(sketches[a], np.uint8) == np.frombuffer(sketches[b], np.uint8))
    j = lambda a, b: len(plain_set(texts[a]) & plain_set(texts[b])) / len(plain_set(texts[a]) | plain_set(texts[b]))
    assert abs(e(0, 1) - j(0, 1)) < 0.1 and abs(e(0, 2) - j(0, 2)) < 0.1
    long = np.arange(3_000_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (near_dedup.minima_of(long) == near_dedup.minima([long])).all()
    data = ("word " * 300_000 + "x").encode()
    assert (near_dedup.words_of(data) == near_dedup.word_hashes(np.frombuffer(data, np.uint8))[0]).all()


def test_pairs_belong_to_a_band_they_share():
    sketch = np.tile(np.arange(near_dedup.HASHES, dtype=np.int64).astype(np.uint8), (2, 1))
    sketch[1, 20 * near_dedup.ROWS :: 5] += 1
    bands = np.stack([np.arange(near_dedup.BANDS), np.arange(near_dedup.BANDS)])
    bands[1, :7] += 1000  # the bytes agree in the bands before the first shared one
    role, hub = np.array([0, 1]), np.array([True, False])
    block = lambda at: near_dedup.block_pairs(np.array([3, 5]), np.array([3, 5]), np.array([90, 90]), role, hub, sketch, bands, np.array([at, at]))
    assert [block(at) for at in (0, 7, 8)] == [([], []), ([3], [5]), ([], [])]


def test_sketch_bytes_of_small_minima():
    r = np.random.default_rng(3)
    a, b = (np.frombuffer(near_dedup.sketch_of(r.integers(0, 4000, 20_000, dtype=np.uint32)), np.uint8) for _ in range(2))
    assert (a == b).mean() < 0.01
