"""Classifiers: held-out accuracy on the labelled documents, and defined results at the edges."""

import zlib

import numpy as np
import pytest

from strandgraph.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def held_out(spark, column, modulus, fold):
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % modulus == fold}


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in quality.judge_quality(docs, labels).collect()}
    assert len(rows) == docs.count()
    test = held_out(spark, "quality", 5, 0)
    assert all(rows[i]["held_out"] for i in test)
    assert np.mean([rows[i]["predicted"] == y for i, y in test.items()]) >= 0.95


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in toxicity.judge_toxicity(docs, labels).collect()}
    test = held_out(spark, "toxic", 3, 1)
    assert np.mean([rows[i]["predicted"] == y for i, y in test.items()]) >= 0.95
    assert np.mean([rows[i]["predicted"] for i, y in test.items() if not y]) <= 0.02


def test_gaps_and_inserted_characters():
    sample = [(f"you {w} thing, really {w} indeed {i}", 1) for i in range(20) for w in ("idiot", "stupid", "moron")]
    sample += [(f"you calm thing, really calm indeed {i}, a text about weather and trees and closing words", 0) for i in range(150)]
    model = toxicity.fit(sample)
    for disguised in ("idiot", "i.d.i.o.t", "id-iot", "stuupid", "STUPID!", "s t u p i d", "mo*ron"):
        assert model.document_features([f"so you {disguised} there"])[0, 0] > 0, disguised
    for clean in ("weather", "trees", "calm", "words"):
        assert model.document_features([f"so you {clean} there"])[0, 0] == 0, clean


def test_kernel_against_all_subsequences():
    import itertools
    import random

    r = random.Random(3)
    for _ in range(200):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(0, 9))) for _ in range(2))

        def weights(s):
            out = {}
            for at in itertools.combinations(range(len(s)), 3):
                if at[1] - at[0] <= toxicity.REACH and at[2] - at[1] <= toxicity.REACH:
                    key = "".join(s[i] for i in at)
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (at[2] - at[0] + 1)
            return out

        x, y = weights(a), weights(b)
        inner = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
        want = inner(x, y) / (inner(x, x) * inner(y, y)) ** 0.5 if x and y else 0
        assert abs(toxicity.similarity(toxicity.unit_vector(a), toxicity.unit_vector(b)) - want) < 1e-9


def test_a_sentence_meets_a_landmark_in_its_windows():
    model = toxicity.ToxicSvm(["^idiot$", "^moron$"], 2)
    text = "What an idiot. And a mo-ron, an idiiot! Fine weather."
    model.compare({w for s in toxicity.SENTENCE.split(text.lower()) for w in model.windows(s)})
    first, second = (np.max(x, axis=0) for x in model.sentences(text))
    assert abs(first[0] - 1) < 1e-9 and first[1] < 0.5 and abs(second[1] - 1) < 1e-9 and 0.5 < second[0] < 1


def test_bound_keeps_every_match():
    model = toxicity.ToxicSvm(["^idiot$", "^moron$", "^stup"], 3)
    words = [toxicity.marked(w) for w in ("idiot", "idiiot", "morons", "m-o-r-o-n", "stupid", "weather", "xyz", "idi")]
    may = model.may_match(words)
    for w, m in zip(words, may, strict=True):
        assert m or model.kernels(w).max() < toxicity.MIN_SIMILARITY


def wide_model(rng):
    m = quality.ByteCnn()
    m.w["top"] = rng.normal(0, 0.3, len(m.w["top"]))
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    return m


def test_gradient():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(32, 120, n, dtype=np.uint8)) for n in (30, 400, 900)] + [b"la la la que que que " * 20]
    m = wide_model(rng)
    cut = [quality.chunks_of([t])[0] for t in texts]
    planes = [quality.plane_counts(c) for c in cut]
    y, weight = np.array([1.0, 0, 1, 0]), np.ones(4)

    def loss():
        z = np.array([(m.pool(m.chunk_features(c), np.array([0])) @ m.w["top"] + m.w["shift"])[0] for c in cut])
        return float(np.mean(np.log1p(np.exp(-z * (2 * y - 1)))))

    g = m._gradient(cut, planes, y, weight)
    for name, at in (("filters", (3, 2)), ("bias", (1,)), ("top", (5,)), ("embed", (65, 1)), ("shift", (0,)), ("plane", (2, 1)), ("plane_bias", (3,))):
        old, step = m.w[name][at], 1e-5
        m.w[name][at] = old + step
        up = loss()
        m.w[name][at] = old - step
        down = loss()
        m.w[name][at] = old
        decay = 1e-4 * old if name in ("filters", "top", "plane") else 0
        assert abs((up - down) / (2 * step) + decay - g[name][at]) < 1e-4, name


def test_network_against_plain_loops():
    rng = np.random.default_rng(5)
    m = wide_model(rng)
    m.trained = True
    for text in (b"", b"short", b"la la la la que que " * 30, bytes(rng.integers(32, 120, 600, dtype=np.uint8))):
        chunks, at = [], 0
        while True:
            chunks.append(text[at : at + quality.CHUNK].ljust(quality.CHUNK, b"\0"))
            at += quality.STEP
            if at + quality.OVERLAP >= len(text):
                break
        rows = []
        for c in chunks:
            kinds = []
            for k in range(quality.FILTERS):
                out = []
                for p in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
                    window = np.concatenate([m.w["embed"][b] for b in c[p : p + quality.WIDTH]])
                    out.append(max(0.0, window @ m.w["filters"][:, k] + m.w["bias"][k]))
                kinds.append(out)
            plane = []
            for k in range(quality.PLANE_FILTERS):
                out = []
                for lag in quality.LAGS:
                    same = [float(c[i] == c[i - lag] and c[i] != 0) for i in range(lag, quality.CHUNK)]
                    for shift in (0, 4):
                        out += [max(0.0, np.dot(same[p : p + 8], m.w["plane"][:, k]) + m.w["plane_bias"][k]) for p in range(shift, len(same) - 7, 8)]
                plane.append(out)
            rows.append([max(x) for x in kinds] + [np.mean(x) for x in kinds] + [max(x) for x in plane] + [np.mean(x) * len(quality.LAGS) for x in plane])
        f = np.array(rows)
        z = np.concatenate([f.max(axis=0), f.mean(axis=0)]) @ m.w["top"] + m.w["shift"]
        assert abs(1 / (1 + np.exp(-z[0])) - m.score([text])[0]) < 1e-4


def test_long_text_in_slices_scores_alike():
    m = quality.ByteCnn()
    m.trained = True
    m.w["top"] = np.random.default_rng(1).normal(0, 0.3, len(m.w["top"])).astype(np.float32)
    text = bytes(np.random.default_rng(2).integers(32, 120, 2_500_000, dtype=np.uint8))
    assert abs(float(m._score([text])[0]) - float(m._score_long(text)[0])) < 1e-4


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")], [(7, "x" * 300), (7, "x" * 300), (None, "y")]])
def test_edges(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge_quality(docs, labels).count() == len(rows)
    found = toxicity.judge_toxicity(docs, labels).collect()
    assert len(found) == len(rows) and all(r["predicted"] == 0 for r in found)
    strange = spark.createDataFrame([(1, None, 1), (1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.judge_quality(docs, strange).count() == len(rows)


def test_filter_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a", 5.0)], "doc_id long, text string, score double")
    assert quality.keep_good(docs, quality.ByteCnn(prior=0.9)).collect() == docs.collect()
    assert quality.keep_good(docs, quality.ByteCnn(prior=0.1)).count() == 0


def test_clashing_columns_and_long_texts(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"good text number {i} of the garden and the sea" if i % 2 else "junk $$$ idiot %%% you idiot " * 3) for i in range(60)] + [(100, "calm words and trees " * 60_000), (101, "x" * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    strange = docs.withColumn("score", F.lit(1)).withColumn("y", F.lit(1)).withColumn("held_out", F.lit(1)).withColumn("label", F.lit(1))
    for judge in (quality.judge_quality, toxicity.judge_toxicity):
        rows = {r["doc_id"]: r for r in judge(strange, labels).collect()}
        assert len(rows) == 62 and all(0 <= r["score"] <= 1 for r in rows.values())
        assert rows == {r["doc_id"]: r for r in judge(docs, labels).collect()}
    named = docs.withColumn("doc_id", F.concat(F.lit("id-"), F.col("doc_id"))), labels.withColumn("doc_id", F.concat(F.lit("id-"), F.col("doc_id")))
    assert quality.judge_quality(*named).where("doc_id = 'id-3'").count() == 1
    assert toxicity.judge_toxicity(*named).where("doc_id = 'id-100'").first()["predicted"] == 0
