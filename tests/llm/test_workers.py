"""What the operators leave behind in an executor's python workers."""

import re
import weakref

import numpy as np
import pyarrow as pa

from strandgraph.llm import bpe, common, near_dedup, sample, secret_scan

SF = "/root/testdata/sf0.001"


def test_a_worker_holds_the_tables_of_one_operator(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).repartition(8)
    near_dedup.signatures(docs, "doc_id", "text").collect()
    secret_scan.redact_secrets(docs).collect()
    bpe.encode_digests(docs).collect()

    def build():
        def step(batch):
            held = [len(near_dedup._powers), secret_scan.encoding.cache_info().currsize, bpe.encoder.cache_info().currsize, bpe.rare.cache_info().currsize]
            return pa.RecordBatch.from_arrays([pa.array([x] * batch.num_rows, pa.int64()) for x in held], ["powers", "encoding", "encoder", "rare"])

        return step

    rows = common.map_rows(spark.range(0, 64, 1, 16), build, "powers long, encoding long, encoder long, rare long").distinct().collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0, 0)]


def test_tables_stay_for_the_same_operator(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    ids = {r["doc_id"]: r["ids_sha256"] for r in bpe.encode_digests(docs).collect()}
    common.enter("strandgraph.llm.bpe")
    held = weakref.ref(bpe.encoder(bpe.vocabulary_path()))
    common.enter("strandgraph.llm.bpe")
    assert held() is bpe.encoder(bpe.vocabulary_path())
    common.enter("strandgraph.llm.quality")
    assert not bpe.encoder.cache_info().currsize and held() is None
    assert ids == {r["doc_id"]: r["ids_sha256"] for r in bpe.encode_digests(docs).collect()}


def anonymous_mb():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024


def test_freed_memory_goes_back_after_each_batch():
    def take(n):
        # Blocks too small for maps of their own, the last one kept: it pins the heap's end.
        blocks = [np.ones(6000) for _ in range(n)]
        return blocks[-1]

    batches, kept = iter([pa.record_batch({"x": pa.array([1])})] * 2), []
    before = anonymous_mb()
    for _ in common.released(batches):
        assert not kept or anonymous_mb() - before < 60
        kept.append(take(4000))
        assert anonymous_mb() - before > 150
    assert anonymous_mb() - before < 60


def test_the_sample_starts_no_other_workers(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    expected = sample.labelled_texts(docs, labels, "quality", 5, 0, (5, 7), 100)
    assert 0 < len(expected[0]) <= 12

    def refused(*_, **__):
        raise AssertionError("rows of Python objects")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    assert sample.labelled_texts(docs, labels, "quality", 5, 0, (5, 7), 100) == expected
