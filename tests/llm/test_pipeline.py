"""The corpus pipeline, stage by stage, against the operators' own results."""

import corpus_pipeline

from strandgraph.llm import bpe, decontam, near_dedup, quality, secret_scan

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), before.schema)
        ids, old = {r["doc_id"] for r in docs.collect()}, {r["doc_id"] for r in before.collect()}
        assert ids <= old
        if name == "quality classifier":
            model = quality.train_quality(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert ids == {r["doc_id"] for r in quality.score_quality(before, model).where("score >= 0.3").collect()}
        elif name == "MinHash near-dedup":
            assert ids == {r["doc_id"] for r in near_dedup.near_duplicates(before).where("kept").collect()}
        elif name == "benchmark decontamination":
            found = decontam.find_contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet"), least_items=1)
            assert ids == {r["doc_id"] for r in found.where("not contaminated").collect()}
        else:
            assert ids == old
            enc = secret_scan.encoding(secret_scan.vocabulary_path())
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            for r in docs.collect():
                assert r["text"] == secret_scan.redact(texts[r["doc_id"]], secret_scan.spans_of(texts[r["doc_id"]], enc, 2.4)[1])
                assert r["n_chars"] == len(r["text"])
    last = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    coder = bpe.encoder(bpe.vocabulary_path())
    assert last == {r["doc_id"]: len(coder.encode(r["text"])) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF).collect()} == last


def test_planted_passages_of_one_item_go(spark):
    from test_joins import brute_hits

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = [r.asDict() for r in docs.collect()]
    for i, r in enumerate(rows[::3]):
        words = r["text"].split()
        passage = items[i % len(items)][1].split()
        at = len(words) // 2
        r["text"] = " ".join(words[:at] + passage[: max(8, len(passage) // 2)] + words[at:])
    planted = {r["doc_id"] for r in rows[::3]}
    before = spark.createDataFrame(rows, docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.decontam_stage(spark, before, SF).collect()}
    assert not kept & planted
    assert kept == {r["doc_id"] for r in rows if not brute_hits(r["text"], items)[2]}


def test_edges(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    strange = [(None, "words of a row without an id here", "en", "s", 33), (1, None, "en", "s", 0), (2, "", None, None, None), (3, "x " * 200_000, "en", "s", 400_000), (3, "x " * 200_000, "en", "s", 400_000)]
    for rows in ([], strange):
        docs = spark.createDataFrame(rows, schema).withColumn("kept", __import__("pyspark").sql.functions.lit(5))
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), docs.schema)
        assert docs.count() == (4 if rows else 0)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
