"""Corpus pipeline: quality, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.

Defined results: an empty table gives an empty result.  Repeated rows: the
near-dedup keeps one row of each group, rows that share an id included.  A null
text counts as an empty one: the classifier scores it, near-dedup links it with
nothing (one row an id stays), it holds no benchmark passage and no secret, and
has no tokens.  A row with a null id takes no part in near-dedup and stays.
Texts of any length are read whole.  Columns besides doc_id and text pass
through as they are (n_chars follows a masked text), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandgraph.llm import bpe, decontam, near_dedup, quality, secret_scan
from strandgraph.llm.common import WorkTables, work_scope


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.keep_one(docs)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go; null texts and texts without words stay."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_items=1)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; the documents stay."""
    return secret_scan.redact_secrets(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with the digest of what they decode to."""
    return bpe.encode_digests(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontam_stage),
    ("secret scans", secrets_stage),
    ("BPE encoding and decoding", tokens_stage),
]

#: Learned scores and a trained classifier have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = WorkTables(spark, "pipeline")
    for _, stage in STAGES:
        with work_scope(spark):
            docs, _ = work.save(stage(spark, docs, sf_dir))
    return docs
