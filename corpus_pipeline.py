"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns documents; the last adds
``shard`` and ``slot``, which replace columns of these names. Null and empty texts fail the quality rules, so later
stages see none of a whole run; given some, they treat them as their operators say. Rows that repeat are copies: one
stays. Null ids stay apart from others; ties go by the least text hash. Columns may have any names; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import materialize
from listwright.llm.decontaminate import drop_leaks
from listwright.llm.mixing import mixed_documents
from listwright.llm.near_copies import drop_near_copies
from listwright.llm.quality import quality_filter
from listwright.llm.sharding import shard_rows


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, or whose host is rejected, go."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are similar at 0.8 or more, or linked by such, one stays."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: a document is taken never, once or twice."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets one of eight shards of near equal bytes."""
    own = [F.col("lw_own").getField(c).alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    return shard_rows(docs, "text", 8, "doc_id").select(*own, F.col("lw_shard").alias("shard"), F.col("lw_slot").cast("long").alias("slot"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("sharding", sharding),
]

#: Fingerprints and differencing are beyond SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
