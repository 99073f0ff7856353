"""Documents to training sequences: quality rules, near-duplicates, repeated spans, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, which the stage before has
written as Parquet. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.llm.common import prepare, read, shared_dir
from visitlens.llm.minhash import one_of_each
from visitlens.llm.packing import pack_documents
from visitlens.llm.quality import keep_quality
from visitlens.llm.suffix_dedup import dedup_suffixes


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, whatever ids the rows have."""
    return one_of_each(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that stand anywhere else go from the texts; n_chars follows."""
    kept = dedup_suffixes(docs, carry=True).select("rest.*", F.col("kept_text").alias("_text"))
    return kept.withColumns({"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in the training sequences."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("repeated_spans", repeated_spans), ("packing", packing)]
#: Packing isn't expressible in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(prepare(spark), sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
