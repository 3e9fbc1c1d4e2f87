"""From raw documents to mixed, sharded training data in five stages.

Each stage takes (spark, docs, sf_dir) and gives a table, which ``run`` writes to
the shared checkpoint folder and reads again as the next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import checkpoint_dir, delete, release, table
from folioscope.llm.near_copies import one_of_each
from folioscope.llm.op1_mixing import mixed_rows
from folioscope.llm.op4_sharding import shard
from folioscope.llm.op5_decontamination import decontaminate
from folioscope.llm.op7_quality import keep_good, train


BATCH_ROWS = 1000  #: rows that go to a Python worker at a time


def small_batches(spark: SparkSession) -> None:
    """Has Spark hand whole texts to Python a few megabytes at a time: batches lie in memory beside an executor's heap, on both sides.

    The session's setting is lowered, never raised, and stays so, as stages run when they are written.
    """
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:  # zero or less: no limit
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    small_batches(spark)
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies, met by SimHash and MinHash: five-word shingles, Jaccard similarity of 0.8 or more."""
    small_batches(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item."""
    small_batches(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents in the sources' proportions; one that is taken twice comes twice."""
    return mixed_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents into 16 shards of near-equal bytes: all their columns, with size, text_crc32, law, shard and slot."""
    return shard(docs, whole=True).withColumn("law", F.lit("bytes"))


STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
ORACLE_SQL = None  # the fitted classifier, BM25 and the components are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, from the documents table; a stage's table goes when the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        release()
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs
