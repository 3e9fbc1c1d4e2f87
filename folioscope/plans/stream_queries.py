"""The events table as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.folders import shared_folder
from folioscope.plans.queries import query, table
from folioscope.streaming import bookmarks


def _is_folder(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(own).isDirectory()


@query(
    """
SELECT user_id AS "surahNumber", event_type AS "verseNumber", max(ts) AS "timestamp" FROM events GROUP BY ALL HAVING count(DISTINCT event_id) % 2 = 1
"""
)
def bookmark_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks after all events have come in as a stream."""
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    stream = source.parquet(f"{sf_dir}/events.parquet") if _is_folder(spark, f"{sf_dir}/events.parquet") else source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    events = stream.select(F.col("user_id").alias("surahNumber"), F.col("event_type").alias("verseNumber"), F.col("ts").cast("timestamp").alias("timestamp"), "event_id")
    folder = shared_folder(spark, "bookmarks")
    bookmarks.start(events, f"{folder}/states", f"{folder}/checkpoint", late="400 days").awaitTermination()  # files come in any order
    found = bookmarks.bookmarked(bookmarks.current(spark.read.parquet(f"{folder}/states")))
    return found.withColumn("timestamp", F.col("timestamp").cast(schema["ts"].dataType))
