"""Bookmarks as a stream of toggles with keyed state.

An event (surahNumber, verseNumber, timestamp, event_id) toggles a verse's
bookmark: the first sets it, the next takes it away.  What a verse's state holds
is the number of its events and the last one, both of which come out the same in
any order, so events that are late change nothing but the moment they arrive in.
An event that a source sends again within the watermark counts once.

Each micro-batch writes the verses it has changed under the batch's number, so a
batch that is run again after a failure writes the same rows over its own; the
bookmarks are each verse's rows of the last batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ["surahNumber", "verseNumber"]


def states(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows (keys, events, last) for each verse, of a stream or a table of events; ``timestamp`` is a timestamp."""
    once = events.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    return once.groupBy(*KEYS).agg(F.count("*").alias("events"), F.max(F.struct("timestamp", "event_id")).alias("last"))


def bookmarked(stated: DataFrame) -> DataFrame:
    """The verses that have a bookmark, as of their last event."""
    return stated.filter("events % 2 = 1").select(*KEYS, F.col("last.timestamp").alias("timestamp"))


def start(events: DataFrame, folder: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Runs over all events that are there, from where the checkpoint left off, and stops."""

    def upsert(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return states(events, late).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(written: DataFrame) -> DataFrame:
    """Each verse's state in the last batch that changed it, of the folder that ``start`` writes."""
    rest = [c for c in written.columns if c not in KEYS]
    return written.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*KEYS, "s.events", "s.last")
