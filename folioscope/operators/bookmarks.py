"""Bookmarks as events: the latest per key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["surahNumber", "verseNumber"]


def latest(events: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The last event of each key."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("_e")).select(*keys, "_e.*")


def add(bookmarks: DataFrame, new: DataFrame) -> DataFrame:
    """New bookmarks whose verse has none, with the old ones, newest first."""
    fresh = new.join(bookmarks.select(*KEYS), KEYS, "left_anti")
    return fresh.unionByName(bookmarks).orderBy(F.desc("timestamp"), *KEYS)


def remove(bookmarks: DataFrame, gone: DataFrame) -> DataFrame:
    return bookmarks.join(gone.select(*KEYS), KEYS, "left_anti").orderBy(F.desc("timestamp"), *KEYS)


def toggle(bookmarks: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked verses lose their bookmark if they have one, and get one if not."""
    return remove(bookmarks, asked).unionByName(asked.join(bookmarks.select(*KEYS), KEYS, "left_anti")).orderBy(F.desc("timestamp"), *KEYS)


def exists(bookmarks: DataFrame, surah: int, verse: int) -> bool:
    return bookmarks.filter((F.col("surahNumber") == surah) & (F.col("verseNumber") == verse)).limit(1).count() > 0
