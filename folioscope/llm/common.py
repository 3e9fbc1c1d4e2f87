"""What the operators share: word counts, cut lineage, checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_held: list[DataFrame] = []
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; only a local session may do without, and gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="folioscope-"))
    return sc.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """Writes rows to the shared checkpoint folder and goes on from there: for loops, whose lineage would grow."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def hold(df: DataFrame) -> DataFrame:
    """Spares narrow rows a second scan of the texts.

    They lie on the executors' disks; where an executor is lost, its share is
    computed again from the scan, which is all the lineage they have.  What the
    caller has freed by ``clearCache`` is let go, so that plans of earlier
    queries don't pile up in the driver.
    """
    if _held and not _held[-1].storageLevel.useDisk:
        _held.clear()
    _held.append(df.persist(StorageLevel.DISK_ONLY))
    return df


def release() -> None:
    """Frees what has been held; for callers that have written their result."""
    while _held:
        _held.pop().unpersist()


def join_hot(rows: DataFrame, facts: DataFrame, key: str, weight: str, most: int = 1000) -> DataFrame:
    """Inner join with ``facts``, which has one row for each key and, in ``weight``, how many of ``rows`` have it.

    Keys that hold a share of 1 / ``most`` or more of all rows, so ``most`` keys at
    most, are broadcast; only the others are shuffled.  ``weight`` is dropped.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * most >= total
    many = F.broadcast(facts.filter(hot).drop(weight))
    few = rows.join(F.broadcast(facts.filter(hot).select(key)), key, "left_anti").join(facts.filter(~hot).drop(weight), key)
    return rows.join(many, key).unionByName(few)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs meets another; ``select("row.*")`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def delete(spark: SparkSession, folder: str) -> None:
    """Removes a folder of written rows, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """Marks a table for broadcast if a count shows that it has ``rows`` rows at most."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lanes_for(rows: int) -> int:
    """Lanes for two-level prefix sums: as many lanes as rows in a lane."""
    return max(1, round(rows**0.5))
