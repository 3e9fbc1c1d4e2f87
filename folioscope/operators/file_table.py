"""Keyed repairs of a stored table that rewrite only the files they touch.

A table is parquet files and a list of those that are current.  An update finds the
files that hold a row it would change, writes these anew beside the old ones, and
publishes a list in which they take the old ones' place.  The other files stay as
they are.  A reader has one list or the other, and of two updates that
start from one list the second is refused, as its number is taken.  An update that
would change nothing writes nothing, so running one again is harmless.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.repair import patch

LISTS = "_lists"


class Outdated(RuntimeError):
    """Another update has been published since the list was read."""


def _system(spark: SparkSession, path: str):  # noqa: ANN202
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def _number(spark: SparkSession, folder: str) -> int:
    system, path = _system(spark, f"{folder}/{LISTS}")
    return max((int(s.getPath().getName().split(".")[0]) for s in system.listStatus(path)), default=-1) if system.exists(path) else -1


def files(spark: SparkSession, folder: str, number: int | None = None) -> list[str]:
    """The current files, or those of an earlier list."""
    number = _number(spark, folder) if number is None else number
    text = spark.read.text(f"{folder}/{LISTS}/{number:08}.json", wholetext=True).first()["value"]
    return [f"{folder}/{name}" for name in json.loads(text)]


def _publish(spark: SparkSession, folder: str, names: list[str], number: int) -> None:
    system, path = _system(spark, f"{folder}/{LISTS}/{number:08}.json")
    try:
        out = system.create(path, False)
    except Exception as e:  # the file is there
        raise Outdated(f"list {number} of {folder} has been published by another update") from e
    try:
        out.write(bytearray(json.dumps(names).encode()))
    finally:
        out.close()


def _written(rows: DataFrame, folder: str) -> list[str]:
    part = f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{part}")
    system, path = _system(rows.sparkSession, f"{folder}/{part}")
    return sorted(f"{part}/{s.getPath().getName()}" for s in system.listStatus(path) if s.getPath().getName().startswith("part-"))


def create(rows: DataFrame, folder: str) -> None:
    """A new table."""
    _publish(rows.sparkSession, folder, _written(rows, folder), 0)


def read(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    return spark.read.parquet(*files(spark, folder, number))


def update(spark: SparkSession, folder: str, patches: DataFrame, keys: list[str]) -> int:
    """Sets the patches' values where all keys match and the patch has one; the number of files that were rewritten."""
    number = _number(spark, folder)
    current = files(spark, folder, number)
    values = [c for c in patches.columns if c not in keys]
    rows = spark.read.parquet(*current).select(*keys, *values, F.element_at(F.split("_metadata.file_path", "/"), -1).alias("_file"))
    theirs = patches.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values])
    differs = reduce(Column.__or__, [F.col(f"_new_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in values])
    touched = {r["_file"] for r in rows.join(theirs, keys).filter(differs).select("_file").distinct().collect()}  # names of files
    if not touched:
        return 0
    old = [f for f in current if f.rsplit("/", 1)[1] in touched]
    new = _written(patch(spark.read.parquet(*old), patches, keys).drop("patched"), folder)
    kept = [f.removeprefix(f"{folder}/") for f in current if f not in old]
    _publish(spark, folder, [*kept, *new], number + 1)
    return len(old)
