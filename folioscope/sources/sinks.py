"""Writers: parquet, CSV, nested XML, JSON, one page per division."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import clean_field
from folioscope.sources.named_files import write_named_files


def write_table(df: DataFrame, path: str) -> None:
    """One distributed, atomic write."""
    df.write.mode("overwrite").parquet(path)


def csv_text(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Lines of a CSV as rows (line), quoted where needed, to be joined by CRLF; with columns by_0 and so on to order them by."""
    cell = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return df.select(F.concat_ws(",", *[cell(c) for c in columns]).alias("line"), *[F.col(c).alias(f"by_{k}") for k, c in enumerate(by or [])])


def write_csv(df: DataFrame, columns: list[str], path: str, order: list[str] | None = None, parts: int | None = None) -> None:
    """A CSV in parts that follow one another, each with the header; lines end in CR LF.

    Parts are ranges of ``order``, or of the order that rows have; a small table
    is one part, unless their number is given, and an empty one the header alone.
    Never for the folder that is being read.
    """
    head = ",".join(columns)
    by = order or ["_at"]
    rows = df if order else df.withColumn("_at", F.monotonically_increasing_id())
    keys = [f"by_{k}" for k in range(len(by))]
    ranged = csv_text(rows, columns, by).repartitionByRange(*([parts] if parts else []), *keys).sortWithinPartitions(*keys)
    first = F.monotonically_increasing_id() % (1 << 33) == 0  # numbers begin anew in each part
    lines = ranged.select(F.when(first, F.concat(F.lit(head + "\r\n"), "line")).otherwise(F.col("line")).alias("value"))
    if not df.limit(1).count():
        lines = df.sparkSession.createDataFrame([(head,)], "value string")
    lines.write.option("lineSep", "\r\n").text(path)


def nested_verses(verses: DataFrame, words: DataFrame, segments: DataFrame) -> DataFrame:
    """One row per surah with verses, words and segments as attributes of a nested XML; empty attributes are null.

    verses (surah, name, verse, text), words (surah, verse, word, token, gloss,
    root), segments (surah, verse, word, segment, text, pos, role).
    """
    empty = lambda c: F.nullif(clean_field(F.col(c)), F.lit(""))
    seg = segments.groupBy("surah", "verse", "word").agg(F.array_sort(F.collect_list(F.struct(F.col("segment").alias("_number"), empty("text").alias("_text"), empty("pos").alias("_pos"), empty("role").alias("_role")))).alias("segment"))
    word = words.join(seg, ["surah", "verse", "word"], "left").groupBy("surah", "verse").agg(
        F.array_sort(F.collect_list(F.struct(F.col("word").alias("_number"), empty("token").alias("_token"), empty("gloss").alias("_translation"), empty("root").alias("_root"), "segment"))).alias("word")
    )
    verse = verses.join(word, ["surah", "verse"], "left").groupBy("surah", "name").agg(F.array_sort(F.collect_list(F.struct(F.col("verse").alias("_number"), F.col("text").alias("_text"), "word"))).alias("verse"))
    return verse.select(F.col("surah").alias("_number"), F.col("name").alias("_name"), "verse")


def write_xml(nested: DataFrame, path: str) -> None:
    nested.write.format("xml").option("rootTag", "corpus").option("rowTag", "surah").save(path)


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON objects (json)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages (file, html), a file each; those of an earlier write go when all are there."""
    write_named_files(pages.select("file", F.col("html").alias("content")), path)


def write_bookmarks(bookmarks: DataFrame, path: str) -> None:
    bookmarks.write.mode("overwrite").json(path)
