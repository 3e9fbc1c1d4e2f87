"""Lookups: by keys, with fallbacks, nested, and as-of; and the guards of their parameters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators.ranges import as_of, last_at_or_below, literal


class BadRequest(ValueError):
    """A parameter that the guards turn away."""


def division_number(value: object) -> int:
    """A division number between 1 and 114."""
    if not re.fullmatch(r"\d+", str(value)) or not 1 <= int(str(value)) <= 114:
        raise BadRequest(f"no such division: {value}")
    return int(str(value))


def positive(value: object, what: str = "number") -> int:
    if not re.fullmatch(r"\d+", str(value)) or int(str(value)) < 1:
        raise BadRequest(f"{what} must be a whole number from 1")
    return int(str(value))


def root_parameter(raw: str, decoded: str) -> str:
    """A root in Arabic script; the length limit of 8 holds for the undecoded value."""
    if not raw or len(raw) > 8 or not re.fullmatch("[؀-ۿ]+", decoded):
        raise BadRequest("not a root")
    return decoded


def divisions(dimension: DataFrame) -> DataFrame:
    """Divisions in order."""
    return dimension.select(F.col("id").alias("number"), "english_name", "english_translation", "revelation_type", "verse_count").orderBy("number")


def division(dimension: DataFrame, verses: DataFrame, number: int) -> DataFrame:
    """A division with its verses in order; no row if it doesn't exist."""
    own = verses.filter(F.col("surah") == number).groupBy(F.col("surah").alias("id")).agg(F.array_sort(F.collect_list(F.struct("verse", "text"))).alias("verses"))
    return dimension.filter(F.col("id") == number).join(own, "id", "left")


def verse(verses: DataFrame, surah: int, number: int) -> DataFrame:
    return verses.filter((F.col("surah") == surah) & (F.col("verse") == number))


def verse_text(verses: DataFrame, surah: int, number: int) -> str | None:
    """The text of a verse, null if there is no such verse."""
    found = verse(verses, surah, number).select("text").first()
    return found["text"] if found else None


def surah_name(verses: DataFrame, surah: int) -> str | None:
    """The name of a surah, null if there is no such surah."""
    found = verses.filter(F.col("surah") == surah).agg(F.min("name").alias("name")).first()
    return found["name"]


def bismillah(opened: DataFrame, surah: int) -> str | None:
    """The opening formula of a surah, of rows that ``quality.with_openings`` gives."""
    return opened.filter(F.col("surah") == surah).agg(F.min("opening").alias("opening")).first()["opening"]


def division_parameters(dimension: DataFrame) -> DataFrame:
    """The parameter (id) of each page there is to make, as text."""
    return dimension.orderBy("id").select(F.col("id").cast("string").alias("id"))


def word_with_segments(nested: DataFrame, surah: int, number: int, word: int) -> DataFrame:
    """A word with its ordered segments, an empty array if it has none."""
    none = F.array().cast(nested.schema["segments"].dataType)
    return nested.filter((F.col("surah") == surah) & (F.col("verse") == number) & (F.col("word") == word)).withColumn("segments", F.coalesce("segments", none))


def root_meaning(meanings: DataFrame, query: str) -> DataFrame:
    """The entry of a root, in the column that the query's script suggests, else in the other."""
    arabic = bool(re.fullmatch("[؀-ۿ]+", query))
    first, second = ("root_arabic", "root") if arabic else ("root", "root_arabic")
    found = meanings.filter((F.col(first) == query) | (F.col(second) == query))
    return found.orderBy(F.when(F.col(first) == query, 0).otherwise(1), F.col("id").try_cast("long")).limit(1)


def with_default(rows: DataFrame, dimension: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """A dimension's columns by key, defaults where it has no row; a null of a row that it has stays null."""
    theirs = dimension.select(F.col(key).alias("_key"), F.struct(*defaults).alias("_found"))
    joined = rows.join(theirs, F.col(key) == F.col("_key"), "left")
    return joined.withColumns({c: F.when(F.col("_found").isNotNull(), F.col("_found")[c]).otherwise(F.lit(v)) for c, v in defaults.items()}).drop("_key", "_found")


def substring_search(verses: DataFrame, query: str) -> DataFrame:
    """Verses that contain a text, case counting, in order."""
    return verses.filter(F.contains("text", F.lit(query))).select("surah", "verse", "text").orderBy("surah", "verse")


MOST_BANDS = 10_000  #: bands that are searched within a row


def as_of_bands(rows: DataFrame, bands: DataFrame, key: Column, start: str, value: str, default: object) -> DataFrame:
    """Value of the last band that starts at or before the key, the default where there is none or it is null.

    Up to ``MOST_BANDS`` bands become one sorted literal that is searched within a
    row, so rows are neither shuffled nor joined; more of them are met in cells.
    """
    known = bands.select(F.struct(F.col(start).alias("start"), F.col(value).alias("value")).alias("b")).orderBy("b").limit(MOST_BANDS + 1)
    found = [r["b"] for r in known.collect()]
    if len(found) > MOST_BANDS:
        starts = bands.select(F.col(start).alias("_key"), F.col(value).alias("_band"))
        own = as_of(rows.withColumn("_key", key), starts, [], "_key", "_band", default)
        return own.withColumn(value, F.col("_band")).drop("_key", "_band")
    table = literal(found).cast(T.ArrayType(known.schema["b"].dataType)) if found else F.array().cast(T.ArrayType(known.schema["b"].dataType))
    below = last_at_or_below(table, key, len(found), "start")
    return rows.withColumn(value, F.coalesce(F.get(table, below - 1)["value"], F.lit(default)))


def first_stem(segments: Column) -> Column:
    """First stem, else first segment with a role, else the last segment."""
    return F.coalesce(F.get(F.filter(segments, lambda s: s["morph_type"] == "Stem"), 0), F.get(F.filter(segments, lambda s: s["syntactic_role"] != ""), 0), F.try_element_at(segments, F.lit(-1)))


def first_role(segments: Column) -> Column:
    """First segment with a role, else first stem, else the last segment."""
    return F.coalesce(F.get(F.filter(segments, lambda s: s["syntactic_role"] != ""), 0), F.get(F.filter(segments, lambda s: s["morph_type"] == "Stem"), 0), F.try_element_at(segments, F.lit(-1)))


def first_filled(segments: Column, field: str) -> Column:
    return F.get(F.filter(segments, lambda s: s[field] != ""), 0)[field]


def filled(segments: Column, field: str) -> Column:
    return F.filter(F.transform(segments, lambda s: s[field]), lambda x: x != "")
