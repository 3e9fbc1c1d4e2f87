"""Readers of a corpus: XML, CSV, JSON maps, JSON lines, HTML pages, tables, bookmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import jsons
from folioscope.functions.text import page_main, split_reference
from folioscope.sources.divisions import FILE_NAMES

VERSE_XML = "_index int, _name string, aya array<struct<_index:int,_text:string,_bismillah:string>>"
MORPHOLOGY_COLUMNS = (
    "Sura_No", "Verse_No", "Word_No", "Segment_No", "Word", "Without_Diacritics", "Segmented_Word", "Morph_Tag", "Morph_Type", "Punctuation_Mark", "Syntactic_Role",
    "Possessive_Construct", "Case_Mood", "Case_Mood_Marker", "Invariable_Declinable", "Phrase", "Phrasal_Function", "Gloss",
)
MEANING_COLUMNS = (
    "id", "root", "root_arabic", "general_meaning", "shades_of_meaning", "hadith_examples", "classical_sources", "idioms_customs", "word_by_word_shades", "full_response", "model_used", "pos",
)
ROOT_ENTRY = (
    "id int, root string, root_arabic string, root_letters string, pos string, occurrences_quran int, meaning struct<en:string,ar:string>, "
    "lexical_analysis struct<ibn_faris:string,al_raghib:string>, quran_examples array<struct<ref:string,ar:string,en:string,context:string>>, "
    "hadith array<struct<ar:string,en:string,source:string,url:string>>, "
    "shades array<struct<name_en:string,name_ar:string,refs:array<string>,explanation:string,hadith_ar:string,hadith_en:string,hadith_url:string>>, verified_date string"
)
BOOKMARK = "surahNumber int, verseNumber int, surahName string, timestamp long, note string"


def read_verses(spark: SparkSession, path: str) -> DataFrame:
    """Rows (surah, name, verse, text, bismillah) of a corpus in XML; a lone verse is a list of one."""
    surahs = spark.read.format("xml").option("rowTag", "sura").schema(VERSE_XML).load(path)
    verse = surahs.select(F.col("_index").alias("surah"), F.col("_name").alias("name"), F.explode("aya").alias("v"))
    return verse.select("surah", "name", F.col("v._index").alias("verse"), F.col("v._text").alias("text"), F.col("v._bismillah").alias("bismillah"))


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A CSV with a header, all fields text, doubled quotes and line breaks inside quotes; ``line`` is each row's place.

    Files follow one another by name; empty fields are null.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    return rows.select(*columns, place_in_files().alias("line"))


def place_in_files() -> Column:
    """A value that sorts rows of files as the files have them, by file, split and row, however the splits are dealt out."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))


def read_morphology(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, MORPHOLOGY_COLUMNS)


def read_meanings(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, MEANING_COLUMNS)


def keyed(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key with its rows in order, as an array ``rows``."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, *rest))), lambda r: F.struct(*[r[c].alias(c) for c in rest])).alias("rows"))


def read_root_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows (root, ref, surah, verse, word, at) from one JSON object of lists; ``at`` is the place in the file."""
    whole = spark.read.text(path, wholetext=True)
    roots = whole.select(F.posexplode(F.map_entries(jsons.map_rows(F.col("value")))).alias("k", "e"))
    refs = roots.select(F.col("e.key").alias("root"), "k", F.posexplode("e.value").alias("i", "ref"))
    return refs.select("root", "ref", split_reference(F.col("ref")).alias("s"), F.struct("k", "i").alias("at")).select("root", "ref", "s.*", "at")


def read_root_entries(spark: SparkSession, path: str) -> DataFrame:
    """Nested root entries from JSON lines; of entries with one id the last stays, files following one another by name."""
    rows = spark.read.schema(ROOT_ENTRY).json(path).select("*", place_in_files().alias("line"))
    last = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "line"]), "line").alias("r"))
    return last.select("r.*")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Rows (number, file, html) of pages named NNN-name.html."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.html").select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file"), F.col("value").alias("html"))
    return rows.select(F.regexp_extract("file", r"^(\d{3,})-", 1).try_cast("int").alias("number"), "file", "html").filter("number is not null")


def read_main(spark: SparkSession, path: str, number: int) -> str | None:
    """The main element of a division's page, of which that file alone is read; null if there is no such page or element."""
    if not 1 <= number <= len(FILE_NAMES):
        return None
    file = f"{number:03}-{FILE_NAMES[number - 1]}.html"
    found = spark.read.text(path, wholetext=True, pathGlobFilter=file).select(page_main(F.col("value")).alias("main")).first()
    return found["main"] if found else None


def read_dimension(spark: SparkSession, rows: list[tuple[int, str, str, str, int]]) -> DataFrame:
    """The divisions' table (id, english_name, english_translation, revelation_type, verse_count)."""
    return spark.createDataFrame(rows, "id int, english_name string, english_translation string, revelation_type string, verse_count int")


def read_dimension_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same table from a CSV with these columns."""
    rows = read_csv(spark, path, ("id", "english_name", "english_translation", "revelation_type", "verse_count"))
    return rows.withColumns({"id": F.col("id").try_cast("int"), "verse_count": F.col("verse_count").try_cast("int")}).drop("line")


def read_labels(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """Labels by category and code from a CSV (category, code, label); a dictionary of some hundreds of codes."""
    out: dict[str, dict[str, str]] = {}
    for r in read_csv(spark, path, ("category", "code", "label")).collect():
        out.setdefault(r["category"], {})[r["code"]] = r["label"]
    return out


def read_bands(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Starts of pages or parts from a CSV (surah, verse, value): a struct ``start`` and the value."""
    rows = read_csv(spark, path, ("surah", "verse", value))
    return rows.select(F.struct(F.col("surah").try_cast("int").alias("s"), F.col("verse").try_cast("int").alias("v")).alias("start"), F.col(value).try_cast("int").alias(value))


def read_bookmarks(spark: SparkSession, path: str) -> DataFrame:
    """Bookmarks from a JSON array; rows that aren't such are left out."""
    return spark.read.schema(BOOKMARK).json(path, multiLine=True).filter("surahNumber is not null and verseNumber is not null")


def cleaned(column: Column) -> Column:
    """Loader's reading of a field: the empty text is null."""
    return F.nullif(column, F.lit(""))
