"""Checks of the dictionary of roots and of the corpus, and their report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import jsons

JSON_KEYS = ("general_meaning", "shades_of_meaning", "hadith_examples", "classical_sources", "idioms_customs", "word_by_word_shades")
LISTS = JSON_KEYS[1:]
OPENING = "بِسْمِ ٱللَّهِ ٱلرَّحْمَـٰنِ ٱلرَّحِيمِ"


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Keys that are wanted and not there, in order."""
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti").orderBy(key)


def orphans(have: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key nothing wants."""
    return have.join(wanted.select(key), key, "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def is_empty(value: Column) -> Column:
    return F.btrim(F.coalesce(value, F.lit("")), F.lit(" \t\n\r\x0b\f")) == ""


def json_findings(text: Column) -> Column:
    """Array of findings about a response: the first of empty, invalid, no object, a missing key or a wrong text; else one for each wrong list."""
    kind = jsons.kind(text)
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    lacking = F.array_except(F.array(*map(F.lit, JSON_KEYS)), keys)
    wrong = F.filter(F.array(*[F.when(jsons.kind_of_key(text, k) != "ARRAY", F.lit(f"{k} is not a list")) for k in LISTS]), lambda x: x.isNotNull())
    return (
        F.when(is_empty(text), F.array(F.lit("empty")))
        .when(kind == "invalid", F.array(F.lit("invalid JSON")))
        .when(kind != "OBJECT", F.array(F.lit("not an object")))
        .when(F.size(lacking) > 0, F.array(F.concat(F.lit("missing key: "), F.get(lacking, 0))))
        .when(jsons.kind_of_key(text, "general_meaning") != "STRING", F.array(F.lit("general_meaning is not a string")))
        .otherwise(wrong)
    )


def invalid_responses(meanings: DataFrame) -> DataFrame:
    return meanings.select("id", "root", F.explode(json_findings(F.col("full_response"))).alias("finding"))


def empty_fields(meanings: DataFrame, columns: list[str]) -> DataFrame:
    """A row (id, column) for each empty field."""
    long = meanings.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in columns]).unpivot("id", columns, "column", "value")
    return long.filter(is_empty(F.col("value"))).select("id", "column")


CHECKS = (
    ("missing roots", "FAIL"), ("empty full_response", "FAIL"), ("invalid full_response", "FAIL"), ("duplicate roots", "FAIL"), ("duplicate ids", "FAIL"), ("empty pos", "FAIL"),
    ("orphans", "INFO"), ("empty fields", "INFO"),
)


def report(meanings: DataFrame, roots: DataFrame) -> DataFrame:
    """Eight rows (check, findings, level, ok); orphans and empty fields inform and never fail.

    Each table is read once: a row of the dictionary counts for its root and for its
    id, and has what it is itself found to lack; a wanted root counts for the root.
    Sums for a key are made before they are shuffled, so no key is too frequent.  A
    null root is wanted by nothing, as in the single checks.
    """
    text = F.col("full_response")
    invalid = F.size(F.filter(json_findings(text), lambda f: f != "empty"))
    fields = sum((is_empty(F.col(c)).cast("int") for c in LISTS), F.lit(0))
    none = [F.lit(0).alias(n) for n in ("empty", "invalid", "pos", "fields")]
    lacks = [is_empty(text).cast("int").alias("empty"), invalid.alias("invalid"), is_empty(F.col("pos")).cast("int").alias("pos"), fields.alias("fields")]
    entry = lambda kind, key, own: F.struct(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.lit(1).alias("rows"), F.lit(0).alias("wanted"), *own)
    told = meanings.select(F.inline(F.array(entry("root", "root", lacks), entry("id", "id", none))))
    asked = roots.select(F.lit("root").alias("kind"), F.col("root").cast("string").alias("key"), F.lit(0).alias("rows"), F.lit(1).alias("wanted"), *none)
    totals = [F.sum(c).alias(c) for c in ("rows", "wanted", "empty", "invalid", "pos", "fields")]
    by_key = told.unionByName(asked).groupBy("kind", "key").agg(*totals)
    root, known = F.col("kind") == "root", F.col("key").isNotNull()
    twice = F.col("rows") > 1
    found = by_key.agg(
        F.count_if(root & (F.col("wanted") > 0) & ((F.col("rows") == 0) | ~known)),
        *[F.sum(c) for c in ("empty", "invalid")],
        F.count_if(root & twice),
        F.count_if(~root & twice),
        F.sum("pos"),
        F.sum(F.when(root & ((F.col("wanted") == 0) | ~known), F.col("rows"))),
        F.sum("fields"),
    )
    n = [F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long") for c in found.columns]
    rows = F.array(*[F.struct(F.lit(name).alias("check"), k.alias("findings"), F.lit(level).alias("level"), ((k == 0) | F.lit(level == "INFO")).alias("ok")) for (name, level), k in zip(CHECKS, n, strict=True)])
    return found.select(F.inline(rows))


def exit_code(reported: DataFrame) -> int:
    return int(reported.filter(~F.col("ok")).limit(1).count() > 0)


LANE = 4096  #: numbers of a key that are counted together


def gaps(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Rows whose number isn't their place among the key's rows, counted from 1; numbers are whole.

    Places are counted in lanes of ``LANE`` numbers, from the rows of the lanes
    before, so a key of any size is spread over as many lanes as it has.
    """
    laned = rows.withColumn("_lane", F.floor(F.col(number) / LANE))
    before = Window.partitionBy(*keys).orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = laned.groupBy(*keys, "_lane").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(before)).filter("_before > 0")
    theirs = starts.select(F.struct(*keys, "_lane").alias("_at"), "_before")
    place = F.row_number().over(Window.partitionBy(*keys, "_lane").orderBy(number))
    placed = laned.withColumn("_place", place).join(theirs, F.struct(*keys, "_lane") == F.col("_at"), "left")
    out = placed.withColumn("expected", (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("int"))
    return out.filter(F.col(number) != F.col("expected")).drop("_lane", "_place", "_at", "_before")


def corpus_findings(verses: DataFrame, divisions: int = 114) -> DataFrame:
    """Rows (rule, surah, verse): numbers out of range, repeated verses, gaps, and a wrong number of divisions."""
    out_of_range = verses.filter(~F.col("surah").between(1, divisions)).select(F.lit("range").alias("rule"), "surah", "verse")
    repeated = duplicates(verses, ["surah", "verse"]).select(F.lit("duplicate").alias("rule"), "surah", "verse")
    holes = gaps(verses.dropDuplicates(["surah", "verse"]), ["surah"], "verse").select(F.lit("gap").alias("rule"), "surah", "verse")
    count = verses.agg(F.countDistinct("surah").alias("surah")).filter(F.col("surah") != divisions).select(F.lit("count").alias("rule"), F.col("surah").cast("int").alias("surah"), F.lit(None).cast("int").alias("verse"))
    return out_of_range.unionByName(repeated).unionByName(holes).unionByName(count)


def with_openings(verses: DataFrame, opening: str = OPENING) -> DataFrame:
    """Strict reading: the opening formula of each surah in a column.

    Surah 1 has its first verse as such, surah 9 none; the others have the
    attribute, else a first verse that is the formula, which then is no verse.
    """
    first = F.max(F.when(F.col("verse") == 1, F.btrim(F.coalesce("text", F.lit(""))))).over(Window.partitionBy("surah"))
    given = F.max("bismillah").over(Window.partitionBy("surah"))
    formula = (F.col("first") == opening) & ~F.col("surah").isin(1, 9)
    rows = verses.withColumns({"first": first, "given": given})
    own = F.when(F.col("surah") == 1, F.col("first")).when(F.col("surah") == 9, F.lit(None)).otherwise(F.coalesce(F.nullif("given", F.lit("")), F.when(formula, F.col("first"))))
    dropped = formula & (F.col("verse") == 1) & (F.coalesce("given", F.lit("")) == "")
    return rows.withColumn("opening", own).filter(~F.coalesce(dropped, F.lit(False))).drop("first", "given")
