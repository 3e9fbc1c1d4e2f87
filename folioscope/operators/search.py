"""Search by text, root and gloss, and the dispatcher over them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import literal_pattern, search_form
from folioscope.operators.lookup import BadRequest

TYPES = ("text", "root", "gloss")


def parameters(q: str | None = "", kind: str | None = "text", limit: object = 20) -> tuple[str, str, int]:
    """Query of 1 to 200 characters, a type, and a limit from 1 to 100."""
    q, kind = q or "", kind or "text"
    if not 1 <= len(q) <= 200 or kind not in TYPES or not re.fullmatch(r"\d+", str(limit)) or not 1 <= int(str(limit)) <= 100:
        raise BadRequest("query, type or limit out of bounds")
    return q, kind, int(str(limit))


def _normal(query: str) -> str:
    marks = "[ً-ٟؐ-ؚۖ-ۭـٰ]"
    return re.sub(marks, "", query).replace("ٱ", "ا").strip().lower()


def relevance(text: Column, query: str, normal: Callable[[Column], Column] = search_form) -> Column:
    """Per term of two characters or more: its matches in the normal form, case aside, and 2 if the raw text has it."""
    score, form = F.lit(0), normal(text)
    for term in (t for t in re.split(r"\s+", _normal(query)) if len(t) >= 2):
        found = F.regexp_count(form, F.lit("(?iu)" + literal_pattern(term)))
        score = score + found + F.when(F.contains(text, F.lit(term)), 2).otherwise(0)
    return score


def search_text(verses: DataFrame, query: str, keys: list[str], text: str = "text", limit: int = 20, normal: Callable[[Column], Column] = search_form) -> DataFrame:
    """The most relevant verses, in corpus order on ties.

    Verses without a match come last, so they are left out after the limit: before it,
    the whole score would be computed a second time in the filter.
    """
    scored = verses.withColumn("relevance", relevance(F.col(text), query, normal).cast("int"))
    return scored.orderBy(F.desc("relevance"), *keys).limit(limit).filter("relevance > 0")


def search_roots(verses: DataFrame, query: str, keys: list[str], roots: str = "roots", limit: int = 20) -> DataFrame:
    """Verses with a root that contains the query or is contained in it, case aside."""
    q = query.lower()
    hit = F.exists(roots, lambda r: F.contains(F.lit(q), F.lower(r)) | F.contains(F.lower(r), F.lit(q)))
    context = F.concat(F.lit("Root: "), F.array_join(roots, ", "))
    return verses.filter(hit).withColumns({"context": context, "relevance": F.lit(1)}).orderBy(*keys).limit(limit)


def search_glosses(verses: DataFrame, query: str, keys: list[str], translation: str = "translation", limit: int = 20) -> DataFrame:
    """Verses whose translation contains the query, case aside."""
    return verses.filter(F.contains(F.lower(translation), F.lit(query.lower()))).withColumns({"context": F.col(translation), "relevance": F.lit(1)}).orderBy(*keys).limit(limit)


def envelope(found: DataFrame, q: str, kind: str = "text") -> DataFrame:
    """One row (query, type, results, total) for the rows of a search, in their order."""
    shown = [c for c in found.columns if c != "relevance"]
    ranked = F.struct((-F.col("relevance")).alias("at"), F.col("surah"), F.col("verse"), F.struct(*shown, "relevance").alias("r"))
    results = F.transform(F.array_sort(F.collect_list(ranked)), lambda x: x["r"])
    return found.agg(results.alias("results")).select(F.lit(q).alias("query"), F.lit(kind).alias("type"), "results", F.size("results").alias("total"))


def ask(verses: DataFrame, morphology: DataFrame, names: DataFrame, q: str | None, kind: str = "text") -> list[dict]:
    """Results as the caller of the interface gets them: a trimmed query, 50 results at most, none for a blank query or one that is turned away."""
    try:
        found = search(verses, morphology, names, (q or "").strip(), kind, 50)
    except BadRequest:
        return []
    return [r.asDict(recursive=True) for r in found.collect()]


def search(verses: DataFrame, morphology: DataFrame, names: DataFrame, q: str, kind: str = "text", limit: object = 20) -> DataFrame:
    """Rows (surah, surah_name, verse, text, relevance[, context]) of a checked search; only the tables of its type are read."""
    q, kind, most = parameters(q, kind, limit)
    keys = ["surah", "verse"]
    if kind == "text":
        found = search_text(verses, q, keys, limit=most)
    else:
        joined = verses.join(morphology, keys)
        found = search_roots(joined, q, keys, limit=most) if kind == "root" else search_glosses(joined, q, keys, limit=most)
    named = found.join(names.select(F.col("id").alias("surah"), F.col("english_name").alias("surah_name")), "surah", "left").withColumn("surah_name", F.coalesce("surah_name", F.lit("")))
    context = ["context"] if kind != "text" else []
    return named.select("surah", "surah_name", "verse", "text", "relevance", *context).orderBy(F.desc("relevance"), *keys)
