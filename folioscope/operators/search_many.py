"""The searches of ``search.search`` for a table of requests at once.

Text and gloss requests go through stored indexes, root requests through the join
of words that contain one another.  A request (query_id, q, type) that the guards
would turn away gets no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators import text_index, word_joins
from folioscope.operators.search import TYPES

KEYS = ("surah", "verse")


@dataclass(frozen=True)
class Corpus:
    """What requests are answered from: indexes of texts and of translations, and the roots of each verse."""

    texts: text_index.TextIndex
    glosses: text_index.TextIndex
    roots: DataFrame  #: (surah, verse, roots)
    names: DataFrame  #: (id, english_name)


def prepare(verses: DataFrame, morphology: DataFrame, names: DataFrame, folder: str) -> Corpus:
    """Builds both indexes in a new folder; verses (surah, verse, text), morphology (surah, verse, translation, roots)."""
    known = morphology.join(verses.select(*KEYS), list(KEYS))
    return Corpus(text_index.build(verses, list(KEYS), "text", f"{folder}/texts"), text_index.build(known, list(KEYS), "translation", f"{folder}/glosses"), known.select(*KEYS, "roots"), names)


def accepted(requests: DataFrame) -> DataFrame:
    """Requests of 1 to 200 characters and a known type; a type that is missing is text."""
    kind = F.coalesce(F.nullif("type", F.lit("")), F.lit("text"))
    return requests.select("query_id", F.col("q").alias("query"), kind.alias("type")).filter(F.char_length("query").between(1, 200) & F.col("type").isin(*TYPES))


def by_root(corpus: Corpus, asked: DataFrame, limit: int) -> DataFrame:
    """Rows (query_id, keys, context, relevance): the first verses with a root that contains the query or that it contains, case aside."""
    each = corpus.roots.select(*KEYS, F.explode("roots").alias("own")).select(*KEYS, F.lower("own").alias("word"))
    met = word_joins.contained_either_way(each, asked, root="query")
    wanted = asked.select("query_id", F.lower("query").alias("root")).join(met, "root").select("query_id", "word").distinct()
    hits = each.join(wanted, "word").select("query_id", *KEYS).distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*KEYS))
    first = hits.withColumn("nth", place).filter(F.col("nth") <= limit).drop("nth")
    context = F.concat(F.lit("Root: "), F.array_join("roots", ", "))
    return first.join(corpus.roots, list(KEYS)).select("query_id", *KEYS, context.alias("context"), F.lit(1).alias("relevance"))


def answer(corpus: Corpus, requests: DataFrame, limit: int = 20) -> DataFrame:
    """Rows (query_id, surah, surah_name, verse, text, relevance, context) of all requests; context is null for texts."""
    asked = accepted(requests)
    of = {kind: asked.filter(F.col("type") == kind).select("query_id", "query") for kind in TYPES}
    found = text_index.search_text(corpus.texts, of["text"], limit).withColumn("context", F.lit(None).cast("string"))
    found = found.select("query_id", *KEYS, "context", "relevance").unionByName(by_root(corpus, of["root"], limit))
    found = found.unionByName(text_index.search_glosses(corpus.glosses, of["gloss"], limit)).persist(StorageLevel.MEMORY_AND_DISK)
    texts = text_index.texts_of(corpus.texts, found.select(F.struct(*KEYS).alias("key")).distinct())
    named = found.join(corpus.names.select(F.col("id").alias("surah"), F.col("english_name").alias("surah_name")), "surah", "left")
    return named.join(texts.select("key.*", "text"), list(KEYS)).select("query_id", "surah", F.coalesce("surah_name", F.lit("")).alias("surah_name"), "verse", "text", "relevance", "context")
