"""Queries that answer whole tables of questions: search over an index, words that contain or resemble each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.folders import shared_folder
from folioscope.functions import text as t
from folioscope.operators import search_many, text_index, word_joins
from folioscope.plans.queries import _SPACE, query, table


def _index(spark: SparkSession, sf_dir: str) -> text_index.TextIndex:
    return text_index.build(table(spark, sf_dir, "documents"), ["doc_id"], "text", shared_folder(spark, "trigrams"))


@query(
    """
WITH q AS (SELECT item_id AS query_id, substring(text, 9, 14) AS query FROM benchmark)
SELECT query_id, doc_id, length(text) AS n_chars FROM q JOIN documents ON contains(text, query)
"""
)
def indexed_substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that contain a piece of a benchmark item, for all items at once."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 9, 14).alias("query"))
    found = text_index.substring_search(_index(spark, sf_dir), asked)
    return found.select("query_id", "doc_id", F.char_length("text").cast("long").alias("n_chars"))


_SQL_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '')"


@query(
    rf"""
WITH q AS (SELECT item_id AS query_id, {_SQL_WORDS} AS w FROM benchmark),
u AS (SELECT query_id, unnest([lower(w[2]), lower(w[5])]) AS term FROM q),
d AS (SELECT doc_id, text, lower(regexp_replace(text, '[\x{{64b}}-\x{{65f}}\x{{610}}-\x{{61a}}\x{{6d6}}-\x{{6ed}}\x{{640}}\x{{670}}]', '', 'g')) AS f FROM documents),
h AS (SELECT query_id, doc_id, (length(f) - length(replace(f, term, ''))) // length(term) + CASE WHEN contains(text, term) THEN 2 ELSE 0 END AS score FROM u JOIN d ON length(term) >= 2 AND (contains(f, term) OR contains(text, term))),
s AS (SELECT query_id, doc_id, CAST(sum(score) AS INTEGER) AS relevance FROM h GROUP BY query_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS nth FROM s WHERE relevance > 0)
SELECT query_id, doc_id, relevance FROM r WHERE nth <= 20
"""
)
def indexed_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that matter most to two words of each benchmark item."""
    words = t.words(F.col("text"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.get(words, 1), F.get(words, 4)).alias("query"))
    return text_index.search_text(_index(spark, sf_dir), asked)


@query(
    """
WITH q AS (SELECT item_id AS query_id, upper(substring(text, 4, 9)) AS query FROM benchmark),
r AS (SELECT query_id, doc_id, text, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS nth FROM q JOIN documents ON contains(lower(text), lower(query)))
SELECT query_id, doc_id, length(text) AS n_chars, CAST(1 AS INTEGER) AS relevance FROM r WHERE nth <= 20
"""
)
def indexed_gloss_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 documents that contain a piece of a benchmark item, case aside."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), t.upper_by_character(F.substring("text", 4, 9)).alias("query"))
    found = text_index.search_glosses(_index(spark, sf_dir), asked)
    return found.select("query_id", "doc_id", F.char_length("context").cast("long").alias("n_chars"), "relevance")


def _words(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.explode(t.words(F.col("text"))).alias("word"))


@query(
    f"""
WITH w AS (SELECT DISTINCT lower(unnest({_SQL_WORDS})) AS word FROM documents),
r AS (SELECT DISTINCT root FROM (SELECT lower(unnest({_SQL_WORDS})) AS root FROM benchmark) WHERE length(root) BETWEEN 5 AND 8)
SELECT word, root FROM w JOIN r ON contains(word, root) OR contains(root, word)
"""
)
def words_and_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents with the roots, words of the benchmark, that contain them or that they contain."""
    roots = _words(spark, sf_dir, "benchmark").filter(F.char_length(F.lower("word")).between(5, 8))
    return word_joins.contained_either_way(_words(spark, sf_dir, "documents"), roots, root="word")


@query(
    f"""
WITH w AS (SELECT DISTINCT unnest({_SQL_WORDS}) AS w FROM documents),
k AS (SELECT w, unnest(range(0, length(w) + 1)) AS i FROM w),
d AS (SELECT w, i, CASE WHEN i = 0 THEN w ELSE substring(w, 1, i - 1) || substring(w, i + 1) END AS k FROM k)
SELECT DISTINCT a.w AS a, b.w AS b FROM d a JOIN d b ON a.k = b.k AND a.w < b.w AND (a.i = b.i OR a.i = 0 OR b.i = 0)
"""
)
def word_pairs_within_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different words of the documents that are one edit apart."""
    return word_joins.pairs_within_one(_words(spark, sf_dir, "documents"))


@query(
    r"""
WITH q AS (SELECT item_id AS query_id, lower(substring(text, 3, 7)) AS q, CAST(item_id % 3 AS INTEGER) AS kind FROM benchmark),
v AS (SELECT lang AS surah, doc_id AS verse, lower(text) AS f, text, source FROM documents),
h AS (
  SELECT query_id, surah, verse, (length(f) - length(replace(f, q, ''))) // length(q) + CASE WHEN contains(text, q) THEN 2 ELSE 0 END AS relevance, NULL AS context FROM (SELECT * FROM q WHERE kind = 0 AND NOT regexp_matches(q, '\s')) JOIN v ON contains(f, q)
  UNION ALL SELECT query_id, surah, verse, 1, 'Root: ' || surah || ', ' || source FROM (SELECT query_id, 'xsrc' || query_id || 'x' AS q FROM q WHERE kind = 1) JOIN v ON contains(q, lower(source)) OR contains(lower(source), q) OR contains(q, lower(surah)) OR contains(lower(surah), q)
  UNION ALL SELECT query_id, surah, verse, 1, source FROM (SELECT query_id, 'RC' || (query_id % 20) AS q FROM q WHERE kind = 2) JOIN v ON contains(lower(source), lower(q))),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, surah, verse) AS nth FROM h)
SELECT query_id, surah, CASE surah WHEN 'en' THEN 'English' ELSE '' END AS surah_name, verse, CAST(relevance AS INTEGER) AS relevance, context FROM r WHERE nth <= 20
"""
)
def many_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of all three types, one for each benchmark item, answered together."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("surah"), F.col("doc_id").alias("verse"), "text", "source")
    morphology = docs.select("surah", "verse", F.col("source").alias("translation"), F.array("surah", "source").alias("roots"))
    item = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lower(F.substring("text", 3, 7)).alias("q"), (F.col("item_id") % 3).alias("kind"))
    one_word = (F.col("kind") != 0) | ~F.col("q").rlike(r"\s")
    asked = F.when(F.col("kind") == 0, F.col("q")).when(F.col("kind") == 1, F.concat(F.lit("xsrc"), "query_id", F.lit("x"))).otherwise(F.concat(F.lit("RC"), F.col("query_id") % 20))
    requests = item.filter(one_word).select("query_id", asked.alias("q"), F.get(F.array(*map(F.lit, ("text", "root", "gloss"))), F.col("kind").cast("int")).alias("type"))
    names = spark.createDataFrame([("en", "English")], "id string, english_name string")
    corpus = search_many.prepare(docs.drop("source"), morphology, names, shared_folder(spark, "requests"))
    return search_many.answer(corpus, requests).drop("text")
