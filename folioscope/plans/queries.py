"""The operators applied to the test tables, each with SQL for the same rows.

Documents stand for verses, customers with orders and lines for divisions with
verses and segments, conversations for verses with words, events for bookmarks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as t
from folioscope.functions.align import align
from folioscope.operators import bookmarks, lookup, model, quality, render, repair, search
from folioscope.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_SPACE = r"[\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- search -------------------------------------------------------------------


@query(
    r"""
WITH n AS (SELECT doc_id, text, lower(regexp_replace(text, '[\x{64b}-\x{65f}\x{610}-\x{61a}\x{6d6}-\x{6ed}\x{640}\x{670}]', '', 'g')) AS f FROM documents),
s AS (SELECT doc_id, CAST(len(regexp_extract_all(f, 'the')) + CASE WHEN contains(text, 'the') THEN 2 ELSE 0 END
                        + len(regexp_extract_all(f, 'license')) + CASE WHEN contains(text, 'license') THEN 2 ELSE 0 END AS INTEGER) AS relevance FROM n)
SELECT doc_id, relevance FROM s WHERE relevance > 0 ORDER BY relevance DESC, doc_id LIMIT 20
"""
)
def text_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_text(table(spark, sf_dir, "documents"), "The license a", ["doc_id"]).select("doc_id", "relevance")


@query(
    """
WITH v AS (SELECT n_nationkey, list_sort([n_name, r_name]) AS roots FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, 'Root: ' || array_to_string(roots, ', ') AS context FROM v
WHERE len(list_filter(roots, lambda r: contains('nation_1', lower(r)) OR contains(lower(r), 'nation_1'))) > 0 ORDER BY n_nationkey LIMIT 20
"""
)
def root_search_bidirectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = joined.withColumn("roots", F.array_sort(F.array("n_name", "r_name")))
    return search.search_roots(rows, "Nation_1", ["n_nationkey"]).select("n_nationkey", "context")


@query(
    """
WITH f AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS translation FROM orders GROUP BY o_custkey)
SELECT o_custkey, translation FROM f WHERE contains(lower(translation), 'high') ORDER BY o_custkey LIMIT 20
"""
)
def gloss_search_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = model.first_and_set(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", ["o_orderkey"], "o_orderstatus")
    return search.search_glosses(first, "HIGH", ["o_custkey"], "o_orderpriority").select("o_custkey", F.col("o_orderpriority").alias("translation"))


@query("SELECT doc_id, n_chars FROM documents WHERE contains(text, 'License') ORDER BY doc_id")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    verses = table(spark, sf_dir, "documents").select(F.col("lang").alias("surah"), F.col("doc_id").alias("verse"), "text", "n_chars")
    found = lookup.substring_search(verses, "License")
    return found.select(F.col("verse").alias("doc_id"), F.char_length("text").cast("long").alias("n_chars")).orderBy("doc_id")


# -- joins, groups, order -------------------------------------------------------


@query(
    """
SELECT c.c_custkey, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(l.l_linenumber) AS BIGINT) AS n_segments
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R'
GROUP BY c.c_custkey
"""
)
def left_join_predicate_in_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    none = [F.lit(0).alias("verse"), F.lit(0).alias("word")]
    words = c.join(o, c["c_custkey"] == o["o_custkey"]).select("c_custkey", F.col("o_orderkey").alias("surah"), *none)
    segments = li.select(F.col("l_orderkey").alias("surah"), *none, F.col("l_linenumber").alias("segment"), F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).alias("root"))
    return model.with_roots(words, segments).groupBy("c_custkey").agg(F.count("*").alias("n_rows"), F.count("segment").alias("n_segments"))


@query(
    """
WITH j AS (SELECT o.o_custkey, o.o_orderkey, o.o_orderpriority, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_returnflag
           FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_returnflag <> 'N')
SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS translation,
       array_to_string(list_sort(array_agg(DISTINCT l_returnflag) FILTER (WHERE l_returnflag IS NOT NULL)), ',') AS roots
FROM j GROUP BY o_custkey
"""
)
def verse_first_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("surah"), F.lit(1).alias("verse"), F.col("o_orderkey").alias("word"), F.col("o_orderpriority").alias("translation"))
    flags = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    segments = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("surah"), F.lit(1).alias("verse"), F.col("o_orderkey").alias("word"), F.col("l_linenumber").alias("segment"), flags.alias("root"))
    out = model.search_morphology(words, segments)
    return out.select(F.col("surah").alias("o_custkey"), "translation", F.nullif(F.array_join("roots", ","), F.lit("")).alias("roots"))


@query("SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY turn) AS line, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY conv_id")
def ordered_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.ordered(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], ["role", "text"], "words")
    line = F.array_join(F.transform("words", lambda w: F.concat(w["role"], F.lit(":"), w["text"])), "|")
    return rows.select("conv_id", line.alias("line"), F.size("words").cast("long").alias("n"))


@query(
    """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r WHERE k = 1
"""
)
def segment_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    return model.keep_first(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT l_orderkey, arg_max(l_partkey, CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey")
def invert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey"))
    return model.last_wins(rows, "l_orderkey", "l_partkey", "at")


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 1")
def longest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.longest(table(spark, sf_dir, "documents"), "lang")


@query(
    f"""
SELECT CAST(count(DISTINCT lang) AS BIGINT) AS total_surahs, CAST(count(*) AS BIGINT) AS total_verses,
       CAST(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda w: w <> ''))) AS BIGINT) AS total_words FROM documents
"""
)
def word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.corpus_counts(table(spark, sf_dir, "documents").withColumnRenamed("lang", "surah"))


@query(
    """
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS in_verse,
       CAST(row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS INTEGER) AS in_surah FROM conversations
"""
)
def running_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.running_index(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "in_verse")
    return model.running_index(rows, ["role"], ["conv_id", "turn"], "in_surah").select("conv_id", "turn", F.col("in_verse").cast("int"), F.col("in_surah").cast("int"))


@query(
    """
SELECT o_orderkey, o_totalprice, coalesce(name, '') AS name FROM (
  SELECT o.o_orderkey, o.o_totalprice, c.c_name AS name FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey)
"""
)
def dimension_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_totalprice")
    return lookup.with_default(rows, known, "key", {"name": ""}).select("o_orderkey", "o_totalprice", "name")


@query("SELECT n_nationkey, n_name AS name FROM nation ORDER BY n_nationkey")
def ordered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    dimension = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("english_name"), *[F.lit(None).alias(c) for c in ("english_translation", "revelation_type", "verse_count")])
    return lookup.divisions(dimension).select(F.col("number").alias("n_nationkey"), F.col("english_name").alias("name"))


@query(
    """
SELECT o.o_orderkey, o.o_orderpriority, string_agg(l.l_linenumber || '-' || l.l_partkey, ',' ORDER BY l.l_linenumber, l.l_partkey) AS segments
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_custkey = 7 GROUP BY o.o_orderkey, o.o_orderpriority
"""
)
def hierarchy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_custkey = 7")
    own = table(spark, sf_dir, "lineitem").join(o.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    nested = model.ordered(own, ["o_orderkey"], ["l_linenumber", "l_partkey"], [], "s")
    line = F.array_join(F.transform("s", lambda s: F.concat(s["l_linenumber"], F.lit("-"), s["l_partkey"])), ",")
    return o.join(nested, "o_orderkey", "left").select("o_orderkey", "o_orderpriority", line.alias("segments"))


@query(
    """
WITH b(start, page) AS (VALUES (5, 1), (12, 2), (30, 3), (41, 4))
SELECT p_partkey, CAST(coalesce(page, 1) AS INTEGER) AS page FROM part ASOF LEFT JOIN b ON p_size >= start
"""
)
def floor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame([(5, 1), (12, 2), (30, 3), (41, 4)], "start int, page int")
    return lookup.as_of_bands(table(spark, sf_dir, "part"), bands, F.col("p_size"), "start", "page", 1).select("p_partkey", "page")


@query(
    """
WITH v AS (SELECT user_id, ts, event_id FROM events WHERE event_type <> 'purchase'),
b AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT v.event_id, coalesce(b.value, -1.0) AS value FROM v ASOF LEFT JOIN b ON v.user_id = b.user_id AND v.ts >= b.ts
"""
)
def floor_lookup_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    bands = events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    rows = events.filter("event_type <> 'purchase'").select("user_id", "ts", "event_id")
    return lookup.as_of(rows, bands, ["user_id"], "ts", "value", -1.0).select("event_id", "value")


@query(
    """
WITH b AS (SELECT l_extendedprice AS start, max(l_orderkey) AS line FROM lineitem GROUP BY l_extendedprice)
SELECT o_orderkey, coalesce(line, -1) AS line FROM orders ASOF LEFT JOIN b ON o_totalprice >= start
"""
)
def floor_lookup_unkeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order's price the line with the next lower one: as many bands as there are prices, and no key to split them by."""
    bands = table(spark, sf_dir, "lineitem").groupBy(F.col("l_extendedprice").alias("price")).agg(F.max("l_orderkey").alias("line"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    return lookup.as_of(rows, bands, [], "price", "line", -1).select("o_orderkey", "line")


# -- text -----------------------------------------------------------------------


@query(
    r"""
SELECT doc_id, trim(replace(regexp_replace(text, '[\x{64b}-\x{65f}\x{610}-\x{61a}\x{6d6}-\x{6ed}\x{640}\x{670}]', '', 'g'), chr(1649), chr(1575)), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160)) AS form FROM documents
"""
)
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.search_form(F.col("text")).alias("form"))


@query(
    """
SELECT n_nationkey, translate(n_name, '''|>&<}ApHx$c*vYbtjdrzsSDTZEgfqklmnhwy', 'ءءأأإإآةحخششذثىبتجدرزسصضطظعغفقكلمنهوي') AS arabic,
       translate(CAST(n_nationkey AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') AS digits FROM nation
"""
)
def transliterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", t.transliterate(F.col("n_name")).alias("arabic"), t.arabic_digits(F.col("n_nationkey")).alias("digits"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE levenshtein(a.n_name, b.n_name) <= 1")
def edit_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    a, b = (n.select("n_regionkey", F.col("n_nationkey").alias(k), F.col("n_name").alias(f"name_{k}")) for k in "ab")
    return a.join(b, "n_regionkey").filter("a < b").filter(t.within_distance(F.col("name_a"), F.col("name_b"))).select("a", "b")


@query(
    r"""
SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160)) AS title,
       nullif(regexp_extract(html, '(?s)(<main\b[^>]*class="quran"[^>]*>.*?</main>)', 1), '') AS main,
       replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS url FROM pages
"""
)
def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", t.page_title(F.col("html")).alias("title"), t.page_main(F.col("html")).alias("main"), t.xml_escape(F.col("url")).alias("url"))


@query(
    f"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '')) AS w FROM documents),
k AS (SELECT doc_id, CASE WHEN regexp_full_match(w, '[\\x{{6d6}}-\\x{{6ed}}]+') THEN 'pause' WHEN regexp_matches(w, '[\\x{{fd3e}}\\x{{fd3f}}]') THEN 'ayah' ELSE 'word' END AS type FROM w)
SELECT doc_id, type, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY doc_id, type
"""
)
def token_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode(t.classified_tokens(F.col("text"))).alias("t"))
    return tokens.groupBy("doc_id", F.col("t.type").alias("type")).agg(F.count("*").alias("n"))


@query(
    f"""
WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '')) AS word FROM documents)
SELECT word, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY word
"""
)
def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(t.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT doc_id, coalesce(nullif(split_part(text, '.', 1), ''), substring(text, 1, 80)) AS gloss FROM documents")
def first_sentence_gloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.first_sentence(F.col("text")).alias("gloss"))


@query(
    r"""
SELECT event_id, user_id || ':' || event_id AS reference, CAST(user_id AS INTEGER) AS first, CAST(event_id AS INTEGER) AS second,
       try_cast(regexp_extract(props, ':\s*(\d+)', 1) AS INTEGER) AS k FROM events
"""
)
def references_and_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = t.format_reference(F.col("user_id"), F.col("event_id"))
    rows = table(spark, sf_dir, "events").select("event_id", "props", ref.alias("reference"))
    return rows.select("event_id", "reference", t.parse_reference(F.col("reference"))["first"].alias("first"), t.parse_reference(F.col("reference"))["second"].alias("second"), F.from_json("props", "k int")["k"].alias("k"))


_CODES = {"Syntactic_Role": {"R": "Returned", "A": "Accepted"}}


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Accepted' ELSE upper(l_returnflag[1]) || l_returnflag[2:] END AS label,
       CASE WHEN l_returnflag IN ('R', 'A') THEN 'Syntactic_Role' ELSE '' END AS category FROM lineitem
"""
)
def code_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", t.label(code, _CODES).alias("label"), t.category(code, _CODES).alias("category"))


@query(
    r"""
SELECT url, trim(regexp_replace(url, '[^\p{L}\p{N}_]+', '-', 'g'), '-') AS slug FROM pages
"""
)
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url", t.slug(F.col("url")).alias("slug"))


# -- quality and repair ------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id")
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.orphans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id").select("doc_id", "lang", "source")


@query(
    """
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INTEGER) AS expected FROM d)
SELECT * FROM r WHERE l_linenumber <> expected
"""
)
def consecutive_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return quality.gaps(rows, ["l_orderkey"], "l_linenumber")


@query(
    """
SELECT n_nationkey, coalesce(p.name, n.n_name) AS n_name, p.name IS NOT NULL AS patched
FROM nation n LEFT JOIN (VALUES (1, 'nation_1', 'first'), (2, 'other', 'second')) p(k, old, name) ON n.n_nationkey = p.k AND n.n_name = p.old
"""
)
def keyed_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").withColumn("old", F.col("n_name"))
    patches = spark.createDataFrame([(1, "nation_1", "first"), (2, "other", "second")], "n_nationkey int, old string, n_name string")
    return repair.patch(rows, patches, ["n_nationkey", "old"]).select("n_nationkey", "n_name", "patched")


@query(
    """
WITH new AS (SELECT 'nation_3' AS root UNION ALL SELECT 'zeta' UNION ALL SELECT 'alpha'), m AS (SELECT max(n_nationkey) AS k FROM nation)
SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS root FROM nation
UNION ALL SELECT CAST(m.k + row_number() OVER (ORDER BY root) AS BIGINT), root FROM new, m WHERE root NOT IN (SELECT n_name FROM nation)
"""
)
def append_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("root"))
    return repair.add_missing(have, spark.createDataFrame([("nation_3",), ("zeta",), ("alpha",)], "root string"))


_LISTS = ("shades_of_meaning", "hadith_examples", "classical_sources", "idioms_customs", "word_by_word_shades")
_REST = ', "hadith_examples": [], "classical_sources": [], "idioms_customs": '


def _response(k: Column, props: Column, event_type: Column) -> Column:
    """Of an event's own values a response that is empty, broken, a list, short of keys, wrong twice, wrong in its text, or right."""
    full = lambda meaning, shades, idioms: F.concat(F.lit('{"general_meaning": '), meaning, F.lit(', "shades_of_meaning": '), shades, F.lit(_REST), idioms, F.lit(', "word_by_word_shades": []}'))
    text = F.concat(F.lit('"'), event_type, F.lit('"'))
    return (
        F.when(k % 7 == 0, " \t")
        .when(k % 7 == 1, F.substring(props, 1, 5))
        .when(k % 7 == 2, F.concat(F.lit("["), k, F.lit("]")))
        .when(k % 7 == 3, F.concat(F.lit('{"general_meaning": '), text, F.lit("}")))
        .when(k % 7 == 4, full(text, props, k.cast("string")))
        .when(k % 7 == 5, full(k.cast("string"), F.lit("[]"), F.lit("[]")))
        .otherwise(full(text, F.concat(F.lit("["), props, F.lit("]")), F.lit("[]")))
    )


_FINDINGS = """
SELECT event_id, user_id, event_type, value, k, CASE k % 7 WHEN 0 THEN ['empty'] WHEN 1 THEN ['invalid JSON'] WHEN 2 THEN ['not an object'] WHEN 3 THEN ['missing key: shades_of_meaning']
  WHEN 4 THEN ['shades_of_meaning is not a list', 'idioms_customs is not a list'] WHEN 5 THEN ['general_meaning is not a string'] ELSE [] END AS findings
FROM (SELECT *, CAST(regexp_extract(props, ':\\s*(\\d+)', 1) AS INTEGER) AS k FROM events)
""".replace("\\\\", "\\")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries of a dictionary."""
    k = F.from_json("props", "k int")["k"]
    rows = table(spark, sf_dir, "events").withColumn("k", k)
    return rows.select(
        "event_id", (F.col("event_id") % 900).alias("id"), F.when(F.col("k") != 50, F.concat_ws("-", "event_type", F.col("user_id").cast("string"))).alias("root"),
        F.when(F.col("value") >= 20, F.col("event_type")).otherwise(" ").alias("pos"), _response(F.col("k"), F.col("props"), F.col("event_type")).alias("full_response"),
        *[F.when(F.col("k") > 10 * i, F.col("props")).alias(c) for i, c in enumerate(_LISTS)],
    )


@query(
    f"""
WITH f AS ({_FINDINGS}),
m AS (SELECT event_id % 900 AS id, CASE WHEN k <> 50 THEN event_type || '-' || user_id END AS root, value, k, findings FROM f),
w AS (SELECT event_type || '-' || (user_id + CASE WHEN event_id % 97 = 0 THEN 100000 ELSE 0 END) AS root FROM events WHERE user_id % 3 <> 0),
r("check", findings, level) AS (
  SELECT 'missing roots', count(DISTINCT root), 'FAIL' FROM w WHERE root NOT IN (SELECT root FROM m WHERE root IS NOT NULL)
  UNION ALL SELECT 'empty full_response', count(*) FILTER (WHERE k % 7 = 0), 'FAIL' FROM m
  UNION ALL SELECT 'invalid full_response', CAST(sum(CASE WHEN k % 7 = 0 THEN 0 ELSE len(findings) END) AS BIGINT), 'FAIL' FROM m
  UNION ALL SELECT 'duplicate roots', count(*), 'FAIL' FROM (SELECT root FROM m GROUP BY root HAVING count(*) > 1)
  UNION ALL SELECT 'duplicate ids', count(*), 'FAIL' FROM (SELECT id FROM m GROUP BY id HAVING count(*) > 1)
  UNION ALL SELECT 'empty pos', count(*) FILTER (WHERE coalesce(value < 20, true)), 'FAIL' FROM m
  UNION ALL SELECT 'orphans', count(*) FILTER (WHERE root IS NULL OR root NOT IN (SELECT root FROM w)), 'INFO' FROM m
  UNION ALL SELECT 'empty fields', CAST(sum(5 - (CAST(k > 0 AS INT) + CAST(k > 10 AS INT) + CAST(k > 20 AS INT) + CAST(k > 30 AS INT) + CAST(k > 40 AS INT))) AS BIGINT), 'INFO' FROM m)
SELECT "check", CAST(findings AS BIGINT) AS findings, level, findings = 0 OR level = 'INFO' AS ok FROM r
"""
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight checks of a dictionary of events, against the roots of a third of the users and some that nobody has."""
    wanted = table(spark, sf_dir, "events").filter("user_id % 3 <> 0")
    user = F.col("user_id") + F.when(F.col("event_id") % 97 == 0, 100000).otherwise(0)
    return quality.report(_entries(spark, sf_dir), wanted.select(F.concat_ws("-", "event_type", user.cast("string")).alias("root")))


@query(f"WITH f AS ({_FINDINGS}) SELECT event_id, unnest(findings) AS finding FROM f")
def json_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("event_id", F.explode(quality.json_findings(F.col("full_response"))).alias("finding"))


@query("SELECT user_id, event_type, arg_max(event_id, CAST(epoch_us(ts) AS HUGEINT) * 1000000 + event_id) AS event_id FROM events GROUP BY user_id, event_type")
def bookmark_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return bookmarks.latest(events, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT CAST((SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY c_name) AS BIGINT) AS id, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def next_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    return model.next_ids(c.filter("c_mktsegment = 'BUILDING'").drop("id"), c, "id", "c_name").select("id", "c_name")


# -- no SQL form -------------------------------------------------------------------


def _pairs_joined(words: Column) -> Column:
    """A list of words with every second one stuck to the one before it."""
    first, second = F.filter(words, lambda _, i: i % 2 == 0), F.filter(words, lambda _, i: i % 2 == 1)
    return F.zip_with(first, second, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))


def _aligned(rows: DataFrame) -> DataFrame:
    entries = rows.select("conv_id", "turn", F.explode(align(F.col("w"), F.col("joined"))).alias("e"))
    return entries.select("conv_id", "turn", F.col("e.index").alias("word"), F.array_join(F.col("e.tokens").cast("array<string>"), ",").alias("tokens"), F.col("e.match").alias("match"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.words(F.col("text")).alias("w"))
    return rows.withColumn("joined", _pairs_joined(F.col("w")))


@query()
def align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's words against the same words with every second pair joined."""
    return _aligned(_turns(spark, sf_dir).filter(F.size("w") > 0))


@query(
    f"""
WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda w: w <> '') AS w FROM conversations),
p AS (SELECT * FROM t WHERE len(list_filter(w, lambda x, i: i % 2 = 0 AND length(x) < 2)) = 0),
e AS (SELECT conv_id, turn, len(w) AS n, unnest(range(len(w))) AS word FROM p)
SELECT conv_id, turn, CAST(word AS INTEGER) AS word, CAST(word // 2 AS VARCHAR) AS tokens, CASE WHEN word = n - 1 AND n % 2 = 1 THEN 'direct' ELSE 'join' END AS match FROM e
"""
)
def align_joined_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for turns whose every second word is of two letters or more: then each pair of words shares a token, and a last odd word has its own."""
    rows = _turns(spark, sf_dir)
    short = F.size(F.filter("w", lambda w, i: (i % 2 == 1) & (F.char_length(w) < 2)))
    return _aligned(rows.filter(short == 0))


_PAGE = """
WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, 'SPACE'), lambda w: w <> '') AS words FROM conversations),
p AS (SELECT conv_id, turn, words, coalesce(sum(len(words)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w),
s AS (SELECT conv_id, turn, array_to_string(list_transform(words, lambda w, i: '<span class="quran-word" data-surah="' || conv_id || '" data-ayah="' || (turn + 1) || '" data-word="' || i || '" data-index="' || CAST(before + i AS BIGINT)
    || '" data-morphology=''' || CASE WHEN i % 3 = 1 THEN ESCAPED('[{"gloss":"' || replace(replace('<' || w || '>', chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"}]') ELSE '[]' END || '''>' || ESCAPED(w) || '</span>'), chr(10)) AS line FROM p),
b AS (SELECT conv_id, string_agg('<section class="ayah" id="ayah-' || (turn + 1) || '" data-ayah="' || (turn + 1) || '"><h2 class="ayah-number">' || (turn + 1) || '</h2><p class="ayah-text">' || line || '</p></section>', chr(10) ORDER BY turn) AS body FROM s GROUP BY conv_id)
SELECT conv_id AS surah, lpad(CAST(conv_id AS VARCHAR), CAST(greatest(3, length(CAST(conv_id AS VARCHAR))) AS INTEGER), '0') || '-conversation-' || conv_id || '.html' AS file,
       '<!doctype html>' || chr(10) || '<html lang="ar" dir="rtl"><head><meta charset="utf-8"><title>conversation ' || conv_id || '</title></head><body>' || chr(10) || '<main class="quran" data-surah-number="' || conv_id
       || '"><header class="surah-header"><h1 class="surah-name">conversation ' || conv_id || '</h1></header>' || chr(10) || body || chr(10) || '</main></body></html>' || chr(10) AS html FROM b
"""


def _sql_escaped(sql: str) -> str:
    """Calls of ESCAPED(x) as the replacements of HTML's five characters."""
    while "ESCAPED(" in sql:
        start = sql.index("ESCAPED(")
        end, depth, quoted = start + 8, 1, False
        while depth:
            quoted ^= sql[end] == "'"
            depth += 0 if quoted else (sql[end] == "(") - (sql[end] == ")")
            end += 1
        inner = sql[start + 8 : end - 1]
        for char, name in (("'&'", "&amp;"), ("'<'", "&lt;"), ("'>'", "&gt;"), ("chr(34)", "&quot;"), ("chr(39)", "&#x27;")):
            inner = f"replace({inner}, {char}, '{name}')"
        sql = sql[:start] + inner + sql[end:]
    return sql


@query(_sql_escaped(_PAGE.replace("SPACE", _SPACE)))
def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of HTML for each conversation, its turns as verses, with the morphology of every third word."""
    turns = table(spark, sf_dir, "conversations")
    verses = turns.select(F.col("conv_id").alias("surah"), F.concat(F.lit("conversation "), F.col("conv_id")).alias("name"), (F.col("turn") + 1).alias("verse"), "text")
    words = verses.select("surah", "verse", F.posexplode(t.words(F.col("text"))).alias("at", "word_text")).filter("at % 3 = 0")
    rows = words.select("surah", "verse", (F.col("at") + 1).alias("word"), F.concat(F.lit("<"), "word_text", F.lit(">")).alias("gloss"), F.lit(0).alias("line"))
    return render.pages(verses, readers.keyed(rows, ["surah", "verse", "word"], "line"))
