"""Further operators as queries: words and segments, priorities, marks, guards' outcomes, repairs, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import jsons
from folioscope.functions import text as t
from folioscope.operators import bookmarks, lookup, model, quality, repair, search
from folioscope.plans.queries import query, table
from folioscope.sources import divisions, sinks

_NESTED = """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'Stem' ELSE 'Prefix' END AS morph_type,
                  CASE WHEN l_linestatus = 'O' THEN 'SUBJ' END AS syntactic_role FROM lineitem),
k AS (SELECT l_orderkey,
  first(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (WHERE morph_type = 'Stem') AS stem,
  first(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (WHERE syntactic_role <> '') AS role,
  last(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS final FROM s GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(stem, role, final) AS stem_first, coalesce(role, stem, final) AS role_first FROM k
"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumns({"morph_type": F.when(F.col("l_returnflag") == "R", "Stem").otherwise("Prefix"), "syntactic_role": F.when(F.col("l_linestatus") == "O", "SUBJ")})
    return model.ordered(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], ["morph_type", "syntactic_role"], "segments")


@query(_NESTED)
def first_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("segments")
    return _segments(spark, sf_dir).select("l_orderkey", lookup.first_stem(s)["l_partkey"].alias("stem_first"), lookup.first_role(s)["l_partkey"].alias("role_first"))


@query(
    """
SELECT conv_id, coalesce(string_agg(DISTINCT role, ' · ' ORDER BY role) FILTER (WHERE role NOT IN ('', 'null')), '') AS glosses FROM conversations GROUP BY conv_id
"""
)
def unique_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("role")).alias("g"))
    return rows.select("conv_id", t.unique_glosses(F.col("g"), F.lit(""), " · ").alias("glosses"))


_MARKED = "translate(text, '.,', 'ۖۗ')"


@query(
    rf"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce({_MARKED}, ''), '[\t\n\x0b\f\r ]+'), lambda w: w <> '')) AS w FROM documents),
k AS (SELECT doc_id, regexp_extract(w, '^((?s:.*?))[ۖۗ]*$', 1) AS word, w FROM w)
SELECT doc_id, CAST(count(*) FILTER (WHERE word <> '') AS BIGINT) AS words, CAST(sum(length(w) - length(word)) AS BIGINT) AS marks FROM k GROUP BY doc_id
"""
)
def words_and_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.translate("text", ".,", "ۖۗ")
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode(t.tokens_and_marks(marked)).alias("t"))
    return tokens.groupBy("doc_id").agg(F.count_if(F.col("t.kind") == "word").alias("words"), F.count_if(F.col("t.kind") == "mark").alias("marks"))


@query(
    """
SELECT doc_id, translate(regexp_replace(translate(text, 'aeio', 'ىٱٰآ'), '[ً-ٟؐ-ؚـ]', '', 'g'), 'ٰٱىآ', 'اايا') AS form FROM documents
"""
)
def matching_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.matching_form(F.translate("text", "aeio", "ىٱٰآ")).alias("form"))


@query(
    """
SELECT p_partkey, CASE WHEN length(u) > 18 THEN substring(u, 1, 15) || '…' ELSE u END AS label FROM (
  SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(replace(p_type, '_', ' '), '([A-Za-z0-9]+|[^A-Za-z0-9]+)'), lambda p: upper(p[1]) || p[2:]), '') AS u FROM part)
"""
)
def short_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", t.short_label(F.col("p_type")).alias("label"))


_SPEECH = ("NOUN_PROP", "PREP", "CASE_INDEF_(ACC_GEN)", "PRON_3MP", "GEN_CONS", "NEG_PART.NEG_MAA", "SUKUN", "no_such_code", "null")


@query(
    """
SELECT p_partkey, r[1] AS label, r[2] AS short, r[3] AS category FROM (SELECT p_partkey, CASE p_partkey % 9
  WHEN 0 THEN ['Proper Noun — e.g. Allāh, Mūsā, Ibrāhīm', 'Proper N', 'Morph_Tag (POS)']
  WHEN 1 THEN ['Preposition (حرف جر) — e.g. bi-, li-, fi-, min, `an', 'Prep', 'Morph_Tag (POS)']
  WHEN 2 THEN ['Indefinite Acc/Gen Marker — diptote fatḥa (ـَ)', 'Indefinite Acc/…', 'Morph_Tag (POS)']
  WHEN 3 THEN ['3rd Person Masculine Plural — ''they'' (-hum)', '3rd Person Masc…', 'Morph_Tag (POS)']
  WHEN 4 THEN ['Genitive Construct (مضاف إليه) — second term of iḍāfa', 'Iḍāfa', 'Syntactic_Role']
  WHEN 5 THEN ['Negation with Mā — ''mā'' of negation', 'Negation with M…', 'Morph_Tag (POS)']
  WHEN 6 THEN ['Sukūn (ـْ) — jussive marker (no vowel)', 'Sukūn', 'Case_Mood_Marker']
  WHEN 7 THEN ['No Such Code', 'No Such Code', '']
  ELSE ['', '', ''] END AS r FROM part)
"""
)
def speech_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, short labels and categories of codes that are in the tables, of an unknown one, and of none."""
    code = F.get(F.array(*map(F.lit, _SPEECH)), (F.col("p_partkey") % 9).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", t.label(code).alias("label"), t.short_label(code).alias("short"), t.category(code).alias("category"))


@query(
    r"""
SELECT page_id, lpad(CAST(page_id AS VARCHAR), CAST(greatest(3, length(CAST(page_id AS VARCHAR))) AS INTEGER), '0') || '-' || trim(regexp_replace(url, '[^\p{L}\p{N}_]+', '-', 'g'), '-') || '.html' AS file,
       CASE WHEN page_id % 3 = 0 THEN '' ELSE ' url="' || replace(replace(replace(replace(trim(url), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '"' END AS attribute FROM pages
"""
)
def file_names_and_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("page_id") % 3 == 0, "(null)").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", t.page_file(F.col("page_id"), t.slug(F.col("url"))).alias("file"), t.xml_attribute("url", value).alias("attribute"))


@query(
    """
SELECT o.o_orderkey, coalesce(n.n_name, '') AS name, coalesce(r.r_name, '') AS region
FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
"""
)
def two_hop_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("hop"), F.col("n_name").alias("name"), F.col("r_name").alias("region"))
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("hop"))
    rows = table(spark, sf_dir, "orders").join(c, "o_custkey", "left")
    return lookup.with_default(rows, n, "hop", {"name": "", "region": ""}).select("o_orderkey", "name", "region")


_LINES = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query(
    f"""
WITH s AS (SELECT *, l_orderkey % 7 AS surah, l_linenumber % 2 AS word, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS gloss FROM lineitem)
SELECT surah, l_orderkey AS verse, word, CAST(first(l_partkey {_LINES}) AS VARCHAR) AS token, first(gloss {_LINES}) FILTER (WHERE gloss IS NOT NULL) AS first_gloss,
       string_agg(coalesce(gloss, l_linestatus), ' ' {_LINES}) AS translation, CAST(last(l_suppkey {_LINES}) FILTER (WHERE l_linestatus = 'F') AS VARCHAR) AS root
FROM s JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey GROUP BY surah, l_orderkey, word
"""
)
def words_from_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row's fields, the joined glosses of all rows and the last root given, words of unknown verses left out."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    at = [(F.col("l_orderkey") % 7).alias("surah"), F.col("l_orderkey").alias("verse"), (F.col("l_linenumber") % 2).alias("word")]
    lines = table(spark, sf_dir, "lineitem")
    segments = lines.select(
        *at, line.alias("line"), F.col("l_partkey").cast("string").alias("token"), F.lit("").alias("without_diacritics"), F.lit("").alias("punctuation_mark"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("gloss"), F.col("l_linestatus").alias("text"),
    )
    roots = lines.filter("l_linestatus = 'F'").select(*at, F.col("l_suppkey").cast("string").alias("root"), line.alias("at"))
    verses = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select((F.col("o_orderkey") % 7).alias("surah"), F.col("o_orderkey").alias("verse"))
    return model.words_of(segments, verses, roots).select("surah", "verse", "word", "token", "first_gloss", "translation", "root")


@query(
    """
SELECT event_id, '"' || replace(props, '"', '""') || '"' AS cell, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS json FROM events
"""
)
def csv_and_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    objects = sinks.as_json(events.select("event_id", "event_type")).select(F.get_json_object("json", "$.event_id").cast("long").alias("event_id"), "json")
    cells = sinks.csv_text(events.select("event_id", "props"), ["event_id", "props"]).select(F.regexp_extract("line", r"^(\d+),(.*)$", 1).cast("long").alias("event_id"), F.regexp_extract("line", r"(?s)^(\d+),(.*)$", 2).alias("cell"))
    return objects.join(cells, "event_id")


@query(
    """
SELECT n_nationkey AS id, 'n_name' AS "column" FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT n_nationkey, 'note' FROM nation WHERE n_nationkey % 3 <> 0
"""
)
def empty_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 4 == 0, " \t").otherwise(F.col("n_name")).alias("n_name"), F.when(F.col("n_nationkey") % 3 == 0, "x").alias("note"))
    return quality.empty_fields(rows, ["n_name", "note"])


@query(
    """
SELECT CAST(count(*) FILTER (WHERE n_nationkey % 3 = 0 AND n_nationkey % 2 = 0) AS BIGINT) AS updated, CAST(count(*) FILTER (WHERE n_nationkey % 3 = 0 AND n_nationkey % 2 = 1) AS BIGINT) AS skipped,
       CAST(count(*) FILTER (WHERE n_nationkey % 3 <> 0) AS BIGINT) AS valid FROM nation
"""
)
def backfill_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(
        key.alias("id"), F.when(key % 3 == 0, F.when(key % 2 == 0, "").otherwise("{")).otherwise("{}").alias("full_response"), F.when(key % 2 == 0, F.col("n_name")).otherwise("").alias("general_meaning"), *[F.lit("[]").alias(c) for c in repair.PARTS]
    )
    return repair.counters(repair.backfill(rows))


@query(
    """
WITH v AS (SELECT conv_id AS surah, turn + 1 AS verse, CASE WHEN turn = 0 AND conv_id % 2 = 0 THEN 'formula' ELSE text END AS text, CASE WHEN conv_id % 5 = 0 THEN 'given' END AS b FROM conversations),
f AS (SELECT surah, max(CASE WHEN verse = 1 THEN trim(text) END) AS first FROM v GROUP BY surah)
SELECT v.surah, v.verse, CASE WHEN v.surah = 1 THEN first WHEN v.surah = 9 THEN NULL ELSE coalesce(b, CASE WHEN first = 'formula' THEN first END) END AS opening
FROM v JOIN f USING (surah) WHERE NOT (verse = 1 AND b IS NULL AND first = 'formula' AND v.surah NOT IN (1, 9))
"""
)
def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("surah"), (F.col("turn") + 1).alias("verse"), F.when((F.col("turn") == 0) & (F.col("conv_id") % 2 == 0), "formula").otherwise(F.col("text")).alias("text"), F.when(F.col("conv_id") % 5 == 0, "given").alias("bismillah")
    )
    return quality.with_openings(rows, "formula").select("surah", "verse", "opening")


@query(
    r"""
WITH s AS (SELECT doc_id, lang, CAST(len(regexp_extract_all(lower(text), 'ing')) + CASE WHEN contains(text, 'ing') THEN 2 ELSE 0 END AS INTEGER) AS relevance FROM documents)
SELECT lang AS surah, CASE lang WHEN 'en' THEN 'English' ELSE '' END AS surah_name, doc_id AS verse, relevance FROM s WHERE relevance > 0 ORDER BY relevance DESC, lang, doc_id LIMIT 50
"""
)
def search_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    verses = table(spark, sf_dir, "documents").select(F.col("lang").alias("surah"), F.col("doc_id").alias("verse"), "text")
    names = spark.createDataFrame([("en", "English")], "id string, english_name string")
    return search.search(verses, verses, names, " ING ", "text", 50).drop("text")


@query(
    """
WITH old AS (SELECT user_id AS s, event_type AS v, max(epoch_us(ts) // 1000000) AS ts FROM events WHERE event_id % 2 = 0 GROUP BY ALL), asked AS (SELECT DISTINCT user_id AS s, event_type AS v FROM events WHERE event_id % 5 = 0)
SELECT s AS "surahNumber", v AS "verseNumber", ts AS "timestamp" FROM old WHERE (s, v) NOT IN (SELECT (s, v) FROM asked)
UNION ALL SELECT s, v, 0 FROM asked WHERE (s, v) NOT IN (SELECT (s, v) FROM old)
"""
)
def bookmark_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("surahNumber"), F.col("event_type").alias("verseNumber"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), "event_id")
    old = events.filter("event_id % 2 = 0").groupBy("surahNumber", "verseNumber").agg(F.max("timestamp").alias("timestamp"))
    asked = events.filter("event_id % 5 = 0").select("surahNumber", "verseNumber").distinct().withColumn("timestamp", F.lit(0).cast("long"))
    return bookmarks.toggle(old, asked)


@query("SELECT n_regionkey AS id, string_agg(n_nationkey || ':' || n_name, '|' ORDER BY n_nationkey) AS verses FROM nation WHERE n_regionkey = 2 GROUP BY n_regionkey")
def division_with_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    verses = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("surah"), F.col("n_nationkey").alias("verse"), F.col("n_name").alias("text"))
    dim = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"))
    out = lookup.division(dim, verses, 2)
    return out.select("id", F.array_join(F.transform("verses", lambda v: F.concat(v["verse"], F.lit(":"), v["text"])), "|").alias("verses"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS root FROM nation WHERE n_name = 'nation_7' OR n_name || 'x' = 'nation_7' LIMIT 1")
def two_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("root"), F.concat("n_name", F.lit("x")).alias("root_arabic"))
    return lookup.root_meaning(rows, "nation_7").select("id", "root")


@query("SELECT l_orderkey, coalesce(string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (WHERE l_linestatus = 'O'), '') AS parts FROM lineitem GROUP BY l_orderkey")
def non_empty_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("gloss", F.when(F.col("l_linestatus") == "O", F.col("l_partkey").cast("string")).otherwise(""))
    nested = model.ordered(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], ["gloss"], "segments")
    return nested.select("l_orderkey", F.array_join(lookup.filled(F.col("segments"), "gloss"), ",").alias("parts"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 0 ELSE CAST(event_id % 4 AS INTEGER) END AS n FROM events")
def json_list_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    text = F.when(k == 0, "").when(k == 1, '[{"arabic": "a"}]').when(k == 2, '[{"arabic": "a"}, {}]').otherwise("{")
    return table(spark, sf_dir, "events").select("event_id", jsons.list_size(text, jsons.QUOTES).alias("n"))


@query("SELECT doc_id, lang, length(text) AS length FROM documents ORDER BY lang, doc_id")
def verse_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat iteration over all documents, in corpus order."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.char_length("text").cast("long").alias("length")).orderBy("lang", "doc_id")


@query(
    """
WITH f AS (SELECT lang, doc_id, source FROM documents WHERE contains(source, 'src1') OR contains('src1', source) OR contains(lang, 'src1') OR contains('src1', lang) ORDER BY lang, doc_id LIMIT 30)
SELECT 'SRC1' AS query, 'root' AS type, string_agg(lang || ':' || doc_id || ' Root: ' || array_to_string(list_sort([lang, source]), ', '), '|' ORDER BY lang, doc_id) AS results, CAST(count(*) AS INTEGER) AS total FROM f
"""
)
def search_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to a search by root as one row, with its number of results."""
    docs = table(spark, sf_dir, "documents")
    verses = docs.select(F.col("lang").alias("surah"), F.col("doc_id").alias("verse"), "text")
    morphology = docs.select(F.col("lang").alias("surah"), F.col("doc_id").alias("verse"), F.col("source").alias("translation"), F.array_sort(F.array("lang", "source")).alias("roots"))
    names = spark.createDataFrame([], "id string, english_name string")
    out = search.envelope(search.search(verses, morphology, names, "SRC1", "root", 30), "SRC1", "root")
    line = F.array_join(F.transform("results", lambda r: F.concat(r["surah"], F.lit(":"), r["verse"], F.lit(" "), r["context"])), "|")
    return out.select("query", "type", line.alias("results"), "total")


@query(
    """
WITH f AS (SELECT lang, doc_id, source FROM documents WHERE contains(source, 'rc1') ORDER BY lang, doc_id LIMIT 40)
SELECT lang AS surah, CASE lang WHEN 'en' THEN 'English' ELSE '' END AS surah_name, doc_id AS verse, CAST(1 AS INTEGER) AS relevance, source AS context FROM f
"""
)
def search_by_gloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dispatcher's search by gloss, with the context of each result."""
    docs = table(spark, sf_dir, "documents")
    verses = docs.select(F.col("lang").alias("surah"), F.col("doc_id").alias("verse"), "text")
    morphology = docs.select(F.col("lang").alias("surah"), F.col("doc_id").alias("verse"), F.col("source").alias("translation"), F.array().cast("array<string>").alias("roots"))
    names = spark.createDataFrame([("en", "English")], "id string, english_name string")
    return search.search(verses, morphology, names, "RC1", "gloss", 40).drop("text")


_DIVISIONS = ", ".join(str(d[:1] + tuple(x.replace("'", "''") for x in d[1:4]) + d[4:]).replace('"', "'") for d in divisions.DIVISIONS)


@query(
    f"""
WITH d(id, name, meaning, revealed, verses) AS (VALUES {_DIVISIONS}),
v AS (SELECT doc_id, CAST(doc_id % 120 AS INTEGER) AS surah, CAST(n_chars % 300 AS INTEGER) AS verse FROM documents),
p AS (SELECT s * 1000 + v AS start, row_number() OVER () AS part FROM (VALUES {", ".join(map(str, divisions.PART_STARTS))}) t(s, v))
SELECT doc_id, coalesce(lpad(CAST(d.id AS VARCHAR), 3, '0') || '-' || f[d.id] || '.html', '') AS file, coalesce(d.name, '') AS english_name, coalesce(d.revealed, '') AS revelation_type, coalesce(verse <= d.verses, false) AS is_there, CAST(coalesce(p.part, 1) AS INTEGER) AS part
FROM (SELECT *, {divisions.FILE_NAMES!r} AS f FROM v) v LEFT JOIN d ON v.surah = d.id ASOF LEFT JOIN p ON v.surah * 1000 + v.verse >= p.start
"""
)
def division_and_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and kind of each row's division, and the part that its place is in."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 120).cast("int").alias("id"), (F.col("n_chars") % 300).cast("int").alias("verse"))
    named = lookup.with_default(rows, divisions.divisions(spark), "id", {"english_name": "", "revelation_type": "", "verse_count": -1})
    parts = lookup.as_of_bands(named, divisions.part_bands(spark), F.struct(F.col("id").alias("s"), F.col("verse").alias("v")), "start", "part", 1)
    filed = lookup.with_default(parts.withColumn("number", F.col("id")), divisions.page_files(spark), "number", {"file": ""})
    return filed.select("doc_id", "file", "english_name", "revelation_type", (F.col("verse") <= F.col("verse_count")).alias("is_there"), "part")
