"""What is written is read back: files made of the tables by the sinks, and the readers over them; and repairs of whole dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.folders import shared_folder
from folioscope.functions import text as t
from folioscope.operators import file_table, lookup, model, quality, render, repair
from folioscope.plans.queries import _SPACE, query, table
from folioscope.sources import readers, sinks


@query(
    """
SELECT CAST(conv_id AS INTEGER) AS surah, 'conversation ' || conv_id AS name, CAST(turn + 1 AS INTEGER) AS verse, replace(text, chr(10), ' ') AS text, CASE WHEN role = 'system' THEN role END AS bismillah FROM conversations
"""
)
def verses_from_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a corpus in XML, read verse by verse."""
    aya = F.struct((F.col("turn") + 1).alias("_index"), F.translate("text", "\n", " ").alias("_text"), F.when(F.col("role") == "system", F.col("role")).alias("_bismillah"))
    suras = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("_index")).agg(F.array_sort(F.collect_list(aya)).alias("aya"))
    path = shared_folder(spark, "xml")
    suras.withColumn("_name", F.concat(F.lit("conversation "), F.col("_index"))).write.format("xml").option("rootTag", "quran").option("rowTag", "sura").save(path)
    return readers.read_verses(spark, path)


@query(
    f"""
WITH v AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda w: w <> '') AS words FROM conversations),
w AS (SELECT conv_id, turn, words, unnest(range(1, len(words) + 1)) AS word FROM v)
SELECT conv_id AS surah, turn + 1 AS verse, CAST(word AS BIGINT) AS word, words[word] AS token, CASE WHEN word % 2 = 0 THEN 'r-' || words[word][1] END AS root, CASE WHEN word % 3 = 0 THEN words[word][1] || '+' || words[word][2:] END AS segments FROM w
"""
)
def words_from_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested XML of verses, words and segments, read word by word; empty attributes are left out."""
    verses = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("surah"), F.concat(F.lit("c"), "conv_id").alias("name"), (F.col("turn") + 1).alias("verse"), F.translate("text", "\n", " ").alias("text"))
    words = verses.select("surah", "verse", F.posexplode(t.words(F.col("text"))).alias("at", "token")).withColumn("word", F.col("at") + 1)
    first = F.substring("token", 1, 1)
    rooted = words.select("surah", "verse", "word", "token", F.lit("(null)").alias("gloss"), F.when(F.col("word") % 2 == 0, F.concat(F.lit("r-"), first)).otherwise("").alias("root"))
    halves = F.posexplode(F.array(first, F.substring("token", F.lit(2), F.length("token"))))
    segments = words.filter("word % 3 = 0").select("surah", "verse", "word", halves.alias("segment", "text"), F.lit("N").alias("pos"), F.lit(None).cast("string").alias("role"))
    path = shared_folder(spark, "export")
    sinks.write_xml(sinks.nested_verses(verses, rooted, segments), path)
    kind = "_number long, verse array<struct<_number:long, word:array<struct<_number:long,_token:string,_translation:string,_root:string,segment:array<struct<_number:long,_text:string>>>>>>"
    back = spark.read.format("xml").option("rowTag", "surah").schema(kind).load(path)
    verse = back.select(F.col("_number").alias("surah"), F.explode("verse").alias("v"))
    word = verse.select("surah", F.col("v._number").alias("verse"), F.explode("v.word").alias("w"))
    joined = F.array_join(F.transform("w.segment", lambda s: F.coalesce(s["_text"], F.lit(""))), "+")
    return word.select("surah", "verse", F.col("w._number").alias("word"), F.col("w._token").alias("token"), F.col("w._root").alias("root"), joined.alias("segments"))


@query("SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, text, CAST(row_number() OVER (ORDER BY conv_id, turn) AS INTEGER) AS place FROM conversations")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes and line breaks in a CSV of ordered parts, read back in its order."""
    path = shared_folder(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "conversations"), ["conv_id", "turn", "text"], path, order=["conv_id", "turn"], parts=3)
    rows = readers.read_csv(spark, path, ("conv_id", "turn", "text"))
    return model.running_index(rows, [], ["line"], "place").select("conv_id", "turn", "text", F.col("place").cast("int"))


@query(
    r"""
SELECT CAST(page_id AS INTEGER) AS number, lpad(CAST(page_id AS VARCHAR), CAST(greatest(3, length(CAST(page_id AS VARCHAR))) AS INTEGER), '0') || '-' || trim(regexp_replace(url, '[^\p{L}\p{N}_]+', '-', 'g'), '-') || '.html' AS file, html FROM pages
"""
)
def pages_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as files of their names, read back."""
    path = shared_folder(spark, "pages")
    sinks.write_pages(table(spark, sf_dir, "pages").select(t.page_file(F.col("page_id"), t.slug(F.col("url"))).alias("file"), "html"), path)
    return readers.read_pages(spark, path)


@query("SELECT c_mktsegment AS root, CAST(c_nationkey AS INTEGER) AS surah, CAST(c_custkey AS INTEGER) AS verse, CAST(c_custkey % 5 AS INTEGER) AS word FROM customer")
def root_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by root in one JSON object, read row by row."""
    ref = F.concat_ws(":", "c_nationkey", "c_custkey", F.col("c_custkey") % 5)
    lists = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.collect_list(ref).alias("refs"))
    whole = lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "refs")))).alias("value"))
    path = shared_folder(spark, "roots")
    whole.write.text(path)
    return readers.read_root_index(spark, path).select("root", "surah", "verse", "word")


@query(
    """
SELECT CAST(event_id % 500 AS INTEGER) AS id, arg_max(event_type, event_id) AS root, arg_max(props, event_id) AS meaning, CAST(arg_max(user_id, event_id) AS INTEGER) AS occurrences FROM events GROUP BY event_id % 500
"""
)
def root_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in JSON lines, over several files, of which the last of each id stays."""
    path = shared_folder(spark, "entries")
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("id"), F.col("event_type").alias("root"), F.struct(F.col("props").alias("en")).alias("meaning"), F.col("user_id").alias("occurrences_quran"), "event_id")
    rows.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").drop("event_id").write.json(path)
    return readers.read_root_entries(spark, path).select("id", "root", F.col("meaning.en").alias("meaning"), F.col("occurrences_quran").alias("occurrences"))


@query("""SELECT CAST(user_id AS INTEGER) AS "surahNumber", CAST(event_id AS INTEGER) AS "verseNumber", event_type AS "surahName", epoch_us(ts) // 1000000 AS "timestamp", CASE WHEN event_id % 2 = 0 THEN props END AS note FROM events WHERE event_id % 10 <> 3""")
def bookmarks_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks written as JSON and read back; rows without a verse are left out."""
    path = shared_folder(spark, "marks")
    verse = F.when(F.col("event_id") % 10 != 3, F.col("event_id").cast("int"))
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("int").alias("surahNumber"), verse.alias("verseNumber"), F.col("event_type").alias("surahName"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("note")
    )
    sinks.write_bookmarks(rows, path)
    return spark.read.schema(readers.BOOKMARK).json(path).filter("surahNumber is not null and verseNumber is not null")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0")
def table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that a later write has replaced."""
    path, rows = shared_folder(spark, "table"), table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    sinks.write_table(rows, path)
    sinks.write_table(rows.filter("o_orderkey % 2 = 0"), path)
    return spark.read.parquet(path)


@query(
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 7 AND o_orderstatus = 'F' THEN 'P' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 50 = 7 AND o_orderstatus = 'F' THEN 'patched' ELSE o_orderpriority END AS o_orderpriority FROM orders
"""
)
def patched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table after an update by two keys, which rewrites the files it touches."""
    folder, orders = shared_folder(spark, "orders"), table(spark, sf_dir, "orders")
    own = orders.select("o_orderkey", F.col("o_orderstatus").alias("key"), "o_orderstatus", "o_orderpriority")
    file_table.create(own.repartitionByRange(8, "o_orderkey"), folder)
    patches = orders.filter("o_orderkey % 50 = 7").select("o_orderkey", F.lit("F").alias("key"), F.lit("P").alias("o_orderstatus"), F.lit("patched").alias("o_orderpriority"))
    file_table.update(spark, folder, patches, ["o_orderkey", "key"])
    return file_table.read(spark, folder).drop("key")


@query(
    f"""
WITH v AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda w: w <> '') AS words FROM conversations)
SELECT conv_id AS surah, turn AS verse, CAST(i + i // 3 AS INTEGER) AS token, CAST(i + 1 AS INTEGER) AS word FROM (SELECT conv_id, turn, unnest(range(len(words))) AS i FROM v)
"""
)
def tokens_tied_to_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each token's word, where a pause mark stands after every third word."""
    listed = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("surah"), F.col("turn").alias("verse"), t.words(F.col("text")).alias("w"))
    marked = F.array_join(F.transform("w", lambda x, i: F.when(i % 3 == 2, F.concat(x, F.lit(" ۖ"))).otherwise(x)), " ")
    words = listed.select("surah", "verse", F.posexplode("w").alias("at", "token")).select("surah", "verse", (F.col("at") + 1).alias("word"), "token")
    return render.token_words(render.aligned_tokens(listed.select("surah", "verse", marked.alias("text")), words))


@query(
    """
WITH v AS (SELECT CAST(l_orderkey % 130 AS INTEGER) AS surah, CAST(l_linenumber + 7 * (l_orderkey // 130 % 3) AS INTEGER) AS verse FROM lineitem WHERE l_orderkey % 130 <> 5),
d AS (SELECT DISTINCT surah, verse FROM v),
g AS (SELECT *, row_number() OVER (PARTITION BY surah ORDER BY verse) AS expected FROM d)
SELECT 'range' AS rule, surah, verse FROM v WHERE surah NOT BETWEEN 1 AND 114
UNION ALL SELECT 'duplicate', surah, verse FROM v GROUP BY surah, verse HAVING count(*) > 1
UNION ALL SELECT 'gap', surah, verse FROM g WHERE verse <> expected
UNION ALL SELECT 'count', CAST(count(DISTINCT surah) AS INTEGER), NULL FROM v HAVING count(DISTINCT surah) <> 114
"""
)
def corpus_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of range, repeated verses, gaps, and a wrong number of divisions."""
    verse = F.col("l_linenumber") + 7 * (F.floor(F.col("l_orderkey") / 130) % 3)
    rows = table(spark, sf_dir, "lineitem").filter("l_orderkey % 130 <> 5").select((F.col("l_orderkey") % 130).cast("int").alias("surah"), verse.cast("int").alias("verse"))
    return quality.corpus_findings(rows)


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entries of a dictionary, with lists of shades and no response for some."""
    key = F.col("c_custkey")
    shades = F.when(key % 4 == 0, "[]").otherwise(F.concat(F.lit('[{"shade": "'), F.col("c_mktsegment"), F.lit('"}, {"shade": "x"}]')))
    own = {"shades_of_meaning": shades} | {c: F.lit("") for c in repair.PARTS if c != "shades_of_meaning"}
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("id"), F.col("c_name").alias("root"), F.when(key % 3 != 0, F.col("c_mktsegment")).alias("general_meaning"), *[v.alias(c) for c, v in own.items()],
        F.when(key % 2 == 0, F.lit("{}")).when(key % 5 == 0, F.lit("{broken")).alias("full_response"),
    )


@query(
    """
SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey % 6 = 1 AS patched, CASE WHEN c_custkey % 6 = 1 THEN 'new ' || c_custkey END AS meaning, CASE WHEN c_custkey % 6 = 1 THEN CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 2 END END AS shades FROM customer
"""
)
def rebuilt_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries patched by id and root, whose responses are built anew."""
    rows = _dictionary(spark, sf_dir)
    patches = rows.select("id", F.when(F.col("id") % 6 == 1, F.col("root")).otherwise("another").alias("root"), F.concat(F.lit("new "), "id").alias("general_meaning"))
    done = repair.patch_and_rebuild(rows, patches)
    response = F.when(F.col("patched"), F.col("full_response"))
    return done.select("id", "patched", F.get_json_object(response, "$.general_meaning").alias("meaning"), F.json_array_length(F.get_json_object(response, "$.shades_of_meaning")).alias("shades"))


@query(
    """
WITH m AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS id, c_name AS root, (c_custkey % 2 = 1 AND (c_custkey % 3 <> 0 OR c_custkey % 4 <> 0)) AS built,
                  CASE WHEN c_custkey % 2 = 0 THEN '{}' WHEN c_custkey % 5 = 0 THEN '{broken' END AS old FROM customer),
s AS (SELECT DISTINCT s_name AS root FROM supplier WHERE s_name NOT IN (SELECT root FROM m)),
n AS (SELECT CAST((SELECT max(k) FROM m) + row_number() OVER (ORDER BY root) AS VARCHAR) AS id, root FROM s)
SELECT id, root, CASE WHEN built THEN 'built' ELSE coalesce(old, 'none') END AS response FROM m UNION ALL SELECT id, root, 'none' FROM n
"""
)
def repaired_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing roots added with ids after the largest, and responses rebuilt where there is something to say."""
    new = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("root")).distinct()
    done = repair.run(_dictionary(spark, sf_dir), new, True, True)
    response = F.when(F.startswith("full_response", F.lit('{"general_meaning"')), "built").otherwise(F.coalesce("full_response", F.lit("none")))
    return done.select("id", "root", response.alias("response"))


@query(
    r"""
SELECT event_id, regexp_matches(event_type, '[\x{600}-\x{6ff}\x{750}-\x{77f}]') OR event_id % 2 = 0 AS arabic, event_id % 3 = 0 AS only, CAST(user_id AS INTEGER) AS leading, CAST(user_id AS INTEGER) AS s, CAST(event_id AS INTEGER) AS v,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 9 AS INTEGER) END AS w, event_type AS lemma, CASE WHEN event_id % 4 <> 0 THEN 'r' || user_id END AS root FROM events
"""
)
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts, leading numbers, references and tags."""
    e, user = F.col("event_id"), F.col("user_id")
    mixed = F.concat("event_type", F.when(e % 2 == 0, "ق").otherwise(""))
    alone = F.when(e % 3 == 0, "قو").otherwise(F.col("event_type"))
    ref = t.split_reference(F.concat_ws(":", user, e, F.when(e % 5 == 0, "x").otherwise((e % 9).cast("string"))))
    tag = t.morphology_tag(F.concat(F.lit("STEM|POS:N LEM:{"), "event_type", F.lit("}"), F.when(e % 4 != 0, F.concat(F.lit(" ROOT:r"), user)).otherwise("")))
    leading = t.leading_int(F.concat(F.lit("  "), user, F.lit("abc 7")))
    return table(spark, sf_dir, "events").select(
        "event_id", t.has_arabic(mixed).alias("arabic"), t.only_arabic(alone).alias("only"), leading.alias("leading"), ref["surah"].alias("s"), ref["verse"].alias("v"), ref["word"].alias("w"), tag["lemma"].alias("lemma"), tag["root"].alias("root")
    )


@query(
    """
SELECT l_orderkey AS surah, l_linenumber AS verse, l_suppkey AS word, string_agg(l_partkey, ',' ORDER BY l_partkey, l_quantity, l_extendedprice) AS segments FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 1 GROUP BY ALL
"""
)
def word_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of one place with their ordered segments."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("surah"), F.col("l_linenumber").alias("verse"), F.col("l_suppkey").alias("word"), "l_partkey", "l_quantity", "l_extendedprice")
    at = lookup.verse(rows, 7, 1)
    nested = model.ordered(at, ["surah", "verse", "word"], ["l_partkey", "l_quantity", "l_extendedprice"], [], "segments")
    first = at.agg(F.min("word")).first()[0]
    found = lookup.word_with_segments(nested, 7, 1, first) if first is not None else nested
    others = nested.filter(F.col("word") != F.lit(first)) if first is not None else nested.limit(0)
    return found.unionByName(others).select("surah", "verse", "word", F.array_join(F.transform("segments", lambda s: s["l_partkey"].cast("string")), ",").alias("segments"))
