"""Search for a whole table of queries at once over a stored index of trigrams.

``build`` writes three tables into a folder: the texts, with their search form, in
blocks of some thousand, a directory for each block; postings (gram, block, texts),
in order of grams, so that a look-up reads few row groups; and how many texts each
gram has.
Grams are of a folded form, in which letters have no case and no marks; whatever
any of the searches calls a match is a match of folded forms, too.

A search cuts its queries into grams, keeps the ``RAREST`` of each, intersects
their postings block by block, and checks the texts that are left by the very
expression that a scan uses.  Only blocks with such texts are read: the join
prunes the others' directories.  Queries of one or two characters take the
grams that begin with them; those whose folded form is empty take every text.

Defined cases: a null text matches nothing; a null query gives no rows, nor do
empty terms; the empty query is in every text; queries that repeat are answered
each; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.text import SPACES, marks_removed, search_form
from folioscope.shipping import ship

RAREST = 3  #: grams of a query whose postings are read
LOOKED_UP = 10  #: grams that a scan's filter names
BLOCK = 1024  #: texts in a block, doubled until there are no more than MOST_BLOCKS
MOST_BLOCKS = 20_000
MOST_PAIRS = 4_000_000  #: pairs of gram and text that a worker holds
_BITS = 21  # of a code point
#: Characters whose lower case is not what a pattern that ignores case takes them for; all others match as their lower cases do.
_ODD = "[\u00b5\u0130\u0131\u017f\u0345\u03a3\u03c2\u03d0\u03d1\u03d5\u03d6\u03f0\u03f1\u03f5\u1c80-\u1c89\u1e9b\u1fbe\u2c2f\ua7c0\ua7cb-\ua7dc\U00010570-\U00010595\U00010d50-\U00010d65]"


def folded(text: Column) -> Column:
    """A form in which texts that differ by case or marks are equal; what it makes of a character is the same wherever it stands."""
    return F.replace(F.replace(F.lower(F.upper(F.lower(marks_removed(text)))), F.lit("ς"), F.lit("σ")), F.lit("\u0307"), F.lit(""))


def grams_of(text: str) -> np.ndarray:
    """Distinct trigrams as numbers; two marks of the end make every position begin one."""
    c = np.frombuffer((text + "\0\0").encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique((c[:-2] << 2 * _BITS) | (c[1:-1] << _BITS) | c[2:])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, block, n, texts): the texts of a block that have a gram, by place in the block."""
    block, grams, places, pairs = None, [], [], 0

    def packed() -> pa.RecordBatch:
        gram, place = np.concatenate(grams), np.repeat(np.array(places, np.int32), [len(g) for g in grams])
        order = np.argsort(gram, kind="stable")
        gram, place = gram[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.empty(0, np.int64)
        ends = np.append(first, len(gram)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(place))
        return pa.record_batch([pa.array(gram[first]), pa.array(np.full(len(first), block, np.int64)), pa.array(np.diff(ends).astype(np.int32)), lists], names=["gram", "block", "n", "texts"])

    for batch in batches:
        for b, place, form in zip(*(batch.column(c).to_pylist() for c in ("block", "place", "form")), strict=True):
            if grams and (b != block or pairs > MOST_PAIRS):
                yield packed()
                grams, places, pairs = [], [], 0
            block = b
            grams.append(grams_of(form))
            places.append(place)
            pairs += len(grams[-1])
    if grams:
        yield packed()


@dataclass(frozen=True)
class TextIndex:
    """An index in its folder; ``key`` is the type of the struct of key columns, so that one may be opened again."""

    spark: SparkSession
    folder: str
    key: str

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    @property
    def texts(self) -> DataFrame:
        return self._table("texts", f"key {self.key}, text string, form string, place int, block long")

    @property
    def postings(self) -> DataFrame:
        return self._table("postings", "gram long, block long, n int, texts array<int>")

    @property
    def grams(self) -> DataFrame:
        return self._table("grams", "gram long, n long")


def build(rows: DataFrame, keys: list[str], text: str, folder: str) -> TextIndex:
    """Writes the index of a text column into a new folder; rows with a null text can't match and are left out."""
    spark = rows.sparkSession
    ship(spark)
    own = rows.select(F.struct(*keys).alias("key"), F.col(text).alias("text")).filter("text is not null")
    size, n = BLOCK, own.count()
    while n > size * MOST_BLOCKS:
        size *= 2
    at = F.monotonically_increasing_id()
    placed = own.withColumn("at", at).select("key", "text", search_form(F.col("text")).alias("form"), F.pmod("at", F.lit(size)).cast("int").alias("place"), F.floor(F.col("at") / size).cast("long").alias("block"))
    placed.write.partitionBy("block").parquet(f"{folder}/texts")
    index = TextIndex(spark, folder, own.schema["key"].dataType.simpleString())
    found = index.texts.select("block", "place", folded(F.col("text")).alias("form")).mapInArrow(_postings, "gram long, block long, n int, texts array<int>").persist(StorageLevel.DISK_ONLY)  # dealing by range reads it twice
    found.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.parquet(f"{folder}/postings")
    found.unpersist()
    counts = index.postings.groupBy("gram").agg(F.sum("n").alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{folder}/grams")
    return index


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ask, gram, length): all grams of a folded term, or its own one or two characters as the beginning of some."""
    for batch in batches:
        ask, gram, length = [], [], []
        for a, form in zip(batch.column("ask").to_pylist(), batch.column("form").to_pylist(), strict=True):
            own = grams_of(form)
            if len(form) > 2:
                c = np.frombuffer(form.encode("utf-32-le"), np.uint32).astype(np.int64)
                own = np.unique((c[:-2] << 2 * _BITS) | (c[1:-1] << _BITS) | c[2:])
            elif form:
                own = np.array([ord(form[0]) if len(form) == 1 else (ord(form[0]) << _BITS) | ord(form[1])], np.int64)
            else:
                own = np.zeros(1, np.int64)
            ask += [a] * len(own)
            gram += own.tolist()
            length += [min(3, len(form))] * len(own)
        yield pa.record_batch([pa.array(ask, pa.string()), pa.array(gram, pa.int64()), pa.array(length, pa.int32())], names=["ask", "gram", "length"])


def _of_grams(postings: DataFrame, chosen: DataFrame) -> DataFrame:
    """Postings, those of the chosen grams alone where the scan can look them up: Parquet takes ``LOOKED_UP`` values one by one, more as a range."""
    few = [r["gram"] for r in chosen.select("gram").distinct().limit(LOOKED_UP + 1).collect()]
    return postings.filter(F.col("gram").isin(few)) if len(few) <= LOOKED_UP else postings


def candidates(index: TextIndex, terms: DataFrame) -> DataFrame:
    """Rows (term, block, place) of texts that may hold a term; each term of the column ``term`` once."""
    asks = terms.select(F.col("term").alias("ask"), folded(F.col("term")).alias("form")).filter("form is not null").distinct()
    asked = asks.mapInArrow(_asked, "ask string, gram long, length int")
    known = index.grams
    whole = asked.filter("length = 3").join(known, "gram", "left")
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.col("n").asc_nulls_first(), "gram"))
    rare = whole.withColumn("rank", rank).withColumn("grams", F.least(F.count("*").over(Window.partitionBy("ask")), F.lit(RAREST))).filter(F.col("rank") <= RAREST)
    chosen = rare.filter("n is not null").select("ask", "gram", "grams").persist(StorageLevel.MEMORY_AND_DISK)
    met = _of_grams(index.postings, chosen).join(chosen, "gram").groupBy("ask", "block", "grams").agg(F.collect_list("texts").alias("lists"))
    common = met.filter(F.size("lists") >= F.col("grams")).select("ask", "block", F.explode(F.aggregate(F.slice("lists", 2, RAREST), F.get("lists", 0), F.array_intersect)).alias("place"))
    some = []
    for length in (2, 1):
        begins = known.withColumn("start", F.shiftright("gram", _BITS * (3 - length)))
        those = asked.filter(F.col("length") == length).select("ask", F.col("gram").alias("start")).join(begins, "start").select("ask", "gram")
        some.append(index.postings.join(those, "gram").select("ask", "block", F.explode("texts").alias("place")).distinct())
    every = asked.filter("length = 0").join(index.texts.select("block", "place", F.lit(0).alias("length")), "length").select("ask", "block", "place")
    return common.unionByName(some[0]).unionByName(some[1]).unionByName(every).withColumnRenamed("ask", "term")


def checked(index: TextIndex, queries: DataFrame, terms: DataFrame, *more: Column) -> DataFrame:
    """Queries' terms (query_id, term) with the texts (key, text, form) that may hold them, and what ``more`` makes of each text.

    Candidates are persisted, as their blocks have to be known before texts are read.
    """
    found = candidates(index, terms.select("term")).persist(StorageLevel.MEMORY_AND_DISK)
    blocks = [r["block"] for r in found.select("block").distinct().collect()]  # of MOST_BLOCKS, and a few for each file
    texts = index.texts.filter(F.col("block").isin(blocks)) if blocks else index.texts.limit(0)
    texts = texts.select("block", "place", "key", "text", "form", *more)
    return terms.join(found, "term").join(texts, ["block", "place"]).drop("block", "place")


def texts_of(index: TextIndex, keys: DataFrame) -> DataFrame:
    """Rows (key, text) of some keys, which are met where they are few by broadcast, as Spark sees it."""
    return index.texts.select("key", "text").join(keys, "key", "left_semi")


def rows_read(found: DataFrame) -> dict[str, int]:
    """Rows that the scans of a search's plan have read, by table of the index; for a search that has been collected."""
    out: dict[str, int] = {}

    def walk(node) -> None:  # noqa: ANN001
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.startswith("Scan parquet"):
            table = node.relation().location().rootPaths().head().getName()
            out[table] = out.get(table, 0) + node.metrics().apply("numOutputRows").value()
        if name.endswith("QueryStage"):
            walk(node.plan())
        if name == "InMemoryTableScan":
            return None
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))
        return None

    walk(found._jdf.queryExecution().executedPlan())
    return out


def substring_search(index: TextIndex, queries: DataFrame) -> DataFrame:
    """Rows (query_id, keys, text) of all texts that contain a query, case counting; ``queries`` has (query_id, query)."""
    own = queries.select("query_id", "query")
    hits = checked(index, own, own.withColumn("term", F.col("query"))).filter(F.contains("text", F.col("query")))
    return hits.select("query_id", "key.*", "text")


def search_glosses(index: TextIndex, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Rows (query_id, keys, context, relevance): each query's first texts that contain it, case aside."""
    own = queries.select("query_id", "query")
    hits = checked(index, own, own.withColumn("term", F.col("query"))).filter(F.contains(F.lower("text"), F.lower("query")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("key"))
    return hits.withColumn("nth", place).filter(F.col("nth") <= limit).select("query_id", "key.*", F.col("text").alias("context"), F.lit(1).alias("relevance"))


def search_text(index: TextIndex, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Rows (query_id, keys, text, relevance): each query's most relevant texts, in order of keys on ties.

    A term of two characters or more counts its matches in the search form, case
    aside, and 2 if the text has it as it is; terms that repeat count again.
    """
    normal = F.lower(F.btrim(marks_removed(F.col("query")), F.lit(SPACES)))
    split = F.filter(F.split(F.translate(normal, SPACES, " " * len(SPACES)), " "), lambda t: F.length(t) >= 2)
    terms = queries.select("query_id", F.explode(split).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    own = terms.select("query_id", "times")
    even = F.when(F.col("form").rlike(_ODD), None).otherwise(F.lower("form")).alias("even")
    escaped = F.concat(F.lit(r"(?iu)\Q"), F.replace("term", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    times = ((F.octet_length("even") - F.octet_length(F.replace("even", F.col("term"), F.lit("")))) / F.octet_length("term")).cast("int")
    score = F.when(F.col("even").isNull() | F.col("term").rlike(_ODD), F.regexp_count("form", escaped)).otherwise(times) + F.when(F.contains("text", F.col("term")), 2).otherwise(0)
    scored = checked(index, own, terms, even).withColumn("score", score * F.col("times"))
    summed = scored.groupBy("query_id", "key").agg(F.sum("score").cast("int").alias("relevance")).filter("relevance > 0")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "key"))
    return summed.withColumn("nth", place).filter(F.col("nth") <= limit).select("query_id", "key.*", "relevance")
