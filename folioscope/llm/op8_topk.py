"""Exact top-k search by a pivot-distance index.

Scores are inner products of whole-number vectors.  One more coordinate,
``sqrt(M - |x|^2)`` with M the largest squared norm, puts every vector on a
sphere, so that the highest product is the smallest distance and the triangle
inequality holds bounds on it.  A vector is keyed by its nearest pivot and its
distance from it; each pivot's vectors, in order of distance, are cut into annuli
of about ``ANNULUS`` vectors.  A query first searches the annulus its own key
falls into, which gives its tenth best score so far; then it goes to every annulus
whose bound, from the query's distance to the pivot and the annulus's nearest and
farthest distance, still reaches that score, and to no other.  Pivots come from a
bounded sample (``PIVOTS`` vectors); every vector is indexed, and since bounds
are exact the recall is 1.  Bounds carry a margin for rounding; scores are exact.

Distances that many vectors share, copies of one vector say, make an annulus of
several parts, which are dealt by hash.  Queries go to annuli in blocks of
``QUERY_BLOCK``, so a task holds one part of one annulus and one block.

Defined cases: rows with a null id, a null vector, or null or non-finite
components take no part; shorter vectors count as ending in zeros; rows that
repeat a query's id are its own and no candidates of it, and of repeated query
rows the least vector asks; empty tables give no rows; other columns are not
read.  Scores are exact: floating point where the largest squared norm is below
2**53, whole numbers beyond.  Vectors whose squared norm reaches 2**62 stay out of
the index, whose bounds and 64-bit products they would spoil for all others: they
are compared with every vector, block by block, in whole numbers of any size, and
their hits are ranked with those of the index.  A score that doesn't fit its column
is ranked as it is and told as the column's largest or smallest number.
"""

from __future__ import annotations

import heapq
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import hold
from folioscope.shipping import ship

PIVOTS = 32
ANNULUS = 4096
QUERY_BLOCK = 4096
LARGE = 2.0**62  #: squared norm of vectors that the index doesn't take
RINGS = 512  #: steps of distance by which a pivot's vectors are counted


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null if a component is null or not finite."""
    return F.when(_finite(vector), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.Array, width: int, kind: type = float) -> np.ndarray:
    """Rows of equal length, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), width), kind)
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = np.asarray(column.flatten()).astype(kind)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))[:, None]], 1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T))


_HIT = "query_id long, vec_id long, score long"


def _search(index: pa.Table, queries: pa.Table, k: int, width: int, kind: type = float) -> pa.Table:
    """Each query's k best of one part of an annulus; products of ``kind`` are exact."""
    x, q = _matrix(index.column("v"), width, kind), _matrix(queries.column("v"), width, kind)
    none = -np.inf if kind is float else np.iinfo(np.int64).min
    ids, own = np.asarray(index.column("vec_id")), np.asarray(queries.column("query_id"))
    out: tuple[list, list, list] = ([], [], [])
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    for a in range(0, len(q), 256):
        scores = q[a : a + 256] @ x.T
        scores[own[a : a + 256, None] == ids[None, :]] = none
        for i, row in enumerate(scores):
            if len(row) > k:
                least = np.partition(row, len(row) - k)[len(row) - k]
                sure = np.flatnonzero(row > least)
                best = np.concatenate([sure, np.flatnonzero(row == least)[: k - len(sure)]])
            else:
                best = np.arange(len(row))
            best = best[row[best] > none]
            out[0].append(np.full(len(best), own[a + i]))
            out[1].append(ids[best])
            out[2].append(row[best].astype(np.int64))
    return pa.table({n: pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), out, strict=True)})


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k highest scores of each query, ties to the smaller id."""
    ship(vectors.sparkSession)
    known = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x"), is_query.alias("asks"))
    far = F.aggregate("x", F.lit(0.0), lambda s, x: s + (x.cast("double") * scale) * (x.cast("double") * scale)) >= LARGE
    large = known.filter(_finite(F.col("x")) & far)
    if large.limit(1).count():
        return _with_large(known.filter(_finite(F.col("x"))).withColumns({"x": F.col("x").cast("array<double>"), "large": far}), k, scale)
    return _indexed(known, k, scale)


def _finite(vector: Column) -> Column:
    return ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))


def _whole_numbers(vector: list[float], scale: int) -> list[int]:
    """floor(scale * x) of every component, also beyond what 64 bits hold."""
    return [math.floor(scale * x) if math.isfinite(scale * x) else scale * int(x) for x in vector]


def _with_large(rows: DataFrame, k: int, scale: int) -> DataFrame:
    """The k highest scores where some vectors are too large for the index; of repeated query rows the least asks."""
    least = rows.filter("asks").groupBy("vec_id").agg(F.min("x").alias("least"))
    once = hold(rows.join(least, "vec_id", "left").select("vec_id", "x", F.coalesce(F.col("asks") & (F.col("x") == F.col("least")), F.lit(False)).alias("asks"), "large"))
    n, n_large = once.agg(F.count("*"), F.count_if("large")).first()
    parts, blocks = -(-n // ANNULUS), -(-n_large // QUERY_BLOCK)
    hashed = lambda m: F.pmod(F.xxhash64("vec_id", "x"), F.lit(m)).cast("int")
    few = once.filter("large").select(F.col("vec_id").alias("id"), F.col("x").alias("v"), F.col("asks").alias("ask"), hashed(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    every = once.select("vec_id", "x", "asks", "large", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), hashed(parts).alias("part"))

    def best(query: int, own: list[int], others: list[tuple[int, list[int]]]) -> list[tuple[int, int, str]]:
        scores = ((sum(map(operator.mul, own, v)), i) for i, v in others if i != query)
        return [(query, i, str(s)) for s, i in heapq.nsmallest(k, scores, key=lambda h: (-h[0], h[1]))]

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        left = [(r["id"], _whole_numbers(r["v"], scale), r["ask"]) for r in a.to_pylist()]
        right = [(r["vec_id"], _whole_numbers(r["x"], scale), r["asks"], r["large"]) for r in b.to_pylist()]
        hits = [h for i, v, asks in left if asks for h in best(i, v, [x[:2] for x in right])]
        hits += [h for i, v, asks, is_large in right if asks and not is_large for h in best(i, v, [x[:2] for x in left])]
        return pa.table({name: pa.array([h[c] for h in hits], kind) for c, (name, kind) in enumerate((("query_id", pa.int64()), ("vec_id", pa.int64()), ("exact", pa.string())))})

    def rank(hits: pa.Table) -> pa.Table:
        own = sorted(((-int(r["exact"]), r["vec_id"], r["query_id"]) for r in hits.to_pylist()))[:k]
        held = [max(-(2**63), min(2**63 - 1, -s)) for s, _, _ in own]
        return pa.table({"query_id": pa.array([h[2] for h in own], pa.int64()), "rank": pa.array(range(1, len(own) + 1), pa.int32()), "vec_id": pa.array([h[1] for h in own], pa.int64()), "score": pa.array(held, pa.int64())})

    met = few.groupBy("block", "part").cogroup(every.groupBy("block", "part")).applyInArrow(compare, "query_id long, vec_id long, exact string")
    indexed = _indexed(once.filter("not large").select("vec_id", "x", "asks"), k, scale).select("query_id", "vec_id", F.col("score").cast("string").alias("exact"))
    return met.unionByName(indexed).groupBy("query_id").applyInArrow(rank, "query_id long, rank int, vec_id long, score long")


def _indexed(known: DataFrame, k: int, scale: int) -> DataFrame:
    """The k highest scores over the index, of rows (vec_id, x, asks)."""
    spark = known.sparkSession
    base = hold(known.select("vec_id", whole(F.col("x"), scale).alias("v"), "asks").filter("v is not null"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, most, width, n_queries = base.agg(F.count("*"), F.max(square), F.max(F.size("v")), F.count_if("asks")).first()
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = most or 0.0
    kind = float if most < 2.0**53 * (1 - 1e-9) else np.int64
    sample = base.orderBy(F.xxhash64("vec_id"), "v").select("v").limit(PIVOTS).toArrow()
    pivots = _lifted(_matrix(sample.column("v"), width), float(most))
    ring_width = max(1e-9, 2 * float(most) ** 0.5) / RINGS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_lifted(_matrix(batch.column("v"), width), float(most)), pivots)
            near = d.argmin(1)
            least = d[np.arange(len(d)), near]
            yield pa.record_batch([*batch.columns, pa.array(near, pa.int32()), pa.array(least), pa.array(np.minimum(least / ring_width, RINGS - 1).astype(np.int32))], names=["vec_id", "v", "asks", "pivot", "distance", "ring"])

    placed = hold(base.mapInArrow(place, "vec_id long, v array<long>, asks boolean, pivot int, distance double, ring int"))
    before = Window.partitionBy("pivot").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)
    rings = placed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"))  # PIVOTS * RINGS rows at most
    rings = rings.withColumn("annulus", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / ANNULUS).cast("int"))
    annuli = rings.groupBy("pivot", "annulus").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    annuli = annuli.withColumn("parts", F.ceil(F.col("n") / (2 * ANNULUS)).cast("int"))
    known = annuli.toArrow().to_pandas().sort_values(["pivot", "annulus"]).reset_index(drop=True)
    number = {(int(p), int(a)): i for i, (p, a) in enumerate(zip(known["pivot"], known["annulus"], strict=True))}
    to_annulus = F.broadcast(spark.createDataFrame([(r["pivot"], r["ring"], number[r["pivot"], r["annulus"]], int(known["parts"][number[r["pivot"], r["annulus"]]])) for r in rings.collect()], "pivot int, ring int, annulus int, parts int"))
    blocks = -(-n_queries // QUERY_BLOCK)
    part = F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int")
    indexed = placed.join(to_annulus, ["pivot", "ring"]).select("vec_id", "v", "asks", "annulus", part.alias("part"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    indexed = hold(indexed)
    queries = indexed.filter("asks").groupBy(F.col("vec_id").alias("query_id"), "block").agg(F.min(F.struct("v", "annulus", "part")).alias("q")).select("query_id", "block", "q.*")
    group = ["annulus", "part", "block"]

    def sent(asking: DataFrame) -> DataFrame:
        """The index, a part of an annulus once for each block of queries that asks it."""
        return indexed.select("vec_id", "v", "annulus", "part").join(asking.select(*[F.col(c).alias(c) for c in group]).distinct(), ["annulus", "part"])

    def search(i: pa.Table, q: pa.Table) -> pa.Table:
        return _search(i, q, k, width, kind)

    at_home = queries.groupBy(*group).cogroup(sent(queries).groupBy(*group)).applyInArrow(lambda q, i: search(i, q), _HIT)
    floor = at_home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    pivot, low, high, parts = (known[c].to_numpy() for c in ("pivot", "low", "high", "parts"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query for every part of every annulus that can still hold one of its k best."""
        for batch in batches:
            q = _matrix(batch.column("v"), width)
            norm = (q * q).sum(1)
            d = _distances(np.concatenate([q, np.zeros((len(q), 1))], 1), pivots)[:, pivot]
            gap = np.maximum(0.0, np.maximum(d - high, low - d) - 1e-6 * (1 + d))
            bound = (norm[:, None] + most - gap * gap) / 2
            bound += 1e-9 * (np.abs(bound) + norm[:, None] + most) + 1
            floors = np.asarray(batch.column("floor").cast(pa.float64()).fill_null(-np.inf))
            row, annulus = np.nonzero(bound >= floors[:, None])
            times = parts[annulus]
            row, annulus = np.repeat(row, times), np.repeat(annulus, times)
            at = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            taken = batch.take(pa.array(row))
            yield pa.record_batch([taken.column("query_id"), taken.column("block"), taken.column("v"), pa.array(annulus, pa.int32()), pa.array(at, pa.int32())], names=["query_id", "block", "v", "annulus", "part"])

    asked = queries.join(floor, "query_id", "left").select("query_id", "block", "v", "floor").mapInArrow(expand, "query_id long, block int, v array<long>, annulus int, part int")
    hits = asked.groupBy(*group).cogroup(sent(asked).groupBy(*group)).applyInArrow(lambda q, i: search(i, q), _HIT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
