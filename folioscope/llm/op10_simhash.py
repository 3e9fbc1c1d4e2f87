"""SimHash near-duplicates, joined by the pigeonring principle.

A fingerprint of 64 bits lies on a ring of ``SEGMENTS`` segments.  If two
fingerprints differ in at most ``distance`` bits, there is a segment from which
every chain of 1, 2, ..., SEGMENTS consecutive segments differs in at most
``length * distance / SEGMENTS`` bits.  With 5 segments and 4 bits the first
segment of such a chain is equal and the first two differ in one bit at most:
each distinct fingerprint is listed under its five pairs of segments, and looked
up under these and their one-bit variants.  Longer chains prune the candidates
before the full comparison.  Only distinct fingerprints are joined, so copies of
a text cost nothing.  Components of the links come from alternating large-star
and small-star steps.

Defined cases: a null or empty text has fingerprint zero, linked like any
other; null ids are not ids: a component without any other id has the id null;
repeated rows come out as often as they came in; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import hold, join_hot, keep, whole_row
from folioscope.llm.words import pieces
from folioscope.shipping import ship

SEED = 42
WIDTHS = (13, 13, 13, 13, 12)  # of the segments, from the lowest bit
SEGMENTS = len(WIDTHS)
DISTANCE = 4
ROUND_ROWS = 100_000  #: links that a task writes in a round


def _fingerprint(hashes: list[int]) -> int:
    """Bit set if it is set in over half of the hashes."""
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes)).tobytes(), "big")


def fingerprints_of(texts: pa.Array, width: int) -> list[int]:
    """Fingerprints of whole texts as signed 64-bit numbers."""
    digest, out = xxhash.xxh64_intdigest, []
    for piece in pieces(texts, lower=True):
        for k in range(len(piece)):
            words = piece.words(k)
            joined = b" ".join(words)
            if len(words) <= width:
                hashes = [digest(joined, SEED)] if words else []
            else:
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                starts = np.concatenate(([0], ends[: len(words) - width])).tolist()
                stops = (ends[width - 1 :] - 1).tolist()
                hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]
            f = _fingerprint(hashes)
            out.append(f - (1 << 64) if f >> 63 else f)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """Rows (id, uid, fp): the SimHash of each document's word shingles; uid is a hash of id and text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"id": batch.column(0), "uid": batch.column(2), "fp": pa.array(fingerprints_of(batch.column(1), width), pa.int64())})

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("uid")).mapInArrow(run, f"id {kind}, uid long, fp long")


def _segment(fp: Column, k: int) -> Column:
    k %= SEGMENTS
    return F.shiftrightunsigned(fp, sum(WIDTHS[:k])).bitwiseAND(F.lit((1 << WIDTHS[k]) - 1))


def _key(fp: Column, k: int) -> Column:
    """Segments k and k + 1 under the number k."""
    return F.shiftleft(F.lit(k).cast("long"), 32) + F.shiftleft(_segment(fp, k), 14) + _segment(fp, k + 1)


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b), a < b, of fingerprints within ``distance`` <= 4 bits; ``distinct`` has a column fp without repeats."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"distance must be between 0 and {DISTANCE}")
    fp = F.col("fp")
    listed = distinct.select(fp.alias("a"), F.explode(F.array(*[_key(fp, k) for k in range(SEGMENTS)])).alias("key"))
    near = [_key(fp, k).bitwiseXOR(F.lit(flip)) for k in range(SEGMENTS) for flip in (0, *(1 << j for j in range(WIDTHS[(k + 1) % SEGMENTS])))]
    asked = distinct.select(fp.alias("b"), F.explode(F.array(*near)).alias("key"))
    start = F.shiftright("key", 32)
    ring = [F.bit_count(_segment(F.col("a").bitwiseXOR(F.col("b")), k)) for k in range(SEGMENTS)]

    def within(k: int) -> Column:
        """All chains from segment k keep to their budgets; the last is the full comparison."""
        chain, ok = ring[k], F.lit(True)
        for length in range(2, SEGMENTS + 1):
            chain = chain + ring[(k + length - 1) % SEGMENTS]
            ok = ok & (chain <= length * distance // SEGMENTS)
        return ok

    pruned = F.lit(False)
    for k in range(SEGMENTS):
        pruned = F.when(start == k, within(k)).otherwise(pruned)
    candidates = listed.join(asked, "key").filter((F.col("a") < F.col("b")) & pruned)
    return candidates.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b").distinct()


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, root): the smallest node of each linked node's component.

    Large-star ties all larger neighbours of a node to the smallest of its
    neighbourhood, small-star does so with the smaller ones; links never grow in
    number, and rounds go with the logarithm of the nodes squared at most.
    """
    edges = keep(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))  # u < v
    parts = max(1, -(-edges.count() // ROUND_ROWS))
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        lower = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lower, "v").select("m", "u", "v")
        edges = keep(small.select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").filter("u < v").distinct().coalesce(parts))
        # Done when every node hangs on one root, and no root on another node: a star each.
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(0).alias("hangs")), F.struct(F.col("v").alias("x"), F.lit(1).alias("hangs")))).alias("e")).select("e.*")
        if ends.groupBy("x").agg(F.sum("hangs").alias("n"), F.min("hangs").alias("least")).filter("n > 1 or n > least").isEmpty():
            break
    else:
        raise RuntimeError(f"components need more than {most_rounds} rounds")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _classes(rows: DataFrame, distance: int) -> DataFrame:
    """Rows (fp, n, first, root): of each fingerprint its documents and the first of them (null ids last), and the least fingerprint that it reaches."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first")
    distinct = hold(rows.groupBy("fp").agg(first, F.count("*").alias("n")))
    roots = components(links(distinct.select("fp"), distance)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = DISTANCE) -> DataFrame:
    """Rows (id, fp, component_id): the fingerprint, and the smallest id reachable over links, the own included."""
    rows = hold(fingerprints(docs, id_col, text_col, width))
    classes = hold(_classes(rows, distance))
    ids = classes.groupBy("root").agg(F.min("first")["id"].alias("component_id"), F.count("*").alias("fps"))
    named = hold(join_hot(classes.select("fp", "n", "root"), ids, "root", "fps").drop("root"))
    return join_hot(rows, named, "fp", "n").select(F.col("id").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = DISTANCE) -> DataFrame:
    """The documents, columns unchanged, but one of each component: that with the smallest id, and one row of rows alike."""
    rows = hold(fingerprints(docs, id_col, text_col, width))
    return only(docs, _classes(rows, distance).groupBy("root").agg(F.min("first").alias("first")), id_col, text_col)


def only(docs: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents that ``first`` (first.id, first.uid) names, one row of rows alike; whatever their columns are called."""
    first = first.select(F.col("first.id").alias("id"), F.col("first.uid").alias("uid"))
    named = docs.select(F.col(id_col).alias("own"), F.xxhash64(id_col, text_col).alias("uid"), whole_row(docs))
    kept = named.join(first, "uid").filter(F.col("own").eqNullSafe(F.col("id")))
    # Partitioned as the join is, so the texts are dealt once.
    alike = Window.partitionBy("uid").orderBy("id")
    return kept.withColumn("n", F.row_number().over(alike)).withColumn("before", F.lag(F.struct("id")).over(alike)).filter((F.col("n") == 1) | ~F.col("before.id").eqNullSafe(F.col("id"))).select("row.*")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
