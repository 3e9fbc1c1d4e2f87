"""Sharding: contiguous parts of an ordered list of atomic groups, the largest as small as possible.

Equal texts are never parted: texts are dealt into ``cells`` by hash, and a cell,
with all the groups of equal texts in it, is an atom.  The atoms are ordered by
cell number.  A binary search finds the smallest capacity for which greedy
filling needs no more than ``n_shards`` shards, and the list is cut where the
greedy filling cuts it.  Cell sizes are one array of at most ``cells`` numbers,
whatever the input; the search over it is one SQL expression.

Defined cases: a null text counts as no bytes (size 1, CRC 0); an empty table
gives no rows; null or repeated ids are rows like any other; columns of the
input other than the two named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import hold, lanes_for, whole_row

_SEARCH = """
aggregate(
  sequence(1, 62),
  named_struct('lo', greatest(array_max(sizes), cast(ceil(total / {n}) as bigint)),
               'hi', cast(ceil(total / {n}) as bigint) + array_max(sizes)),
  (b, i) -> if(b.lo >= b.hi, b,
    if(aggregate(sizes, named_struct('used', 0L, 'shards', 1),
         (a, s) -> if(a.used + s <= (b.lo + b.hi) div 2,
                      named_struct('used', a.used + s, 'shards', a.shards),
                      named_struct('used', s, 'shards', a.shards + 1))).shards <= {n},
       named_struct('lo', b.lo, 'hi', (b.lo + b.hi) div 2),
       named_struct('lo', (b.lo + b.hi) div 2 + 1, 'hi', b.hi)))).lo
"""
_CUTS = """
aggregate(
  atoms, named_struct('used', 0L, 'starts', cast(array() as array<bigint>)),
  (a, x) -> if(a.used + x.bytes <= capacity,
               named_struct('used', a.used + x.bytes, 'starts', a.starts),
               named_struct('used', x.bytes, 'starts', array_append(a.starts, x.cell)))).starts
"""


def cut_points(atoms: DataFrame, n_shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity over atoms (cell, bytes), and the cells that begin shards 1, 2, ..."""
    row = (
        atoms.agg(F.array_sort(F.collect_list(F.struct("cell", "bytes"))).alias("atoms"))
        .withColumn("sizes", F.col("atoms.bytes"))
        .withColumn("total", F.expr("aggregate(sizes, 0L, (a, s) -> a + s)"))
        .withColumn("capacity", F.expr(_SEARCH.format(n=n_shards)))
        .select("capacity", F.expr(_CUTS).alias("starts"))
        .first()
    )
    return row["capacity"] or 0, list(row["starts"] or [])


def shard(docs: DataFrame, n_shards: int = 16, cells: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """One row per document: id, size, text_crc32, cell, shard, slot (gapless from 0 in each shard), capacity.

    There must be 64 cells a shard at least, so that shards can be near equal.
    With ``whole`` the rows are the documents, with size, text_crc32, shard and
    slot beside their columns, in place of any of the same name.
    """
    if not 1 <= n_shards <= cells // 64:
        raise ValueError(f"{cells} cells make 1 to {cells // 64} shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    columns = [
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(cells)).alias("cell"),
    ]
    rows = hold(docs.select(*columns))
    atoms = rows.groupBy("cell").agg(F.sum("size").alias("bytes"))
    capacity, starts = cut_points(atoms, n_shards)
    begun = F.filter(F.array(*map(F.lit, starts)).cast("array<bigint>"), lambda s: s <= F.col("cell"))
    n_lanes = lanes_for(rows.count())
    placing = (F.size(begun).alias("shard"), F.pmod(F.xxhash64("id", "text_crc32"), F.lit(n_lanes)).alias("lane"))
    by_shard = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.select(*placing).groupBy("shard", "lane").agg(F.count("*").alias("n")).select("shard", "lane", F.coalesce(F.sum("n").over(by_shard), F.lit(0)).alias("before"))
    in_lane = Window.partitionBy("shard", "lane").orderBy("id", "text_crc32", "size")
    placed = (docs.select(*columns, whole_row(docs)) if whole else rows).select("*", *placing).join(before, ["shard", "lane"])
    slot = (F.col("before") + F.row_number().over(in_lane) - 1).cast("long").alias("slot")
    if whole:
        own = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")]
        return placed.select(*own, "size", "text_crc32", "shard", slot)
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "cell", "shard", slot, F.lit(capacity).cast("long").alias("capacity"))
