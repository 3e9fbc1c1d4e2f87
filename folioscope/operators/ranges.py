"""Order across partitions: sampled cells, numbering and as-of values with a carry from cell to cell.

Rows are cut into cells, ranges of (keys, order) with about as many rows each.  A
window over a cell does the work inside it.  What one cell hands to the next, a
count or a last value, concerns only the key at the cell's lower bound, since any
other key begins in the cell itself; so it is a few values for each cell, which
the driver adds up.  No key is too large: it spans as many cells as it needs.

Bounds are literals, so a lost partition is computed again with the same cells.
Rows are read three times (sample, carry, result), the first two times only the
columns of keys and order.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_CELLS = 4096  #: cells grow with the data beyond that, results don't change
SAMPLE = 32  #: rows of the sample for each cell


def literal(value: Any) -> Column:
    """A row, a list or a plain value as an expression."""
    if isinstance(value, Row):
        return F.struct(*[literal(v).alias(k) for k, v in value.asDict().items()])
    return F.array(*map(literal, value)) if isinstance(value, list) else F.lit(value)


def last_at_or_below(sorted_array: Column, key: Column, size: int, field: str | None = None) -> Column:
    """Number of elements of a sorted array that are at or below the key: a binary search within the row."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, size.bit_length())))])

    def step(at: Column, jump: Column) -> Column:
        element = F.get(sorted_array, at + jump - 1)
        return F.when((at + jump <= size) & ((element[field] if field else element) <= key), at + jump).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


class Cells:
    """Ranges of the given columns, nulls first, with about as many of the sampled rows each."""

    def __init__(self, rows: DataFrame, columns: list[str], cells: int | None = None) -> None:
        self.columns = columns
        wanted = rows.select(F.struct(*columns).alias("o"))
        most = min(MOST_CELLS, cells or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        n = wanted.count()
        found = [r["o"] for r in wanted.sample(min(1.0, most * SAMPLE / max(1, n)), seed=7).orderBy("o").collect()]
        places = sorted({len(found) * k // most for k in range(1, most)}) if found else []
        bounds = reduce(lambda a, b: a if a and a[-1] == b else [*a, b], [found[p] for p in places], [])
        self.bounds = bounds[1:] if bounds and bounds[0] == found[0] else bounds
        kind = T.ArrayType(wanted.schema["o"].dataType)
        self.array = F.sort_array(literal(self.bounds).cast(kind)) if self.bounds else F.array().cast(kind)

    def __len__(self) -> int:
        return len(self.bounds) + 1

    @property
    def cell(self) -> Column:
        """A row's cell, from 0."""
        return last_at_or_below(self.array, F.struct(*self.columns), len(self.bounds)) if self.bounds else F.lit(0)

    def first_key(self, keys: list[str], cell: Column) -> Column:
        """Whether a row has the key at the lower bound of its cell, so that rows of the key may lie in cells before."""
        if not keys:
            return F.lit(True)
        low = F.get(self.array, cell - 1)
        return F.coalesce(reduce(Column.__and__, [F.col(k).eqNullSafe(low[k]) for k in keys]) & low.isNotNull(), F.lit(False))

    def at_bounds(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Rows, one for each key and cell, of keys that lie at a bound: two for each cell at most."""
        if not keys or not self.bounds:
            return rows if not keys else rows.limit(0)
        schema = T.StructType([f for f in rows.schema.fields if f.name in keys])
        known = rows.sparkSession.createDataFrame([tuple(x) for x in dict.fromkeys(tuple(b[k] for k in schema.names) for b in self.bounds)], schema)
        alike = reduce(Column.__and__, [rows[k].eqNullSafe(known[k]) for k in keys])
        return rows.join(F.broadcast(known), alike, "left_semi")


def _key(row: Row, keys: list[str]) -> tuple:
    return tuple(row[k] for k in keys)


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, cells: int | None = None) -> DataFrame:
    """Rows with their number within the keys, from 1, in an order that should leave no ties.

    Nulls come first and a null key is a key; an empty table gives none.
    """
    own = Cells(rows, [*keys, *order], cells)
    celled = rows.withColumn("_cell", own.cell)
    counts = celled.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    starts, seen = [0] * len(own), {}
    here = {(_key(r, keys), r["_cell"]): r["_n"] for r in own.at_bounds(counts, keys).collect()}
    for cell in range(len(own)):
        if cell:
            starts[cell] = seen.get(_key(own.bounds[cell - 1], keys), 0)
        for (key, _), n in ((k, n) for k, n in here.items() if k[1] == cell):
            seen[key] = seen.get(key, 0) + n
    place = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(*order)).cast("long")
    before = F.when(own.first_key(keys, F.col("_cell")), F.get(literal(starts), F.col("_cell"))).otherwise(0)
    return celled.withColumn(name, place + before).drop("_cell")


def as_of(rows: DataFrame, bands: DataFrame, keys: list[str], order: str, value: str, default: object, cells: int | None = None) -> DataFrame:
    """Value of the last band of the keys that starts at or before a row's place in the order, any number of bands, with or without keys.

    Bands with a null value are passed over; of bands with equal keys and start
    the largest value counts.  Rows before the first band get the default.
    """
    known = bands.filter(F.col(value).isNotNull()).select(*keys, order, value)
    own = Cells(rows.select(*keys, order).unionByName(known.select(*keys, order)), [*keys, order], cells)
    starts = known.withColumn("_cell", own.cell)
    lasts = starts.groupBy(*keys, "_cell").agg(F.max(F.struct(order, value)).alias("_last"))
    carry, seen = [None] * len(own), {}
    here = {(_key(r, keys), r["_cell"]): r["_last"][value] for r in own.at_bounds(lasts, keys).collect()}
    for cell in range(len(own)):
        if cell:
            carry[cell] = seen.get(_key(own.bounds[cell - 1], keys))
        seen |= {k[0]: v for k, v in here.items() if k[1] == cell}
    kind = bands.schema[value].dataType
    both = rows.withColumns({"_value": F.lit(None).cast(kind), "_row": F.lit(1), "_cell": own.cell}).unionByName(starts.withColumnRenamed(value, "_value").withColumn("_row", F.lit(0)), allowMissingColumns=True)
    last = F.last("_value", ignorenulls=True).over(Window.partitionBy(*keys, "_cell").orderBy(order, "_row", "_value").rowsBetween(Window.unboundedPreceding, 0))
    before = F.when(own.first_key(keys, F.col("_cell")), F.get(literal(carry).cast(T.ArrayType(kind)), F.col("_cell")))
    return both.withColumn("_value", F.coalesce(last, before, F.lit(default))).filter("_row = 1").drop("_row", "_cell").withColumn(value, F.col("_value")).drop("_value")
