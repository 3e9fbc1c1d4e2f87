"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order that a hash fixes.
A document finishes at the virtual time at which its source, served in
proportion to its weight, has given all words up to its end: cumulative words
of the source divided by the weight.  After its last document a source starts
again, ``max_repeats`` times in all.  Serving all sources in the order of
finish times, and stopping at the word budget, is the mix.

The fluid form of the same service gives the targets: at virtual time v a source
has given ``least(weight * v, max_repeats * size)``, so excess over a full source
goes to the others by weight.  The time at which the fluid total meets the
budget decides all but the copies in service at that time; these few are put
in order to find the exact end.  Cumulative words come from two-level prefix
sums over lanes of the shuffled order, so no source meets in one task.

Defined cases: a null text has size 0 and is never taken; a null source is a
source, last in order; repeated rows are queued one after the other; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import hold, lanes_for, small, whole_row, word_count

WEIGHTS = (3, 1, 2)


def _by_code_point() -> list[Column]:
    return [F.col("source").isNull(), F.col("source")]


def _level(sources: DataFrame, budget: Column, name: str) -> DataFrame:
    """Adds the virtual time at which the fluid service has given ``budget`` words."""
    full = Window.orderBy("full_at", *_by_code_point())
    given = F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing))
    at = (budget - given) / weights
    return sources.withColumn("_at", at).withColumn(name, F.coalesce(F.max(F.when(F.col("_at") <= F.col("full_at"), F.col("_at"))).over(Window.partitionBy()), F.max("full_at").over(Window.partitionBy()))).drop("_at")


def targets(sized: DataFrame, weights: tuple[int, ...], share: float, max_repeats: int) -> DataFrame:
    """One row per source: weight, size, cap, target, and the virtual times ``level`` and ``beyond``."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("longest"))
    everything = Window.partitionBy()
    sources = (
        sources.withColumn("rank", F.row_number().over(Window.orderBy(*_by_code_point())) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.least(F.sum("source_size").over(everything) * share, F.sum("cap").over(everything).cast("double")))
        .withColumn("most", F.least(F.col("budget") + F.sum("longest").over(everything), F.sum("cap").over(everything).cast("double")))
    )
    sources = _level(_level(sources, F.col("budget"), "level"), F.col("most"), "beyond")
    return sources.withColumn("target", F.least(F.col("weight") * F.col("level"), F.col("cap").cast("double")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_repeats: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document, in the order of first finish: how many copies the mix takes of it.

    ``weights`` are dealt to the sources in code-point order, repeating; the budget
    is ``share`` of all words.  Columns: id, source, size, source_size, weight,
    target, finish (virtual time of the first copy), copies, taken, uid.
    """
    rows = hold(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"),
            F.xxhash64(id_col, source_col, text_col).alias("uid"),
        )
    )
    n_lanes = lanes_for(rows.count())
    sources = hold(targets(rows, weights, share, max_repeats))
    lane = F.shiftright(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * n_lanes, 28)
    queued = rows.alias("r").join(small(sources.alias("s")), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "s.rank", "s.weight", "s.source_size", "s.target", "s.level", "s.beyond", lane.alias("lane"))
    by_source = Window.partitionBy("rank").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    before = queued.groupBy("rank", "lane").agg(F.sum("size").alias("n")).select("rank", "lane", F.coalesce(F.sum("n").over(by_source), F.lit(0)).alias("before"))
    in_lane = Window.partitionBy("rank", "lane").orderBy("key", "id", "size", "uid").rowsBetween(Window.unboundedPreceding, 0)
    timed = hold(queued.join(before, ["rank", "lane"]).withColumn("served", F.col("before") + F.sum("size").over(in_lane)).drop("before", "lane"))

    def finish(copy: int) -> Column:
        return (F.col("served") + copy * F.col("source_size")) / F.col("weight")

    finishes = F.array(*[finish(c) for c in range(max_repeats)])
    sure = timed.agg(F.coalesce(F.sum(F.size(F.filter(finishes, lambda f: f <= F.col("level"))) * F.col("size")), F.lit(0))).first()[0]
    budget, level = sources.agg(F.max("budget"), F.max("level")).first()
    # Copies that finish after the level and before the time by which the budget must be met: a few documents of each source.
    late = timed.filter("size > 0").select("key", "size", F.explode(F.filter(finishes, lambda f: (f > F.col("level")) & (f <= F.col("beyond")))).alias("finish"))
    total = F.sum("size").over(Window.orderBy("finish", "key").rowsBetween(Window.unboundedPreceding, 0))
    end = late.withColumn("total", total).filter(F.col("total") <= F.lit(float((budget or 0) - sure))).agg(F.max(F.struct("finish", "key"))).first()[0]
    end_at, end_key = (end["finish"], end["key"]) if end else (float(level or 0), "~")
    copies = F.size(F.filter(finishes, lambda f: (f < F.lit(end_at)) | ((f == F.lit(end_at)) & (F.col("key") <= F.lit(end_key)))))
    copies = F.when(F.col("size") > 0, copies).otherwise(0)
    return (
        timed.select(F.col("id").alias(id_col), "source", "size", "source_size", "weight", "target", finish(0).alias("finish"), "key", "uid", copies.alias("copies"))
        .withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
        .orderBy("finish", "key")
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how: object) -> DataFrame:
    """The documents of the mix, each as often as it is taken; their columns unchanged, whatever they are called.

    Rows alike in id, source and text share their copies as evenly as can be.
    The documents are read twice and must be the same both times, as a table is.
    """
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how).groupBy("uid", F.col(id_col).alias("id")).agg(F.sum("copies").alias("copies"), F.count("*").alias("alike")).filter("copies > 0")
    named = docs.select(F.col(id_col).alias("own"), F.xxhash64(id_col, source_col, text_col).alias("uid"), whole_row(docs))
    joined = named.join(taken, "uid").filter(F.col("own").eqNullSafe(F.col("id")))
    joined = joined.withColumn("nth", F.row_number().over(Window.partitionBy("uid", "id").orderBy("uid")))  # as the join is dealt
    times = F.expr("copies div alike + if(nth <= copies % alike, 1, 0)")
    return joined.filter(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).select("row.*")
