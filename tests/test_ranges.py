"""Numbers and as-of values over cells against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession

from folioscope.operators.ranges import Cells, as_of, numbered


def rows(seed: int, n: int = 3000) -> list[tuple]:
    r = random.Random(seed)
    return [(r.choice([None, "a", "a", "a", "a", "b", "c", f"z{r.randrange(30)}"]), r.choice([None, *range(50)]), i) for i in range(n)]


def frame(session: SparkSession, data: list[tuple]) -> DataFrame:
    return session.createDataFrame(data, "k string, o int, i int").repartition(5)


def in_order(x: tuple) -> tuple:
    return (x[1] is not None, x[1] or 0, x[2])


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("cells", [1, 7, 40])
def test_numbers_are_those_of_a_loop(session, keys: list[str], cells: int) -> None:
    data, seen, want = rows(1), {}, {}
    for k, _, i in sorted(data, key=in_order):
        key = k if keys else None
        seen[key] = want[i] = seen.get(key, 0) + 1
    got = numbered(frame(session, data), keys, ["o", "i"], "n", cells)
    assert got.columns == ["k", "o", "i", "n"]
    assert {r["i"]: r["n"] for r in got.collect()} == want


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("cells", [1, 7, 40])
def test_as_of_is_the_last_band(session, keys: list[str], cells: int) -> None:
    r, data = random.Random(3), rows(2)
    bands = [(r.choice([None, "a", "a", "b", "z3"]), r.randrange(50), r.choice([None, 1, 2, 3, 4])) for _ in range(80)]
    got = {x["i"]: x["v"] for x in as_of(frame(session, data), session.createDataFrame(bands, "k string, o int, v int"), keys, "o", "v", -1, cells).collect()}
    for k, o, i in data:
        below = [(bo, bv) for bk, bo, bv in bands if (not keys or bk == k) and bv is not None and o is not None and bo <= o]
        assert got[i] == (max(below)[1] if below else -1)


def test_empty_tables(session) -> None:
    some, none = frame(session, rows(4, 50)), frame(session, rows(4, 1)).limit(0)
    bands = session.createDataFrame([(5, 1)], "o int, v int")
    assert numbered(none, ["k"], ["o", "i"], "n").count() == 0 and as_of(none, bands, [], "o", "v", 0).count() == 0
    assert {r["v"] for r in as_of(some, bands.limit(0), [], "o", "v", 0).collect()} == {0}


def test_a_key_of_nearly_all_rows_spans_cells_of_like_size(session) -> None:
    df = session.range(40_000).selectExpr("if(id % 50 = 0, concat('k', id), 'hot') as k", "id as o")
    sizes = [r["count"] for r in df.withColumn("cell", Cells(df, ["k", "o"], 16).cell).groupBy("cell").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_no_task_holds_all_rows(session) -> None:
    df = session.range(1000).selectExpr("id as o", "id as v")
    for out in (numbered(df, [], ["o"], "n"), as_of(df.select("o"), df, [], "o", "v", 0)):
        assert "SinglePartition" not in out._jdf.queryExecution().toString()
