"""Mixing against its SQL and its laws; sharding against brute force."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.llm import queries
from folioscope.llm.op1_mixing import mix, mixed_rows
from folioscope.llm.op4_sharding import cut_points, shard
from tests.llm.conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text: str | None) -> int:
    return len(WORD.findall(text or ""))


def fluid(sizes: dict, weights: dict, budget: float) -> dict:
    """Targets by sharing out again and again what full sources leave."""
    full: dict = {}
    while True:
        left = budget - sum(full.values())
        open_ = {s: w for s, w in weights.items() if s not in full}
        shares = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = {s: 2.0 * sizes[s] for s in shares if shares[s] > 2 * sizes[s]}
        if not over:
            return full | shares
        full |= over


def test_targets_and_takings(docs) -> None:
    got = mix(docs).collect()
    data = rows()
    sizes: dict = defaultdict(int)
    longest: dict = defaultdict(int)
    for _, t, _, s, _ in data:
        sizes[s] += size(t)
        longest[s] = max(longest[s], size(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want = fluid(sizes, weights, 1.5 * sum(sizes.values()))
    assert len(got) == len(data)
    taken: dict = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * longest[s]
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    finishes = [r["finish"] for r in got]
    assert finishes == sorted(finishes)
    assert sorted(map(str, got)) == sorted(map(str, mix(docs.repartition(3)).collect()))


def test_mix_equals_sql(spark, docs, tmp_path) -> None:
    d = docs.select("doc_id", "text", "lang", "source", "n_chars").dropDuplicates(["doc_id"]).filter("doc_id is not null")
    d.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op1_mixing(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["op1_mixing"]).fetchall()
    assert [tuple(r) for r in sorted(got)] == [pytest.approx(r) for r in sorted(want)]


def test_mixed_rows_come_as_often_as_taken(docs) -> None:
    unique = docs.dropDuplicates(["doc_id"])
    unique = docs.sparkSession.createDataFrame(unique.collect(), unique.schema)  # of two rows without id the same one each time
    copies = {r["doc_id"]: r["copies"] for r in mix(unique).collect()}
    out = mixed_rows(unique)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: c for k, c in copies.items() if c}


def shards_needed(sizes: list[int], capacity: int) -> int:
    used, n = 0, 1
    for s in sizes:
        used, n = (used + s, n) if used + s <= capacity else (s, n + 1)
    return n


@pytest.mark.parametrize("n", [1, 3, 7, 16])
def test_capacity_is_the_least(spark, n: int) -> None:
    sizes = [(i * 7919) % 97 + 1 for i in range(60)] + [500]
    capacity, starts = cut_points(spark.createDataFrame(list(enumerate(sizes)), "cell long, bytes long"), n)
    assert capacity == next(c for c in range(max(sizes), sum(sizes) + 1) if shards_needed(sizes, c) <= n)
    bounds = [0, *starts, len(sizes)]
    assert len(starts) < n and all(sum(sizes[a:b]) <= capacity for a, b in zip(bounds, bounds[1:], strict=False))


def test_shards(docs) -> None:
    got = shard(docs, 5).collect()
    data = rows()
    assert len(got) == len(data)
    texts = {(i, zlib.crc32((t or "").encode())): len((t or "").encode()) + 1 for i, t, *_ in data}
    slots: dict = defaultdict(list)
    where: dict = defaultdict(set)
    for r in got:
        assert r["size"] == texts[r["doc_id"], r["text_crc32"]]
        assert 0 <= r["shard"] < 5
        slots[r["shard"]].append(r["slot"])
        where[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())


def test_too_many_shards_for_the_cells(docs) -> None:
    with pytest.raises(ValueError, match="cells"):
        shard(docs, 2000)


def test_empty(no_docs) -> None:
    assert mix(no_docs).count() == 0
    assert mixed_rows(no_docs).count() == 0
    assert shard(no_docs).count() == 0


def test_one_text_alone(spark) -> None:
    one = spark.createDataFrame([(i, "same text", "s") for i in range(9)], "doc_id long, text string, source string")
    assert {r["shard"] for r in shard(one).collect()} == {0}
    assert mix(one).agg(F.sum("taken")).first()[0] == 26  # one copy short of 27 words, in whole documents
