"""Stages keep columns whatever their names are, and rows that repeat."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import DataFrame

from folioscope.llm import near_copies, op10_simhash
from folioscope.llm.op1_mixing import mix, mixed_rows
from folioscope.llm.op4_sharding import shard

NAMES = ("_n", "_uid", "_own", "_id", "_copies", "_copy", "row", "own", "uid", "id", "n", "nth", "copies", "alike", "first", "same", "cell", "before", "lane", "a.b")


def named(df: DataFrame) -> DataFrame:
    own = df.select("doc_id", "text", "source")
    return own.selectExpr("*", *[f"concat('{n}', doc_id) as `{n}`" for n in NAMES])


@pytest.mark.parametrize("stage", [near_copies.one_of_each, op10_simhash.one_of_each, mixed_rows, lambda d: shard(d, whole=True)])
def test_columns_pass_unchanged(docs, stage) -> None:
    df = named(docs)
    out = stage(df)
    assert out.columns[: len(df.columns)] == df.columns
    rows = out.collect()
    assert rows and {tuple(r)[: len(df.columns)] for r in rows} <= {tuple(r) for r in df.collect()}
    assert all(r[n] == (None if r["doc_id"] is None else f"{n}{r['doc_id']}") for r in rows for n in NAMES)


def test_near_duplicate_stages_keep_a_document_without_id(docs) -> None:
    for stage in (near_copies.one_of_each, op10_simhash.one_of_each):
        kept = [tuple(r) for r in stage(docs).select("doc_id", "text").collect()]
        assert len(kept) == len(set(kept)) and (None, "Some words here") in kept


def test_repeated_rows_take_what_the_mix_takes(spark) -> None:
    rows = [(i % 7, f"w{i % 7} " * (3 + i % 7), "a" if i % 7 < 3 else "b") for i in range(40)] + [(9, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = {r["doc_id"]: r["n"] for r in mix(df).groupBy("doc_id").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "n").collect()}
    got = Counter(r["doc_id"] for r in mixed_rows(df).collect())
    assert got == Counter({i: n for i, n in want.items() if n})


def test_sharded_documents_are_the_documents(docs) -> None:
    out = shard(docs, whole=True)
    assert out.columns == [c for c in docs.columns if c not in ("size", "shard")] + ["size", "text_crc32", "shard", "slot"]
    plain = Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in shard(docs).collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in out.collect()) == plain
    assert Counter(r["text"] for r in out.collect()) == Counter(r["text"] for r in docs.select("text").collect())
