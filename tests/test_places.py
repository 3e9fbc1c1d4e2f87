"""Places in files and in keys, whatever the splits and sizes."""

from __future__ import annotations

import random

from folioscope.operators import quality
from folioscope.sources import readers


def test_rows_of_several_files_keep_the_files_order(session, tmp_path) -> None:
    for k, n in enumerate((3, 4000, 5)):  # the largest file is dealt out first
        (tmp_path / f"{k}.csv").write_text("id,root\n" + "".join(f"{k}-{i:05},x\n" for i in range(n)))
    rows = readers.read_csv(session, str(tmp_path), ("id", "root")).orderBy("line").collect()
    assert [r["id"] for r in rows] == [f"{k}-{i:05}" for k, n in enumerate((3, 4000, 5)) for i in range(n)]


def test_the_last_entry_is_that_of_the_last_file(session, tmp_path) -> None:
    (tmp_path / "a.jsonl").write_text('{"id": 1, "root": "first"}\n' * 3000)
    (tmp_path / "b.jsonl").write_text('{"id": 1, "root": "last"}\n')
    session.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert [r["root"] for r in readers.read_root_entries(session, str(tmp_path)).collect()] == ["last"]
    finally:
        session.conf.unset("spark.sql.files.maxPartitionBytes")


def test_gaps_of_a_key_that_spans_lanes(session) -> None:
    r = random.Random(1)
    data = [*((None, n) for n in range(1, 9_000) if n != 5_000), ("b", 2), ("b", 3), *(("a", n) for n in range(1, 20_000) if n not in (9_000, 15_000))]
    r.shuffle(data)
    got = {(x["k"], x["n"], x["expected"]) for x in quality.gaps(session.createDataFrame(data, "k string, n int"), ["k"], "n").collect()}
    want = {("b", 2, 1), ("b", 3, 2), *((None, n, n - 1) for n in range(5_001, 9_000)), *(("a", n, n - 1) for n in range(9_001, 15_000)), *(("a", n, n - 2) for n in range(15_001, 20_000))}
    assert got == want


def test_the_report_reads_each_table_once(session, tmp_path) -> None:
    columns = ("id", "root", "full_response", "pos", *quality.LISTS)
    session.createDataFrame([("1", "a", "", "n", *["[]"] * 5)], ", ".join(f"{c} string" for c in columns)).write.parquet(str(tmp_path / "m"))
    session.createDataFrame([("a",), ("b",), (None,)], "root string").write.parquet(str(tmp_path / "r"))
    out = quality.report(session.read.parquet(str(tmp_path / "m")), session.read.parquet(str(tmp_path / "r")))
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    assert {r["check"]: r["findings"] for r in out.collect()} == {"missing roots": 2, "empty full_response": 1, "invalid full_response": 0, "duplicate roots": 0, "duplicate ids": 0, "empty pos": 0, "orphans": 0, "empty fields": 0}
