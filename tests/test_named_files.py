"""Pages as files of their names: all of them or none."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioscope.sources import readers, sinks


def pages(session, n: int, start: int = 1):
    return session.range(start, start + n).selectExpr("id as surah", "concat(lpad(cast(id as string), greatest(3, length(id)), '0'), '-Name-é.html') as file", "concat('<p>\\n', id, '</p>') as html").repartition(3)


def test_pages_are_read_back(session, tmp_path) -> None:
    path = str(tmp_path / "pages")
    sinks.write_pages(pages(session, 3, 999), path)
    assert sorted(p.name for p in Path(path).iterdir()) == ["1000-Name-é.html", "1001-Name-é.html", "999-Name-é.html"]
    assert sorted((r["number"], r["html"]) for r in readers.read_pages(session, path).collect()) == [(n, f"<p>\n{n}</p>") for n in (999, 1000, 1001)]


def test_a_later_write_replaces_the_folder(session, tmp_path) -> None:
    path = str(tmp_path / "pages")
    sinks.write_pages(pages(session, 5), path)
    sinks.write_pages(pages(session, 2, 4), path)
    assert sorted(p.name for p in Path(path).iterdir()) == ["004-Name-é.html", "005-Name-é.html"]


@pytest.mark.parametrize("bad", ["a/b", "", None, "../x"])
def test_a_failing_task_leaves_the_old_folder(session, tmp_path, bad) -> None:
    path = str(tmp_path / "pages")
    sinks.write_pages(pages(session, 4), path)
    broken = pages(session, 9).withColumn("file", F.when(F.col("surah") == 7, F.lit(bad)).otherwise(F.col("file"))).withColumn("html", F.lit("new"))
    with pytest.raises(Exception, match="not a file's name"):
        sinks.write_pages(broken, path)
    assert sorted(p.name for p in Path(path).iterdir()) == [f"00{n}-Name-é.html" for n in range(1, 5)]
    assert all("new" not in p.read_text() for p in Path(path).iterdir())


def test_two_rows_of_one_name_are_refused(session, tmp_path) -> None:
    path = str(tmp_path / "pages")
    with pytest.raises(Exception, match="one file's name"):
        sinks.write_pages(pages(session, 3).withColumn("file", F.lit("same.html")), path)
    assert not list(Path(path).iterdir())


def test_csv_in_ordered_parts(session, tmp_path) -> None:
    df = session.range(5_000).selectExpr("id", "if(id % 7 = 0, concat('a \"b\",\n', id), null) as text").repartition(7)
    path = str(tmp_path / "csv")
    sinks.write_csv(df, ["id", "text"], path, order=["id"], parts=4)
    parts = sorted(Path(path).glob("part-*"))
    assert len(parts) > 1 and all(p.read_bytes().startswith(b"id,text\r\n") for p in parts)
    assert parts[0].read_bytes().startswith(b'id,text\r\n0,"a ""b"",\n0"\r\n1,\r\n')
    back = readers.read_csv(session, path, ("id", "text")).orderBy("line").collect()
    assert [(int(r["id"]), r["text"]) for r in back] == [(n, f'a "b",\n{n}' if n % 7 == 0 else None) for n in range(5_000)]


def test_csv_of_nothing_is_its_header(session, tmp_path) -> None:
    path = str(tmp_path / "csv")
    sinks.write_csv(session.range(0), ["id"], path)
    assert b"".join(p.read_bytes() for p in Path(path).glob("part-*")) == b"id\r\n"
