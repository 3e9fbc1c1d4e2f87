"""File names of all pages: numbers over 999 stay whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope import catalog
from folioscope.functions import text as t


def test_numbers_are_padded_and_never_cut(session) -> None:
    rows = session.createDataFrame([(1,), (123,), (1234,)], "n long").select(t.page_file(F.col("n"), F.lit("x")).alias("f"))
    assert [r["f"] for r in rows.collect()] == ["001-x.html", "123-x.html", "1234-x.html"]


def test_all_pages_are_named(session, tmp_path) -> None:
    session.createDataFrame([(7, "a"), (1234, "b")], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = catalog.QUERIES["file_names_and_attributes"](session, str(tmp_path))
    assert sorted(r["file"] for r in got.collect()) == ["007-a.html", "1234-b.html"]
