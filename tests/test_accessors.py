"""Single values, defaults, envelopes of searches, and bands beyond what a row searches."""

from __future__ import annotations

import bisect

from pyspark.sql import functions as F

from folioscope.operators import lookup, model, quality, search
from folioscope.sources import divisions, readers, sinks

VERSES = "surah int, name string, verse int, text string, bismillah string"


def test_single_values(session) -> None:
    v = session.createDataFrame([(1, "One", 1, quality.OPENING, None), (1, "One", 2, "x", None), (2, "Two", 1, quality.OPENING, None), (2, "Two", 2, "y", None), (9, "Nine", 1, "z", None)], VERSES)
    assert lookup.verse_text(v, 1, 2) == "x" and lookup.verse_text(v, 1, 3) is None
    assert lookup.surah_name(v, 2) == "Two" and lookup.surah_name(v, 3) is None
    opened = quality.with_openings(v)
    assert [lookup.bismillah(opened, n) for n in (1, 2, 9, 50)] == [quality.OPENING, quality.OPENING, None, None]


def test_divisions_and_their_parameters(session) -> None:
    table = divisions.divisions(session)
    assert [r["id"] for r in lookup.division_parameters(table).collect()] == [str(n) for n in range(1, 115)]
    assert table.agg(F.sum("verse_count")).first()[0] == 6236
    files = {r["number"]: r["file"] for r in divisions.page_files(session).collect()}
    assert len(files) == 114 and files[1] == "001-الفاتحة.html" and files[114].startswith("114-")
    at = session.createDataFrame([(1, 7), (2, 141), (2, 142), (83, 36), (114, 1), (0, 0)], "s int, v int")
    parts = lookup.as_of_bands(at, divisions.part_bands(session), F.struct("s", "v"), "start", "part", 1).collect()
    assert [(r["s"], r["part"]) for r in parts] == [(1, 1), (2, 1), (2, 2), (83, len(divisions.PART_STARTS)), (114, len(divisions.PART_STARTS)), (0, 1)]


def test_the_main_element_of_a_page(session, tmp_path) -> None:
    page = '<html><main class="quran" data-x="1">\n<p>{}</p></main></html>'
    rows = divisions.page_files(session).filter("number in (1, 2, 114)").withColumn("html", F.when(F.col("number") == 2, "<html></html>").otherwise(F.replace(F.lit(page), F.lit("{}"), F.col("number").cast("string"))))
    sinks.write_pages(rows, str(tmp_path / "p"))
    assert [readers.read_main(session, str(tmp_path / "p"), n) for n in (1, 2, 3, 114, 0, 115)] == ['<main class="quran" data-x="1">\n<p>1</p></main>', None, None, '<main class="quran" data-x="1">\n<p>114</p></main>', None, None]


def test_defaults_are_for_rows_without_a_match(session) -> None:
    rows = session.createDataFrame([(1, "mine"), (2, None), (3, None), (None, None)], "key int, note string")
    known = session.createDataFrame([(1, "one"), (2, None)], "key int, name string")
    got = lookup.with_default(rows, known, "key", {"name": "none"})
    assert sorted(map(str, got.collect())) == sorted(map(str, session.createDataFrame([(1, "mine", "one"), (2, None, None), (3, None, "none"), (None, None, "none")], "key int, note string, name string").collect()))


def test_more_bands_than_a_row_searches(session) -> None:
    n = lookup.MOST_BANDS + 5
    bands = session.range(n).selectExpr("id * 10 as start", "cast(id as int) as page")
    rows = session.range(0, 400, 1, 3).selectExpr("id", "id * 251 - 7 as at")
    out = lookup.as_of_bands(rows, bands, F.col("at"), "start", "page", -1)
    starts = [10 * k for k in range(n)]
    assert {r["id"]: r["page"] for r in out.collect()} == {k: bisect.bisect_right(starts, k * 251 - 7) - 1 for k in range(400)}
    assert "SinglePartition" not in out._jdf.queryExecution().toString()


def test_envelope_and_what_the_caller_gets(session) -> None:
    verses = session.createDataFrame([(s, v, f"the text {'the ' * v}") for s in (1, 2) for v in range(1, 41)], "surah int, verse int, text string")
    names = session.createDataFrame([(1, "One")], "id int, english_name string")
    e = search.envelope(search.search(verses, None, names, "the", "text", 3), "the").first()
    assert (e["query"], e["type"], e["total"]) == ("the", "text", 3) and [(r["surah"], r["verse"], r["surah_name"]) for r in e["results"]] == [(1, 40, "One"), (2, 40, ""), (1, 39, "One")]
    assert search.envelope(search.search(verses, None, names, "nowhere"), "nowhere").first()["total"] == 0
    assert len(search.ask(verses, None, names, "  the ")) == 50 and search.ask(verses, None, names, " ") == [] and search.ask(verses, None, names, None) == [] and search.ask(verses, None, names, "the", "kind") == []


def test_the_first_gloss_of_a_word(session) -> None:
    cell = {c: None for c in readers.MORPHOLOGY_COLUMNS}
    data = [cell | {"Sura_No": "1", "Verse_No": "1", "Word_No": str(w), "Segment_No": str(s), "Segmented_Word": f"t{s}", "Gloss": g} for w, s, g in ((1, 1, "(null)"), (1, 2, "second"), (1, 3, "third"), (2, 1, None))]
    rows = session.createDataFrame([tuple(r.values()) for r in data], ", ".join(f"{c} string" for c in readers.MORPHOLOGY_COLUMNS)).withColumn("line", F.monotonically_increasing_id())
    roots = session.createDataFrame([], "surah int, verse int, word int, root string, at int")
    words = model.words_of(model.segments_of(rows), session.createDataFrame([(1, 1)], "surah int, verse int"), roots)
    assert {r["word"]: (r["first_gloss"], r["translation"]) for r in words.collect()} == {1: ("second", "t1 second third"), 2: (None, "t1")}
