"""Sources, sinks, model, lookups, search, quality and repair on small made-up files."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import bookmarks, lookup, model, quality, render, repair, search
from folioscope.sources import readers, sinks

XML = """<quran><sura index="1" name="One"><aya index="1" text="abc def"/><aya index="2" text="gh &amp; i"/></sura>
<sura index="2" name="Two"><aya index="1" text="only" bismillah="formula"/></sura>
<sura index="9" name="Nine"><aya index="1" text="x"/><aya index="3" text="y"/></sura></quran>"""
HEAD = ",".join(readers.MORPHOLOGY_COLUMNS)
MORPH = [
    '1,1,1,1,"""abc""",abc,ab,PREP,Prefix,,,,,,,,,(null)',
    '1,1,1,2,"""abc""",abc,c,NOUN,Stem,.,SUBJ,,,,,,,sea',
    '1,1,1,2,"""abc""",abc,dup,NOUN,Stem,.,OBJ,,,,,,,again',
    "1,1,2,1,def,def,(null),V,Stem,,,,,,,,,",
    "1,2,1,1,gh,gh,gh,V,Stem,,,,,,,,,go",
    "7,7,1,1,lost,lost,l,V,Stem,,,,,,,,,no verse",
]
ROOTS = {"b": ["1:1:1", "1:1:2"], "a": ["1:1:1"], "Z": ["5:5:5"]}


@pytest.fixture(scope="module")
def corpus(session, tmp_path_factory):
    d: Path = tmp_path_factory.mktemp("corpus")
    (d / "v.xml").write_text(XML)
    (d / "m.csv").write_text("\n".join([HEAD, *MORPH]) + "\n")
    (d / "r.json").write_text(json.dumps(ROOTS))
    verses = readers.read_verses(session, str(d / "v.xml"))
    segments = model.segments_of(readers.read_morphology(session, str(d / "m.csv")))
    roots = readers.read_root_index(session, str(d / "r.json"))
    return verses, segments, roots


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def test_xml(corpus) -> None:
    assert sorted(rows(corpus[0]), key=str) == [(1, "One", 1, "abc def", None), (1, "One", 2, "gh & i", None), (2, "Two", 1, "only", "formula"), (9, "Nine", 1, "x", None), (9, "Nine", 3, "y", None)]


def test_words_and_segments(corpus) -> None:
    verses, segments, roots = corpus
    words = model.words_of(segments, verses, roots)
    got = {(r["surah"], r["verse"], r["word"]): r for r in words.collect()}
    assert set(got) == {(1, 1, 1), (1, 1, 2), (1, 2, 1)}
    assert got[1, 1, 1]["token"] == "abc" and got[1, 1, 1]["translation"] == "ab sea again" and got[1, 1, 1]["root"] == "a"
    assert got[1, 1, 2]["translation"] == "" and got[1, 1, 2]["root"] == "b" and got[1, 2, 1]["root"] is None
    nested = model.nested_words(words, segments)
    word = lookup.word_with_segments(nested, 1, 1, 1).first()
    assert [(s["segment"], s["text"], s["syntactic_role"]) for s in word["segments"]] == [(1, "ab", None), (2, "c", "SUBJ")]
    one = nested.filter("word = 1 and verse = 1")
    assert one.select(lookup.first_stem(F.col("segments"))["text"]).first()[0] == "c"
    assert one.select(lookup.first_filled(F.col("segments"), "syntactic_role")).first()[0] == "SUBJ"
    assert one.select(lookup.filled(F.col("segments"), "gloss")).first()[0] == ["sea"]
    assert {(r["surah"], r["verse"]): len(r["words"]) for r in model.verse_morphology(nested).collect()} == {(1, 1): 2, (1, 2): 1}


def test_csv_round_trip_with_quotes_and_line_breaks(session, tmp_path) -> None:
    data = [(str(i), f"r{i}", "x", 'say "hi",\nthere', "[]", "[]", "[]", "[]", "[]", '{"a": "b"}', "m", "n") for i in range(3)]
    df = session.createDataFrame(data, ", ".join(f"{c} string" for c in readers.MEANING_COLUMNS))
    sinks.write_csv(df, list(readers.MEANING_COLUMNS), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part*")).read_bytes()
    assert text.count(b"\r\n") == 4 and text.startswith(b"id,root,")
    back = readers.read_meanings(session, str(tmp_path / "out")).drop("line")
    assert sorted(rows(back)) == data


def test_xml_round_trip(session, corpus, tmp_path) -> None:
    verses, segments, roots = corpus
    words = model.words_of(segments, verses, roots).withColumn("gloss", F.col("translation"))
    seg = segments.select("surah", "verse", "word", "segment", "text", F.col("part_of_speech").alias("pos"), F.col("syntactic_role").alias("role"))
    sinks.write_xml(sinks.nested_verses(verses, words, seg), str(tmp_path / "x"))
    text = "".join(p.read_text() for p in (tmp_path / "x").glob("part*"))
    assert 'text="gh &amp; i"' in text and 'role="SUBJ"' in text and "null" not in text
    back = session.read.format("xml").option("rowTag", "surah").load(str(tmp_path / "x"))
    assert sorted(r["_number"] for r in back.collect()) == [1, 2, 9]


def test_pages(session, corpus, tmp_path) -> None:
    verses, segments, _ = corpus
    keyed = readers.keyed(segments.select("surah", "verse", "word", "text", "line"), ["surah", "verse", "word"], "line")
    marked = verses.withColumn("text", F.when(F.col("text") == "abc def", "abcۖ def").otherwise(F.col("text")))
    got = {r["surah"]: r for r in render.pages(marked, keyed).collect()}
    assert got[1]["file"] == "001-One.html" and got[1]["html"].count('class="quran-word"') == 5
    assert 'data-word="2" data-index="2"' in got[1]["html"] and "&quot;text&quot;:&quot;ab&quot;" in got[1]["html"] and "gh" in got[1]["html"]
    (tmp_path / "001-One.html").write_text(got[1]["html"])
    (tmp_path / "x.html").write_text("no number")
    read = readers.read_pages(session, str(tmp_path)).collect()
    assert [r["number"] for r in read] == [1]


def test_aligned_tokens_keep_both_numbers(session) -> None:
    verses = session.createDataFrame([(1, 1, "abcd ۖ efgh")], "surah int, verse int, text string")
    words = session.createDataFrame([(1, 1, 1, "abcd"), (1, 1, 2, "efgh")], "surah int, verse int, word int, token string")
    got = render.aligned_tokens(verses, words)
    assert sorted((r["word"], r["word_token"], r["token"], r["match"]) for r in got.collect()) == [(1, 0, 0, "direct"), (2, 1, 2, "direct")]
    assert sorted(rows(render.token_words(got))) == [(1, 1, 0, 1), (1, 1, 2, 2)]


VERSES = [(1, 1, "The cat sat. the end"), (1, 2, "THE dog"), (2, 1, "a.b and axb"), (2, 2, "nothing here"), (2, 3, "then the other")]


@pytest.mark.parametrize(
    ("q", "limit", "want"),
    [("the", 20, [(2, 3, 5), (1, 1, 4), (1, 2, 1)]), ("the", 2, [(2, 3, 5), (1, 1, 4)]), ("a.b", 20, [(2, 1, 3)]), ("a", 20, []), ("The cat", 20, [(1, 1, 7), (2, 3, 5), (1, 2, 1)])],
)
def test_text_search(session, q, limit, want) -> None:
    verses = session.createDataFrame(VERSES, "surah int, verse int, text string")
    names = session.createDataFrame([(1, "One")], "id int, english_name string")
    got = search.search(verses, None, names, q, "text", limit).collect()
    assert [(r["surah"], r["verse"], r["relevance"]) for r in got] == want
    assert all(r["surah_name"] == ("One" if r["surah"] == 1 else "") for r in got)


def test_root_and_gloss_search(session) -> None:
    verses = session.createDataFrame(VERSES, "surah int, verse int, text string")
    m = session.createDataFrame([(1, 1, "A Sea", ["ktb", "S"]), (2, 3, "the sea", ["qwl"])], "surah int, verse int, translation string, roots array<string>")
    names = session.createDataFrame([(1, "One")], "id int, english_name string")
    assert [r["context"] for r in search.search(verses, m, names, "KT", "root").collect()] == ["Root: ktb, S"]
    assert [r["verse"] for r in search.search(verses, m, names, "xqwlx s", "root").collect()] == [1, 3]
    assert [r["context"] for r in search.search(verses, m, names, "SEA", "gloss").collect()] == ["A Sea", "the sea"]
    assert len(search.search(verses, m, names, "sea", "gloss", 1).collect()) == 1


@pytest.mark.parametrize("bad", [("", "text", 20), ("x" * 201, "text", 20), ("a", "other", 20), ("a", "text", 0), ("a", "text", 101), ("a", "text", "x")])
def test_guards(bad) -> None:
    with pytest.raises(lookup.BadRequest):
        search.parameters(*bad)


def test_more_guards() -> None:
    assert search.parameters("a", None, "50") == ("a", "text", 50) and lookup.division_number("114") == 114
    assert lookup.root_parameter("قول", "قول") == "قول"
    for call in (lambda: lookup.division_number(115), lambda: lookup.positive("0"), lambda: lookup.root_parameter("%D9%82%D9%88", "قو"), lambda: lookup.root_parameter("abc", "abc")):
        with pytest.raises(lookup.BadRequest):
            call()


def test_lookups(session, corpus) -> None:
    dim = readers.read_dimension(session, [(2, "Two", "t", "Meccan", 1), (1, "One", "o", "Medinan", 2)])
    assert [r["number"] for r in lookup.divisions(dim).collect()] == [1, 2]
    assert [v["verse"] for v in lookup.division(dim, corpus[0], 1).first()["verses"]] == [1, 2]
    assert lookup.division(dim, corpus[0], 3).count() == 0 and lookup.verse(corpus[0], 1, 2).count() == 1
    m = session.createDataFrame([("1", "qwl", "قول"), ("2", "قول", "x")], "id string, root string, root_arabic string")
    assert lookup.root_meaning(m, "قول").first()["id"] == "1" and lookup.root_meaning(m, "x").first()["id"] == "2"
    assert lookup.substring_search(corpus[0], "only").count() == 1


def test_as_of_both_ways(session) -> None:
    data = session.createDataFrame([(1, 5), (2, 5), (2, 6), (114, 6), (0, 1)], "s int, v int")
    bands = session.createDataFrame([(1, 1, 1), (2, 1, 2), (2, 6, 3), (83, 7, 554)], "s int, v int, page int")
    got = lookup.as_of_bands(data, bands.withColumn("start", F.struct("s", "v")), F.struct("s", "v"), "start", "page", 1)
    assert sorted((r["s"], r["v"], r["page"]) for r in got.collect()) == [(0, 1, 1), (1, 5, 1), (2, 5, 2), (2, 6, 3), (114, 6, 554)]
    key = lambda df: df.select(F.lit(0).alias("k"), F.struct("s", "v").alias("at"), *(["page"] if "page" in df.columns else []))
    again = lookup.as_of(key(data), key(bands), ["k"], "at", "page", 1)
    assert sorted((r["at"]["s"], r["at"]["v"], r["page"]) for r in again.collect()) == [(0, 1, 1), (1, 5, 1), (2, 5, 2), (2, 6, 3), (114, 6, 554)]


GOOD = json.dumps({"general_meaning": "g"} | {k: [] for k in quality.LISTS})


def meanings(session):
    base = {c: None for c in readers.MEANING_COLUMNS}
    data = [
        base | {"id": "1", "root": "a", "general_meaning": "g", "full_response": GOOD, "pos": "n"} | {k: "[]" for k in quality.LISTS},
        base | {"id": "2", "root": "b", "full_response": "", "pos": " ", "general_meaning": "m", "shades_of_meaning": '[{"shade": "s"}]'},
        base | {"id": "2", "root": "b", "full_response": "{", "pos": "n"},
        base | {"id": "4", "root": "orphan", "full_response": "[1]", "pos": "n"},
        base | {"id": "5", "root": "c", "full_response": '{"general_meaning": "x"}', "pos": "n"},
        base | {"id": "6", "root": "d", "full_response": GOOD.replace('"shades_of_meaning": []', '"shades_of_meaning": {}').replace('"idioms_customs": []', '"idioms_customs": 1'), "pos": "n"},
    ]
    return session.createDataFrame([tuple(r.values()) for r in data], ", ".join(f"{c} string" for c in readers.MEANING_COLUMNS))


def test_report(session) -> None:
    roots = session.createDataFrame([("a",), ("b",), ("c",), ("d",), ("gone",)], "root string")
    m = meanings(session)
    got = {r["check"]: (r["findings"], r["ok"]) for r in quality.report(m, roots).collect()}
    assert got == {
        "missing roots": (1, False), "empty full_response": (1, False), "invalid full_response": (5, False), "duplicate roots": (1, False), "duplicate ids": (1, False),
        "empty pos": (1, False), "orphans": (1, True), "empty fields": (24, True),
    }
    assert quality.exit_code(quality.report(m, roots)) == 1
    findings = {(r["id"], r["finding"]) for r in quality.invalid_responses(m).collect()}
    assert {("2", "empty"), ("2", "invalid JSON"), ("4", "not an object"), ("5", "missing key: shades_of_meaning"), ("6", "shades_of_meaning is not a list"), ("6", "idioms_customs is not a list")} == findings


def test_repairs(session) -> None:
    m = meanings(session)
    filled = repair.backfill(m)
    assert tuple(repair.counters(filled).first()) == (1, 1, 4)
    built = filled.filter("outcome = 'updated'").first()["full_response"]
    assert json.loads(built)["general_meaning"] == "m" and json.loads(built)["shades_of_meaning"][0]["shade"] == "s" and json.loads(built)["hadith_examples"] == []
    more = repair.add_missing(m, session.createDataFrame([("zz",), ("a",), ("aa",)], "root string"), constants={"model_used": "none"})
    assert sorted((r["id"], r["root"]) for r in more.filter("model_used = 'none'").collect()) == [("7", "aa"), ("8", "zz")]
    patches = session.createDataFrame([("1", "a", "new"), ("1", "b", "never")], "id string, root string, general_meaning string")
    fixed = repair.patch_and_rebuild(m, patches)
    assert [(r["id"], r["general_meaning"], json.loads(r["full_response"])["general_meaning"]) for r in fixed.filter("patched").collect()] == [("1", "new", "new")]
    assert repair.anything(fixed) and not repair.anything(repair.patch(m, patches.limit(0), ["id", "root"]))
    assert repair.run(m, session.createDataFrame([("zz",)], "root string"), True, True).count() == 7


def test_corpus_rules(session, corpus) -> None:
    found = {(r["rule"], r["surah"], r["verse"]) for r in quality.corpus_findings(corpus[0]).collect()}
    assert found == {("gap", 9, 3), ("count", 3, None)}
    f = quality.OPENING
    v = session.createDataFrame([(1, 1, f, None), (1, 2, "x", None), (9, 1, f, None), (2, 1, f, None), (2, 2, "y", None), (3, 1, "z", "given"), (4, 1, "w", None)], "surah int, verse int, text string, bismillah string")
    got = {(r["surah"], r["verse"]): r["opening"] for r in quality.with_openings(v).collect()}
    assert got == {(1, 1): f, (1, 2): f, (9, 1): None, (2, 2): f, (3, 1): "given", (4, 1): None}


def test_root_entries_keep_the_last(session, tmp_path) -> None:
    (tmp_path / "e.jsonl").write_text('{"id": 1, "root": "a", "meaning": {"en": "x", "ar": "y"}}\n{"id": 1, "root": "b"}\n{"id": 2, "root": "c"}\n')
    assert sorted((r["id"], r["root"]) for r in readers.read_root_entries(session, str(tmp_path / "e.jsonl")).collect()) == [(1, "b"), (2, "c")]


def test_bookmarks(session, tmp_path) -> None:
    schema = readers.BOOKMARK
    old = session.createDataFrame([(1, 1, "One", 5, None), (2, 1, "Two", 9, "n")], schema)
    new = session.createDataFrame([(1, 1, "One", 20, None), (3, 1, "Three", 20, None)], schema)
    assert [r["timestamp"] for r in bookmarks.add(old, new).collect()] == [20, 9, 5]
    assert [r["surahNumber"] for r in bookmarks.toggle(old, new).collect()] == [3, 2]
    assert bookmarks.exists(old, 2, 1) and not bookmarks.exists(bookmarks.remove(old, old), 2, 1)
    sinks.write_bookmarks(old, str(tmp_path / "b"))
    assert readers.read_bookmarks(session, str(tmp_path / "b")).count() == 2
    (tmp_path / "bad.json").write_text("not json")
    assert readers.read_bookmarks(session, str(tmp_path / "bad.json")).count() == 0


def test_parameters_from_files(session, tmp_path) -> None:
    (tmp_path / "d.csv").write_text("id,english_name,english_translation,revelation_type,verse_count\n1,One,The First,Meccan,7\n")
    (tmp_path / "l.csv").write_text('category,code,label\nMorph_Tag (POS),PREP,"A word, before"\n')
    (tmp_path / "b.csv").write_text("surah,verse,page\n1,1,1\n2,6,3\n")
    assert rows(readers.read_dimension_csv(session, str(tmp_path / "d.csv"))) == [(1, "One", "The First", "Meccan", 7)]
    labels = readers.read_labels(session, str(tmp_path / "l.csv"))
    code = session.createDataFrame([("PREP",), ("ADJ",)], "c string")
    assert rows(code.select(text.label(F.col("c"), labels), text.category(F.col("c"), labels))) == [("A word, before", "Morph_Tag (POS)"), ("Adjective (صفة / نعت) — describes a noun", "Syntactic_Role")]
    bands = readers.read_bands(session, str(tmp_path / "b.csv"), "page")
    at = session.createDataFrame([(2, 7)], "s int, v int")
    assert lookup.as_of_bands(at, bands, F.struct("s", "v"), "start", "page", 1).first()["page"] == 3


def test_helpers(session) -> None:
    m = session.createDataFrame([("a", "first. second"), ("b", ".x")], "root string, general_meaning string")
    assert dict(rows(model.root_glosses(m))) == {"a": "first", "b": ".x"}
    assert [json.loads(r["json"])["root"] for r in sinks.as_json(m).collect()] == ["a", "b"]
