"""Scalar functions on golden values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import jsons
from folioscope.functions import text as t
from folioscope.functions.align import align, near, walk


def value(session, column, **inputs):
    return session.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]).select(column.alias("x")).first()["x"]


CASES = [
    (t.search_form, "ٱلرَّحْمَـٰنِ", "الرحمن"),
    (t.matching_form, "ٱلرَّحْمَـٰنِ", "الرحمان"),
    (t.search_form, " بِسْمِ ۖ ", "بسم"),
    (t.transliterate, "$Am*", "شآمذ"),
    (t.transliterate, "hello 7", "هeللo 7"),
    (t.arabic_digits, "120", "١٢٠"),
    (t.titled, "IV_COP_foo.bar", "IV COP Foo.Bar"),
    (t.label, "None", ""),
    (t.label, "NOMINATIVE", "Nominative (مرفوع) — subject/predicate case (ـُ / ـٌ)"),
    (t.label, "some_code", "Some Code"),
    (t.short_label, "PREP", "Prep"),
    (t.short_label, "a_very_long_unknown_code", "A Very Long Unk…"),
    (t.category, "SUKUN", "Case_Mood_Marker"),
    (t.category, "x", ""),
    (t.unquote, '"a"b"', 'a"b'),
    (t.clean_field, " (null)", "(null)"),
    (t.clean_field, "(null)", ""),
    (t.xml_escape, 'a&<>"', "a&amp;&lt;&gt;&quot;"),
    (t.slug, "--a b_c!é", "a-b_c-é"),
    (t.page_main, '<main a\nclass="quran" b>x\ny</main></main>', '<main a\nclass="quran" b>x\ny</main>'),
    (t.page_main, '<main class="quran">x', None),
    (t.page_title, "<title> a\n</title>", "a"),
    (t.page_title, "a", None),
    (t.first_sentence, ".abc", ".abc"),
    (t.first_sentence, "ab. c", "ab"),
    (t.leading_int, " 12abc", 12),
    (t.leading_int, "x1", None),
    (t.is_pause, "ۖۚ", True),
    (t.is_pause, "aۖ", False),
    (t.has_arabic, "xب", True),
    (t.only_arabic, "بx", False),
]


@pytest.mark.parametrize(("function", "text", "want"), CASES)
def test_scalars(session, function, text, want) -> None:
    assert value(session, function(F.col("a")), a=text) == want


@pytest.mark.parametrize(("a", "b", "want"), [("a", "a", 0), ("ab", "abc", 1), ("ab", "abcd", 2), ("ab", "xy", 2), ("", "a", 1), ("", "ab", 2)])
def test_bounded_distance(session, a, b, want) -> None:
    assert value(session, t.bounded_distance(F.col("a"), F.col("b")), a=a, b=b) == want
    assert near(a, b, 1) == (want <= 1)


def test_marks_are_peeled_off(session) -> None:
    got = value(session, t.tokens_and_marks(F.col("a")), a="abcۖۚ de ۖ")
    assert [tuple(x) for x in got] == [("word", "abc"), ("mark", "ۖ"), ("mark", "ۚ"), ("word", "de"), ("mark", "ۖ")]
    assert 'data-meaning="Stop preferred"' in value(session, t.mark_html(F.col("a")), a="ۖ")


def test_tokens(session) -> None:
    got = value(session, t.classified_tokens(F.col("a")), a=" a ۖۚ ﴿1﴾\n")
    assert [tuple(x) for x in got] == [("word", "a"), ("pause", "ۖۚ"), ("ayah", "﴿1﴾")]
    assert value(session, t.count_words(F.col("a")), a="") == 0


def test_references(session) -> None:
    assert tuple(value(session, t.parse_reference(F.col("a")), a="2:255")) == (2, 255)
    assert value(session, t.parse_reference(F.col("a")), a="2:255:1") is None
    assert tuple(value(session, t.split_reference(F.col("a")), a="2:255:1")) == (2, 255, 1)
    assert tuple(value(session, t.morphology_tag(F.col("a")), a="STEM LEM:{foo} ROOT:$yA")) == ("foo", "$yA")


@pytest.mark.parametrize("term", ["a.b", "\\E", "x\\Ey", "(", "$1"])
def test_literal_pattern(session, term) -> None:
    assert value(session, F.regexp_count(F.col("a"), F.lit(t.literal_pattern(term))), a=f"-{term}-{term}") == 2


@pytest.mark.parametrize(("text", "kind"), [(None, "empty"), (" ", "empty"), ("{", "invalid"), ("{}", "OBJECT"), ("[1]", "ARRAY"), ('"a"', "STRING")])
def test_json_kinds(session, text, kind) -> None:
    assert value(session, jsons.kind(F.col("a").cast("string")), a=text) == kind
    assert value(session, F.size(jsons.array_or_empty(F.col("a").cast("string"), jsons.QUOTES)), a=text) in ((0,) if kind != "ARRAY" else (0, 1))


ALIGNED = [
    ("abcd efgh", "abcd efgx", [(0, [0], "direct"), (1, [1], "direct")]),
    ("abc wxyz", "abcwxyz", [(0, [0], "join"), (1, [0], "join")]),
    ("abcdef zzz", "abc def zzz", [(0, [0, 1], "split"), (1, [2], "direct")]),
    ("qqqq abcd", "mmmm abcd", [(0, [0], "fallback"), (1, [1], "direct")]),
    ("abcd efgh ijkl", "abcd", [(0, [0], "direct"), (1, [], "fallback"), (2, [], "fallback")]),
    ("", "a", []),
    ("abcd", "", [(0, [], "fallback")]),
]


@pytest.mark.parametrize(("listed", "tokens", "want"), ALIGNED)
def test_alignment(session, listed, tokens, want) -> None:
    assert walk(listed.split(), tokens.split()) == want
    got = value(session, align(t.words(F.col("a")), t.words(F.col("b"))), a=listed, b=tokens)
    assert [(e["index"], e["tokens"], e["match"]) for e in got] == want


def distance(a: str, b: str) -> int:
    if not a or not b:
        return len(a) + len(b)
    return min(distance(a[1:], b) + 1, distance(a, b[1:]) + 1, distance(a[1:], b[1:]) + (a[0] != b[0]))


def test_near_on_random_words() -> None:
    r = random.Random(1)
    for _ in range(400):
        a, b = ("".join(r.choices("ab", k=r.randrange(6))) for _ in range(2))
        for most in (0, 1, 2):
            assert near(a, b, most) == (distance(a, b) <= most)


def test_upper_case_by_character_is_that_of_the_sql(session) -> None:
    import duckdb

    wide = [c for c in map(chr, range(0x110000)) if len(c.upper()) > 1]
    rows = ["ich schß. Öl", "", None, "ßß", "aßb\ncß", "ǆ ΐ ﬁn", *wide, "x".join(wide)]
    df = session.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    got = {r["i"]: r["u"] for r in df.select("i", t.upper_by_character(F.col("x")).alias("u")).collect()}
    assert [got[i] for i in range(len(rows))] == [duckdb.execute("SELECT upper(?)", [x]).fetchone()[0] for x in rows]


def test_gloss_search_finds_sharp_s(session, tmp_path) -> None:
    from folioscope import catalog

    session.createDataFrame([(1, "So. ich schß. Ende"), (2, "ich schss.")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    session.createDataFrame([(89, "Enlich schß. Ö")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = catalog.QUERIES["indexed_gloss_search"](session, str(tmp_path)).collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [(89, 1)]
