"""Search over the index against a scan, and joins of words against plain loops."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import search, search_many, text_index, word_joins

ALPHABET = "abc ABéَٱـ.\\EßẞİiΣσς🙂\0"


def texts(seed: int, n: int = 120) -> list[tuple]:
    r = random.Random(seed)
    out = [(r.randrange(3), i, "".join(r.choices(ALPHABET, k=r.randrange(0, 40)))) for i in range(n)]
    return [*out, (9, 1, None), (9, 2, ""), (9, 3, "The cat. " * 3000 + "needle"), (9, 4, "َ")]


def queries(seed: int, known: list[tuple]) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for k in range(60):
        text = r.choice([t for _, _, t in known if t])
        a = r.randrange(len(text))
        out.append((k, r.choice([text[a : a + r.randrange(1, 12)], text[a : a + 3].upper(), "".join(r.choices(ALPHABET, k=r.randrange(1, 5)))])))
    return [*out, (100, "needle"), (101, ""), (102, None), (103, "َ"), (104, "nowhere at all"), (105, "the"), (105, "the")]


@pytest.fixture(scope="module")
def corpus(session, tmp_path_factory) -> tuple[DataFrame, text_index.TextIndex, DataFrame, list[tuple]]:
    known = texts(1)
    verses = session.createDataFrame(known, "surah int, verse int, text string").selectExpr("*", "'x' as block", "1 as term").repartition(6)
    asked = queries(2, known)
    index = text_index.build(verses, ["surah", "verse"], "text", str(tmp_path_factory.mktemp("index") / "a"))
    return verses, index, session.createDataFrame(asked, "query_id int, query string"), asked


def test_substring_search_finds_what_a_scan_finds(corpus) -> None:
    verses, index, asked, plain = corpus
    want = sorted((k, s, v) for k, q in plain if q is not None for s, v, t in texts(1) if t is not None and q in t)
    assert sorted((r["query_id"], r["surah"], r["verse"]) for r in text_index.substring_search(index, asked).collect()) == want


@pytest.mark.parametrize("query", ["the", "a.", "é", "ab", "\\E", "c a", "ẞ", "İi", "Σσ", "zzz", "needle", "a"])
def test_text_search_finds_what_a_scan_finds(session, corpus, query: str) -> None:
    verses, index, _, _ = corpus
    want = [(r["surah"], r["verse"], r["relevance"]) for r in search.search_text(verses, query, ["surah", "verse"], limit=15).collect()]
    got = text_index.search_text(index, session.createDataFrame([(1, query)], "query_id int, query string"), limit=15).collect()
    assert [(r["surah"], r["verse"], r["relevance"]) for r in sorted(got, key=lambda r: (-r["relevance"], r["surah"], r["verse"]))] == want


def test_gloss_search_finds_what_a_scan_finds(session, corpus) -> None:
    verses, index, asked, plain = corpus
    got: dict = {}
    for r in text_index.search_glosses(index, asked, limit=5).collect():
        got.setdefault(r["query_id"], []).append((r["surah"], r["verse"]))
    for k, q in plain:
        if q and k != 105:
            want = [(r["surah"], r["verse"]) for r in search.search_glosses(verses, q, ["surah", "verse"], "text", limit=5).collect()]
            assert sorted(got.get(k, [])) == want


def test_a_rare_query_reads_few_texts(session, tmp_path) -> None:
    rows = session.range(20_000).selectExpr("id", "concat('word', id, ' and some more text ', md5(cast(id as string))) as text").repartition(4)
    index = text_index.build(rows, ["id"], "text", str(tmp_path / "i"))
    found = text_index.substring_search(index, session.createDataFrame([(1, "word17123 ")], "query_id int, query string"))
    assert [r["id"] for r in found.collect()] == [17123]
    assert text_index.rows_read(found)["texts"] <= 2 * text_index.BLOCK
    hits = text_index.candidates(index, session.createDataFrame([("word17123 ",)], "term string"))
    assert hits.count() < 10  # the exact check comes after
    hits.collect()
    assert 0 < text_index.rows_read(hits)["postings"] < index.postings.count() / 2


def test_the_folded_form_is_made_character_by_character(session) -> None:
    r = random.Random(5)
    pairs = [("".join(r.choices(ALPHABET, k=5)), "".join(r.choices(ALPHABET, k=5))) for _ in range(200)]
    df = session.createDataFrame(pairs, "a string, b string")
    assert df.filter(text_index.folded(F.concat("a", "b")) != F.concat(text_index.folded(F.col("a")), text_index.folded(F.col("b")))).count() == 0


def test_many_requests_are_answered_as_one_is(session, tmp_path) -> None:
    r = random.Random(8)
    verses = session.createDataFrame([(k % 3, k, " ".join(r.choices(["the", "The", "sea", "end", "theme", "É"], k=6))) for k in range(60)], "surah int, verse int, text string")
    roots = ["ktb", "Kt", "s", "qwl", "ab"]
    morphology = session.createDataFrame([(k % 3, k, r.choice(["A Sea", "the end", None, "other"]), sorted(r.sample(roots, r.randrange(0, 3)))) for k in range(55)], "surah int, verse int, translation string, roots array<string>")
    names = session.createDataFrame([(1, "One"), (2, "Two")], "id int, english_name string")
    asked = [("text", "the"), ("text", "the É"), ("root", "KT"), ("root", "xqwlx s"), ("root", "none"), ("gloss", "SEA"), ("gloss", "e"), (None, "sea end"), ("text", "a"), ("kind", "the"), ("text", ""), ("text", "x" * 201), ("gloss", None)]
    requests = session.createDataFrame([(k, q, kind) for k, (kind, q) in enumerate(asked)], "query_id int, q string, type string")
    got: dict = {}
    for x in search_many.answer(search_many.prepare(verses, morphology, names, str(tmp_path / "many")), requests, limit=7).collect():
        got.setdefault(x["query_id"], []).append((x["surah"], x["surah_name"], x["verse"], x["text"], x["relevance"], x["context"]))
    for k, (kind, q) in enumerate(asked):
        try:
            rows = search.search(verses, morphology, names, q, kind, 7).collect()
        except search.BadRequest:
            rows = []
        want = [(x["surah"], x["surah_name"], x["verse"], x["text"], x["relevance"], x["context"] if "context" in x else None) for x in rows]
        assert sorted(got.get(k, [])) == sorted(want), (kind, q)


def test_empty_index(session, tmp_path) -> None:
    none = session.createDataFrame([], "id int, text string")
    index = text_index.build(none, ["id"], "text", str(tmp_path / "none"))
    asked = session.createDataFrame([(1, "abc"), (2, "a"), (3, "")], "query_id int, query string")
    assert text_index.substring_search(index, asked).count() == 0


# -- words ----------------------------------------------------------------------------


def some_words(seed: int, n: int) -> list[str | None]:
    r = random.Random(seed)
    return [*("".join(r.choices("aabBcdé🙂", k=r.choice([0, 1, 2, 3, 5, 8]))) for _ in range(n)), None, "ab" * 500]


@pytest.mark.parametrize("most_roots", [0, word_joins.MOST_ROOTS])
def test_containment_either_way(session, most_roots: int) -> None:
    words, roots = some_words(1, 150), [w for w in some_words(2, 40) if w is None or len(w) < 100]
    own, theirs = ({w.lower() for w in x if w} for x in (words, roots))
    want = {(w, r) for w in own for r in theirs if w in r or r in w}
    got = word_joins.contained_either_way(session.createDataFrame([(w,) for w in words], "word string"), session.createDataFrame([(r,) for r in roots], "root string"), most_roots=most_roots).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def within_one(a: str, b: str) -> bool:
    a, b = sorted((a, b), key=len)
    return any((len(a) == len(b) and a[:i] + a[i + 1 :] == b[:i] + b[i + 1 :]) or (len(a) + 1 == len(b) and a == b[:i] + b[i + 1 :]) for i in range(len(b)))


def test_pairs_within_one_edit(session) -> None:
    r = random.Random(3)
    words = {w for w in some_words(4, 150) if w is not None}
    for length in range(22, 28):
        base = "".join(r.choices("abc", k=length))
        words |= {base, base + "x", base[1:], base[:10] + "y" + base[11:], "z" + base[:-1]}
    want = {(a, b) for a in words for b in words if a.encode() < b.encode() and within_one(a, b)}
    out = word_joins.pairs_within_one(session.createDataFrame([(w,) for w in [*words, None]], "word string"))
    got = out.collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", out._jdf.queryExecution().toString())
