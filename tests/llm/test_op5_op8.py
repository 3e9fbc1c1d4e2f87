"""Decontamination, LM scores, classifier and top-k search against brute force or held-out accuracy."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import folioscope.llm.op5_decontamination as op5
import folioscope.llm.op6_lm as op6
from folioscope.llm.op7_quality import classify, estimate, keep_good, train
from folioscope.llm.op8_topk import top_k
from folioscope.llm.words import PUNCTUATION, pieces
from tests.llm.conftest import SCHEMA, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def benchmark(seed: int = 1) -> tuple[list[tuple], list[tuple]]:
    r = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    words = common * 6 + [f"r{i}" for i in range(400)]
    items: list[tuple] = [(i, " ".join(r.choices(words, k=r.randrange(12, 45)))) for i in range(60)] + [(100, None), (101, ""), (102, "one two three"), (103, "?!")]
    docs: list[tuple] = [(i, " ".join(r.choices(words, k=r.randrange(5, 400)))) for i in range(60)]
    for i in range(40):
        w = r.choices(words, k=r.randrange(10, 300))
        leak = (items[r.randrange(60)][1] or "").split()
        if i % 4 == 1:
            leak = leak[: len(leak) // 2]  # no answer
        if i % 4 == 2:
            leak[r.randrange(len(leak))] = "changed"
        if i % 4 == 3:
            leak = [x.upper() + "###" for x in leak]
        at = r.randrange(len(w))
        docs.append((100 + i, " ".join(w[:at] + leak + w[at:])))
    docs += [(200, None), (201, ""), (202, "well: one, two... three!"), (None, items[0][1]), docs[61], docs[61]]
    return docs, items


def brute_leaks(docs: list[tuple], items: list[tuple], threshold: float, overlap: float) -> list[tuple]:
    bags = {}
    for i, t in items:
        if w := plain_words(t):
            cut = len(w) - max(5, len(w) // 4) if len(w) >= 10 else len(w)
            bags[i] = (w, w[:cut], w[cut:])
    n, mean = len(bags), sum(len(b[0]) for b in bags.values()) / len(bags)
    df = Counter(t for w, _, _ in bags.values() for t in set(w))

    def score(passage: set[str], w: list[str]) -> float:
        tf = Counter(w)
        return sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, c in tf.items() if t in passage)

    def share(passage: list[str], part: list[str]) -> float:
        k = min(5, len(part))
        s = {tuple(part[i : i + k]) for i in range(len(part) - k + 1)} if k else set()
        return len(s & {tuple(passage[i : i + k]) for i in range(len(passage) - k + 1)}) / len(s) if s else 1.0

    stride, out = max(len(b[0]) for b in bags.values()), []
    for d, t in docs:
        w = plain_words(t)
        for i, (b, q, a) in bags.items():
            best = [(score(set(p), b) / score(set(b), b), share(p, q), share(p, a), share(p, b)) for s in range(0, max(1, len(w) - stride), stride) for p in [w[s : s + 2 * stride]]]
            best = [x for x in best if x[0] >= threshold - 1e-9 and ((x[1] >= overlap and x[2] >= overlap) or x[3] >= overlap)]
            if best:
                out.append((d, i, *max(best)))
    return sorted(out, key=str)


def test_leaks_equal_brute_force(spark) -> None:
    docs, items = benchmark()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item", "2 as score", "3 as id").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 as q", "6 as a")
    want = brute_leaks(docs, items, op5.THRESHOLD, op5.OVERLAP)
    got = sorted(map(tuple, op5.leaks(df, it).collect()), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(want) > 20
    assert all(g[2:] == pytest.approx(w[2:]) for g, w in zip(got, want, strict=True))
    clean = op5.decontaminate(df, it)
    assert clean.columns == df.columns
    dirty = {w[0] for w in want}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(d) for d, _ in docs if d not in dirty)


def recall_by_edits(words: int) -> list[float]:
    """Share of items found when 0 to 3 of their words are changed anywhere, each item in a text of its own."""
    r = random.Random(words)
    vocabulary = [f"v{i}" for i in range(3_000)]
    items = [(i, r.choices(vocabulary, k=words), None) for i in range(100)]
    index = op5.build_index([(i, " ".join(w), None) for i, w, _ in items])
    out = []
    for edits in range(4):
        texts = []
        for _, w, _ in items:
            changed = list(w)
            for k in r.sample(range(words), edits):
                changed[k] = "changed"
            texts.append(" ".join([*r.choices(vocabulary, k=50), *changed, *r.choices(vocabulary, k=50)]))
        found = {(f[0], f[1]) for f in op5.find_leaks(pa.array(texts), index, op5.THRESHOLD, op5.OVERLAP)}
        assert all(text == item for text, item in found)
        out.append(len(found) / len(items))
    return out


@pytest.mark.parametrize(("words", "least"), [(37, [1.0, 1.0, 0.1, 0.0]), (60, [1.0, 1.0, 1.0, 0.1]), (100, [1.0, 1.0, 1.0, 1.0])])
def test_recall_by_changed_words(words: int, least: list[float]) -> None:
    assert all(got >= want for got, want in zip(recall_by_edits(words), least, strict=True))


def test_retrieval_loses_nothing_at_any_threshold() -> None:
    docs, items = benchmark(7)
    index = op5.build_index([(i, t, None) for i, t in items])
    assert index is not None and (~index.rare).any() and index.rare.any()
    dense = np.zeros((len(index.terms), len(index.ids)))
    dense[np.repeat(np.arange(len(index.terms)), np.diff(index.first)), index.items] = index.impacts
    for threshold in (0.1, 0.3, 0.6):
        for piece in pieces(pa.array([t or "" for _, t in docs]), True, PUNCTUATION):
            hashes = piece.hashes()
            p, i, s, _ = op5.retrieve(piece, hashes, index, threshold)
            passage, term, _ = op5._passages(piece, hashes, index)
            want = {}
            for g in np.unique(passage):
                total = dense[term[passage == g]].sum(0)
                want |= {(int(g), int(k)): total[k] for k in np.flatnonzero(total >= threshold - 1e-9)}
            assert dict(zip(zip(p.tolist(), i.tolist(), strict=True), s.tolist(), strict=True)) == pytest.approx(want)


def test_item_blocks_cover_all_items(spark, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(op5, "BLOCK_ITEMS", 10)
    docs, items = benchmark()
    got = op5.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), threshold=0.0)
    want = {(i + 100, items[k][0]) for i in range(0, 40, 4) for k in range(60) if (items[k][1] or "") in (docs[60 + i][1] or "")}
    assert want <= {(r["doc_id"], r["item_id"]) for r in got.collect()}


@pytest.mark.parametrize(("threshold", "overlap"), [(0.6, 0.5), (0.3, 0.3)])
def test_item_blocks_change_no_score(spark, monkeypatch: pytest.MonkeyPatch, threshold: float, overlap: float) -> None:
    docs, items = benchmark()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    want = brute_leaks(docs, items, threshold, overlap)
    assert sum(w[2] < 0.99 for w in want) >= 4  # partly leaked items, whose scores depend on the statistics
    for size in (1000, 25, 7):
        monkeypatch.setattr(op5, "BLOCK_ITEMS", size)
        got = sorted(map(tuple, op5.leaks(df, it, threshold, overlap).collect()), key=str)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(g[2:] == pytest.approx(w[2:]) for g, w in zip(got, want, strict=True))
        dirty = {str(w[0]) for w in want}
        assert sorted(str(r["doc_id"]) for r in op5.decontaminate(df, it, threshold, overlap).collect()) == sorted(str(d) for d, _ in docs if str(d) not in dirty)


def lower(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("filter_bytes", [op6.FILTER_BYTES, 3])
def test_base_scores_equal_brute_force(spark, docs, monkeypatch: pytest.MonkeyPatch, filter_bytes: int) -> None:
    monkeypatch.setattr(op6, "FILTER_BYTES", filter_bytes)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    data = rows()
    counts: Counter = Counter()
    pairs: Counter = Counter()
    for i, t, *_ in data:
        if not held(i):
            w = [*lower(t), None]
            counts.update(w)
            pairs.update(zip(["<", *w], w, strict=False))
    counts["<"] = counts[None]
    n, v = sum(c for w, c in counts.items() if w != "<"), len(counts) - 1
    d = n + 0.5 * (v + 1)
    value = op6.count_at()

    def seen(c: int) -> float:
        return value[int(op6.level_of(np.array([c]))[0]) + 1] if c else 0.0

    def scores(t: str | None) -> tuple[float, float]:
        w = [*lower(t), None]
        base = sum(math.log10((counts[x] + 0.5) / d) for x in w)
        model = 0.0
        for a, b in zip(["<", *w], w, strict=False):
            p = (1 - op6.PAIRS) * (seen(counts[b]) + 0.5) / d
            if counts[a]:
                p += op6.PAIRS * min(1.0, seen(pairs[a, b]) / seen(counts[a]))
            model += math.log10(p)
        return base, model

    got = sorted(map(tuple, op6.score_documents(docs, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1).collect()), key=str)
    want = sorted(((i, held(i), len(lower(t)) + 1, sum(counts[x] > 0 for x in [*lower(t), None]), n, *scores(t)) for i, t, *_ in data), key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[:5]), r[5])), sorted(want, key=lambda r: (str(r[:5]), r[5])), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5])
        assert g[6] == pytest.approx(w[6], rel=0.02)  # a probe is wrong three times in a thousand


def noisy(seed: int, n: int) -> tuple[list[tuple], list[tuple]]:
    """Documents of which some are junk and some hold insults that only labels give away."""
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("tar", "mul", "lin", "ve") for b in ("sa", "ni", "ro", "que") for c in ("", "n", "st", "le")]
    docs, labels = [], []
    for i in range(n):
        w = r.choices(words, k=r.randrange(20, 150))
        bad = toxic = 0
        kind = r.random()
        if kind < 0.12:
            w, bad = [x + r.choice(["***", "&&&", "$$$"]) for x in w], 1
        elif kind < 0.2:
            w, bad = [x.upper() + "!!" for x in w], 1
        elif kind < 0.27:
            w, bad = [w[0]] * 60, 1
        elif kind < 0.35:
            w.insert(r.randrange(len(w)), r.choice(["idiot", "Stupid,"]))
            toxic = 1
        elif kind < 0.43:
            w.insert(r.randrange(len(w)), "zoqu" + r.choice(words))
            toxic = 1
        docs.append((i, " ".join(w)))
        labels.append((i, 1 - bad, toxic))
    return docs, labels


def test_classifier_on_held_out_documents(spark) -> None:
    docs, labels = noisy(3, 1200)
    test, truth = noisy(4, 800)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    given = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, quality int, toxic int").unionByName(spark.createDataFrame([(None, None, None), (1, None, None), (5000, 1, 0)], "doc_id long, quality int, toxic int"))
    model = train(df, given)
    edge = spark.createDataFrame([*test, (900, None), (901, ""), (None, "one")], "doc_id long, text string").selectExpr("*", "1 as score", "2 as keep", "3 as id")
    got = {r["doc_id"]: r["keep"] for r in classify(edge, model).collect()}
    assert got[900] and got[901] and got[None] and len(got) == 803
    bad = {i for i, q, t in truth if not q or t}
    assert sum(not got[i] for i, _, _ in truth if i not in bad) == 0
    assert sum(got[i] for i in bad) <= 0.03 * len(bad)
    kept = keep_good(edge, model)
    assert kept.columns == edge.columns and {r["doc_id"] for r in kept.collect()} == {i for i, k in got.items() if k}
    alone = train(df, None)
    junk = {i for i, q, _ in truth if not q}
    assert sum(r["keep"] for r in classify(edge, alone).collect() if r["doc_id"] in junk) <= 0.05 * len(junk)


def test_em_finds_the_rates_of_labellers() -> None:
    r = np.random.default_rng(0)
    truth = r.random(4000) < 0.25
    accuracy = [0.95, 0.8, 0.7, 0.9]
    cast = np.stack([np.where(r.random(4000) < 0.3, 2, np.where(r.random(4000) < a, truth, ~truth)) for a in accuracy], 1).astype(np.int8)
    post, rates = estimate(cast, pseudo=0.0)
    assert ((post > 0.5) == truth).mean() > 0.93
    for j, a in enumerate(accuracy):
        assert rates[0, j, 0] / rates[0, j, :2].sum() == pytest.approx(a, abs=0.04)


def test_classifier_on_empty_tables(spark, no_docs) -> None:
    model = train(no_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert classify(no_docs, model).count() == 0


def vectors(seed: int) -> list[tuple]:
    r = random.Random(seed)
    out: list[tuple] = [(i, [r.gauss(0, 1 + i % 3) for _ in range(6)]) for i in range(900)]
    out += [(1000 + i, [0.5, 0.25, -1.0, 0.0, 0.1, 2.0]) for i in range(300)]  # ties
    out += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (2100, [9.0, 9.0]), (2200, []), (5, [1.0] * 6)]
    return out


@pytest.mark.parametrize("annulus", [4096, 40])
def test_top_k_equals_brute_force(spark, monkeypatch: pytest.MonkeyPatch, annulus: int) -> None:
    import folioscope.llm.op8_topk as m

    monkeypatch.setattr(m, "ANNULUS", annulus)
    monkeypatch.setattr(m, "QUERY_BLOCK", 7)
    data = vectors(5)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("*", "1 as v", "2 as score", "3 as annulus").repartition(4)
    got = sorted(map(tuple, top_k(df, F.pmod("vec_id", F.lit(100)) == 0).collect()))
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in sorted(x for x in good if x[0] % 100 == 0):
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:10])]
    assert got == sorted(want)


def test_few_vectors(spark) -> None:
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k(few, F.col("vec_id") == 0).collect())) == [(0, 1, 2, 3072 * 1024), (0, 2, 1, 2048 * 1024)]
    assert top_k(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_empty(spark, no_docs) -> None:
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert op5.leaks(no_docs, items).count() == 0
    assert op5.leaks(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).count() == 0
    assert op6.score_documents(no_docs, F.lit(False)).count() == 0
