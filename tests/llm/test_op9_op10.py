"""Substring dedup and SimHash against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash

from folioscope.llm.op9_substrings import dedup_substrings
from folioscope.llm.op10_simhash import hex_of, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed: int) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    words = [f"w{i}é" for i in range(40)] + ["The", "the", " x"]
    passages = [[r.choice(words) for _ in range(n)] for n in (50, 51, 70, 120, 49)]
    docs: list[tuple[int | None, str | None]] = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "a " * 300), (1004, "a " * 120), (None, "a " * 60)]
    for i in range(120):
        parts = [[r.choice(words) for _ in range(r.randrange(0, 90))]]
        for _ in range(r.randrange(3)):
            parts += [r.choice(passages), [r.choice(words) for _ in range(r.randrange(30))]]
        docs.append((i, r.choice([" ", "\n", "  \t"]).join(w for p in parts for w in p)))
    docs += [(200 + i, docs[10 + i % 4][1]) for i in range(12)]
    docs += [docs[20], docs[20]]
    tail = [f"t{r.randrange(10**6)}" for _ in range(300)]
    for i in range(20):  # near copies
        w = (docs[40][1] or "").split() + tail
        docs.append((400 + i, " ".join([*w[:100], f"n{i}", *w[101:]])))
    r.shuffle(docs)
    return docs


def removed(docs: list[tuple[int | None, str | None]], length: int) -> list[tuple]:
    last = 1 << 62
    first: dict[tuple, int] = {}
    split = [(last if i is None else i, WORD.findall(t or "")) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            first[g] = min(first.get(g, last), i)
    out = []
    for (i, w), (own, _) in zip(split, docs, strict=True):
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((own, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [50, 7])
def test_removed_words_equal_brute_force(spark, length: int) -> None:
    docs = corpus(length)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as uid", "2 as flags", "3 as id").repartition(5)
    got = dedup_substrings(df, length).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == removed(docs, length)


def test_small_flushes_change_nothing(spark, monkeypatch: pytest.MonkeyPatch) -> None:
    import folioscope.llm.op9_substrings as m

    monkeypatch.setattr(m, "FILTER_BYTES", 1 << 10)  # a full filter: every window goes on
    docs = corpus(3)
    got = dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"), 50).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == removed(docs, 50)


def fingerprint(text: str | None) -> int:
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_components_equal_brute_force(spark) -> None:
    docs = corpus(11)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as node").repartition(5)
    got = near_duplicates(df).select("doc_id", hex_of_column(), "component_id").collect()
    prints = [(i, fingerprint(t)) for i, t in docs]
    root = {f: f for _, f in prints}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    keys = list(root)
    for a in keys:
        for b in keys:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    want = [(i, f"{f:016x}", least.get(find(f))) for i, f in prints]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len({c for _, _, c in want}) < len({f for _, f in prints}) - 10


def hex_of_column():
    from pyspark.sql import functions as F

    return hex_of(F.col("fp")).alias("fingerprint")


def test_links_lose_none_at_any_four_bits(spark) -> None:
    """Every pattern of up to four flipped bits, drawn at random, is linked, and five bits are not."""
    from folioscope.llm.op10_simhash import links

    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(60)]
    want, all_ = set(), set(base)
    for b in base:
        for n in (1, 2, 3, 4, 5):
            x = b
            for bit in r.sample(range(64), n):
                x ^= 1 << bit
            all_.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    every = [signed(x) for x in all_]
    for a in every:
        for b in every:
            if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4:
                want.add((a, b))
    got = {tuple(x) for x in links(spark.createDataFrame([(x,) for x in every], "fp long")).collect()}
    assert got == want and len(want) >= 240


def test_empty_tables(spark) -> None:
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_substrings(empty).count() == 0
    assert near_duplicates(empty).count() == 0
