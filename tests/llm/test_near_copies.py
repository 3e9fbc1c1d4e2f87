"""The near-dedup stage finds every pair of Jaccard similarity 0.8 or more, and no other."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as p
from folioscope.llm import near_copies
from folioscope.llm.op10_simhash import fingerprints_of
from tests.llm.conftest import SCHEMA


def shingles(text: str) -> frozenset:
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_edited_copies_are_found_and_others_kept(spark) -> None:
    r, texts = random.Random(5), []
    for k in range(40):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(60, 300))]
        edited = list(words)
        for at in range(7, len(words), 60 if k % 2 else 17):  # about 0.85, and about 0.55
            edited[at] = "changed"
        texts += [" ".join(words), " ".join(edited)]
    texts += [texts[0].upper(), "one two", "One  two", "one three", "", " "]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(500, None, None, None, None), (3, texts[3], "en", "s", 1)]
    sets, root = {i: shingles(t or "") for i, t, *_ in rows}, {}
    for i in sorted(sets):
        near = {root[j] for j in root if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
        root[i] = min(near, default=i)
        root.update({j: root[i] for j in root if root[j] in near})
    got = p.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), "")
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(x["doc_id"] for x in got.collect()) == sorted(set(root.values()))
    assert 15 <= sum(root[i + 1] == i for i in range(0, 80, 2)) <= 25


def test_simhash_alone_brings_near_copies_together(spark, monkeypatch) -> None:
    """Without MinHash keys, pairs within four bits are still found, and those that are not similar are not."""
    r, texts = random.Random(6), []
    for _ in range(60):
        words = [f"w{r.randrange(10**6)}" for _ in range(400)]
        edited = list(words)
        edited[200] = "changed"
        texts += [" ".join(words), " ".join(edited)]
    fps = fingerprints_of(pa.array(texts), 5)
    close = [k for k in range(0, 120, 2) if bin((fps[k] ^ fps[k + 1]) & (2**64 - 1)).count("1") <= 4]
    assert len(close) > 20
    plain = near_copies.signatures
    monkeypatch.setattr(near_copies, "signatures", lambda *a: plain(*a).withColumn("keys", F.slice("keys", 1, 0)))
    got = p.near_dedup(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(4), "")
    assert {x["doc_id"] for x in got.collect()} == set(range(120)) - {k + 1 for k in close}


def test_plans_of_freed_rows_are_let_go(spark) -> None:
    from folioscope.llm import common

    common.release()
    for k in range(3):
        common.hold(spark.range(10 + k)).count()
    assert len(common._held) == 3
    spark.catalog.clearCache()
    again = common.hold(spark.range(20))
    assert common._held == [again]
    common.release()
