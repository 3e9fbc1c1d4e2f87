"""The n-gram model holds all that was counted, whatever a part of the filter may take."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import folioscope.llm.op6_lm as op6


def scored(docs) -> list:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    return sorted(map(tuple, op6.score_documents(docs, held_out).collect()), key=str)


@pytest.mark.parametrize("group", [1, 4])
def test_scores_do_not_depend_on_the_way_of_the_filter(spark, docs, monkeypatch: pytest.MonkeyPatch, group: int) -> None:
    """Broadcast as one, or asked where its slices are; whatever the buckets and chunks."""
    whole = scored(docs)
    monkeypatch.setattr(op6, "GROUP", group)
    monkeypatch.setattr(op6, "FILTER_BYTES", 1024)
    routed = scored(docs)
    monkeypatch.setattr(op6, "CHUNK_BYTES", 5000)
    monkeypatch.setattr(op6, "FLUSH", 1000)
    chunked = scored(docs)
    for got in (routed, chunked):
        assert [r[:5] for r in got] == [r[:5] for r in whole]
        assert [r[5:] for r in got] == [pytest.approx(r[5:], rel=1e-9) for r in whole]


def test_every_count_comes_back_from_the_filter() -> None:
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(0, (1 << 64) - 1, 20_000, dtype=np.uint64))
    counts = np.where(r.random(len(keys)) < 0.5, 1, r.integers(1, 10_000, len(keys)))
    names = {b"w%d" % i: int(c) for i, c in enumerate(counts[:5000])} | {b"": 7}
    dealt = pa.Table.from_batches([op6._cells(op6.pair_cells(keys, counts, 3) + op6.word_cells(names, 3))])
    seen = 0
    for b in range(3):
        places = op6.placed(keys, 3)
        own = op6._bucket(places) == b
        part = dealt.filter(pa.array(np.asarray(dealt.column("bucket")) == b))
        for table, times in ((part, 1), (pa.concat_tables([part, part]), 2)):  # as from one task, and from two
            kinds = np.asarray(table.column("kind"))
            words = op6.merged_words(table.filter(pa.array(kinds == op6.WORDS)))
            assert all(c == times * names[t] for t, c in words.items())
            bits = op6.filled(words, table.filter(pa.array(kinds == op6.WORD_PAIRS)), 3)
            found = op6.asked(bits, 0, np.uint64(len(bits)), op6._salted(places[own], op6.WORD_PAIRS))
            want = op6.level_of(counts[own] * times) + 1
            assert (found >= want).all() and (found == want).mean() > 0.99
            other = op6.asked(bits, 0, np.uint64(len(bits)), op6._salted(places[own], op6.WORDS))
            assert (other == 0).mean() > 0.99
        seen += len(words)
    assert seen == len(names)


def test_pairs_seen_once_are_in(spark) -> None:
    training = spark.createDataFrame([(1, "a b c d"), (2, "b a d c")], "doc_id long, text string")
    seen, unseen = (spark.createDataFrame([(9, t)], "doc_id long, text string") for t in ("a b c d", "a c b d"))
    score = [op6.score_documents(training.unionByName(x), F.col("doc_id") == 9).filter("doc_id = 9").first()["score"] for x in (seen, unseen)]
    assert score[0] > score[1] + 0.1
