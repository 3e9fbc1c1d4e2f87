"""The classifier's sample is drawn from the labelled rows, its rates from all documents."""

from __future__ import annotations

import numpy as np
import pytest

from folioscope.llm.op7_quality import classify, estimate, train
from tests.llm.test_op5_op8 import noisy


def test_few_labels_are_all_used(spark) -> None:
    docs, labels = noisy(3, 1200)
    test, truth = noisy(4, 400)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    given = spark.createDataFrame([x for x in labels if x[0] % 6 == 0], "doc_id long, quality int, toxic int")
    model = train(df, given, sample=210)
    got = {r["doc_id"]: r["keep"] for r in classify(spark.createDataFrame(test, "doc_id long, text string"), model).collect()}
    told = {i for i, t in test if "zoqu" in t}  # insults that only labels give away
    assert len(told) > 10 and sum(got[i] for i in told) <= 0.1 * len(told)
    assert sum(not got[i] for i, q, t in truth if q and not t) == 0


def test_counted_patterns_are_as_good_as_rows() -> None:
    r = np.random.default_rng(1)
    cast, given, times = r.integers(0, 3, (30, 3)).astype(np.int8), r.integers(0, 3, 30), r.integers(1, 9, 30)
    post, rates = estimate(cast, given, times=times)
    at = np.repeat(np.arange(30), times)
    each, same = estimate(cast[at], given[at])
    assert post[at] == pytest.approx(each) and rates == pytest.approx(same)
