"""Scores of large components are exact, and refused where they can't be held."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from folioscope.llm.op8_topk import top_k


@pytest.mark.parametrize("size", [2.0**17, 1e6])
def test_scores_beyond_floating_point(spark, size: float) -> None:
    r = random.Random(2)
    data = [(i, [r.uniform(-size, size) for _ in range(4)]) for i in range(220)]
    got = sorted(map(tuple, top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.pmod("vec_id", F.lit(100)) == 0).collect()))
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in data}
    want = []
    for q in (0, 100, 200):
        best = sorted((-sum(x * y for x, y in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want) and max(abs(w[3]) for w in want) > 2**53


@pytest.mark.parametrize("sizes", [[3.0e6], [1e9], [1e300, 1e308], [-1e300, 3.0e6, 1e9]])
def test_large_vectors_spoil_nothing(spark, sizes: list[float]) -> None:
    """Some large vectors among small ones, one of them a query: every score is exact, those beyond 64 bits are held at its edge."""
    r = random.Random(4)
    data = [(i, [r.uniform(-1, 1) for _ in range(2)]) for i in range(1, 300)]
    data += [(1000 + k, [s, 0.5]) for k, s in enumerate(sizes)] + [(400, [0.25, sizes[0]]), (400, [0.25, 0.5]), (500, None), (600, [math.inf, 1.0])]
    got = sorted(map(tuple, top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3), F.pmod("vec_id", F.lit(100)) == 0).collect()))
    whole = [(i, [math.floor(1024 * x) if math.isfinite(1024 * x) else 1024 * int(x) for x in v]) for i, v in data if v and all(map(math.isfinite, v))]
    want = []
    for q in sorted({i for i, _ in whole if i % 100 == 0}):
        own = min(v for i, v in whole if i == q)
        best = sorted((-sum(x * y for x, y in zip(own, v, strict=True)), i) for i, v in whole if i != q)[:10]
        want += [(q, k + 1, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    spark.catalog.clearCache()
