"""Similarities within a block equal those of the sets, or of their least hashes where there are more."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

import folioscope.llm.near_copies as m


@pytest.mark.parametrize("size", [16, 256])
def test_similarities_of_a_block(monkeypatch: pytest.MonkeyPatch, size: int) -> None:
    monkeypatch.setattr(m, "SKETCH", size)
    r = np.random.default_rng(0)
    base = np.unique(r.integers(0, 2**32, 400))
    sets = [np.unique(np.concatenate([r.choice(base, r.integers(0, 300), replace=False), r.integers(0, 2**32, r.integers(0, 60))])).astype(np.int64) for _ in range(40)]
    cut, longer = [s[:size].astype("<u4") for s in sets], np.array([len(s) > size for s in sets])
    got = m._similarity(cut, longer)
    for i in range(40):
        for j in range(40):
            end = min([s[size - 1] for s, more in ((sets[i], longer[i]), (sets[j], longer[j])) if more], default=2**32)
            a, b = sets[i][sets[i] <= end], sets[j][sets[j] <= end]
            assert i == j or got[i, j] == pytest.approx(len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b))), abs=1e-6)


def test_blocks_keep_one_pair_for_two_roots() -> None:
    words = np.arange(100, dtype="<u4")
    near, far = words.copy(), words.copy()
    near[:5], far[:50] = near[:5] + 1000, far[:50] + 2000
    rows = [(1, 10, words), (2, 10, words), (3, 30, np.sort(near)), (4, 30, np.sort(near)), (5, 50, np.sort(far))]
    n = len(rows)
    table = pa.table({"key": [7] * n, "x": [0] * n, "y": [0] * n, "own": [0] * n, "same": [x[0] for x in rows], "root": [x[1] for x in rows], "longer": [False] * n, "sketch": pa.array([x[2].tobytes() for x in rows], pa.binary())})
    pairs = [tuple(p.values()) for p in m._alike(table).to_pylist()]
    assert len(pairs) == 1 and pairs[0][0] in (1, 2) and pairs[0][1] in (3, 4)
