"""Expectation-maximisation and the scorer against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm.op7_quality import BITS, KEEP, NONE, REJECT, Model, estimate, features, votes
from folioscope.llm.words import pieces


def plain_em(cast: list[tuple], given: list[int], times: list[int], prior: float, pseudo: float, rounds: int) -> list[float]:
    open_rows = sum(t for t, g in zip(times, given, strict=True) if g == NONE)
    scale = max(1.0, open_rows / (sum(times) - open_rows + pseudo))
    times = [t if g == NONE else t * scale for t, g in zip(times, given, strict=True)]
    pseudo, total = pseudo * scale, sum(times)
    post = [(0.98 if g == REJECT else 0.02) if g != NONE else 0.8 if REJECT in c else prior / 4 for c, g in zip(cast, given, strict=True)]
    for _ in range(rounds):
        rates = []
        for y in (0, 1):
            of_class = [t * (p if y else 1 - p) for p, t in zip(post, times, strict=True)]
            rates.append([])
            for j in range(len(cast[0])):
                seen = {v: sum(w for w, c in zip(of_class, cast, strict=True) if c[j] == v) + (([0.95, 0.005, 0.045], [0.65, 0.25, 0.1])[y][(KEEP, REJECT, NONE).index(v)] * pseudo + 0.01) for v in (KEEP, REJECT, NONE)}
                rates[y].append({v: n / sum(seen.values()) for v, n in seen.items()})
        share = min(0.95, max(0.005, (sum(p * t for p, t in zip(post, times, strict=True)) + pseudo * prior) / (total + pseudo)))
        for i, (c, g) in enumerate(zip(cast, given, strict=True)):
            if g == NONE:
                good, bad = ((1 - share, share)[y] * math.prod(rates[y][j][v] for j, v in enumerate(c)) for y in (0, 1))
                post[i] = bad / (good + bad)
    return post


@pytest.mark.parametrize(("prior", "pseudo", "labelled"), [(0.2, 20.0, 0.4), (0.05, 1.0, 0.1), (0.3, 5.0, 0.0)])
def test_em_equals_plain_loops(prior: float, pseudo: float, labelled: float) -> None:
    r = random.Random(5)
    cast = [tuple(r.choice((KEEP, KEEP, REJECT, NONE)) for _ in range(3)) for _ in range(40)]
    given = [r.choice((KEEP, REJECT)) if r.random() < labelled else NONE for _ in cast]
    times = [r.randrange(1, 9) for _ in cast]
    want = plain_em(cast, given, times, prior, pseudo, 12)
    got, _ = estimate(np.array(cast, np.int8), np.array(given, np.int8), prior, pseudo, 12, np.array(times))
    assert got == pytest.approx(want, abs=2e-6)
    rows = [i for i, t in enumerate(times) for _ in range(t)]
    whole, _ = estimate(np.array([cast[i] for i in rows], np.int8), np.array([given[i] for i in rows], np.int8), prior, pseudo, 12)
    assert whole == pytest.approx([got[i] for i in rows], abs=2e-6)


def test_scores_of_a_batch_equal_those_of_single_texts() -> None:
    r = np.random.default_rng(2)
    model = Model(np.where(r.random(1 << BITS) < 0.5, r.random(1 << BITS), 0.0), -1.5, {})
    texts = ["some plain words", None, "", "idiot!! *** $$$", "A B C D E " * 4000, "some plain words", "  \n", "é ü"]
    got = model.scores(pa.array(texts))
    for text, score in zip(texts, got, strict=True):
        piece = next(pieces(pa.array([text or ""]), False))
        _, found = features(piece, votes(piece))
        assert score == pytest.approx(-1.5 + sum(model.weights[f] for f in set(found.tolist())))


def test_labels_decide_however_many_documents_there_are() -> None:
    r = random.Random(7)

    def row(bad: bool) -> tuple:
        fault = r.randrange(4) if bad else -1
        return tuple(REJECT if j == fault or r.random() < 0.01 else KEEP for j in range(4))

    truth = [i % 5 == 0 for i in range(400)]
    labelled = [row(b) for b in truth]
    for unlabelled in (0, 400, 40_000):
        more = [row(i % 5 == 0) for i in range(400)]
        cast = np.array(labelled + more * bool(unlabelled), np.int8)
        given = np.array([REJECT if b else KEEP for b in truth] + [NONE] * (len(cast) - 400))
        times = np.array([1] * 400 + [max(1, unlabelled // 400)] * (len(cast) - 400))
        _, rates = estimate(cast, given, times=times)
        assert (rates[0][:, REJECT] < 0.05).all() and (np.abs(rates[1][:, REJECT] - 0.25) < 0.12).all()
