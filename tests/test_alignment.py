"""Alignment of batches against the rules told one step at a time."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.functions.align import MOST_TOKENS, aligned, near, walk


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def plain(listed: list[str], tokens: list[str], most: int) -> list[tuple[int, list[int], str]]:
    alike = lambda a, b: distance(a, b) <= most
    out: list = []
    k = at = 0
    while k < len(listed):
        rest = tokens[at:]
        if not rest:
            out.append((k, [], "fallback"))
        elif alike(listed[k], rest[0]):
            out.append((k, [at], "direct"))
            at += 1
        elif k + 1 < len(listed) and rest[0] != listed[k] and rest[0].startswith(listed[k]) and alike(rest[0][len(listed[k]) :], listed[k + 1]):
            out += [(k, [at], "join"), (k + 1, [at], "join")]
            k, at = k + 1, at + 1
        else:
            for n in range(1, min(MOST_TOKENS, len(rest)) + 1):
                text = "".join(rest[:n])
                if alike(listed[k], text):
                    out.append((k, list(range(at, at + n)), "split"))
                    at += n
                    break
                if len(text) > len(listed[k]) + most + 2:
                    n = MOST_TOKENS
                    break
            if not out or out[-1][0] != k:
                out.append((k, [at], "fallback"))
                at += 1
        k += 1
    return out


WORDS = st.lists(st.text("ab", max_size=5), max_size=12)


@given(WORDS, WORDS, st.integers(0, 2))
@settings(max_examples=500, deadline=None)
def test_walk_follows_the_rules(listed: list[str], tokens: list[str], most: int) -> None:
    assert walk(listed, tokens, most) == plain(listed, tokens, most)


@given(st.text("abc", max_size=8), st.text("abc", max_size=8), st.integers(0, 3))
@settings(max_examples=500, deadline=None)
def test_near_is_a_bounded_distance(a: str, b: str, most: int) -> None:
    assert near(a, b, most) == (distance(a, b) <= most)


@pytest.mark.parametrize("seed", [1, 2])
def test_a_batch_is_aligned_as_its_verses_are(seed: int) -> None:
    r = random.Random(seed)
    pairs: list = [(None, ["a"]), (["a"], None), ([], []), (["a", "b"], ["a"]), (["a"], ["a", "b"])]
    for _ in range(300):
        words = ["".join(r.choices("abcde", k=r.randrange(1, 7))) for _ in range(r.randrange(0, 40))]
        tokens, i = [], 0
        while i < len(words):
            kind = r.choice(["same"] * 8 + ["join", "split", "typo", "lost", "more"])
            tokens += {"same": [words[i]], "join": ["".join(words[i : i + 2])], "split": [words[i][:2], words[i][2:]], "typo": [words[i][:-1] + "z"], "lost": [], "more": [words[i], "qq"]}[kind]
            i += 1 + (kind == "join")
        pairs.append((words, [x for x in tokens if x]))
    kind = pa.list_(pa.string())
    for cut in (0, 7):
        own = pairs[cut:]
        a, b = (pa.array([p[k] for p in pairs], kind).slice(cut) for k in (0, 1))
        got = [[(e["index"], e["tokens"], e["match"]) for e in verse] for verse in aligned(a, b).to_pylist()]
        assert got == [plain(x or [], y or [], 1) for x, y in own]
