"""Aligns the words of a list with the tokens of a text, a batch of verses at a time.

``walk`` says what an alignment is: a cursor in each list, and four ways to go on.
``aligned`` gives the same for a batch, on flat Arrow buffers.  Words become
numbers, so that equal words are equal numbers.  Up to the first place where the
lists differ every word meets its token, which one comparison of the buffers finds
for all verses; only verses that differ are walked from there, over numbers, and
strings are looked at where numbers differ, once for each pair of words.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import matching_form
from folioscope.shipping import ship

SCHEMA = "array<struct<index:int,tokens:array<int>,match:string>>"
MOST_TOKENS = 5
MATCHES = ("fallback", "direct", "join", "split")


def near(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is ``most`` or less; only a band around the diagonal is looked at."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    if most == 1:
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return a[i + (len(a) == len(b)) :] == b[i + 1 :]
    row, far = list(range(len(b) + 1)), most + 1
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        new = [far] * (len(b) + 1)
        new[0] = i
        for j in range(low, high + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
        row = new
    return row[len(b)] <= most


def walk(listed: list[str], tokens: list[str], most: int = 1) -> list[tuple[int, list[int], str]]:
    """An entry (index, token numbers, match) for each listed word, both sides in matching form.

    Tried in turn: one token for the word (direct); one token for this and the
    next word (join); up to five tokens for the word (split); else the next
    token is taken as it is (fallback).  When tokens run out, words have none.
    """
    words = dict.fromkeys([*listed, *tokens])
    number = {w: i for i, w in enumerate(words)}
    found = _walked([number[w] for w in listed], [number[t] for t in tokens], list(words), 0, _memory(list(words), most), most)
    return [(k, list(range(first, first + n)), MATCHES[match]) for k, (first, n, match) in enumerate(found)]


def _memory(words: list[str], most: int) -> Callable[[int, int], bool]:
    """Whether two numbered words are near, worked out once for each pair."""
    known: dict[tuple[int, int], bool] = {}

    def close(a: int, b: int) -> bool:
        if (a, b) not in known:
            known[a, b] = near(words[a], words[b], most)
        return known[a, b]

    return close


def _walked(listed: list[int], tokens: list[int], words: list[str], at: int, close: Callable[[int, int], bool], most: int) -> list[tuple[int, int, int]]:
    """(first token, number of tokens, match) of each listed word from place ``at`` on, which both cursors have."""
    out: list[tuple[int, int, int]] = []
    k, n, m = at, len(listed), len(tokens)
    while k < n and at < m:
        a, b = listed[k], tokens[at]
        if a == b or close(a, b):
            out.append((at, 1, 1))
            k, at = k + 1, at + 1
            continue
        word, token = words[a], words[b]
        if k + 1 < n and len(token) > len(word) and token.startswith(word) and near(token[len(word) :], words[listed[k + 1]], most):
            out += [(at, 1, 2), (at, 1, 2)]
            k, at = k + 2, at + 1
            continue
        joined, end, met = "", at, False
        while end < min(m, at + MOST_TOKENS):
            joined += words[tokens[end]]
            end += 1
            met = near(word, joined, most)
            if met or len(joined) > len(word) + most + 2:
                break
        out.append((at, end - at, 3) if met else (at, 1, 0))
        k, at = k + 1, end if met else at + 1
    return out + [(at, 0, 0)] * (n - k)


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The elements of lists without nulls around them, and where each list begins."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def aligned(listed: pa.ListArray, tokens: pa.ListArray, most: int = 1) -> pa.ListArray:
    """``walk`` for a batch of verses; a null list is empty, a null word is the empty word."""
    (left, starts), (right, begins) = _flat(listed), _flat(tokens)
    coded = pa.concat_arrays([left, right]).fill_null("").dictionary_encode()
    numbers, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    a, b = numbers[: len(left)], numbers[len(left) :]
    n, m = np.diff(starts), np.diff(begins)
    both = np.minimum(n, m)
    within = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
    differ = a[np.repeat(starts[:-1], both) + within] != b[np.repeat(begins[:-1], both) + within]
    verse = np.repeat(np.arange(len(n)), both)[differ]
    alike = both.copy()  # words before the first difference
    np.minimum.at(alike, verse, within[differ])
    index = np.arange(len(a)) - np.repeat(starts[:-1], n)
    direct = index < np.repeat(alike, n)
    first, count, match = np.where(direct, index, 0), direct.astype(np.int64), direct.astype(np.int64)
    close = _memory(words, most)
    for v in np.unique(verse):
        at = int(alike[v])
        found = _walked(a[starts[v] : starts[v + 1]].tolist(), b[begins[v] : begins[v + 1]].tolist(), words, at, close, most)
        first[starts[v] + at : starts[v + 1]], count[starts[v] + at : starts[v + 1]], match[starts[v] + at : starts[v + 1]] = np.array(found, np.int64).T
    ends = np.concatenate([[0], np.cumsum(count)])
    taken = np.repeat(first - ends[:-1], count) + np.arange(ends[-1])
    own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(taken, pa.int32()))
    entry = pa.StructArray.from_arrays([pa.array(index, pa.int32()), own, pa.array(MATCHES).take(pa.array(match))], ["index", "tokens", "match"])
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), entry)


def align(listed: Column, tokens: Column, most: int = 1) -> Column:
    """Array of (index, tokens, match) from an array of listed words and one of word tokens."""
    if session := SparkSession.getActiveSession():
        ship(session)

    @F.arrow_udf(SCHEMA)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return aligned(a, b, most)

    return run(F.transform(listed, matching_form), F.transform(tokens, matching_form))
