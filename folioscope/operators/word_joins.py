"""Joins of words by what they have in common: containment either way, and an edit distance of one.

Neither compares every word with every other.  Containment: a word holds a root
where an automaton of all roots finds it in one pass over the word; roots beyond
``MOST_ROOTS`` meet the parts of words that have some root's length instead, by an
equal join.  A root holds a word where one of its parts is the word, another equal
join.  Edit distance: two words within one edit share a string that is left when at
most one character is dropped from each; long words, whose such strings would be
too many, share their first or their last half.  What meets is checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.ranges import literal

MOST_ROOTS = 100_000  #: roots sent to every worker
MOST_ROOT_CHARS = 4_000_000
LONG = 24  #: characters from which words meet by halves


def _distinct(rows: DataFrame, column: str, name: str) -> DataFrame:
    return rows.select(F.lower(column).alias(name)).filter(F.col(name) != "").distinct()


@cache
def _automaton(roots: tuple[str, ...]):  # noqa: ANN202
    import ahocorasick

    out = ahocorasick.Automaton()
    for r in roots:
        out.add_word(r, r)
    out.make_automaton()
    return out


def parts(text: Column, lengths: list[int]) -> Column:
    """All parts of a text that have one of the lengths."""
    n = F.char_length(text)
    of_length = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(text, i, k))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(literal(lengths), lambda k: F.when(n >= k, of_length(k)).otherwise(none))))


def _holding(words: DataFrame, roots: DataFrame, most_roots: int) -> DataFrame:
    """Rows (word, root) of words that contain a root."""
    size = roots.agg(F.count("*"), F.coalesce(F.sum(F.char_length("root")), F.lit(0))).first()
    if size[0] <= most_roots and size[1] <= MOST_ROOT_CHARS:
        sent = words.sparkSession.sparkContext.broadcast(tuple(r["root"] for r in roots.collect()))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(sent.value) if sent.value else None
            for batch in batches:
                hits = [(w, r) for w in batch.column("word").to_pylist() for r in sorted({r for _, r in automaton.iter(w)})] if automaton else []
                yield pa.record_batch([pa.array([h[k] for h in hits], pa.string()) for k in (0, 1)], names=["word", "root"])

        return words.mapInArrow(find, "word string, root string")
    lengths = [r[0] for r in roots.select(F.char_length("root")).distinct().collect()]
    return words.select("word", F.explode(parts(F.col("word"), lengths)).alias("root")).join(roots, "root").select("word", "root")


def contained_either_way(words: DataFrame, roots: DataFrame, word: str = "word", root: str = "root", most_roots: int = MOST_ROOTS) -> DataFrame:
    """Rows (word, root), lower case, of which one contains the other; nulls and empty ones take no part, copies count once."""
    own, theirs = _distinct(words, word, "word"), _distinct(roots, root, "root")
    longest = theirs.agg(F.max(F.char_length("root"))).first()[0] or 0
    inside = theirs.select("root", F.explode(parts(F.col("root"), list(range(1, longest + 1)))).alias("word")).join(own, "word").select("word", "root")
    return _holding(own, theirs, most_roots).unionByName(inside).distinct()


def _keys(word: Column) -> Column:
    """Strings by which words within one edit of each other meet."""
    n = F.char_length(word)
    dropped = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == 0, word).otherwise(F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n))))

    def halves(k: Column) -> list[Column]:
        h = F.floor(k / 2).cast("int")
        return [F.concat(F.lit("\0p"), k, F.lit("\0"), F.substring(word, F.lit(1), h)), F.concat(F.lit("\0s"), k, F.lit("\0"), F.substring(word, n - (k - h) + 1, k - h))]

    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.when(n <= LONG, dropped).otherwise(none), F.when(n >= LONG, F.array(*halves(n), *halves(n - 1))).otherwise(none)))


def pairs_within_one(words: DataFrame, word: str = "word") -> DataFrame:
    """Rows (a, b), a before b, of distinct words an edit apart; nulls take no part."""
    own = words.select(F.col(word).alias("w")).filter("w is not null").distinct()
    keyed = own.select("w", F.explode(_keys(F.col("w"))).alias("key"))
    met = keyed.withColumnRenamed("w", "a").join(keyed.withColumnRenamed("w", "b"), "key").filter("a < b").filter(F.levenshtein("a", "b", 1) >= 0)
    return met.select("a", "b").distinct()
