"""How far the sources of a language lie apart: chi-square divergences of their terms, exact.

A term is a run of letters; only A-Z are lower-cased.  Each language keeps the V
terms of at least ``LEAST_DOCS`` of its documents.  In a group (a source of a
language, or the language) a kept term with count c has the weight
p = 1 + floor(SCALE * (c + 1) / (N + V)), N the sum of c over kept terms, and two
weights differ by f(p, q) = floor((p - q)**2 / q).

A pair of groups sums f over all V terms, but most terms are in neither.  So the
sum is taken apart by supports.  Terms in neither group all cost f(p0, q0), p0
and q0 the weights of count 0: a constant times their number.  Terms of one group
alone are priced from its histogram of counts, a few rows however many terms
there are, as if the other group had none of them.  Terms of both groups are
then found by joining postings on the term, and each puts its own f in the place
of what the other two parts have charged for it.  Sums are decimals.

Postings come from one pass over the texts, cut and added up by numpy, a few
megabytes at a time, before Spark adds them up and shuffles them.  A term's postings are one for each source at most; groups are joined to them by
broadcast where a count shows that they are few, else by a join that Spark can
split.  Partial sums for pairs are added up before they are shuffled.

Defined cases: null texts, languages and sources read as empty; a group without
terms has N = 0 and takes part; a language without kept terms has V = 0, values
0 and p = q = 1 + floor(SCALE / 1) never used; rows that repeat are documents of
their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import hold, small
from folioscope.llm.words import Piece, mix64, owners_of, pieces
from folioscope.shipping import ship

#: Bytes between terms, the complement of [^\x00-\x40\x5B-\x60\x7B-\x7F]; all of a multi-byte character belongs to a term.
BETWEEN = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
LEAST_DOCS = 3
SCALE = 1_000_000_000
MOST_TERMS = 200  #: ranks of terms that are told of each group
LANES = 32  #: by which a group's terms are ranked before they meet
TOKENS = 1 << 20  #: terms of texts that are added up at a time, or those of one piece, if more
_EXACT = "decimal(38,0)"


def _eights(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k to 8k + 7 of each term as one number, those beyond its end zero; ``data`` has eight bytes more than the texts."""
    every = np.lib.stride_tricks.as_strided(data.view(np.uint8)[:8].view("<u8"), (len(data) - 7,), (1,))
    left = np.minimum(ends - starts - 8 * k, 8).astype(np.uint64)
    return every[starts + 8 * k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))


def added_up(found: list[Piece], group_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of consecutive pieces: bytes and offsets of each group's distinct terms, their groups, occurrences and texts.

    Terms are sorted by a hash of their bytes and group; each is then compared with the first of its hash.
    """
    base = np.cumsum([0] + [len(p.data) for p in found])
    data = np.concatenate([p.data for p in found] + [np.zeros(8, np.uint8)])
    starts, ends = (np.concatenate([getattr(p, x) + at for p, at in zip(found, base, strict=False)]) for x in ("starts", "ends"))
    row = np.concatenate([owners_of(p.counts) + p.first for p in found])
    group, size = group_of[row], ends - starts
    parts = []  # (terms with more than 8k bytes, their bytes from there)
    some, key = np.arange(len(starts)), mix64(group.astype(np.uint64), 46)
    while len(some):
        part = _eights(data, starts[some], ends[some], len(parts))
        key[some] = mix64(key[some] ^ part, 47)
        parts.append((some, part))
        some = some[size[some] > 8 * len(parts)]
    order = np.argsort(key, kind="stable")
    key, own = key[order], row[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(key)))
    one = np.empty(len(order), np.int64)  # of each term, the first of its hash
    one[order] = np.repeat(order[first], n)
    alike = (group == group[one]).all() and (size == size[one]).all()
    for some, part in parts if alike else []:
        whole = np.zeros(len(order), np.uint64)
        whole[some] = part
        alike = alike and (part == whole[one[some]]).all()
    if not alike:  # two terms of one hash
        return _plainly(data, starts, ends, group, row)
    texts = np.add.reduceat(np.append(True, own[1:] != own[:-1])[: len(own)] | new, first, dtype=np.int64) if len(first) else first
    at = order[first]
    offsets = np.concatenate(([0], np.cumsum(size[at])))
    return data[np.repeat(starts[at] - offsets[:-1], size[at]) + np.arange(offsets[-1])], offsets, group[at], n, texts


def _plainly(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same without hashes."""
    n: dict[tuple[int, bytes], int] = {}
    having: dict[tuple[int, bytes], int] = {}
    last: dict[tuple[int, bytes], int] = {}
    for a, b, g, r in zip(starts.tolist(), ends.tolist(), group.tolist(), row.tolist(), strict=True):
        key = g, data[a:b].tobytes()
        n[key] = n.get(key, 0) + 1
        if last.get(key) != r:
            last[key], having[key] = r, having.get(key, 0) + 1
    offsets = np.cumsum([0] + [len(t) for _, t in n])
    return np.frombuffer(b"".join(t for _, t in n), np.uint8), offsets, np.array([g for g, _ in n], np.int64), np.array([*n.values()], np.int64), np.array([having[k] for k in n], np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (lang, source, text), rows (lang, source, term, n, df) for a few megabytes of texts at a time."""

    def rows(found: list[Piece]) -> pa.RecordBatch:
        data, offsets, group, n, df = added_up(found, group_of)
        term = pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        whose = pa.array(one_row[group])
        return pa.record_batch([batch.column(0).take(whose), batch.column(1).take(whose), term, pa.array(n), pa.array(df)], names=["lang", "source", "term", "n", "df"])

    for batch in batches:
        lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
        both = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        _, one_row, group_of = np.unique(both, return_index=True, return_inverse=True)
        found, tokens = [], 0
        for piece in pieces(batch.column(2), True, BETWEEN):
            if found and tokens + len(piece.starts) > TOKENS:
                yield rows(found)
                found, tokens = [], 0
            found.append(piece)
            tokens += len(piece.starts)
        if found:
            yield rows(found)


def weight(count: Column, total: Column, kept: Column) -> Column:
    """p of a count in a group of ``total`` occurrences over ``kept`` terms."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), F.greatest(total + kept, F.lit(1)).cast("decimal(20,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    """f of two weights; both stay below 2**31 up to a thousand million kept terms, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def postings(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, df): occurrences, and documents that have the term."""
    ship(docs.sparkSession)
    each = docs.select(*_group(), "text").mapInArrow(_counted, "lang string, source string, term string, n long, df long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _group() -> list[Column]:
    return [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]


def audit(docs: DataFrame, most_terms: int = MOST_TERMS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): every other source by its divergence, and each group's terms above its language."""
    per_term = Window.partitionBy("lang", "term")
    found = postings(docs).withColumns({"docs": F.sum("df").over(per_term), "n_lang": F.sum("n").over(per_term), "first": F.min("source").over(per_term)})
    kept = hold(found.filter(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "n_lang", (F.col("first") == F.col("source")).alias("counts")))
    in_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"), F.count_if("counts").alias("starts"), F.sum(F.when(F.col("counts"), F.col("n_lang"))).alias("lang_total"))
    everyone = docs.select(*_group()).distinct()
    known = everyone.join(in_group, ["lang", "source"], "left").fillna(0, ["total", "support", "starts", "lang_total"])
    own_lang = Window.partitionBy("lang")
    groups = hold(known.withColumns({"kept": F.sum("starts").over(own_lang), "n_all": F.sum("lang_total").over(own_lang)}).withColumn("p0", weight(F.lit(0), F.col("total"), F.col("kept"))).select("lang", "source", "total", "support", "kept", "n_all", "p0"))
    told = groups.select("lang", "source", "total", "kept", "n_all", "p0")
    priced = kept.join(few := small(told), ["lang", "source"]).withColumn("p", weight(F.col("n"), F.col("total"), F.col("kept")))
    if few is told:  # a join with broadcast groups is cheaper than its rows' keeping
        priced = hold(priced)
    return _pairs(groups, priced).unionByName(_terms(priced, most_terms))


def _pairs(groups: DataFrame, priced: DataFrame) -> DataFrame:
    """Sums for ordered pairs of sources, taken apart by supports."""
    one, other = (groups.select("lang", F.col("source").alias(s), F.col("support").alias(f"support_{s}"), F.col("p0").alias(f"p0_{s}"), *rest) for s, rest in (("g", ["kept"]), ("h", [])))
    both = one.join(small(other), "lang").filter("g <> h")  # the pairs that are the result
    neither = both.select("lang", "g", "h", ((F.col("kept") - F.col("support_g") - F.col("support_h")).cast(_EXACT) * divergence(F.col("p0_g"), F.col("p0_h"))).alias("part"))
    counts = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    price = lambda p, q: (F.col("k").cast(_EXACT) * divergence(p, q)).alias("part")
    theirs = small(groups.select("lang", F.col("source").alias("o"), F.col("p0").alias("q0")))
    charged = counts.join(theirs, "lang").filter("source <> o")
    only = _both_ways(charged, "source", "o", price(F.col("p"), F.col("q0")), price(F.col("q0"), F.col("p")))
    a, b = (priced.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"p_{s}"), F.col("p0").alias(f"p0_{s}")) for s in "gh")
    shared = a.join(b, ["lang", "term"]).filter("g < h")

    def correction(p: str, q: str) -> Column:
        parts = [divergence(F.col(f"{x}_{p}"), F.col(f"{y}_{q}")) for x, y in (("p", "p"), ("p", "p0"), ("p0", "p"), ("p0", "p0"))]
        return F.sum((parts[0] - parts[1] - parts[2] + parts[3]).cast("decimal(20,0)"))

    met = shared.groupBy("lang", "g", "h").agg(correction("g", "h").alias("there"), correction("h", "g").alias("back"))
    both_have = _both_ways(met, "g", "h", F.col("there").cast(_EXACT), F.col("back").cast(_EXACT))
    sums = neither.unionByName(only).unionByName(both_have).groupBy("lang", "g", "h").agg(F.sum("part").cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "g").orderBy(F.desc("value"), "h"))
    return sums.select("lang", F.col("g").alias("source"), F.lit("pair").alias("part"), F.col("h").alias("item"), "value", rank.alias("rank"))


def _both_ways(rows: DataFrame, g: str, h: str, there: Column, back: Column) -> DataFrame:
    """Rows (lang, g, h, part) for each pair and its reverse, from one reading of the rows."""
    way = lambda x, y, part: F.struct(F.col(x).alias("g"), F.col(y).alias("h"), part.alias("part"))
    return rows.select("lang", F.inline(F.array(way(g, h, there), way(h, g, back))))


def _terms(priced: DataFrame, most: int) -> DataFrame:
    """Each group's terms that weigh more in it than in its language, the furthest first."""
    q = weight(F.col("n_lang"), F.col("n_all"), F.col("kept"))
    above = priced.withColumn("q", q).filter("p > q").withColumn("value", divergence(F.col("p"), F.col("q")))
    lane = F.pmod(F.xxhash64("term"), F.lit(LANES))
    order = [F.desc("value"), F.col("term")]
    best = above.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "source", lane).orderBy(*order))).filter(F.col("nth") <= most)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    return best.withColumn("rank", rank).filter(F.col("rank") <= most).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
