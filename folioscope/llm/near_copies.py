"""Near copies by word shingles: links of Jaccard similarity ``LEAST`` or more.

Texts that are the same but for A-Z and white space are one class.  Classes are
met by SimHash, and where its four bits are too few, by MinHash: each class has
its fingerprint and the least one that ``op10_simhash`` links to it as keys, and
``BANDS`` keys of ``ROWS`` minima over its distinct shingles; a pair of
similarity s shares one of these with probability 1 - (1 - s**ROWS)**BANDS, which
is 0.9999 at 0.8.  Who shares a key is first compared with one member of it only;
then members of a key that are not yet in one component are compared with one
another where they lie, in blocks of ``BLOCK`` members, by their ``SKETCH`` least
shingle hashes: all there are in short texts, an estimate in longer ones.  Only
pairs that reach ``LEAST``, or may do so, leave their block, and the shingles
themselves decide about these, so no link is below it.

Defined cases: a text of fewer words than a shingle has is one shingle; null and
empty texts are one class without links; null ids, repeated rows and other
columns are as in ``op10_simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import hold, keep
from folioscope.llm.op10_simhash import components, fingerprints_of, only
from folioscope.llm.op10_simhash import links as simhash_links
from folioscope.llm.words import Piece, mix64, owners_of, pieces, window_hashes
from folioscope.shipping import ship

WIDTH = 5
LEAST = 0.8
BANDS, ROWS = 24, 5
MARGIN = 0.17  #: more than four standard deviations of the share of equal minima
SKETCH = 256
SLACK = 0.11  #: more than four standard deviations of a similarity estimated from ``SKETCH`` hashes
BLOCK = 512  #: members of a key that are compared at a time with as many others
SIEVE_BITS = 1 << 26  #: of the filter for texts that are asked for, at most; a full one lets more texts pass
TASK_MEMBERS = 20_000  #: members meant for a task's group of blocks
_FACTORS = mix64(np.arange(BANDS * ROWS, dtype=np.uint64), 41) | np.uint64(1)
_TERMS = mix64(np.arange(BANDS * ROWS, dtype=np.uint64), 42)


def shingles(piece: Piece, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles and the text of each, in order of the texts; and a hash of each text's words (0: none)."""
    hashes, owner, n = piece.hashes(), owners_of(piece.counts), np.diff(piece.counts)
    place = np.arange(len(hashes)) - piece.counts[:-1][owner]
    marked = mix64(hashes + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 43)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(marked, dtype=np.uint64)))
    whole = sums[piece.counts[1:]] - sums[piece.counts[:-1]]
    windows = window_hashes(hashes, width)
    inside = np.flatnonzero(owner[: len(windows)] == owner[width - 1 :]) if len(windows) else np.empty(0, np.int64)
    found, text = windows[inside], owner[inside]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        found, text = np.concatenate([found, whole[short]]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        found, text = found[order], text[order]
    return found, text, whole


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows (id, uid, same, fp, sig, keys): the class of each document, its SimHash (null without words), a byte of each minimum, and its keys."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array(fingerprints_of(batch.column(1), width), pa.int64())
            for piece in pieces(batch.column(1), lower=True):
                found, text, whole = shingles(piece, width)
                own, starts = np.unique(text, return_index=True)
                keys = np.empty((len(own), BANDS), np.uint64)
                sig = np.empty((len(own), BANDS * ROWS), np.uint8)
                for band in range(BANDS):
                    key = np.full(len(own), band, np.uint64)
                    for i in range(band * ROWS, (band + 1) * ROWS):
                        least = np.minimum.reduceat(found * _FACTORS[i] + _TERMS[i], starts) if len(own) else np.empty(0, np.uint64)
                        key = mix64(key ^ least, 44)
                        sig[:, i] = mix64(least, 45) & np.uint64(255)
                    keys[:, band] = key
                have = np.zeros(len(piece), np.int64)
                have[own] = BANDS
                listed, held = [b""] * len(piece), sig.tobytes()
                for k, row in enumerate(own.tolist()):
                    listed[row] = held[k * BANDS * ROWS : (k + 1) * BANDS * ROWS]
                yield pa.record_batch(
                    {
                        "id": batch.column(0).slice(piece.first, len(piece)),
                        "uid": batch.column(2).slice(piece.first, len(piece)),
                        "same": pa.array(whole.view(np.int64)),
                        "fp": pc.if_else(pa.array(have > 0), fps.slice(piece.first, len(piece)), None),
                        "sig": pa.array(listed, pa.binary()),
                        "keys": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(have))), pa.int32()), pa.array(keys.ravel().view(np.int64))),
                    }
                )

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("uid"))
    return rows.mapInArrow(run, f"id {kind}, uid long, same long, fp long, sig binary, keys array<long>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """Rows (same, shingles): the distinct shingles of each text (columns same, text), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1), lower=True):
                found, text, _ = shingles(piece, width)
                cuts = np.searchsorted(text, np.arange(len(piece) + 1))
                packed = [np.unique(found[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.record_batch({"same": batch.column(0).slice(piece.first, len(piece)), "shingles": pa.array(packed, pa.binary())})

    return texts.select("same", "text").mapInArrow(run, "same long, shingles binary")


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for k in (2, 3))
        yield batch.select([0, 1]).filter(pa.array((x == y).mean(1) >= LEAST - MARGIN))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least hashes of each set, and whether it has more."""
    for batch in batches:
        every = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(1)]
        cut = [(x[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes() for x in every]
        yield pa.record_batch({"same": batch.column(0), "sketch": pa.array(cut, pa.binary()), "longer": pa.array([len(x) > SKETCH for x in every])})


def _similarity(sketches: list[np.ndarray], longer: np.ndarray) -> np.ndarray:
    """Similarity of each to each: exact where neither has more hashes, else estimated below the lesser of their greatest."""
    n, sizes = len(sketches), np.array([len(x) for x in sketches])
    values, at, times = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[at]  # of those that two have or more
    both = np.zeros((n, n), np.float32)
    for a in range(0, int(column.max(initial=-1)) + 1, 8192):
        own = (column >= a) & (column < a + 8192)
        some = np.zeros((n, min(8192, int(column.max()) + 1 - a)), np.float32)
        some[owner[own], column[own] - a] = 1
        both += some @ some.T
    most = np.array([x[-1] if more and len(x) else np.iinfo(np.int64).max for x, more in zip(sketches, longer, strict=True)], np.int64)
    below = np.stack([np.searchsorted(x.astype(np.int64), most, "right") for x in sketches])  # of each row's hashes, up to each column's greatest
    below = np.minimum(below, sizes[:, None])
    return both / np.maximum(1, below + below.T - both)


def _alike(members: pa.Table) -> pa.Table:
    """Pairs (a, b), a < b, of a block's members of different roots that are similar, or may be: of those surely so one for two roots."""
    key, x, y, own, same, root, longer = (np.asarray(members.column(c)) for c in ("key", "x", "y", "own", "same", "root", "longer"))
    order = np.lexsort((same, y, x, key))
    key, x, y, own, same, root, longer = (c[order] for c in (key, x, y, own, same, root, longer))
    sketches = [np.frombuffer(s, "<u4") for s in members.column("sketch").take(pa.array(order)).to_pylist()]
    starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    found = [np.empty((0, 2), np.int64)]
    for i, j in zip(starts.tolist(), np.append(starts[1:], len(key)).tolist(), strict=True):
        r, s, more = root[i:j], same[i:j], longer[i:j]
        if (r == r[0]).all():
            continue
        apart = (r[:, None] != r[None, :]) & (s[:, None] < s[None, :])
        if x[i] != y[i]:
            apart &= own[i:j, None] != own[None, i:j]
        a, b = np.nonzero(apart & (_similarity(sketches[i:j], more) >= LEAST - 1e-6 - SLACK * (more[:, None] | more[None, :])))
        sure = ~(more[a] | more[b])
        roots = np.sort(np.stack([r[a[sure]], r[b[sure]]], 1), axis=1)
        one = np.flatnonzero(sure)[np.unique(roots, axis=0, return_index=True)[1]]
        keep = np.concatenate([one, np.flatnonzero(~sure)])
        found.append(np.stack([s[a[keep]], s[b[keep]]], 1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= LEAST * max(len(x), len(y)) else 0
            near.append(both >= LEAST * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))


def _with_both(pairs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    for k in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("same").alias(k), F.col(column).alias(f"of_{k}")), k)
    return pairs.select("a", "b", "of_a", "of_b")


def _asked_for(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts (uid, text) whose uid is among ``ids``, and a few others: what a join with these needs of them.

    A bit for each uid, 16 times as many bits as ids, so that most other texts need not be shuffled.
    """
    size = min(SIEVE_BITS, 1 << max(13, (16 * ids.count()).bit_length()))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[np.asarray(batch.column(0)) & (size - 1)] = True
        yield pa.record_batch({"bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    bits = np.zeros(size // 8, np.uint8)
    for row in ids.select("uid").coalesce(8).mapInArrow(marked, "bits binary").toLocalIterator():
        bits |= np.frombuffer(row["bits"], np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(bits.tobytes())

    def sieved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            at = np.asarray(batch.column(0)) & (size - 1)
            yield batch.filter(pa.array((known[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))

    return texts.mapInArrow(sieved, "uid long, text string")


def links(distinct: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Pairs (a, b), a < b, of classes: enough links of similarity ``LEAST`` or more to tie each component together."""
    printed = distinct.filter("fp is not null").select("same", "fp")
    least = simhash_links(printed.select("fp").distinct()).groupBy(F.col("b").alias("fp")).agg(F.min("a").alias("near"))
    alike = printed.select("same", F.xxhash64("fp", F.lit(BANDS)).alias("key")).unionByName(printed.join(least, "fp").select("same", F.xxhash64("near", F.lit(BANDS)).alias("key")))
    banded = hold(distinct.select("same", F.explode("keys").alias("key")).unionByName(alike))
    shared = banded.groupBy("key").agg(F.min("same").alias("low"), F.max("same").alias("high")).filter("low < high").select("key")
    several = hold(banded.join(shared, "key"))
    one = several.groupBy("key").agg(F.min(F.struct(F.xxhash64("same", "key").alias("at"), "same"))["same"].alias("one"))
    met = keep(several.join(one, "key"))  # narrow; later plans start from here
    wanted = hold(met.select("same").distinct().join(distinct.select("same", F.col("first.uid").alias("uid")), "same"))
    texts = _asked_for(docs.select(F.xxhash64(id_col, text_col).alias("uid"), F.col(text_col).alias("text")), wanted).join(wanted, "uid")
    sets = hold(_sets(texts, width).dropDuplicates(["same"]))

    def verified(pairs: DataFrame) -> DataFrame:
        hopeful = _with_both(pairs, distinct, "sig").mapInArrow(_hopeful, "a long, b long")
        return keep(_with_both(hopeful, sets, "shingles").mapInArrow(_close, "a long, b long"))

    def ordered(x: str, y: str) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    star = hold(met.filter("same <> one").select(*ordered("same", "one")).distinct())
    first = verified(star)
    known = components(first)
    rooted = met.select("key", "same").join(known.withColumnRenamed("node", "same"), "same", "left").select("key", "same", F.coalesce("root", "same").alias("root"))
    rooted = hold(rooted)
    apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("low < high").select("key", "blocks")
    open_ = rooted.join(apart, "key").withColumn("own", F.pmod(F.xxhash64("same"), "blocks").cast("int")).join(sets.mapInArrow(_sketched, "same long, sketch binary, longer boolean"), "same")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    blocks = open_.select("*", other).select("key", "same", "root", "sketch", "longer", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    groups = -(-(rooted.join(apart, "key").agg(F.sum("blocks")).first()[0] or 0) // TASK_MEMBERS)
    group = F.pmod(F.xxhash64("key", "x", "y"), F.lit(max(1, groups))).alias("group")
    cross = blocks.select(group, "*").groupBy("group").applyInArrow(_alike, "a long, b long").distinct()
    near = keep(_with_both(cross.join(star, ["a", "b"], "left_anti"), sets, "shingles").mapInArrow(_close, "a long, b long"))
    return known.filter("root < node").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(near)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The documents, columns unchanged, but one of each component: that with the smallest id, and one row of rows alike."""
    rows = signatures(docs, id_col, text_col, width)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first")
    distinct = hold(rows.groupBy("same").agg(first, F.first("fp").alias("fp"), F.first("sig").alias("sig"), F.first("keys").alias("keys")))
    roots = components(links(distinct, docs, id_col, text_col, width)).withColumnRenamed("node", "same")
    classes = distinct.select("same", "first").join(roots, "same", "left").select("first", F.coalesce("root", "same").alias("root"))
    return only(docs, classes.groupBy("root").agg(F.min("first").alias("first")), id_col, text_col)
