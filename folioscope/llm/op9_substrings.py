"""Substring dedup by level-wise doubling.

A window is ``length`` consecutive words.  Level one looks at half-length
windows: of these, each document hands in those that are the least by hash
among the half-windows of some full window, which is enough for equal full
windows to hand in equal half-windows.  Half-windows that occur in one document
alone die here.  Only full windows whose half-window survived are extended to
level two, where the windows themselves are matched.  Windows that survive level
two are covered in full by it, so a longer level would remove no further word.

Both levels deal hashes into buckets as packed arrays.  A map task hands in a
hash once, with the smallest document that has it, and settles its other
documents itself; so a passage that all documents share costs one entry a task,
not one a document.  Level one's survivors travel as a Bloom filter of bounded
size; its false positives reach level two and die there, they never change the
result.  A full filter lets every window pass, some 14 bytes a word.  Hashes of level two have 96 bits.

Defined cases: null and short texts have no window; a null id counts as larger
than any other and equal to other nulls; rows with the same id never remove words
from one another; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import hold
from folioscope.llm.words import Piece, mix64, owners_of, pieces, window_hashes
from folioscope.shipping import ship

LENGTH = 50
FLUSH_ROWS = 1 << 19  #: entries that a map task settles at a time
BUCKET_ROWS = 1 << 21  #: entries meant for a bucket
FILTER_BYTES = 64 << 20  #: the Bloom filter of level one is never larger
_NO_ID = np.iinfo(np.int64).max
_PROBES = 4


def _least(values: np.ndarray, width: int, pick: np.ufunc = np.minimum) -> np.ndarray:
    """Least (or most) value of every run of ``width`` values."""
    got, out, at = 1, None, 0
    power = values
    while width:
        if width & 1:
            n = len(values) - (at + got) + 1
            out = power[:n].copy() if out is None else pick(out[:n], power[at : at + n])
            at += got
        width >>= 1
        if width:
            power = pick(power[:-got], power[got:])
            got *= 2
    return out


class _Windows:
    """Half-windows and windows of a piece's texts, those that cross texts left out."""

    def __init__(self, piece: Piece, length: int) -> None:
        self.hashes = piece.hashes()
        half = length // 2
        span = length - half + 1  # half-windows in a window
        owners = owners_of(piece.counts)
        n = len(self.hashes) - length + 1
        if n <= 0:
            self.at = np.empty(0, np.int64)
            return
        self.halves = window_hashes(self.hashes, half)
        self.inside = owners[:n] == owners[length - 1 :]
        self.at = np.flatnonzero(self.inside)
        self.owner = owners[self.at]
        self.anchor = _least(self.halves, span)[:n][self.at]  # of each window

    def keys(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of the windows that start at these words."""
        half = length // 2
        a, b = self.halves[at], self.halves[at + length - half]
        wide = mix64(a * np.uint64(3) + mix64(b, 1), 2)
        return wide, (mix64(self.hashes[at] + mix64(window_hashes(self.hashes, length)[at], 4), 3) >> np.uint64(32)).astype(np.uint32)


def _first(keys: tuple[np.ndarray, ...], ids: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of entries by key and id, and for each entry whether its key has a smaller id."""
    order = np.lexsort((ids, *reversed(keys)))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    starts = np.flatnonzero(new)
    first = np.repeat(ids[order][starts], np.diff(np.append(starts, len(order))))
    return order, first


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)


_PACKED = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])


def _deal(bucket: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
    """Entries packed by bucket, field after field: the ids of a document's neighbours compress to almost nothing."""
    order = np.argsort(bucket, kind="stable")
    b, e = bucket[order], entries[order]
    starts = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.empty(0, int)
    stops = np.append(starts[1:], len(b)) if len(b) else starts
    packed = [b"".join(np.ascontiguousarray(e[f][i:j]).tobytes() for f in e.dtype.names) if e.dtype.names else e[i:j].tobytes() for i, j in zip(starts, stops, strict=True)]
    return pa.record_batch([pa.array(b[starts], pa.int32()), pa.array(packed, pa.binary())], schema=_PACKED)


def _unpacked(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    """All entries of packed cells."""
    out = np.empty(sum(len(x.as_py()) for x in column) // kind.itemsize, kind)
    at = 0
    for x in column:
        data = x.as_py()
        n, place = len(data) // kind.itemsize, 0
        for f in kind.names:
            out[f][at : at + n] = np.frombuffer(data, kind[f], n, place)
            place += n * kind[f].itemsize
        at += n
    return out


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


_ANCHOR = np.dtype([("v", "<u8"), ("low", "<i8"), ("high", "<i8")])


def _anchors(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Level one, map side: each half-window once, with its smallest and largest document."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        v, i = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((i, v))
        v, i = v[order], i[order]
        starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        out = np.empty(len(starts), _ANCHOR)
        out["v"], out["low"], out["high"] = v[starts], i[starts], i[np.append(starts[1:], len(v)) - 1]
        held.clear()
        return _deal(_bucket(mix64(out["v"], 5), buckets), out)  # least hashes are small: mixed anew

    for batch in batches:
        ids = _ids(batch.column(0))
        for piece in pieces(batch.column(1), lower=False):
            w = _Windows(piece, length)
            if len(w.at):
                new = np.append(True, (w.anchor[1:] != w.anchor[:-1]) | (w.owner[1:] != w.owner[:-1]))
                held.append((w.anchor[new], ids[piece.first + w.owner[new]]))
            if sum(len(v) for v, _ in held) >= FLUSH_ROWS:
                yield flush()
    if held:
        yield flush()


def _repeated(dealt: pa.Table) -> np.ndarray:
    """Level one, reduce side: half-windows of one bucket that two documents or more have."""
    data = _unpacked(dealt.column("data"), _ANCHOR)
    order = np.argsort(data["v"], kind="stable")
    data = data[order]
    starts = np.flatnonzero(np.append(True, data["v"][1:] != data["v"][:-1]))
    alive = np.minimum.reduceat(data["low"], starts) != np.maximum.reduceat(data["high"], starts)
    return data["v"][starts][alive]


def _bits(values: np.ndarray, size: int) -> np.ndarray:
    """Bit positions of values in a filter of ``size`` bits, a row each."""
    a, b = mix64(values, 7), mix64(values, 8) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) % np.uint64(size) for k in range(_PROBES)], 1)


def _member(values: np.ndarray, bits: np.ndarray, size: int) -> np.ndarray:
    a, b = mix64(values, 7), mix64(values, 8) | np.uint64(1)
    ok = np.arange(len(values))
    for k in range(_PROBES):
        at = (a[ok] + np.uint64(k) * b[ok]) % np.uint64(size)
        ok = ok[(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0]
    out = np.zeros(len(values), bool)
    out[ok] = True
    return out


_WINDOW = np.dtype([("a", "<u8"), ("b", "<u4"), ("at", "<u4"), ("id", "<i8"), ("uid", "<i8")])
_DEALT = pa.schema([("bucket", pa.int32()), ("owner", pa.int32()), ("data", pa.binary())])
_FLAG = np.dtype([("id", "<i8"), ("uid", "<i8"), ("at", "<u4")])


def _flags(late: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Starts of removed windows, dealt by document: ``owner`` is the document's bucket."""
    out = np.empty(len(late), _FLAG)
    out["id"], out["uid"], out["at"] = late["id"], late["uid"], late["at"]
    dealt = _deal(_bucket(mix64(out["uid"].astype(np.uint64), 9), buckets), out)
    return pa.record_batch([dealt.column(0), dealt.column(0), dealt.column(1)], schema=_DEALT)


def _extended(batches: Iterator[pa.RecordBatch], length: int, buckets: int, bits: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """Level two, map side: windows once each with their smallest document; all other documents of the task are settled."""
    held: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        data = np.concatenate(held)
        held.clear()
        order, first = _first((data["a"], data["b"]), data["id"])
        late = data["id"][order] > first
        if late.any():
            yield _flags(data[np.sort(order[late])], buckets)
        data = data[np.sort(order[~late])]  # in the order of the texts again
        dealt = _deal(_bucket(data["a"], buckets), data)
        yield pa.record_batch([dealt.column(0), pa.nulls(len(dealt), pa.int32()), dealt.column(1)], schema=_DEALT)

    for batch in batches:
        ids, uids = _ids(batch.column(0)), batch.column(2).to_numpy()
        for piece in pieces(batch.column(1), lower=False):
            w = _Windows(piece, length)
            if not len(w.at):
                continue
            alive = _member(w.anchor, bits, size)
            at, owner = w.at[alive], w.owner[alive]
            out = np.empty(len(at), _WINDOW)
            out["a"], out["b"] = w.keys(at, length)
            out["at"] = at - piece.counts[owner]
            out["id"], out["uid"] = ids[piece.first + owner], uids[piece.first + owner]
            held.append(out)
            if sum(map(len, held)) >= FLUSH_ROWS:
                yield from flush()
    if held:
        yield from flush()


def _settle(dealt: pa.Table, buckets: int) -> pa.Table:
    """Level two, reduce side: windows of a bucket whose document isn't the first."""
    out = [dealt.filter(dealt.column("owner").is_valid())]
    data = _unpacked(dealt.filter(dealt.column("owner").is_null()).column("data"), _WINDOW)
    if len(data):
        order, first = _first((data["a"], data["b"]), data["id"])
        late = data["id"][order] > first
        out.append(pa.Table.from_batches([_flags(data[np.sort(order[late])], buckets)]))
    return pa.concat_tables(x.cast(_DEALT) for x in out)


def _by_document(dealt: pa.Table) -> pa.Table:
    """One row for each document of a bucket: the starts of its removed windows, packed."""
    data = _unpacked(dealt.column("data"), _FLAG)
    data = data[np.lexsort((data["at"], data["uid"], data["id"]))]
    ids, uids, at = data["id"], data["uid"], np.ascontiguousarray(data["at"])
    starts = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (uids[1:] != uids[:-1]))) if len(data) else np.empty(0, int)
    stops = np.append(starts[1:], len(data)) if len(data) else starts
    packed = [at[i:j].tobytes() for i, j in zip(starts, stops, strict=True)]
    return pa.table({"fid": pa.array(ids[starts], mask=ids[starts] == _NO_ID), "fuid": pa.array(uids[starts]), "flags": pa.array(packed, pa.binary())})


def removed_words(flags: bytes, n: int, length: int) -> np.ndarray:
    """Whether each of a text's words lies in a removed window."""
    at = np.frombuffer(flags, "<u4").astype(np.int64)
    steps = np.bincount(at, minlength=n + 1) - np.bincount(at + length, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def _digest(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flags = batch.column("flags").to_pylist()
        n_words, n_removed, digests, kept = [], [], [], []
        for piece in pieces(batch.column("text"), lower=False):
            for k in range(len(piece)):
                words = piece.words(k)
                found = flags[piece.first + k]
                if found:
                    out = removed_words(found, len(words), length)
                    left = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                else:
                    left = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                joined = b" ".join(left)
                digests.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode())
        yield pa.record_batch([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def dedup_substrings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, n_removed, kept_sha256, kept_text) for every document.

    ``length`` is at least 2.  A word goes if a window over it also starts in a
    document with a smaller id.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("uid"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, n_bytes // (6 * BUCKET_ROWS) + 1)  # words have about six bytes
    packed = rows.select("id", "text").mapInArrow(partial(_anchors, length=length, buckets=buckets), "bucket int, data binary")

    def survivors(dealt: pa.Table) -> pa.Table:
        values = _repeated(dealt)
        return pa.table({"n": pa.array([len(values)], pa.int64()), "data": pa.array([values.tobytes()], pa.binary())})

    alive = hold(packed.groupBy("bucket").applyInArrow(survivors, "n long, data binary"))
    n_alive = alive.agg(F.sum("n")).first()[0] or 0
    size = min(FILTER_BYTES * 8, max(1 << 13, 1 << int(12 * n_alive).bit_length()))
    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(1):
                at = np.unique(_bits(np.frombuffer(x.as_py(), np.uint64), size).ravel())
                yield _deal((at >> np.uint64(23)).astype(np.int32), (at & np.uint64((1 << 23) - 1)).astype("<u4"))

    def gather(key: tuple[pa.Scalar, ...], dealt: pa.Table) -> pa.Table:
        bits = np.zeros(min(size, 1 << 23), np.uint8)
        for x in dealt.column("data"):
            bits[np.frombuffer(x.as_py(), "<u4")] = 1
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([packed], pa.binary())})

    bits = np.zeros(size // 8, np.uint8)
    for row in alive.mapInArrow(scatter, "bucket int, data binary").groupBy("bucket").applyInArrow(gather, "slice int, bits binary").collect():  # FILTER_BYTES at most
        bits[row["slice"] << 20 : (row["slice"] << 20) + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bits.tobytes())

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _extended(batches, length, buckets, np.frombuffer(shared.value, np.uint8), size)

    def settle(dealt: pa.Table) -> pa.Table:
        return _settle(dealt, buckets)

    kind = "bucket int, owner int, data binary"
    settled = rows.mapInArrow(extended, kind).groupBy("bucket").applyInArrow(settle, kind)
    by_doc = settled.groupBy("owner").applyInArrow(_by_document, "fid long, fuid long, flags binary")
    joined = rows.join(by_doc, (rows["uid"] == by_doc["fuid"]) & rows["id"].eqNullSafe(by_doc["fid"]), "left").select("id", "text", "flags")
    return joined.mapInArrow(partial(_digest, length=length), "id long, n_words long, n_removed long, kept_sha256 string, kept_text string").withColumnRenamed("id", id_col)
