"""LM scoring with a log-frequency Bloom filter.

Training documents give exact counts of words (with one end mark a document)
and counts of word pairs, in one pass.  The base score is the sum of smoothed
log10 word probabilities from the exact counts.  The model's counts live in a
Bloom filter instead: an n-gram with count c is entered under the levels 0, 1,
..., floor(log(c) / log(STEP)); asking for one level after the other until one is
missing gives the quantised count back.  Every counted word and pair is in,
pairs from count 1.  The model's probability of a word mixes the pair's share in
its context with the word's smoothed share::

    (1 - PAIRS) * (c(w) + 0.5) / (N + 0.5 * (V + 1)) + PAIRS * min(1, c(v w) / c(v))

N-grams travel compressed in buckets of bounded size, and each bucket fills its
own slice of the filter, 64-bit words in each of which an entry sets ``PROBES``
bits; beside it lie the bucket's words with their exact counts.  The slices grow
with the n-grams.  As long as all of them take ``FILTER_BYTES`` at most, they are
broadcast.  Larger ones stay where they were made, and the questions go to them
instead: chunks of consecutive texts hand in their distinct words and pairs by
bucket, and get levels and counts back.  Both ways ask the same bits, so the
scores are the same, and both do work in proportion to the texts.

Defined cases: null and empty texts are one end mark; a null id is not held out;
repeated rows come out as often as they came in; an empty table gives no rows;
with nothing to learn from every word has count 0; other columns are not read.
Words are told apart by 64-bit hashes within a chunk, by themselves in a bucket.
Of the n-grams of a bucket, some ``BUCKET``, one in 2,000 at most shares its
filter entry with another; a probe errs about three times in a thousand.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import hold
from folioscope.llm.words import Piece, mix64, owners_of, pieces
from folioscope.shipping import ship

STEP = 1.5
PAIRS = 0.05
FILTER_BYTES = 10 << 20  #: slices are broadcast up to this size, which is what Spark itself broadcasts
BITS_PER_KEY, PROBES = 16, 5
FLUSH = 1 << 21  #: tokens that a map task counts at a time
BUCKET = 1 << 21  #: tokens meant for a bucket
CHUNK_BYTES = 6 << 20  #: text whose questions to the slices are put together
GROUP = 4  #: pieces of text that are scored together by broadcast slices
MOST_LEVELS = 200
WORDS, WORD_PAIRS = 1, 2
_BEGIN, _END = np.uint64(0x51ED270B9F4A7C15), np.uint64(0xA24BAED4963EE407)
_END_TOKEN = b""


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log(counts) / math.log(STEP) + 1e-9).astype(np.int64)


def count_at(levels: int = MOST_LEVELS) -> np.ndarray:
    """The count that a level stands for: the mean of its whole numbers; 0 at index 0, for a missing n-gram."""
    out = [0.0]
    for q in range(levels):
        low, high = math.ceil(STEP**q - 1e-9), math.ceil(STEP ** (q + 1) - 1e-9) - 1
        out.append((low + high) / 2 if high >= low else STEP**q)
    return np.array(out)


_VALUES = count_at()


def word_keys(hashes: np.ndarray) -> np.ndarray:
    return mix64(hashes, 23)


_END_KEY = word_keys(np.full(1, _END))[0]


def keys_of(tokens: list[bytes]) -> np.ndarray:
    """Keys of distinct words; the empty one is the end mark."""
    keys = [np.empty(0, np.uint64)]
    for piece in pieces(pa.array(tokens, pa.binary()).cast(pa.string()), False):
        own = np.full(len(piece), _END, np.uint64)  # the end mark alone has no word
        own[owners_of(piece.counts)] = piece.hashes()
        keys.append(word_keys(own))
    return np.concatenate(keys)


def _tokens(piece: Piece) -> list[bytes]:
    """All words of a piece, text after text."""
    if len(piece) == 1:
        return piece.data.tobytes().split()
    return b" ".join(piece.data[a:b].tobytes() for a, b in zip(piece.offsets[:-1], piece.offsets[1:], strict=True)).split()


def ngrams(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each token and of its pair with the one before, and how many tokens each text has.  Every text ends in an end mark."""
    owner = owners_of(piece.counts)
    n = len(owner) + len(piece)
    tokens = np.full(n, _END, np.uint64)
    tokens[np.arange(len(owner)) + owner] = piece.hashes()
    context = np.empty(n, np.uint64)
    context[1:] = tokens[:-1]
    context[piece.counts[:-1] + np.arange(len(piece))] = _BEGIN
    pair = mix64(context * np.uint64(3) + mix64(tokens, 21), 22)
    return word_keys(tokens), pair, np.diff(piece.counts) + 1


def placed(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Keys dealt in order into fewer than 2**32 buckets: the bucket's number above, the place in the bucket in the low 32 bits."""
    low = np.uint64((1 << 32) - 1)
    return (keys >> np.uint64(32)) * np.uint64(buckets) + ((keys & low) * np.uint64(buckets) >> np.uint64(32))


def _bucket(places: np.ndarray) -> np.ndarray:
    return (places >> np.uint64(32)).astype(np.int64)


def _squeezed(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte, compressed; their number comes first."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return len(values).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _joined(tokens: list[bytes]) -> bytes:
    """Words, which have no spaces, compressed; their size comes first."""
    data = b" ".join(tokens)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _parted(data: bytes) -> list[bytes]:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True).split(b" ")


def _loosened(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:4], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[4:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind)


def _pack(places: np.ndarray) -> bytes:
    """Places in one bucket, in order, as differences."""
    return _squeezed(np.diff(places.astype("<u4"), prepend=np.uint32(0)))


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_loosened(data, np.uint32), dtype=np.uint64)


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Of buckets in order: each, and where it starts and ends."""
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
    return zip(bucket[starts].tolist(), starts.tolist(), np.append(starts[1:], len(bucket)).tolist(), strict=True)


_ENTRIES = "bucket long, kind int, keys binary, more binary, counts binary"


def _cells(cells: list[tuple]) -> pa.RecordBatch:
    """Rows (bucket, kind, keys, more, counts) of packed n-grams."""
    columns = list(zip(*cells, strict=True)) or [()] * 5
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "kind", "keys", "more", "counts"])


def pair_cells(keys: np.ndarray, counts: np.ndarray, buckets: int) -> list[tuple]:
    """Distinct pairs in order and their counts; those counted once need no number."""
    places, cells = placed(keys, buckets), []
    for b, i, j in _runs(_bucket(places)):
        k, c = places[i:j], counts[i:j]
        cells.append((b, WORD_PAIRS, _pack(k[c == 1]), _pack(k[c > 1]), _squeezed(c[c > 1].astype("<u8"))))
    return cells


def word_cells(counts: dict[bytes, int], buckets: int) -> list[tuple]:
    """Words with their counts."""
    tokens = list(counts)
    bucket = _bucket(placed(keys_of(tokens), buckets))
    order = np.argsort(bucket, kind="stable")
    tokens = [tokens[i] for i in order.tolist()]
    numbers = np.fromiter(counts.values(), np.uint64, len(counts))[order]
    return [(b, WORDS, _joined(tokens[i:j]), b"", _squeezed(numbers[i:j])) for b, i, j in _runs(bucket[order])]


def _counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of a task's words and word pairs."""
    held: list[np.ndarray] = []
    words: Counter[bytes] = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        yield _cells(word_cells(words, buckets))
        words.clear()
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        yield _cells(pair_cells(keys, counts, buckets))

    for batch in batches:
        for piece in pieces(batch.column(0), True):
            held.append(ngrams(piece)[1])
            words.update(_tokens(piece))
            words[_END_TOKEN] += len(piece)
            if sum(map(len, held)) >= FLUSH:
                yield from flush()
    if held:
        yield from flush()


def _spots(salted: np.ndarray, level: int, size: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The word of a slice of ``size`` < 2**32 words, and the bits in it, of each key at a level."""
    h = mix64(salted + np.uint64(0xD6E8FEB86659FD93 * level & 0xFFFFFFFFFFFFFFFF), 31)
    mask = np.uint64(1) << (h & np.uint64(63))
    for k in range(1, PROBES):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return ((h >> np.uint64(32)) * size >> np.uint64(32)).astype(np.int64), mask


def _salted(places: np.ndarray, kind: int) -> np.ndarray:
    return (places & np.uint64((1 << 32) - 1)) * np.uint64(4) + np.uint64(kind)


def merged_words(rows: pa.Table) -> dict[bytes, int]:
    """Counts of the words of one bucket, from its word cells."""
    words: Counter[bytes] = Counter()
    for tokens, counts in zip(rows.column("keys"), rows.column("counts"), strict=True):
        for token, c in zip(_parted(tokens.as_py()), _loosened(counts.as_py(), np.uint64).tolist(), strict=True):
            words[token] += c
    return words


def filled(words: dict[bytes, int], pairs: pa.Table, buckets: int) -> np.ndarray:
    """The filter slice of one bucket, from its words and its pair cells."""
    keys = [_salted(placed(keys_of(list(words)), buckets), WORDS)]
    levels = [level_of(np.fromiter(words.values(), float, len(words)))]
    once = [_unpack(x.as_py()) for x in pairs.column("keys")]
    more = [_unpack(x.as_py()) for x in pairs.column("more")]
    if once:
        counts = [_loosened(x.as_py(), np.uint64).astype(np.int64) for x in pairs.column("counts")]
        own, at = np.unique(np.concatenate(once + more), return_inverse=True)
        total = np.bincount(at, np.concatenate([np.ones(sum(map(len, once)), np.int64), *counts]), len(own))
        keys.append(_salted(own, WORD_PAIRS))
        levels.append(level_of(total))
    salted, top = np.concatenate(keys), np.concatenate(levels)
    size = -(-int((top + 1).sum()) * BITS_PER_KEY // 64)
    bits = np.zeros(size, np.uint64)
    for level in range(int(top.max(initial=-1)) + 1):
        salted, top = salted[top >= level], top[top >= level]
        at, mask = _spots(salted, level, np.uint64(size))
        np.bitwise_or.at(bits, at, mask)
    return bits


def asked(bits: np.ndarray, base: np.ndarray | int, size: np.ndarray | np.uint64, salted: np.ndarray) -> np.ndarray:
    """Levels found, and one, of keys whose slices begin at ``base`` and have ``size`` words; 0 for none."""
    out = np.zeros(len(salted), np.uint8)
    alive = np.arange(len(salted))
    if np.ndim(size):
        alive = np.flatnonzero(size)
        base, size, salted = base[alive], size[alive].astype(np.uint64), salted[alive]
    elif not size:
        return out
    for level in range(MOST_LEVELS):
        at, mask = _spots(salted, level, size)
        ok = (bits[base + at] & mask) == mask
        alive, salted = alive[ok], salted[ok]
        if not len(alive):
            break
        if np.ndim(size):
            base, size = base[ok], size[ok]
        out[alive] = level + 1
    return out


@dataclass
class Model:
    """All slices as one; ``first`` holds where each begins, and the end."""

    first: np.ndarray
    bits: np.ndarray
    words: dict[bytes, int]
    total: int  #: N
    distinct: int  #: V

    def levels(self, keys: np.ndarray, kind: int) -> np.ndarray:
        buckets = len(self.first) - 1
        if not buckets:
            return np.zeros(len(keys), np.uint8)
        places = placed(keys, buckets)
        own = _bucket(places)
        return asked(self.bits, self.first[own], self.first[own + 1] - self.first[own], _salted(places, kind))


@dataclass
class Questions:
    """Distinct words and pairs of some pieces of text, in order, and where each token's are."""

    group: list[Piece]
    words: np.ndarray = field(init=False)
    pairs: np.ndarray = field(init=False)
    lengths: np.ndarray = field(init=False)  #: tokens of each text

    def __post_init__(self) -> None:
        word, pair, lengths = zip(*map(ngrams, self.group), strict=True)
        self.lengths = np.concatenate(lengths)
        self.words, self._at, at = np.unique(np.concatenate(word), return_index=True, return_inverse=True)
        self._word = at.astype(np.int32)
        self._context = np.empty_like(self._word)
        self._context[1:] = self._word[:-1]
        # A text begins as if after an end mark; each text has one.
        self._context[np.cumsum(self.lengths) - self.lengths] = np.searchsorted(self.words, _END_KEY)
        del word
        self.pairs, at = np.unique(np.concatenate(pair), return_inverse=True)
        self._pair = at.astype(np.int32)

    def tokens(self) -> list[bytes]:
        """The distinct words themselves."""
        every = [w for piece in self.group for w in _tokens(piece)]
        marks = np.searchsorted(np.cumsum(self.lengths), self._at, "right")  # end marks before each
        at = np.where(self.words == _END_KEY, -1, self._at - marks)
        return [every[i] if i >= 0 else _END_TOKEN for i in at.tolist()]

    def sums(self, counts: np.ndarray, words: np.ndarray, pairs: np.ndarray, total: int, distinct: int) -> pa.RecordBatch:
        """Numbers of tokens and of known ones, base score and score of each text, from exact counts and levels."""
        every = total + 0.5 * (distinct + 1)
        near = _VALUES[words]
        p = ((near + 0.5) / every * (1 - PAIRS))[self._word]
        context = near[self._context]
        p += PAIRS * np.minimum(1.0, np.where(context > 0, _VALUES[pairs][self._pair], 0.0) / np.maximum(context, 1.0))
        at = np.cumsum(self.lengths) - self.lengths
        known = np.add.reduceat((counts > 0).astype(np.int64)[self._word], at)
        base = np.add.reduceat(np.log10((counts + 0.5) / every)[self._word], at)
        return pa.record_batch([pa.array(x) for x in (self.lengths, known, base, np.add.reduceat(np.log10(p), at))], names=["n_tokens", "n_known", "base", "score"])


def build_slices(training: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, size, bits, tokens, counts, n, v) of texts (column text); n tokens are v words in the bucket."""
    ship(training.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, buckets)

    def fill(key: tuple[pa.Scalar, ...], dealt: pa.Table) -> pa.Table:
        kinds = np.asarray(dealt.column("kind"))
        words = merged_words(dealt.filter(pa.array(kinds == WORDS)))
        bits = filled(words, dealt.filter(pa.array(kinds == WORD_PAIRS)), buckets)
        tokens, counts = _joined(list(words)), _squeezed(np.fromiter(words.values(), np.uint64, len(words)))
        cells = (key[0].as_py(), bits.nbytes + len(tokens) + len(counts), bits.tobytes(), tokens, counts, sum(words.values()), len(words))
        return pa.table([pa.array([x], t) for x, t in zip(cells, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["bucket", "size", "bits", "tokens", "counts", "n", "v"])

    entries = training.select("text").mapInArrow(count, _ENTRIES)
    return hold(entries.groupBy("bucket").applyInArrow(fill, "bucket long, size long, bits binary, tokens binary, counts binary, n long, v long"))


def _dictionary(tokens: bytes, counts: bytes) -> dict[bytes, int]:
    numbers = _loosened(counts, np.uint64).tolist()
    return dict(zip(_parted(tokens), numbers, strict=True)) if numbers else {}


def gathered(slices: list[tuple[int, bytes, bytes, bytes]], buckets: int, total: int, distinct: int) -> Model:
    """All slices (bucket, bits, tokens, counts), which take ``FILTER_BYTES`` at most, as one."""
    parts: dict[int, bytes] = {}
    words: dict[bytes, int] = {}
    for bucket, bits, tokens, counts in slices:
        parts[bucket] = bits
        words |= _dictionary(tokens, counts)
    sizes = [len(parts.get(b, b"")) // 8 for b in range(buckets)]
    bits = np.frombuffer(b"".join(parts.get(b, b"") for b in range(buckets)), np.uint64)
    return Model(np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), bits, words, total, distinct)


def _grouped(pieces_: Iterator[Piece], size: int) -> Iterator[list[Piece]]:
    group: list[Piece] = []
    for piece in pieces_:
        group.append(piece)
        if len(group) == size:
            yield group
            group = []
    if group:
        yield group


def _beside(batch: pa.RecordBatch, sums: pa.RecordBatch) -> pa.RecordBatch:
    """The rows' own columns and their sums."""
    return pa.record_batch([batch.column("id"), batch.column("held_out"), *sums.columns], names=["id", "held_out", *sums.schema.names])


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for group in _grouped(pieces(batch.column("text"), True), GROUP):
            asking = Questions(group)
            counts = np.array([model.words.get(t, 0) for t in asking.tokens()], np.int64)
            sums = asking.sums(counts, model.levels(asking.words, WORDS), model.levels(asking.pairs, WORD_PAIRS), model.total, model.distinct)
            yield _beside(batch.slice(group[0].first, len(sums)), sums)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Consecutive rows of about ``CHUNK_BYTES`` of text, and a hash of the rows' uids."""
    held: list[pa.RecordBatch] = []
    size = 0

    def chunk() -> tuple[int, pa.RecordBatch]:
        own = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        uids = own.column("uid").to_numpy().astype(np.uint64)
        number = np.bitwise_xor.reduce(mix64(uids + np.arange(len(uids), dtype=np.uint64), 51))
        held.clear()
        return int(number.view(np.int64)), own

    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)).astype(np.int64))
        at = 0
        while at < len(batch):
            done = int(ends[at - 1]) if at else 0
            stop = int(np.searchsorted(ends, done + CHUNK_BYTES - size, "right"))
            if stop <= at and held:  # the next text doesn't fit; where batches end makes no difference
                size = 0
                yield chunk()
                continue
            stop = max(stop, at + 1)
            held.append(batch.slice(at, stop - at))
            size += int(ends[stop - 1]) - done
            at = stop
    if held:
        yield chunk()


def _routed(rows: DataFrame, slices: DataFrame, buckets: int, total: int, distinct: int, schema: str) -> DataFrame:
    """Scores by slices that stay where they are: questions of each chunk of texts, their answers, and the sums.

    A chunk's number is a hash of its rows, so a chunk that comes out otherwise
    the second time finds no answers, which is an error.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, texts in _chunks(batches):
            asking = Questions(list(pieces(texts.column("text"), True)))
            tokens, pairs = asking.tokens(), placed(asking.pairs, buckets)
            cells = [(b, number, WORDS, _joined(tokens[i:j])) for b, i, j in _runs(_bucket(placed(asking.words, buckets)))]
            cells += [(b, number, WORD_PAIRS, _pack(pairs[i:j])) for b, i, j in _runs(_bucket(pairs))]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "chunk", "kind", "keys"])

    def answer(questions: pa.Table, own: pa.Table) -> pa.Table:
        bits, words = np.empty(0, np.uint64), {}
        if len(own):
            bits = np.frombuffer(own.column("bits")[0].as_py(), np.uint64)
            words = _dictionary(own.column("tokens")[0].as_py(), own.column("counts")[0].as_py())
        levels, counts = [], []
        for kind, asked_ in zip(questions.column("kind").to_pylist(), questions.column("keys"), strict=True):
            if kind == WORDS:
                tokens = _parted(asked_.as_py())
                places = placed(keys_of(tokens), buckets)
                counts.append(_squeezed(np.array([words.get(t, 0) for t in tokens], np.int64)))
            else:
                places = _unpack(asked_.as_py())
                counts.append(None)
            levels.append(_squeezed(asked(bits, 0, np.uint64(len(bits)), _salted(places, kind))))
        return pa.table({"chunk": questions.column("chunk"), "bucket": questions.column("bucket"), "kind": questions.column("kind"), "levels": pa.array(levels, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, texts in _chunks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(texts)
            yield pa.record_batch({"chunk": pa.array([number], pa.int64()), "texts": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def score(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], tuple] = {}
        for kind, b, x, c in zip(*(answers.column(n) for n in ("kind", "bucket", "levels", "counts")), strict=True):
            found[kind.as_py(), b.as_py()] = x, c  # alike, if there is more than one

        def all_of(kind: int, at: int, size: type) -> np.ndarray:
            return np.concatenate([np.empty(0, size), *(_loosened(found[k][at].as_py(), size) for k in sorted(found) if k[0] == kind)])

        words, pairs, counts = all_of(WORDS, 0, np.uint8), all_of(WORD_PAIRS, 0, np.uint8), all_of(WORDS, 1, np.int64)
        out = []
        for texts in chunks.column("texts"):  # more than one, if rows alike fill whole chunks
            batch = pa.ipc.open_stream(texts.as_py()).read_all().combine_chunks().to_batches()[0]
            asking = Questions(list(pieces(batch.column("text"), True)))
            if (len(asking.words), len(asking.pairs)) != (len(words), len(pairs)):
                raise RuntimeError("the documents came in another order the second time; write them to a table first")
            out.append(_beside(batch, asking.sums(counts, words, pairs, total, distinct)))
        return pa.Table.from_batches(out, None if out else nothing)

    nothing = pa.schema([*rows.select("id", "held_out").limit(0).toArrow().schema, ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
    questions = rows.select("uid", "text").mapInArrow(ask, "bucket long, chunk long, kind int, keys binary")
    own = slices.select("bucket", "bits", "tokens", "counts").groupBy("bucket")
    answers = questions.groupBy("bucket").cogroup(own).applyInArrow(answer, "chunk long, bucket long, kind int, levels binary, counts binary")
    chunks = rows.mapInArrow(packed, "chunk long, texts binary")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema)


def _by_broadcast(packed: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _score(batches, gathered(*packed.value))

    return run


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score); learns from the rows that aren't held out."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.xxhash64(id_col, text_col).alias("uid"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // (6 * BUCKET)))  # words have about six bytes
    slices = build_slices(rows.filter(~F.col("held_out")).select("text"), buckets)
    total, distinct, size = (x or 0 for x in slices.agg(F.sum("n"), F.sum("v"), F.sum("size")).first())
    schema = f"id {dict(rows.dtypes)['id']}, held_out boolean, n_tokens long, n_known long, base double, score double"
    if size <= FILTER_BYTES:
        held = [(r["bucket"], bytes(r["bits"]), bytes(r["tokens"]), bytes(r["counts"])) for r in slices.collect()]
        packed = spark.sparkContext.broadcast((held, buckets, total, distinct))
        scored = rows.mapInArrow(_by_broadcast(packed), schema)
    else:
        scored = _routed(rows, slices, buckets, total, distinct, schema)
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


_models: dict[int, Model] = {}  #: of a worker, the last broadcast only
