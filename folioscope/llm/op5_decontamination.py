"""Benchmark decontamination: passages as BM25 queries against an index of test items.

Texts are cut into words of letters and digits.  A document's passages are
windows twice as long as the longest item that start every item's length, so any
item lies whole in one passage.  Every passage is a query.  An item's BM25 score
is divided by the score that its own words would get, and all items of
``threshold`` or more are retrieved with block-max WAND, a batch of passages at
a time: rare terms' postings are walked; the other terms add no more than their
maximum within the item's block of postings, and items that cannot reach the
threshold so are passed over; the rest are scored exactly.  A retrieved item is a
leak if the passage holds the share ``overlap`` of the five-word shingles both of
its question and of its answer, or that share of the whole item's: a word changed
in the one part weighs more there than in the whole, and an item without its answer
doesn't reach the share.

Items come in blocks of ``BLOCK_ITEMS``, each with an index of its own, so what
travels to the workers has a fixed bound; each block is a pass over the
documents.  Numbers of items with a term, mean length and passage length are
those of all items, so the blocks change no score and no result.  Where the items
have no column of answers, their last quarter (five words at least) counts as the
answer.

Defined cases: null, empty and short texts leak nothing; items without words are
never found; shorter questions or answers than five words are one shingle; null
or repeated ids are rows like any other; empty tables give no leaks; other
columns pass through ``decontaminate`` unchanged and are not read by ``leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import hold
from folioscope.llm.words import PUNCTUATION, Piece, pieces, window_hashes
from folioscope.shipping import ship

BLOCK_ITEMS = 20_000
THRESHOLD = 0.6
OVERLAP = 0.8
WIDTH = 5
K1, B = 1.2, 0.75
POSTING_BLOCK = 16  #: items that share a block maximum


def _shingles(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    width = min(WIDTH, len(hashes))
    return width, np.unique(window_hashes(hashes, width)) if width else np.empty(0, np.uint64)


def _parts(question: str | None, answer: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of question and answer; without an answer, the question's last quarter is taken."""
    q, a = (next(pieces(pa.array([t or ""], pa.string()), True, PUNCTUATION)).hashes() for t in (question, answer))
    if answer is None and len(q) >= 2 * WIDTH:
        cut = len(q) - max(WIDTH, len(q) // 4)
        q, a = q[:cut], q[cut:]
    return q, a


@dataclass(frozen=True)
class Statistics:
    """What BM25 takes from all items: items with words, their words, the longest, and the items that have a term."""

    items: int
    words: int
    longest: int
    terms: np.ndarray  #: hashes in order
    having: np.ndarray  #: number of items with each term


@dataclass
class Index:
    """Inverted index of items, impacts divided by the items' own scores."""

    ids: list
    terms: np.ndarray  #: hashes in order
    rare: np.ndarray  #: whether a term's postings are walked
    first: np.ndarray  #: first posting of each term
    items: np.ndarray  #: item of each posting, in order within a term
    impacts: np.ndarray
    keys: np.ndarray  #: term and item of each posting in one number, in order
    row: np.ndarray  #: of a common term in ``most``
    most: np.ndarray  #: maximum impact of common terms by block
    questions: list[tuple[int, np.ndarray]]
    answers: list[tuple[int, np.ndarray]]
    wholes: list[tuple[int, np.ndarray]]
    stride: int  #: words of the longest of all items


def build_index(items: list[tuple[object, str | None, str | None]], statistics: Statistics | None = None) -> Index | None:
    """Index of (id, question, answer); if these are not all items, ``statistics`` are those of all."""
    ids, bags, questions, answers, wholes = [], [], [], [], []
    for item, question, answer in items:
        q, a = _parts(question, answer)
        if len(q) + len(a):
            ids.append(item)
            bags.append(np.concatenate([q, a]))
            questions.append(_shingles(q))
            answers.append(_shingles(a))
            wholes.append(_shingles(bags[-1]))
    if not ids:
        return None
    lengths = np.array([len(b) for b in bags])
    rows = [np.unique(b, return_counts=True) for b in bags]
    hashes = np.concatenate([r[0] for r in rows])
    tf = np.concatenate([r[1] for r in rows]).astype(float)
    owner = np.repeat(np.arange(len(bags)), [len(r[0]) for r in rows])
    terms, term = np.unique(hashes, return_inverse=True)
    df = np.bincount(term)
    every = statistics or Statistics(len(ids), int(lengths.sum()), int(lengths.max()), terms, df)
    having = every.having[np.searchsorted(every.terms, terms)]
    idf = np.log1p((every.items - having + 0.5) / (having + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[owner] / (every.words / every.items)))
    impact /= np.bincount(owner, impact)[owner]
    order = np.lexsort((owner, term))
    first = np.concatenate(([0], np.cumsum(df)))
    rare = df <= max(8, len(ids) // 20)
    row = np.where(rare, -1, np.cumsum(~rare) - 1)
    most = np.zeros((int((~rare).sum()) + 1, (len(ids) - 1) // POSTING_BLOCK + 1))
    common = ~rare[term]
    np.maximum.at(most, (row[term[common]], owner[common] // POSTING_BLOCK), impact[common])
    return Index(ids, terms, rare, first, owner[order], impact[order], term[order] * len(ids) + owner[order], row, most, questions, answers, wholes, every.longest)


def _expand(index: Index, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All postings of the terms: which of the terms each belongs to, and the postings."""
    n = index.first[terms + 1] - index.first[terms]
    of = np.repeat(np.arange(len(terms)), n)
    return of, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + index.first[terms][of]


def _passages(piece: Piece, hashes: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (passage, term) pairs in order, and the first slot of each text: a passage is two slots of ``stride`` words."""
    at = np.searchsorted(index.terms, hashes)
    at[at == len(index.terms)] = 0
    known = np.flatnonzero(index.terms[at] == hashes)
    term = at[known]
    sizes = np.diff(piece.counts)
    slots = -(-sizes // index.stride)
    base = np.concatenate(([0], np.cumsum(slots)))
    owner = np.searchsorted(piece.counts, known, "right") - 1
    slot = (known - piece.counts[owner]) // index.stride
    alone = (slot == 0) | (slot < slots[owner] - 1)  # a text's last slot is in the passage before
    passage = np.concatenate([(base[owner] + slot)[alone], (base[owner] + slot - 1)[slot > 0]])
    key = np.unique(passage * len(index.terms) + np.concatenate([term[alone], term[slot > 0]]))
    return key // len(index.terms), key % len(index.terms), base


def retrieve(piece: Piece, hashes: np.ndarray, index: Index, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages, items and scores that reach the threshold; and the first slot of each text."""
    passage, term, base = _passages(piece, hashes, index)
    none = np.empty(0, np.int64)
    if not len(passage):
        return none, none, np.empty(0), base
    threshold -= 1e-9
    n = len(index.ids)
    starts = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    group = np.cumsum(np.append(False, passage[1:] != passage[:-1]))
    bounds = np.add.reduceat(index.most[np.where(index.rare[term], len(index.most) - 1, index.row[term])], starts)  # the last row is zero
    rare = np.flatnonzero(index.rare[term])
    of, posting = _expand(index, term[rare])
    pairs, where = np.unique(group[rare][of] * n + index.items[posting], return_inverse=True)
    scores = np.bincount(where, index.impacts[posting], len(pairs))
    g, item = pairs // n, pairs % n
    alive = scores + bounds[g, item // POSTING_BLOCK] >= threshold
    g, item = g[alive], item[alive]
    whole_g, whole_block = np.nonzero(bounds >= threshold)  # blocks whose items need no rare term
    if len(whole_g):
        more = (whole_block[:, None] * POSTING_BLOCK + np.arange(POSTING_BLOCK)).ravel()
        more_g = np.repeat(whole_g, POSTING_BLOCK)[more < n]
        both = np.unique(np.concatenate([g * n + item, more_g * n + more[more < n]]))
        g, item = both // n, both % n
    if not len(g):
        return none, none, np.empty(0), base
    stops = np.append(starts[1:], len(passage))
    size = stops[g] - starts[g]
    which = np.repeat(np.arange(len(g)), size)
    t = term[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + starts[g][which]]
    wanted = t * n + item[which]
    at = np.minimum(np.searchsorted(index.keys, wanted), len(index.keys) - 1)
    exact = np.bincount(which, np.where(index.keys[at] == wanted, index.impacts[at], 0.0), len(g))
    ok = exact >= threshold
    return passage[starts][g[ok]], item[ok], exact[ok], base


def _overlap(hashes: np.ndarray, wanted: tuple[int, np.ndarray]) -> float:
    width, shingles = wanted
    if not len(shingles):
        return 1.0
    return float(np.isin(shingles, window_hashes(hashes, width)).mean())


def find_leaks(texts: pa.Array, index: Index, threshold: float, overlap: float) -> Iterator[tuple[int, int, float, float, float, float]]:
    """Of each text and item that it leaks: their numbers, the best score, overlap of question, answer and item."""
    for piece in pieces(texts, True, PUNCTUATION):
        hashes = piece.hashes()
        passages, items, scores, base = retrieve(piece, hashes, index, threshold)
        best: dict[tuple[int, int], tuple[float, float, float, float]] = {}
        for p, i, s in zip(passages.tolist(), items.tolist(), scores.tolist(), strict=True):
            k = int(np.searchsorted(base, p, "right")) - 1
            start = int(piece.counts[k]) + (p - int(base[k])) * index.stride
            own = hashes[start : min(start + 2 * index.stride, int(piece.counts[k + 1]))]
            q, a, w = (_overlap(own, part[i]) for part in (index.questions, index.answers, index.wholes))
            if (q >= overlap and a >= overlap) or w >= overlap:
                best[k, i] = max(best.get((k, i), (0.0, 0.0, 0.0, 0.0)), (s, q, a, w))
        for (k, i), found in sorted(best.items()):
            yield piece.first + k, i, *found


def _tally(rows: DataFrame) -> DataFrame:
    """Rows (block, term, having) for each block's terms, and one (block, null, items, words, longest) for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            bags = [np.concatenate(_parts(q.as_py(), a.as_py())) for q, a in zip(batch.column(1), batch.column(2), strict=True)]
            lengths = np.array([len(b) for b in bags], np.int64)
            names = ["block", "term", "items", "words", "longest"]
            if (lengths > 0).any():
                summary = [[0], [None], [int((lengths > 0).sum())], [int(lengths.sum())], [int(lengths.max())]]
                yield pa.record_batch([pa.array(x, pa.int64()) for x in summary], names=names)
                distinct = [np.unique(b) for b in bags]
                term = np.concatenate(distinct).view(np.int64)
                of = np.repeat(block, [len(d) for d in distinct])
                both, n = np.unique(np.stack([of, term]), axis=1, return_counts=True)
                none = pa.nulls(len(n), pa.int64())
                yield pa.record_batch([pa.array(both[0]), pa.array(both[1]), pa.array(n, pa.int64()), none, none], names=names)

    return rows.select("block", "q", "a").mapInArrow(run, "block long, term long, items long, words long, longest long")


def indexes(items: DataFrame, item_col: str = "item_id", text_col: str = "text", answer_col: str | None = None) -> Iterator[Index]:
    """Indexes of the items, a block at a time; each block has ``BLOCK_ITEMS`` items or about that."""
    ship(items.sparkSession)
    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("q"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("a"))
    blocks = -(-rows.count() // BLOCK_ITEMS)
    if blocks == 1 and (index := build_index(sorted(map(tuple, rows.collect()), key=str))):
        yield index
    if blocks < 2:
        return
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item", "q", "a"), F.lit(blocks)))
    tally = hold(_tally(rows))
    every = tally.filter("term IS NULL").agg(F.sum("items"), F.sum("words"), F.max("longest")).first()
    mine = tally.filter("term IS NOT NULL")
    having = hold(mine.select("block", "term").distinct().join(mine.groupBy("term").agg(F.sum("items").alias("having")), "term"))
    for k in range(blocks):
        found = having.filter(F.col("block") == k).select("term", "having").toArrow()
        terms = found["term"].to_numpy().view(np.uint64)
        order = np.argsort(terms)
        statistics = Statistics(*every, terms[order], found["having"].to_numpy()[order])
        block = rows.filter(F.col("block") == k).drop("block").collect()
        if index := build_index(sorted(map(tuple, block), key=str), statistics):
            yield index


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """Rows (id, item, score, question_overlap, answer_overlap, item_overlap): every item that a document leaks."""
    ship(docs.sparkSession)
    kind, item_kind = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_col]
    schema = f"id {kind}, item {item_kind}, score double, question_overlap double, answer_overlap double, item_overlap double"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(items, item_col, item_text_col, answer_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(find_leaks(batch.column(1), shared.value, threshold, overlap))
                if found:
                    row, item, *rest = zip(*found, strict=True)
                    ids = [shared.value.ids[i] for i in item]
                    yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(ids), *map(pa.array, rest)], names=["id", "item", "score", "question_overlap", "answer_overlap", "item_overlap"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    ship(docs.sparkSession)
    for index in indexes(items, item_col, item_text_col, answer_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), bool)
                for row, *_ in find_leaks(batch.column(text_col), shared.value, threshold, overlap):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
