"""Quality classifier from weak labels.

Overlapping heuristic labellers vote keep, reject or nothing on a text: three about
its form (symbols, capitals, and repetition of words, phrases or neighbours,
which go together and so are one labeller) and four about insults (two lists of words, several in one text,
and their share of the words).
For form and for insults, expectation-maximisation over the votes estimates how
often each labeller votes what in good and in bad texts, and gives each pattern
of votes a posterior; where labels are given, they hold the posterior near
theirs.  Labelled rows, with ``PSEUDO`` rows of a prior beside them, weigh as much
as the unlabelled ones where these are more: bad texts mostly have one fault
each, so votes alone do not tell two classes apart, and labels must say which
is which, however many documents there are.  The two posteriors make the label a text is trained with, and a logistic
model over hashed features (words, beginnings and ends of words, the labellers'
own rejections) is fitted to these.  Where there are labels, a text without one
is only trained on if it is probably bad: that no labeller objects says little
about insults that none knows; the labelled texts to which none objects stand for
the unlabelled such, too, by weight.  Only the fitted model meets the whole corpus.

Votes are tallied, and the labellers' rates estimated, over all documents.  The
fit uses about ``SAMPLE`` documents, those with the lowest hashes of id and text
among the labelled ones, and others only where there are fewer labelled ones; the
bound is a parameter.  Features must occur in
``SUPPORT`` sample documents and point to rejection in ``PRECISION`` of them,
counted by weight and with one unseen good text where weights are above 1.

Defined cases: null and empty texts have no features and are kept, as is any text
on which nothing speaks for rejection; null labels are no labels, and of
repeated labels the worse counts; null or repeated ids are rows like any other;
empty tables give an empty result, and without labels the heuristics are left;
other columns pass through ``keep_good`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import hold
from folioscope.llm.words import PUNCTUATION, Piece, mix64, owners_of, pieces, window_hashes
from folioscope.shipping import ship

SAMPLE = 20_000
SUPPORT = 6
PRECISION = 0.8
PSEUDO = 20  #: labelled rows that the prior of the labellers' rates is worth
BITS = 20  #: the model has 2**BITS hashed weights
#: English insults that the labellers know, names for people and judgements.
NAMES = ("idiot", "moron", "loser", "scum", "clown")
JUDGEMENTS = ("stupid", "trash", "worthless", "pathetic", "disgusting")
KEEP, REJECT, NONE = 0, 1, 2
FORM = ("symbols", "capitals", "repetition")
RUDE = ("names", "judgements", "several", "share")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*|<>{}~^=@\\_"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _vote(share: np.ndarray, low: float, high: float, speaks: np.ndarray) -> np.ndarray:
    return np.where(~speaks, NONE, np.where(share > high, REJECT, np.where(share < low, KEEP, NONE))).astype(np.int8)


def _hashes_of(words: tuple[str, ...]) -> np.ndarray:
    return np.sort(np.concatenate([next(pieces(pa.array([w]), True, PUNCTUATION)).hashes() for w in words]))


_LISTS = _hashes_of(NAMES), _hashes_of(JUDGEMENTS)


def votes(piece: Piece) -> np.ndarray:
    """A row per text: the votes of the labellers of form, and of those of insults."""
    n_bytes, n = np.diff(piece.offsets), np.diff(piece.counts)
    hashes, owner = piece.hashes(), owners_of(piece.counts)
    letters = _sums(_LETTER[piece.data], piece.offsets)
    symbols = _sums(_SYMBOL[piece.data], piece.offsets) / np.maximum(1, n_bytes)
    capitals = _sums(_UPPER[piece.data], piece.offsets) / np.maximum(1, letters)
    key = (owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))
    order = np.sort(key)
    starts = np.flatnonzero(np.append(True, order[1:] != order[:-1])) if len(order) else np.empty(0, np.int64)
    runs = np.diff(np.append(starts, len(order)))
    most = np.zeros(len(piece), np.int64)
    np.maximum.at(most, (order[starts] >> np.uint64(40)).astype(np.int64), runs)
    beside = np.zeros(len(hashes), bool)
    beside[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    width = 5
    windows = window_hashes(hashes, width)
    inside = np.flatnonzero(owner[: len(windows)] == owner[width - 1 :]) if len(windows) else np.empty(0, np.int64)
    phrase = np.sort((owner[inside].astype(np.uint64) << np.uint64(40)) | (windows[inside] >> np.uint64(24)))
    again = np.bincount((phrase[1:][phrase[1:] == phrase[:-1]] >> np.uint64(40)).astype(np.int64), minlength=len(piece))
    bare = replace(piece, data=_LOWER[piece.data])
    plain = next(pieces(pa.Array.from_buffers(pa.large_string(), len(piece), [None, pa.py_buffer(piece.offsets.astype(np.int64).tobytes()), pa.py_buffer(bare.data.tobytes())]), False, PUNCTUATION), None) if len(piece.data) else None
    insults = np.zeros((len(_LISTS), len(piece)), np.int64)
    if plain is not None and len(plain) == len(piece):
        h, whose = plain.hashes(), owners_of(plain.counts)
        for k, known in enumerate(_LISTS):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            insults[k] = np.bincount(whose[known[at] == h], minlength=len(piece))
    out = np.empty((len(piece), len(FORM) + len(RUDE)), np.int8)
    repeats = np.stack([
        _vote(most / np.maximum(1, n), 0.2, 0.3, n >= 10),
        _vote(again / np.maximum(1, n), 0.05, 0.2, n >= 10),
        _vote(_sums(beside, piece.counts) / np.maximum(1, n), 0.03, 0.15, n >= 10),
    ])
    out[:, 0] = _vote(symbols, 0.01, 0.04, n_bytes >= 20)
    out[:, 1] = _vote(capitals, 0.15, 0.3, letters >= 20)
    out[:, 2] = np.where((repeats == REJECT).any(0), REJECT, np.where((repeats == KEEP).all(0), KEEP, NONE))
    both = insults.sum(0)
    rude = np.stack([*(insults > 0), both > 1, both > 0.01 * n])  # none of these ever says keep
    out[:, len(FORM) :] = np.where(rude, REJECT, NONE).T
    return out


def features(piece: Piece, cast: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, feature) with repeats: hashed words, their beginnings and ends, and rejecting labellers."""
    low = replace(piece, data=_LOWER[piece.data])
    # Punctuation at a word's edge isn't part of it; its last bytes are a feature of their own.
    edge = PUNCTUATION[piece.data]
    starts, ends = piece.starts.copy(), piece.ends.copy()
    for _ in range(4):
        trim = (starts < ends) & edge[np.minimum(starts, len(edge) - 1)]
        starts[trim] += 1
        trim = (starts < ends) & edge[ends - 1]
        ends[trim] -= 1
    owner = owners_of(piece.counts)
    length = ends - starts
    views = [(starts, ends, length > 0, 1)]
    views += [(starts, np.minimum(starts + k, ends), length > k, 1 + k) for k in (4, 5, 6, 7, 8)]
    views += [(np.maximum(piece.ends - 3, piece.starts), piece.ends, edge[piece.ends - 1] if len(edge) else length > 0, 20)]
    texts, found = [], []
    for a, b, ok, salt in views:
        h = replace(low, starts=a[ok], ends=b[ok]).hashes()
        texts.append(owner[ok])
        found.append(mix64(h, salt))
    rows, labeller = np.nonzero(cast == REJECT)
    texts.append(rows)
    found.append(mix64(labeller.astype(np.uint64), 30))
    return np.concatenate(texts), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def estimate(cast: np.ndarray, given: np.ndarray | None = None, prior: float = 0.2, pseudo: float = PSEUDO, rounds: int = 100, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """EM over votes (rows of KEEP, REJECT, NONE): the posterior of rejection by row, and each labeller's vote rates by class.

    Starts from any rejection as a likely one.  ``pseudo`` rows of a prior, as good
    as labelled ones, are of labellers that seldom reject good texts but miss
    most kinds of bad ones, and of a share ``prior`` of bad texts.
    ``given`` has known labels, or NONE; ``times`` how often each row counts.
    Labelled rows and the prior weigh at least as much as the other rows together.
    """
    times = np.ones(len(cast)) if times is None else times.astype(float)
    told = given != NONE if given is not None else np.zeros(len(cast), bool)
    fixed = np.where(given[told] == REJECT, 0.98, 0.02) if given is not None else np.empty(0)
    sure = times[told].sum() + pseudo
    scale = max(1.0, times[~told].sum() / sure) if sure else 1.0
    times, pseudo = np.where(told, times * scale, times), pseudo * scale
    hot = np.stack([cast == v for v in (KEEP, REJECT, NONE)], 2).astype(float)
    post = np.where((cast == REJECT).any(1), 0.8, prior / 4)
    post[told] = fixed
    rates = np.empty((2, cast.shape[1], 3))
    trust = np.array([[0.95, 0.005, 0.045], [0.65, 0.25, 0.1]]) * pseudo + 0.01
    for _ in range(rounds):
        for y, weight in enumerate((1 - post, post)):
            rates[y] = ((weight * times)[:, None, None] * hot).sum(0) + trust[y]
            rates[y] /= rates[y].sum(1, keepdims=True)
        share = np.clip(((post * times).sum() + pseudo * prior) / (times.sum() + pseudo), 0.005, 0.95)
        logs = [(hot * np.log(rates[y])).sum((1, 2)) for y in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - share) / share), -50, 50)))
        new[told] = fixed
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return post, rates


@dataclass
class Model:
    weights: np.ndarray  #: of hashed features, towards rejection
    bias: float
    rates: dict[str, list]  #: estimated vote rates of the labellers, good and bad texts

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Log-odds of rejection of each text."""
        out = np.full(len(texts), self.bias)
        for piece in pieces(texts, False):
            row, feature = features(piece, votes(piece))
            some = self.weights[feature] != 0
            pairs = np.unique((row[some] << BITS) | feature[some])
            out[piece.first : piece.first + len(piece)] += np.bincount(pairs >> BITS, self.weights[pairs & ((1 << BITS) - 1)], len(piece))
        return out


def _fit(rows: list[np.ndarray], target: np.ndarray, times: np.ndarray, rounds: int = 400, penalty: float = 1e-4) -> tuple[dict[int, float], float]:
    """Logistic regression on sparse presences by gradient steps; weights stay towards rejection; a row counts ``times`` times."""
    known = np.unique(np.concatenate(rows)) if rows else np.empty(0, np.int64)
    at = np.searchsorted(known, np.concatenate(rows)) if rows else known
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, bias, g2, b2 = np.zeros(len(known)), -2.0, np.full(len(known), 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(owner, w[at], len(rows)), -50, 50)))
        error = (p - target) * times
        grad, grad_b = np.bincount(at, error[owner], len(known)) + penalty * w * times.sum(), error.sum()
        g2, b2 = g2 + grad * grad, b2 + grad_b * grad_b
        w, bias = np.maximum(0.0, w - 0.5 * grad / np.sqrt(g2)), bias - 0.5 * grad_b / b2**0.5
    return dict(zip(known.tolist(), w.tolist(), strict=True)), float(bias)


def train(docs: DataFrame, labels: DataFrame | None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", toxic_col: str = "toxic") -> Model:
    """Fits the labellers' rates and the model on about ``sample`` documents."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("uid"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1), False):
                own = [batch.column(k).slice(piece.first, len(piece)) for k in (0, 2)]
                yield pa.record_batch([*own, pa.array([x.tobytes() for x in votes(piece)], pa.binary())], names=["id", "uid", "cast"])

    cast = rows.mapInArrow(vote, f"id {dict(rows.dtypes)['id']}, uid long, cast binary")
    if labels is not None:
        given = labels.select(F.col(id_col).alias("id"), F.col(quality_col).alias("quality"), F.col(toxic_col).alias("toxic"))
        cast = cast.join(given.groupBy("id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")), "id", "left")
    else:
        cast = cast.withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    cast = hold(cast.select("uid", "cast", F.coalesce(1 - F.col("quality"), F.lit(NONE)).cast("int").alias("bad"), F.coalesce("toxic", F.lit(NONE)).cast("int").alias("toxic")))
    tally = cast.groupBy("cast", "bad", "toxic").count().collect()  # 3 ** 5 * 2 ** 4 patterns at most
    if not tally:
        return Model(np.zeros(1 << BITS), -2.0, {})
    tally.sort(key=lambda r: (bytes(r["cast"]), r["bad"], r["toxic"]))
    patterns = np.array([[*np.frombuffer(r["cast"], np.int8), r["bad"], r["toxic"]] for r in tally], np.int8)
    times = np.array([r["count"] for r in tally])
    labelled = int(times[(patterns[:, -2:] != NONE).any(1)].sum())
    shares = min(1.0, sample / max(1, labelled)), min(1.0, max(0, sample - labelled) / max(1, int(times.sum()) - labelled))
    known, other = (F.lit(int(x * (1 << 20))) for x in shares)
    chosen = cast.filter(F.pmod("uid", F.lit(1 << 20)) < F.when((F.col("bad") != NONE) | (F.col("toxic") != NONE), known).otherwise(other))
    chosen = chosen.select("uid", "bad", "toxic").dropDuplicates(["uid"])  # about the sample
    rows = hold(rows.join(F.broadcast(chosen), "uid").select("text", "bad", "toxic"))
    n = len(FORM)
    bad, form_rates = estimate(patterns[:, :n], patterns[:, -2], times=times)
    silent_is_keep = np.where(patterns[:, n:-2] == REJECT, REJECT, KEEP)
    rude, insult_rates = estimate(silent_is_keep, patterns[:, -1], prior=0.05, times=times)
    both = 1 - (1 - bad) * (1 - rude)
    open_ = (patterns[:, -2:] == NONE).any(1)
    both[open_ & ~open_.all() & (both < 0.5)] = np.nan  # not trained on
    calm = (patterns[:, :-2] != REJECT).all(1)
    chance = times * np.where((patterns[:, -2:] != NONE).any(1), *shares)  # about the rows in the sample
    stands_for = float(chance[calm].sum() / max(1.0, chance[calm & ~np.isnan(both)].sum()))
    posterior = dict(zip([x.tobytes() for x in patterns], zip(both.tolist(), np.where(calm, stands_for, 1.0).tolist(), strict=True), strict=True))

    def targets(piece: Piece, batch: pa.RecordBatch, cast: np.ndarray) -> np.ndarray:
        """Rows (target, weight) of a piece's texts."""
        given = [np.asarray(batch.column(k)).astype(np.int8)[piece.first : piece.first + len(piece), None] for k in (1, 2)]
        return np.array([posterior[x.tobytes()] for x in np.concatenate([cast, *given], 1)])

    def trained(piece: Piece, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Targets and weights of a piece's texts, and distinct (text, feature) pairs of those that are trained on."""
        cast = votes(piece)
        target, weight = targets(piece, batch, cast).T
        row, feature = features(piece, cast)
        some = ~np.isnan(target[row])
        pairs = np.unique((row[some] << BITS) | feature[some])
        return target, weight, pairs >> BITS, pairs & ((1 << BITS) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(0), False):
                target, weight, row, feature = trained(piece, batch)
                own, at = np.unique(feature, return_inverse=True)
                bad, good = (np.bincount(at, weight[row] * side, len(own)) for side in (target[row] >= 0.5, target[row] < 0.5))
                yield pa.record_batch({"feature": pa.array(own, pa.int64()), "n": pa.array(np.bincount(at, minlength=len(own)), pa.int64()), "bad": pa.array(bad, pa.float64()), "good": pa.array(good, pa.float64())})

    telling = rows.mapInArrow(count, "feature long, n long, bad double, good double").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")])
    telling = telling.filter((F.col("n") >= SUPPORT) & (F.col("bad") >= PRECISION * (F.col("bad") + F.col("good") + stands_for - 1))).select("feature").collect()  # 2 ** BITS at most
    wanted = np.zeros(1 << BITS, bool)
    wanted[[r["feature"] for r in telling]] = True

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(0), False):
                target, weight, row, feature = trained(piece, batch)
                row, feature = row[wanted[feature]], feature[wanted[feature]].astype("<u4")
                cuts = np.searchsorted(row, np.arange(len(piece) + 1))
                lists = [feature[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                some = ~np.isnan(target)
                yield pa.record_batch({"target": pa.array(target[some]), "weight": pa.array(weight[some]), "features": pa.array([x for x, s in zip(lists, some.tolist(), strict=True) if s], pa.binary())})

    found = rows.mapInArrow(present, "target double, weight double, features binary").toArrow()  # a row for each sample document
    found = found.sort_by([(c, "ascending") for c in ("target", "weight", "features")])  # sums don't depend on the order of tasks
    fitted, bias = _fit([np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in found.column("features")], np.asarray(found.column("target")), np.asarray(found.column("weight")))
    weights = np.zeros(1 << BITS)
    for feature, w in fitted.items():
        weights[feature] = w
    return Model(weights, bias, {x: form_rates[:, i].tolist() for i, x in enumerate(FORM)} | {x: insult_rates[:, i].tolist() for i, x in enumerate(RUDE)})


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score, keep): the log-odds of keeping each document, and whether it is kept."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = -shared.value.scores(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(scores), pa.array(scores >= 0)], names=["id", "score", "keep"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, keep boolean").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that the model keeps, with all their columns."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(text_col)) <= 0))

    return docs.mapInArrow(run, docs.schema)
