"""Secret scans: fixed patterns, and a likelihood ratio of two character models.

The patterns (assign, access, hex) give the base spans.  Beside them, every run
of ``least`` or more key characters is weighed by two first-order Markov models of
characters, one of random strings and one of ordinary identifiers and words, each
character by the log-likelihood ratio, in nats, of following the one before it.
The part of ``least`` or more characters with the highest sum is widened to the
next ``/ _ = -`` or end of the run on both sides and is a span of kind ``markov`` if
its sum reaches ``threshold`` before and after; what lies before and behind a span is
searched in turn, so a key at the end of a long path is found.  Markov spans don't look at
base spans: a key that a pattern finds is found by the models too.

The models are trained from labelled samples.  ``labelled_samples`` draws a fixed,
seeded set of both kinds; ``corpus_counts`` takes from all documents the values
that the patterns find as random, and as ordinary all other runs that are too short
to be asked about, so no unlabelled key passes for ordinary.  Each source of samples
has half the weight, however large it is.

Defined cases: null and empty texts have no spans; texts are scanned whole;
null or repeated ids are rows like any other; an empty table gives no rows;
other columns are not read.  Documents without key characters leave the models to
the drawn samples.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from folioscope.shipping import ship

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
THRESHOLD = 15.0
_WIDTH = len(ALPHABET)
LEAST = 20
EDGES = "/_=-"

_WORDS = (
    "get set read write open close user name file path index value count list item data node tree table column row key map hash sort filter join group order by with from "
    "to and the of in on for is was that this are not handle request response client server session manager service controller factory builder parser reader writer stream "
    "buffer cache queue thread lock event message error warning config option setting default parameter argument function method class object module package version build "
    "test spec mock fixture example sample document text word line page section chapter header footer title author date time year month day hour minute second number total "
    "sum average minimum maximum range limit offset length size width height color style theme image video audio input output result status state change update delete "
    "insert create select where having between international communication responsibility understanding characterization implementation configuration transformation "
    "und der die das ist nicht mit ein eine auch sich werden haben gesellschaft wissenschaft verantwortung entwicklung moglichkeit geschwindigkeit "
    "les des une est dans pour que qui avec sur par gouvernement developpement etablissement naturellement mouvement information question nation "
    "los las una por para con como pero desarrollo informacion universidad conocimiento naturaleza gobierno mente cion direccion"
).split()


def labelled_samples(n: int = 4000, seed: int = 7) -> Iterator[tuple[str, bool]]:
    """Pairs (string, is random): a fixed set of random keys and of ordinary identifiers, paths, dates and words."""
    r = random.Random(seed)
    upper, lower, digits = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
    for _ in range(n):
        letters = r.choice((upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_", lower + digits, upper + digits, digits + "abcdef"))
        yield "".join(r.choices(letters, k=r.randrange(20, 65))), True
        words = r.choices(_WORDS, k=r.randrange(2, 7))
        style = r.randrange(9)
        if style == 0:
            text = words[0] + "".join(w.title() for w in words[1:])
        elif style == 1:
            text = "".join(w.title() for w in words)
        elif style < 5:
            text = r.choice("_-/=").join(words)
        elif style == 5:
            text = "_".join(words).upper()
        elif style == 6:
            text = "".join(words) + str(r.randrange(2030))
        elif style == 7:
            text = r.choice("_-/").join(f"{r.randrange(100):02}" if r.random() < 0.6 else str(1900 + r.randrange(200)) for _ in range(r.randrange(3, 16)))
        else:
            text = r.choice(("-", "=", "_", "/", "+")) * r.randrange(20, 60) if r.random() < 0.3 else "".join(words)
        yield text, False


_PLACE = np.full(256, -1, np.int64)
_PLACE[[ord(c) for c in ALPHABET]] = np.arange(_WIDTH)


def transitions(text: str) -> np.ndarray:
    """How often each key character follows each other; row 0 counts those that follow none."""
    at = _PLACE[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    before = np.append(-1, at[:-1])
    known = at >= 0
    return np.bincount((before[known] + 1) * _WIDTH + at[known], minlength=(_WIDTH + 1) * _WIDTH).reshape(_WIDTH + 1, _WIDTH)


def _halved(counts: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Both counts, the second weighed to the sum of the first."""
    return counts + more * (counts.sum() / more.sum()) if more.sum() else counts


def train(samples: Iterable[tuple[str, bool]], corpus: np.ndarray | None = None, floor: float = 0.5) -> np.ndarray:
    """Log-likelihood ratios, random against ordinary, of each character after each; row 0 holds those of a first character.

    ``corpus`` has further counts of transitions, ordinary and random.
    """
    counts = np.zeros((2, _WIDTH + 1, _WIDTH))
    for text, is_random in samples:
        counts[int(is_random)] += transitions(text)
    if corpus is not None:
        counts = np.stack([_halved(c, m) for c, m in zip(counts, corpus, strict=True)])
    counts += floor
    logs = np.log(counts) - np.log(counts.sum(2, keepdims=True))
    return logs[1] - logs[0]


def corpus_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Transitions in all documents, ordinary and random: of runs shorter than ``LEAST``, and of the patterns' values."""
    ship(docs.sparkSession)
    size = 2 * (_WIDTH + 1) * _WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, _WIDTH + 1, _WIDTH), np.int64)
        for batch in batches:
            for cell in batch.column(0):
                text = cell.as_py() or ""
                keys, rest = [], []
                end = 0
                for start, stop in values(text):
                    rest.append(text[end:start])
                    keys.append(text[start:stop])
                    end = stop
                counts[0] += transitions(RUN.sub(" ", " ".join([*rest, text[end:]])))
                if keys:
                    counts[1] += transitions(" ".join(keys))
        flat = counts.ravel()
        cells = np.flatnonzero(flat)
        yield pa.record_batch([pa.array(cells, pa.int32()), pa.array(flat[cells], pa.int64())], names=["cell", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(2, _WIDTH + 1, _WIDTH)


def likelihood_ratio(run: str, model: np.ndarray) -> float:
    return float(_ratios(run, model).sum())


def _ratios(run: str, model: np.ndarray) -> np.ndarray:
    at = _PLACE[np.frombuffer(run.encode("ascii"), np.uint8)]
    return model[np.append(0, at[:-1] + 1), at]


def best_part(ratios: np.ndarray, least: int) -> tuple[int, int, float]:
    """Start, end and sum of the part of ``least`` or more values with the highest sum; the first and longest of equal ones."""
    sums = np.append(0.0, np.cumsum(ratios))
    low = np.minimum.accumulate(sums[: len(sums) - least])
    gains = sums[least:] - low
    end = len(gains) - 1 - int(np.argmax(gains[::-1]))
    start = int(np.argmax(sums[: end + 1] == low[end]))
    return start, end + least, float(gains[end])


def key_parts(run: str, model: np.ndarray, threshold: float, least: int) -> list[tuple[int, int]]:
    """Parts of a run that the models take for random strings, in order."""
    ratios = _ratios(run, model)
    out, todo = [], [(0, len(run))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        a, b, gain = best_part(ratios[lo:hi], least)
        if gain < threshold:
            continue
        a, b = lo + a, lo + b
        while a > lo and run[a - 1] not in EDGES:
            a -= 1
        while b < hi and run[b] not in EDGES:
            b += 1
        if ratios[a:b].sum() >= threshold:
            out.append((a, b))
            todo += [(lo, a), (b, hi)]
    return sorted(out)


def _matches(text: str) -> Iterator[tuple[int, re.Match[str]]]:
    """Matches of the patterns that hold, with the number of the kind."""
    if ":" in text or "=" in text:
        yield from ((0, m) for m in ASSIGN.finditer(text) if len(m[2]) >= 8)
    if "AKIA" in text:
        yield from ((1, m) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16)
    yield from ((2, m) for m in HEX.finditer(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, number of the kind, end) of the patterns, in order."""
    return sorted((m.start(), k, m.end()) for k, m in _matches(text))


def values(text: str) -> list[tuple[int, int]]:
    """Disjoint parts of the text, in order, that the patterns call keys; of an assignment, the value alone."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(m.span(2 if k == 0 else 0) for k, m in _matches(text)):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def all_spans(text: str, base: list[tuple[int, int, int]], model: np.ndarray, threshold: float, least: int) -> list[tuple[int, int, int]]:
    more = [(m.start() + a, 3, m.start() + b) for m in RUN.finditer(text) if m.end() - m.start() >= least for a, b in key_parts(m[0], model, threshold, least)]
    return sorted(base + more) if more else base


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: np.ndarray | None = None, threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """Rows (id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) for every document; ``least`` is 20 or more.

    Without a model, one is trained from the drawn samples and from the documents.
    """
    ship(docs.sparkSession)
    trained = train(labelled_samples(), corpus_counts(docs, text_col)) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for cell in batch.column(1):
                text = cell.as_py() or ""
                base = base_spans(text)
                found = all_spans(text, base, trained, threshold, least)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in found))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(found))
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
