"""Conversations as training text, with token ids and a loss mask that follows offsets.

A turn is ``<turn>`` role ``<says>`` text ``</turn>``, and a conversation is its
turns, by turn, one after the other.  Where a role or a text holds one of these
control strings, a backslash goes in after its ``<``, and every backslash is
doubled; so no control string is left inside a turn and the text reads back as
it was.  The tokenizer gets the control strings as tokens of their own, so that
no other token reaches over the edge of a text.

A conversation is rendered whole and encoded once, with offsets.  The spans of
turns whose role is trained on are sorted, as token spans are; a binary search
for each span finds the first and the last token that meet it.  The mask is of
tokens; ``loss_text`` reads it back as text.

Rows are dealt out by conversation and sorted by turn, outside memory where that
is needed, and a task goes through them as a stream.  A conversation of more
than ``PIECE_CHARS`` comes in pieces, whole turns each, which are rows that
follow one another; since control strings part the text before it is encoded,
pieces have the tokens of the whole.  Nothing else is ever held together.  A tokenizer is a file of
ranks and a pattern; any byte-level one will do.

Defined cases: null texts and null roles read as empty; null conversation ids
are one conversation; null turns come first; rows of one turn follow by role and
text, nulls as empty; rows that repeat are turns of their own; an empty table
gives no rows; other columns are not read.  What another vocabulary
has as special tokens (``<|endoftext|>``) is ordinary text inside a turn.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.shipping import ship

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary parts texts before it is merged; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_TOKENIZER_BYTES = 64 << 20  #: what is sent to every worker
PIECE_CHARS = 1 << 20
OPEN, SAYS, CLOSE = "<turn>", "<says>", "</turn>"
_CONTROL = re.compile(r"<(?=(?:turn|says|/turn)>)")
_TURN = re.compile(f"{OPEN}(.*?){SAYS}(.*?){CLOSE}", re.S)
PIECES = "conv_id long, piece int, text string, token_ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\", text.replace("\\", "\\\\")) if "\\" in text or "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The text of turns (role, text), and a span (start, end, role) for each text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{SAYS}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body), role))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    return [(unescape(role), unescape(said)) for role, said in _TURN.findall(text)]


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens meet one of the spans; tokens and spans are sorted."""
    own = np.array([s for s in spans if s[0] < s[1]], np.int64).reshape(-1, 2)
    first, last = np.searchsorted(ends, own[:, 0], "right"), np.searchsorted(starts, own[:, 1], "left")
    edges = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, last, -1)
    return np.cumsum(edges[:-1]) > 0


def loss_text(text: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The unescaped text under each run of the mask; characters of several tokens count once."""
    on = np.flatnonzero(np.diff(np.concatenate([[0], loss.astype(np.int8), [0]])))
    return [unescape(text[starts[a] : ends[b - 1]]) for a, b in on.reshape(-1, 2)]


@cache
def _tokenizer(ranks: bytes, pattern: str):  # noqa: ANN202
    """The encoder, with the control strings as tokens after the vocabulary's, and the bytes of each token."""
    import tiktoken

    known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    own = {c: max(known.values()) + 1 + k for k, c in enumerate((OPEN, SAYS, CLOSE))}
    lengths = np.zeros(max(own.values()) + 1, np.int64)
    for token, rank in [*known.items(), *((c.encode(), r) for c, r in own.items())]:
        lengths[rank] = len(token)
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=known, special_tokens=own), lengths


def encode(text: str, encoder, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    """Token ids of a rendered text, and the code points at which each begins and ends; tokens that share one both have it."""
    ids = encoder.encode_to_numpy(text, allowed_special="all").astype(np.int32)
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) > len(text):
        first = (raw & 0xC0) != 0x80
        before = np.concatenate([[0], np.cumsum(first)])
        starts, ends = before[starts] - ~first[starts] if len(starts) else starts, before[ends]
    return ids, starts.astype(np.int32), ends.astype(np.int32)


def _pieces(batches: Iterator[pa.RecordBatch], piece_chars: int) -> Iterator[list[tuple[int | None, int, list[tuple[str, str]]]]]:
    """Lists of pieces (conversation, number, turns), a list of about ``piece_chars`` in all."""
    out, size, now, number, turns, own = [], 0, None, 0, [], 0
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if turns and (conv != now or own >= piece_chars):
                out.append((now, number, turns))
                number, turns, own = (number + 1 if conv == now else 0), [], 0
            if size >= piece_chars and not turns:
                yield out
                out, size = [], 0
            now = conv
            turns.append((role or "", text or ""))
            own += len(text or "") + 32
            size += len(text or "") + 32
    yield [*out, (now, number, turns)] if turns else out


def formatted(conversations: DataFrame, train_on: tuple[str, ...] = ("assistant",), tokenizer: str = TOKENIZER, pattern: str = PATTERN, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Rows (conv_id, piece, text, token_ids, starts, ends, loss) of all conversations, a conversation's pieces one after the other.

    ``tokenizer`` is a file of ranks that the driver reads; offsets are code points of ``text``.
    """
    spark = conversations.sparkSession
    ship(spark)
    with open(tokenizer, "rb") as f:
        ranks = f.read(MOST_TOKENIZER_BYTES + 1)
    if len(ranks) > MOST_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer} is too large to be sent to every worker")
    sent = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = _tokenizer(sent.value, pattern)
        for some in _pieces(batches, piece_chars):
            columns: tuple[list, ...] = ([], [], [], [], [])
            for _, _, turns in some:
                text, spans = render(turns)
                ids, starts, ends = encode(text, encoder, lengths)
                loss = loss_mask(starts, ends, [s[:2] for s in spans if s[2] in train_on])
                for c, x in zip(columns, (text, ids, starts, ends, loss), strict=True):
                    c.append(x)
            lists = [pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())), strict=True)]
            yield pa.record_batch([pa.array([s[0] for s in some], pa.int64()), pa.array([s[1] for s in some], pa.int32()), *lists], names=["conv_id", "piece", "text", "token_ids", "starts", "ends", "loss"])

    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, PIECES)


def read_back(pieces: DataFrame) -> DataFrame:
    """Of each conversation what its rendered text and its mask say; pieces as ``formatted`` gives them."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        turns = loss = None
        counts = [0] * 5  # turns, characters under the mask, all characters, tokens, tokens under the mask
        now = None

        def done() -> tuple:
            return (now, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), *counts[2:])

        for batch in batches:
            for i in range(len(batch)):
                conv, piece, text = (batch.column(c)[i].as_py() for c in ("conv_id", "piece", "text"))
                starts, ends, mask = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("starts", "ends", "loss"))
                if piece == 0:
                    if turns:
                        rows.append(done())
                    now, turns, loss, counts = conv, hashlib.sha256(), hashlib.sha256(), [0] * 5
                own = parse(text)
                under = loss_text(text, starts, ends, mask)
                turns.update("".join(f"{role}\n{said}\n" for role, said in own).encode())
                loss.update("".join(under).encode())
                counts = [a + b for a, b in zip(counts, (len(own), sum(map(len, under)), len(text), len(mask), int(mask.sum())), strict=True)]
            yield _rows(rows)
            rows = []
        yield _rows([done()] if turns else [])

    return pieces.mapInArrow(digests, READ_BACK)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in READ_BACK.split(", ")]
    kinds = {"conv_id": "Int64", "turns_sha256": "string", "loss_sha256": "string"}
    frame = pd.DataFrame(rows, columns=names).astype({n: kinds.get(n, "int64") for n in names})
    return pa.RecordBatch.from_pandas(frame, schema=pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names]), preserve_index=False)


#: A conversation whose texts look like the marks of templates.
CONTROL_CASE = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def with_control_case(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -7."""
    own = conversations.select("conv_id", "turn", "role", "text")
    return own.unionByName(conversations.sparkSession.createDataFrame(CONTROL_CASE, own.schema))
