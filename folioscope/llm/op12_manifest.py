"""A Merkle manifest of a dataset: one digest for all rows, and for each row a proof of its place under it.

A row's leaf is the digest of its fields, each with its length, so that no two
rows of different fields have one text.  Per group (source) the leaves, by id,
are the lowest level of a tree: every ``FANOUT`` consecutive nodes become the
digest of their hex texts, also a last run of fewer, until one is left.  The
groups' roots, by group, are the leaves of one more such tree.

Leaves are cut into aligned blocks of FANOUT**HEIGHT, which are whole subtrees.
In a block the digests are one contiguous numpy matrix of 64-byte hex rows for
each level; a level is reshaped by the fanout and its rows are hashed into the
next, and all siblings of a leaf are found by index arithmetic.  The roots of
blocks are leaves of blocks again, so a group of any size takes a few rounds, a
task never holds more than one block, and no group is in one task.  Paths then
come down the same way: a block's path goes to what lies in it.

The texts are read once.  Places within a group come from ``ranges.numbered``,
so a group of a third of all rows is numbered in many tasks.

Defined cases: null fields are ``-``, so null and empty differ; a null group is
a group, the first; null ids come first; rows with equal ids are ordered by
leaf, and equal leaves stand for one another; an empty table gives no rows;
other columns are not read.  Where ``received`` gives the text as it arrived,
the leaf that is folded is that of the received text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import hold
from folioscope.operators.ranges import numbered
from folioscope.shipping import ship

FANOUT = 3
HEIGHT = 6  #: levels of a block: 3**6 = 729 leaves
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(text: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """Digest of a row's fields, the last of which is ``text``."""
    values = [*[F.col(f"`{f}`").cast("string") for f in fields[:-1]], text]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def _digest(data: bytes | memoryview) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def matrix(column: pa.Array) -> np.ndarray:
    """Hex digests as rows of 64 bytes, without a copy where Arrow has them side by side."""
    offsets = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_string(column.type) else np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, HEX)


def level_above(nodes: np.ndarray) -> np.ndarray:
    """Digests of every FANOUT consecutive rows, also of a last run of fewer."""
    whole = len(nodes) // FANOUT * FANOUT
    runs = [*np.ascontiguousarray(nodes[:whole]).reshape(-1, FANOUT * HEX)]
    if whole < len(nodes):
        runs.append(np.ascontiguousarray(nodes[whole:]).reshape(-1))
    return np.frombuffer(b"".join(_digest(r) for r in runs), np.uint8).reshape(-1, HEX)


def height_of(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    height = 0
    while leaves > 1:
        leaves, height = -(-leaves // FANOUT), height + 1
    return height


def levels(leaves: np.ndarray, height: int) -> list[np.ndarray]:
    out = [leaves]
    for _ in range(height):
        out.append(level_above(out[-1]))
    return out


def siblings(tree: list[np.ndarray], height: int, at: int) -> list[tuple[bytes, bytes]]:
    """For each level the digests left and right of the node above leaf ``at`` within its run."""
    out = []
    for level in tree[:height]:
        data, first = level.reshape(-1), at // FANOUT * FANOUT
        end = min(first + FANOUT, len(level))
        out.append((data[first * HEX : at * HEX].tobytes(), data[(at + 1) * HEX : end * HEX].tobytes()))
        at //= FANOUT
    return out


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        node = _digest(left + node + right)
    return node


def _written(path: list[tuple[bytes, bytes]]) -> str:
    """A path as text: levels parted by commas, a bar at the node's own place."""
    return ",".join(f"{a.decode()}|{b.decode()}" for a, b in path)


def _read(path: str) -> list[tuple[bytes, bytes]]:
    return [(a.encode(), b.encode()) for a, b in (level.split("|") for level in path.split(","))] if path else []


def _children(batch: pa.RecordBatch, field: str) -> Iterator[tuple[int, pa.StructArray]]:
    column = batch.column(batch.schema.get_field_index(field))
    ends = column.offsets.to_numpy()
    for i in range(len(column)):
        yield i, column.values.slice(ends[i], ends[i + 1] - ends[i])


def _heights(block: int, n: int, full: int) -> tuple[int, int]:
    """Levels in a block of n leaves if it is the only one of its group, and else."""
    return (height_of(n), full) if block == 0 else (full, full)


def _roots(batches: Iterator[pa.RecordBatch], full: int) -> Iterator[pa.RecordBatch]:
    """Of each block its root if it is alone in its group, and its root on the level of a full block."""
    for batch in batches:
        alone, raised = [], []
        for i, nodes in _children(batch, "nodes"):
            low, high = _heights(batch.column("block")[i].as_py(), len(nodes), full)
            tree = levels(matrix(nodes.field("node")), high)
            single = len(nodes) == 1 and batch.column("block")[i].as_py() == 0
            alone.append(nodes.field("alone")[0].as_py() if single else tree[low].tobytes().decode())
            raised.append(tree[high].tobytes().decode())
        yield pa.record_batch([batch.column("grp"), batch.column("block"), pa.array(alone, pa.string()), pa.array(raised, pa.string())], names=["grp", "at", "alone", "node"])


def _paths(batches: Iterator[pa.RecordBatch], full: int) -> Iterator[pa.RecordBatch]:
    """What lies in a block gets its path in it and the block's own, with the roots it leads to."""
    for batch in batches:
        rows: list[tuple] = []
        for i, nodes in _children(batch, "nodes"):
            grp, block, only, above, subroot, root = (batch.column(c)[i].as_py() for c in ("grp", "block", "only", "path", "subroot", "root"))
            height = _heights(block, len(nodes), full)[not only]
            tree = levels(matrix(nodes.field("node")), height)
            for k, at in enumerate(nodes.field("at").to_pylist()):
                path = ",".join(x for x in (_written(siblings(tree, height, k)), above) if x)
                rows.append((grp, at, only and len(nodes) == 1, path, subroot, root))
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), *[pa.string()] * 3), strict=True)], names=["grp", "block", "only", "path", "subroot", "root"])


def _packed(nodes: DataFrame, full: int, *fields: str | Column) -> DataFrame:
    """Blocks of a level: rows (grp, block, nodes), the nodes in order, FANOUT**full of them at most."""
    size = FANOUT**full
    block = F.floor(F.col("at") / size).cast("long").alias("block")
    return nodes.groupBy("grp", block).agg(F.array_sort(F.collect_list(F.struct("at", *fields))).alias("nodes"))


def _climb(leaves: DataFrame, full: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each round, from the leaves' on, and the groups' roots."""
    rounds = [leaves]
    while True:
        roots = hold(rounds[-1].mapInArrow(partial(_roots, full=full), "grp string, at long, alone string, node string"))
        if not roots.filter("at > 0").limit(1).count():
            return rounds, roots.select("grp", F.col("alone").alias("node"))
        rounds.append(hold(_packed(roots, full, "node", "alone")))


def _joined(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Blocks with their paths, one to one."""
    theirs = paths.withColumnRenamed("grp", "g").withColumnRenamed("block", "b")
    return blocks.join(theirs, F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b"))).drop("g", "b")


def _descend(rounds: list[DataFrame], paths: DataFrame, full: int) -> DataFrame:
    """Paths of what lies in the lowest of the rounds, from those of the highest."""
    for blocks in reversed(rounds):
        paths = _joined(blocks, paths).mapInArrow(partial(_paths, full=full), "grp string, block long, only boolean, path string, subroot string, root string")
    return paths


def _proofs(batches: Iterator[pa.RecordBatch], full: int) -> Iterator[pa.RecordBatch]:
    """Each leaf's proof, and the root that its received leaf folds up to."""
    for batch in batches:
        for i, nodes in _children(batch, "nodes"):
            block, only, above, subroot, root = (batch.column(c)[i].as_py() for c in ("block", "only", "path", "subroot", "root"))
            height = _heights(block, len(nodes), full)[not only]
            leaves, upper = matrix(nodes.field("node")), _read(above)
            tree, proofs, folded = levels(leaves, height), [], []
            for k, (leaf, got) in enumerate(zip(nodes.field("node").to_pylist(), nodes.field("got").to_pylist(), strict=True)):
                path = [*siblings(tree, height, k), *upper]
                proofs.append(_digest(b"".join(a + b for a, b in path)).decode())
                folded.append(fold((got or leaf).encode(), path).decode())
            columns = [nodes.field("id"), nodes.field("node"), *[pa.array(c, pa.string()) for c in ([subroot] * len(nodes), [root] * len(nodes), proofs, folded)]]
            yield pa.record_batch(columns, names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])


def manifest(docs: DataFrame, received: Column | None = None, fields: tuple[str, ...] = FIELDS, group: str = "source", height: int = HEIGHT) -> DataFrame:
    """Rows (id, leaf, subroot, root, proof_sha256, folded_root, verified), one for each row of ``docs``.

    ``fields`` begin with the id and end with the text; ``received`` is the text
    as it arrived, null where it is taken as it is; a block has FANOUT**height leaves.
    """
    ship(docs.sparkSession)
    text = F.col(f"`{fields[-1]}`")
    changed = received if received is not None else F.lit(None).cast("string")
    leaves = hold(docs.select(F.col(f"`{fields[0]}`").alias("id"), F.col(f"`{group}`").alias("grp"), leaf_of(text, fields).alias("node"), F.when(changed.isNotNull(), leaf_of(changed, fields)).alias("got")))
    placed = numbered(leaves, ["grp"], ["id", "node"], "at").withColumn("at", F.col("at") - 1)
    blocks = hold(_packed(placed, height, "node", F.col("node").alias("alone"), "id", "got"))
    rounds, subroots = _climb(blocks, height)
    tops = hold(numbered(subroots, [], ["grp"], "at").select(F.lit("").alias("grp"), (F.col("at") - 1).alias("at"), "node", F.col("node").alias("alone"), F.col("grp").alias("own")))
    top_rounds, roots = _climb(hold(_packed(tops, height, "node", "alone")), height)
    first = roots.first()  # one digest
    start = roots.select("grp", F.lit(0).cast("long").alias("block"), F.lit(True).alias("only"), F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"), F.lit(first["node"] if first else None).cast("string").alias("root"))
    in_top = _descend(top_rounds, start, height).select(F.col("block").alias("at"), "path", "root")
    starts = tops.join(in_top, "at").select(F.col("own").alias("grp"), F.lit(0).cast("long").alias("block"), F.lit(True).alias("only"), "path", F.col("node").alias("subroot"), "root")
    paths = _descend(rounds[1:], starts, height)
    kind = docs.schema[fields[0]].dataType.simpleString()
    out = _joined(blocks, paths).mapInArrow(partial(_proofs, full=height), f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
