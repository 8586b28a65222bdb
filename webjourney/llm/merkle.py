"""Merkle manifest of a data set with retained hash states.

Every document is a leaf; the leaves of a source, and then the subroots of all sources, are hashed in runs of 16 until one
node is left. While a run is hashed, its parent keeps a copy of the running SHA-256 state before every child. A proof
folds by resuming the copy that belongs to the child's place with the replacement and the siblings to its right; what
stands to its left is never hashed again.

A task holds a subtree of three levels (4,096 consecutive nodes), so neither a large source nor a large table meets in
one task: each round replaces 4,096 nodes by one, and the last step gives every such subtree the runs above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webjourney.llm.common import positions, stored

RUN, LEVELS = 16, 3
SPAN = RUN ** LEVELS
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_text(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field_text(f) for f in fields]).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, replaced: Column | None = None) -> DataFrame:
    """One row per document: key (its source; null before all others), doc_id, leaf, replacement (null: the same leaf).

    ``replaced`` is the text that a replacement leaf takes where it is not null. Null fields hash as ``-``, so a null text
    and an empty one differ; repeated rows are leaves of their own; other columns are not looked at.
    """
    other = F.lit(None).cast("string")
    if replaced is not None:
        other = F.when(replaced.isNotNull(), row_hash(*[F.col(c) for c in FIELDS[:-1]], replaced))
    source = F.col("source").cast("string")
    return docs.select(
        F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"), row_hash(*[F.col(c) for c in FIELDS]).alias("leaf"),
        other.alias("replacement"))


def height(n: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


class Parent:
    """A run of children: their hashes, and the state of the parent's hash before each of them."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: list[bytes]):
        state = hashlib.sha256()
        self.children, self.states = b"".join(children), []
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, child: bytes) -> bytes:
        """The parent's hash with another child in its place."""
        state = self.states[slot].copy()
        state.update(child)
        state.update(self.children[HEX * (slot + 1):])
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> tuple[bytes, bytes]:
        return self.children[:HEX * slot], self.children[HEX * (slot + 1):]


class Step:
    """One place in a run above a subtree: a parent that keeps the state of this place only."""

    __slots__ = ("left", "right", "state")

    def __init__(self, slot: int, children: bytes):
        self.left, self.right = children[:HEX * slot], children[HEX * (slot + 1):]
        self.state = hashlib.sha256(self.left)

    def fold(self, child: bytes) -> bytes:
        state = self.state.copy()
        state.update(child)
        state.update(self.right)
        return state.hexdigest().encode()


def subtree(hashes: list[bytes], n: int) -> tuple[list[list[Parent]], bytes]:
    """Parents by level over at most 4,096 nodes of a sequence of ``n``, and the node that replaces them."""
    tiers: list[list[Parent]] = []
    for _ in range(min(LEVELS, height(n))):
        tiers.append([Parent(hashes[i:i + RUN]) for i in range(0, len(hashes), RUN)])
        hashes = [p.digest for p in tiers[-1]]
    return tiers, hashes[0]


def _subtrees(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, list]]:
    """Rows of one (key, subtree) at a time, as lists by column."""
    now, held = None, {c: [] for c in names}
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in names}
        groups = list(zip(columns["key"], columns["subtree"]))
        at = 0
        while at < len(groups):
            if groups[at] != now:
                if now is not None:
                    yield held
                now, held = groups[at], {c: [] for c in names}
            end = at
            while end < len(groups) and groups[end] == now:
                end += 1
            for c in names:
                held[c] += columns[c][at:end]
            at = end
    if now is not None:
        yield held


def _dealt(nodes: DataFrame) -> DataFrame:
    return (
        nodes.withColumn("subtree", F.shiftright("pos", 12)).repartition("key", "subtree")
        .sortWithinPartitions("key", "subtree", "pos"))


def _tops(nodes: DataFrame) -> DataFrame:
    """key, pos, n, hash of the nodes that replace 4,096 each; ``nodes`` has the same columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _subtrees(batches, ["key", "subtree", "n", "hash"]):
            _, top = subtree([h.encode() for h in t["hash"]], t["n"][0])
            yield pa.RecordBatch.from_pylist([{
                "key": t["key"][0], "pos": t["subtree"][0], "n": -(-t["n"][0] // SPAN), "hash": top.decode()}], _NODE)

    return _dealt(nodes).mapInArrow(run, "key string, pos long, n long, hash string")


_NODE = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("hash", pa.string())])
_STEPS = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("top", pa.string()),
                    ("slots", pa.list_(pa.int32())), ("runs", pa.list_(pa.string()))])


def _steps(nodes: DataFrame) -> DataFrame:
    """For each node its places and the runs around it on the next three levels, and the node above them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _subtrees(batches, ["key", "subtree", "pos", "n", "hash"]):
            tiers, top = subtree([h.encode() for h in t["hash"]], t["n"][0])
            rows = []
            for i, pos in enumerate(t["pos"]):
                slots, runs = [], []
                for tier in tiers:
                    i, slot = divmod(i, RUN)
                    slots.append(slot)
                    runs.append(tier[i].children.decode())
                rows.append({"key": t["key"][0], "pos": pos, "n": t["n"][0], "top": top.decode(),
                             "slots": slots, "runs": runs})
            yield pa.RecordBatch.from_pylist(rows, _STEPS)

    return _dealt(nodes).mapInArrow(
        run, "key string, pos long, n long, top string, slots array<int>, runs array<string>")


def _climb(nodes: DataFrame) -> DataFrame:
    """key, pos, slots, runs (all levels up to the key's last node) and top (that node) of every node."""
    path = nodes.select("key", "pos", "n", F.col("hash").alias("top"), F.lit(None).cast("array<int>").alias("slots"),
                        F.lit(None).cast("array<string>").alias("runs"), F.col("pos").alias("__up"))
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        level = stored(_steps(nodes))
        up = level.select("key", F.col("pos").alias("__up"), F.col("top").alias("__top"),
                          F.col("slots").alias("__slots"), F.col("runs").alias("__runs"))
        none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
        path = path.join(up, ["key", "__up"]).select(
            "key", "pos", "n", F.col("__top").alias("top"),
            F.concat(none(F.col("slots"), "array<int>"), "__slots").alias("slots"),
            F.concat(none(F.col("runs"), "array<string>"), "__runs").alias("runs"),
            F.shiftright("__up", 12).alias("__up"))
        nodes = level.where(F.col("pos") % SPAN == 0).select(
            "key", F.shiftright("pos", 12).alias("pos"), F.ceil(F.col("n") / SPAN).cast("long").alias("n"),
            F.col("top").alias("hash"))
        most = -(-most // SPAN)
    return path.drop("__up", "n")


def manifest(rows: DataFrame) -> dict[str, DataFrame]:
    """The tree over ``leaves``: ``leaves`` (key, doc_id, leaf, replacement, pos, n) and ``paths`` (key, subtree, slots,
    runs, subroot, root: what lies above each subtree of 4,096 leaves). An empty table gives empty ones."""
    placed = positions(stored(rows), ["key"], ["doc_id", "leaf"])
    tops = stored(_tops(placed.select("key", "pos", "n", F.col("leaf").alias("hash"))))
    within = stored(_climb(tops).withColumnsRenamed({"top": "subroot", "pos": "subtree"}))
    subroots = within.where("subtree = 0").select(F.lit("").alias("all"), F.col("key").alias("name"), "subroot")
    ordered = positions(subroots, ["all"], ["name"])
    above = _climb(stored(ordered.select(F.col("all").alias("key"), "pos", "n", F.col("subroot").alias("hash"))))
    above = ordered.select(F.col("name").alias("key"), "pos").join(
        above.select("pos", F.col("slots").alias("__slots"), F.col("runs").alias("__runs"), F.col("top").alias("root")),
        "pos").drop("pos")
    paths = within.join(above, "key").select(
        "key", "subtree",
        F.concat(F.coalesce("slots", F.array().cast("array<int>")),
                 F.coalesce("__slots", F.array().cast("array<int>"))).alias("slots"),
        F.concat(F.coalesce("runs", F.array().cast("array<string>")),
                 F.coalesce("__runs", F.array().cast("array<string>"))).alias("runs"), "subroot", "root")
    return {"leaves": placed, "paths": stored(paths)}


_VERDICT = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
            "verified boolean")


def verify(tree: dict[str, DataFrame]) -> DataFrame:
    """Fold every leaf, or its replacement where it has one, to a root and compare that with the tree's.

    doc_id, leaf, subroot, root, proof_sha256 (hash of the siblings from the leaf's level up, left to right), folded_root,
    verified.
    """
    names = ["key", "subtree", "pos", "n", "doc_id", "leaf", "replacement", "slots", "runs", "subroot", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _subtrees(batches, names):
            # The path sorts before the leaves.
            steps = [Step(s, r.encode()) for s, r in zip(t["slots"][0], t["runs"][0])]
            hashes = [h.encode() for h in t["leaf"][1:]]
            tiers, _ = subtree(hashes, t["n"][1])
            subroot, root = t["subroot"][0], t["root"][0]
            proofs, folded = [], []
            for place, (leaf, other) in enumerate(zip(hashes, t["replacement"][1:])):
                value = other.encode() if other else leaf
                proof, i = hashlib.sha256(), place
                for tier in tiers:
                    i, slot = divmod(i, RUN)
                    value = tier[i].fold(slot, value)
                    for side in tier[i].siblings(slot):
                        proof.update(side)
                for step in steps:
                    value = step.fold(value)
                    proof.update(step.left)
                    proof.update(step.right)
                proofs.append(proof.hexdigest())
                folded.append(value.decode())
            m = len(hashes)
            yield pa.RecordBatch.from_arrays([
                pa.array(t["doc_id"][1:], pa.int64()), pa.array(t["leaf"][1:], pa.string()),
                pa.array([subroot] * m, pa.string()), pa.array([root] * m, pa.string()), pa.array(proofs, pa.string()),
                pa.array(folded, pa.string()), pa.array([f == root for f in folded], pa.bool_()),
            ], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    rows = tree["leaves"].select(
        "key", F.shiftright("pos", 12).alias("subtree"), "pos", "n", "doc_id", "leaf", "replacement")
    heads = tree["paths"].withColumn("pos", F.lit(-1).cast("long"))
    both = heads.unionByName(rows, allowMissingColumns=True).select(*names)
    return both.repartition("key", "subtree").sortWithinPartitions("key", "subtree", "pos").mapInArrow(run, _VERDICT)
