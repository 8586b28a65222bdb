"""Token ids in patched frame-of-reference blocks.

A segment holds the ids of some whole documents. Its ids are cut into blocks of ``BLOCK``; a block stores its minimum,
the width that ``FITS`` of its values less the minimum fit into, all values packed at that width, and a list of
positions and values of the others (the exceptions). An index tells where each block starts, so any block can be read
alone. The segments lie in a table of binary cells that Spark's writers and readers handle on any store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webjourney.llm.common import LibraryIds, bounded_batches, stored, task_number

MAGIC, BLOCK, FITS, SEGMENT_IDS = b"PFR1", 128, 0.9, 1 << 17

SEGMENTS = ("part int, segment int, n_ids long, doc_ids array<long>, lengths array<long>, payload binary")


def pack_segment(ids: np.ndarray) -> bytes:
    """Magic, number of ids, block starts (one more than blocks, in bytes of the body), body."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    rows = np.full((blocks, BLOCK), ids[-1] if n else 0, np.int64)
    rows.reshape(-1)[:n] = ids
    low = rows.min(axis=1)
    rows -= low[:, None]
    fit = np.partition(rows, int(FITS * BLOCK) - 1, axis=1)[:, int(FITS * BLOCK) - 1]
    width = np.ceil(np.log2(fit + 1)).astype(np.int64)
    out = rows >> width[:, None] > 0
    count = out.sum(axis=1)
    heads = np.zeros(blocks, [("low", "<u4"), ("width", "u1"), ("count", "u1")])
    heads["low"], heads["width"], heads["count"] = low, width, count
    bodies: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        bits = (rows[which][:, :, None] >> np.arange(w)) & 1
        packed = np.packbits(bits.astype(np.uint8).reshape(len(which), -1), axis=1, bitorder="little")
        for i, p in zip(which, packed):
            bodies[i] = p.tobytes()
    at, place = np.nonzero(out)
    odd = rows[at, place].astype("<u4")
    ends = np.cumsum(count)
    head, place = heads.tobytes(), place.astype(np.uint8)
    body = [
        head[6 * i:6 * i + 6] + bodies[i] + place[e - c:e].tobytes() + odd[e - c:e].tobytes()
        for i, (e, c) in enumerate(zip(ends.tolist(), count.tolist()))]
    starts = np.concatenate([[0], np.cumsum([len(b) for b in body])]).astype("<u8")
    return MAGIC + np.array([n], "<u8").tobytes() + starts.tobytes() + b"".join(body)


def unpack_segment(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` to ``last`` (all by default)."""
    if payload[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n = int(np.frombuffer(payload, "<u8", 1, 4)[0])
    blocks = -(-n // BLOCK)
    starts = np.frombuffer(payload, "<u8", blocks + 1, 12).astype(np.int64)
    last = blocks if last is None else min(last, blocks)
    body = np.frombuffer(payload, np.uint8, offset=12 + 8 * (blocks + 1))
    at = starts[first:last]
    low = sum(body[at + i].astype(np.int64) << 8 * i for i in range(4)) if len(at) else np.zeros(0, np.int64)
    width, count = body[at + 4].astype(np.int64), body[at + 5].astype(np.int64)
    rows = np.zeros((len(at), BLOCK), np.int64)
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        size = w * BLOCK // 8
        raw = body[(at[which] + 6)[:, None] + np.arange(size)]
        bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(which), BLOCK, w)
        rows[which] = bits @ (1 << np.arange(w, dtype=np.int64))
    has = np.flatnonzero(count)
    if len(has):
        c = count[has]
        block = np.repeat(has, c)
        nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        base = at[block] + 6 + width[block] * BLOCK // 8
        value = base + count[block] + 4 * nth
        rows[block, body[base + nth]] = sum(body[value + i].astype(np.int64) << 8 * i for i in range(4))
    return (rows + low[:, None]).reshape(-1)[:n - first * BLOCK].astype("<u4")


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encode all texts and store them as segments in ascending order of doc_id (null first; equal ones by text).

    Rows are dealt to tasks by ranges of doc_id, so the order needs no task that sees everything. A null text is the
    empty one, repeated rows stay, an empty table gives no segment; other columns are not looked at.
    """
    bounded_batches(docs.sparkSession, 1000)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, part, segment = LibraryIds(tokenizer), task_number(), 0
        names: list = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal names, ids, held, segment
            payload = pack_segment(np.concatenate(ids))
            row = [[part], [segment], [held], [names], [[len(x) for x in ids]], [payload]]
            names, ids, held, segment = [], [], 0, segment + 1
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()),
                                                      pa.list_(pa.int64()), pa.binary()))],
                ["part", "segment", "n_ids", "doc_ids", "lengths", "payload"])

        for batch in batches:
            flat, counts = library.column(batch.column(1))
            at = 0
            for name, n in zip(batch.column(0).to_pylist(), counts.tolist()):
                names.append(name)
                ids.append(np.append(flat[at:at + n], np.uint32(end_id)))
                at, held = at + n, held + n + 1
                if held >= SEGMENT_IDS:
                    yield flush()
        if names:
            yield flush()

    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text")))
    return stored(ordered.mapInArrow(encode, SEGMENTS))


def read_ids(segments: DataFrame) -> DataFrame:
    """Documents as read back: doc_id, start (ids of all documents before), ids (little-endian unsigned 32-bit)."""
    bounded_batches(segments.sparkSession, 200)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, _, names, lengths, payload in zip(*[c.to_pylist() for c in batch.columns]):
                ids = unpack_segment(payload)
                n = np.array(lengths, np.int64)
                end = np.cumsum(n)
                for i in range(0, len(names), 2000):
                    some = slice(i, i + 2000)
                    m = len(names[some])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([part] * m, pa.int32()), pa.array([segment] * m, pa.int32()),
                        pa.array(names[some], pa.int64()), pa.array((end - n)[some], pa.int64()),
                        pa.array(n[some], pa.int64()),
                        pa.array([ids[b - k:b].tobytes() for b, k in zip(end[some], n[some])], pa.binary()),
                    ], ["part", "segment", "doc_id", "within", "n_tokens", "ids"])

    sizes = segments.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.join(parts, "part").select(
        "part", "segment", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("base"))
    found = segments.mapInArrow(
        decode, "part int, segment int, doc_id long, within long, n_tokens long, ids binary")
    return found.withColumn("ids_crc32", F.crc32("ids")).join(bases, ["part", "segment"]).select(
        "doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "ids")

