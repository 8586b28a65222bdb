"""Best-fit packing of documents into sequences by matching large items.

An item over a third of the capacity shares its sequence with at most one other such item, so these are matched
greedily, each with the largest partner that fits. All smaller ones then go, largest first, into the fullest sequence
that still takes them. Only sizes matter for that, and there are no more sizes than the capacity: the plan is made on
the histogram of sizes, and items find their place in it by their rank among items of their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webjourney.llm.common import LibraryIds, bounded_batches, stored, task_number

PIECES = "task int, doc_id long, piece int, start long, length long, nth long, ids binary"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(sizes in a sequence in order, number of such sequences) for so many items of each size."""
    left = {s: n for s, n in sorted(counts.items(), reverse=True) if n}
    third = capacity / 3
    gaps: dict[int, list[list]] = {}  # free room -> [sizes, number]

    def add(sizes: tuple[int, ...], n: int) -> None:
        if n:
            gaps.setdefault(capacity - sum(sizes), []).append([sizes, n])

    for s in [x for x in left if x > third]:
        for t in [x for x in left if third < x <= capacity - s and x <= s]:
            k = left[s] // 2 if s == t else min(left[s], left[t])
            left[s] -= k
            left[t] -= k
            add((s, t), k)
            if not left[s]:
                break
        add((s,), left[s])
        left[s] = 0
    for s in [x for x in left if x <= third]:
        while left[s]:
            fit = min((g for g, some in gaps.items() if g >= s and some), default=None)
            if fit is None:
                many = capacity // s
                k, rest = divmod(left[s], many)
                add((s,) * many, k)
                if rest:
                    add((s,) * rest, 1)
                left[s] = 0
                break
            sizes, n = gaps[fit].pop()
            # A sequence just added to is the fullest that takes one more, so each is filled on before the next.
            many = fit // s
            k = min(n, left[s] // many)
            add((*sizes, *(s,) * many), k)
            left[s] -= k * many
            if k < n and left[s]:
                add((*sizes, *(s,) * left[s]), 1)
                k, left[s] = k + 1, 0
            add(sizes, n - k)
    return [(sizes, n) for some in gaps.values() for sizes, n in some]


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Ids of all documents with the end id, longer ones cut; stored, as two passes follow.

    The first piece of a cut document takes what does not fill a sequence. ``nth`` is the item's rank among those of
    its length in its task. A null text is the empty one; repeated rows are items of their own; other columns are not
    looked at.
    """
    bounded_batches(docs.sparkSession, 1000)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, task = LibraryIds(tokenizer), task_number()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            flat, counts = library.column(batch.column(1))
            rows: list[tuple] = []
            at = 0
            for name, n in zip(batch.column(0).to_pylist(), counts.tolist()):
                ids = np.append(flat[at:at + n], np.uint32(end_id)).astype("<u4")
                at += n
                begin, number = 0, 0
                while begin < len(ids):
                    size = (len(ids) - begin) % capacity or capacity
                    rows.append((task, name, number, begin, size, int(seen[size]), ids[begin:begin + size].tobytes()))
                    seen[size] += 1
                    begin, number = begin + size, number + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*rows), (
                    pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                ["task", "doc_id", "piece", "start", "length", "nth", "ids"])

    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, PIECES))


def assign(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Give every piece its sequence_id and its offset there; other columns are carried along."""
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity at most
    slots: list[tuple[int, int, int, int]] = []
    next_rank: dict[int, int] = {}
    sequence = 0
    for items, n in plan(sizes, capacity):
        offset = 0
        for s in items:
            rank = next_rank.get(s, 0)
            slots.append((s, rank, sequence, offset))
            next_rank[s] = rank + n
            offset += s
        sequence += n
    table = np.array(sorted(slots), np.int64).reshape(-1, 4)
    keys = table[:, 0] * (1 << 48) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("__rank").to_numpy()
            found = np.searchsorted(keys, batch.column("length").to_numpy() * (1 << 48) + rank, side="right") - 1
            rest = batch.drop_columns(["__rank"])
            yield rest.append_column("sequence_id", pa.array(table[found, 2] + rank - table[found, 1])) \
                .append_column("offset", pa.array(table[found, 3]))

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    ranked = pieces.join(bases, ["task", "length"]).withColumn("__rank", F.col("__base") + F.col("nth")).drop(
        "__base", "nth", "task")
    schema = ranked.drop("__rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (as stored), n_tokens. ``placed`` still has its ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n_tokens")).select(
        "sequence_id", "n_tokens", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
