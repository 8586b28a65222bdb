"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Each unit vector is projected on many random lines. Vectors at a cosine of 0.98 are 0.2 apart, so on a line they differ
by a normal variable of deviation 0.2 or less, others by one of 1.4. A pair is a candidate if, on all lines of one of a
few independent sets, the one lies in the window around the other. The lines of a set make a key: a vector is at home in
the cell it falls into, and a query in all cells that its windows touch, so only vectors that collide meet. Lines are
added with the logarithm of a label's size, which keeps the company in a cell small. Inside a cell vectors are sorted on
a line and only those in each other's window are paired; pairs that collide on enough of the counted lines (all but one
in a million of those at the threshold do) are verified by their cosine.

Narrow rows with rounded projections go first; whole vectors go only into the cells where they have a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from math import ceil, comb, erf, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webjourney.llm.common import bounded_batches, forest, group_starts, in_blocks, stored, whole_groups
from webjourney.llm.components import components

COSINE, LINES = 0.98, 24
FAR = sqrt(2 - 2 * COSINE)
#: Half windows of key lines and of counted lines, and the width of a cell.
KEY_WINDOW, WINDOW, CELL = 2.5 * FAR, 2 * FAR, 7.5 * FAR
#: Chance that a pair at the threshold meets in no set, and that one that meets is not counted often enough.
UNMET, MISSES = 0.004, 1e-6
COMPANY, MOST_KEYS, MOST_SETS = 100, 12, 4
#: Share of the other vectors that a cell of one line holds, on average over vectors.
ALIKE = 2 * sum(((erf((i + 1) * CELL / sqrt(2)) - erf(i * CELL / sqrt(2))) / 2) ** 2 for i in range(8))
#: Steps of the rounded projections.
STEP = 1 / 26
BLOCK = 1024


def key_lines(n: int) -> int:
    """Lines in a key for a label of ``n`` vectors: at most ``COMPANY`` others share a cell by chance on average."""
    return min(MOST_KEYS, max(1, ceil(log(max(n / COMPANY, 1)) / -log(ALIKE))))


def key_sets(lines: int) -> int:
    """Sets of so many lines that leave less than ``UNMET`` of the pairs at the threshold apart."""
    met = erf(KEY_WINDOW / FAR / sqrt(2)) ** lines
    return min(MOST_SETS, max(1, ceil(log(UNMET) / log(1 - met))))


def fewest_collisions(lines: int = LINES, misses: float = MISSES) -> int:
    """The count that pairs at the threshold fall short of with probability ``misses`` at most."""
    p = erf(WINDOW / FAR / sqrt(2))
    total = 0.0
    for n in range(lines + 1):
        total += comb(lines, n) * p ** n * (1 - p) ** (lines - n)
        if total > misses:
            return n
    return lines


@lru_cache
def lines_for(dim: int) -> np.ndarray:
    """Counted lines, then those of the keys, set by set."""
    return np.random.default_rng([7, dim]).standard_normal((dim, LINES + MOST_SETS * MOST_KEYS))


def set_lines(nth: int, lines: int) -> slice:
    first = LINES + nth * MOST_KEYS
    return slice(first, first + lines)


def unit(values: list) -> np.ndarray | None:
    """The vector at length one, or None if it has no direction."""
    v = np.array([np.nan if x is None else x for x in values], float)
    if not len(v) or not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()  # squares of very large or small components stay finite
    return v / np.linalg.norm(v)


def collisions(points: np.ndarray, left: np.ndarray, right: np.ndarray, window: float = WINDOW) -> np.ndarray:
    """On how many lines the second point lies in the window around the first; every line is sorted once."""
    count = np.zeros(len(left), np.int8)
    for line in points.T:
        place = np.argsort(line, kind="stable")
        ordered = line[place]
        rank = np.empty(len(line), np.int32)
        rank[place] = np.arange(len(line), dtype=np.int32)
        first = np.searchsorted(ordered, line - window, side="left").astype(np.int32)
        last = np.searchsorted(ordered, line + window, side="right").astype(np.int32)
        at = rank[right]
        count += (at >= first[left]) & (at < last[left])
    return count


def window_pairs(group: np.ndarray, points: np.ndarray, window: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group that lie in each other's window on all lines: sorted on the first one, which gives
    neighbours, then one line after the other."""
    apart = points[:, 0] - points[:, 0].min()
    key = group * (apart.max() + 2 * window + 1) + apart
    order = np.argsort(key, kind="stable")
    key = key[order]
    last = np.searchsorted(key, key + window, side="right")
    more = last - np.arange(len(key)) - 1
    total = np.cumsum(more)
    start = 0
    while start < len(key):
        end = max(int(np.searchsorted(total, (total[start - 1] if start else 0) + 500_000, side="right")), start + 1)
        n = more[start:end]
        a = np.repeat(np.arange(start, end), n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + a + 1
        a, b = order[a], order[b]
        for line in points.T[1:]:
            near = np.abs(line[a] - line[b]) <= window
            a, b = a[near], b[near]
        if len(a):
            yield a, b
        start = end


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each vector and set, its cells, with the projections a candidate is found by."""
    for batch in batches:
        out: list[tuple] = []
        for row, size, raw in zip(*[batch.column(c).to_pylist() for c in ("row", "size", "unit")]):
            v = np.frombuffer(raw, float)
            points = v @ lines_for(len(v))
            lines = key_lines(size)
            rounded = np.round(points[:LINES] / STEP).clip(-127, 127).astype(np.int8).tobytes()
            for nth in range(key_sets(lines)):
                own = points[set_lines(nth, lines)]
                home = tuple(np.floor(own / CELL).astype(int))
                touched = [range(int(np.floor((x - KEY_WINDOW - 1e-9) / CELL)),
                                 int(np.floor((x + KEY_WINDOW + 1e-9) / CELL)) + 1) for x in own]
                narrow = own.astype("<f4").tobytes() + rounded
                for cell in product(*touched):
                    out.append((row, nth, ",".join(map(str, cell)), cell == home, narrow))
            if len(out) > 20_000:
                yield _cell_rows(out)
                out = []
        if out:
            yield _cell_rows(out)


def _cell_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      ["row", "nth", "place", "home", "narrow"])


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole tasks with the group of each row, and whether its partner must be of another block."""
    for table in whole_groups(batches, ["cell", "lo", "hi"], 4 * BLOCK):
        table = table.combine_chunks()
        starts = group_starts(table, ["cell", "lo", "hi"])
        group = np.zeros(table.num_rows, np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        across = table.column("lo").to_numpy() != table.column("hi").to_numpy()
        yield table, group, across


def _allowed(table: pa.Table, across: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs that this task is to look at: of two blocks one from each, and one of the two at home."""
    block, home = table.column("block").to_numpy(), table.column("home").to_numpy(zero_copy_only=False)
    return (home[a] | home[b]) & ~(across[a] & (block[a] == block[b]))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cell and row of all that have a candidate in the cell."""
    for table, group, across in _tasks(batches):
        raw = table.column("narrow").to_pylist()
        has = np.zeros(table.num_rows, bool)
        length = np.array([len(x) for x in raw])
        for size in np.unique(length):
            here = np.flatnonzero(length == size)
            data = np.frombuffer(b"".join([raw[i] for i in here]), np.uint8).reshape(len(here), -1)
            own = np.ascontiguousarray(data[:, :-LINES]).view("<f4").astype(float)
            counted = np.ascontiguousarray(data[:, -LINES:]).view(np.int8)
            # Rounding must not lose any: windows are wider here.
            wide = int(np.ceil(WINDOW / STEP)) + 1
            for a, b in window_pairs(group[here], own, KEY_WINDOW + 1e-4):
                some = _allowed(table, across, here[a], here[b])
                a, b = a[some], b[some]
                enough = (np.abs(counted[a].astype(np.int16) - counted[b]) <= wide).sum(axis=1) >= fewest_collisions()
                has[here[a[enough]]] = has[here[b[enough]]] = True
        at = np.flatnonzero(has)
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [table.column(c).combine_chunks().take(pa.array(at)) if c != "cell" else pa.array(
                    table.column(c).to_numpy()[at]) for c in ("cell", "row")], ["cell", "row"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each vector (weighted by how many share it) and the smallest id it is joined with."""
    for table, group, across in _tasks(batches):
        home, nth, size = (table.column(c).to_numpy(zero_copy_only=False) for c in ("home", "nth", "size"))
        weight, least = table.column("weight").to_numpy(), table.column("row").to_numpy()
        raw = table.column("unit").to_pylist()
        links = np.zeros(table.num_rows, np.int64)
        joined: list[tuple[np.ndarray, np.ndarray]] = []
        kinds = np.array([f"{len(x)}/{key_lines(n)}/{s}" for x, n, s in zip(raw, size, nth)])
        for kind in np.unique(kinds):
            here = np.flatnonzero(kinds == kind)
            units = np.frombuffer(b"".join([raw[i] for i in here]), float).reshape(len(here), -1)
            points = units @ lines_for(units.shape[1])
            _, lines, own = map(int, kind.split("/"))
            for a, b in window_pairs(group[here], points[:, set_lines(own, lines)], KEY_WINDOW):
                some = _allowed(table, across, here[a], here[b])
                a, b = a[some], b[some]
                # A pair that collides in several sets counts in the first.
                for before in range(own):
                    gap = np.abs(points[a, set_lines(before, lines)] - points[b, set_lines(before, lines)])
                    new = ~(gap <= KEY_WINDOW).all(axis=1)
                    a, b = a[new], b[new]
                enough = collisions(points[:, :LINES], a, b) >= fewest_collisions()
                a, b = a[enough], b[enough]
                same = np.einsum("ij,ij->i", units[a], units[b]) >= COSINE
                a, b = here[a[same]], here[b[same]]
                # A vector's whole window is in its home cell, so there its links count once.
                links += np.bincount(a[home[a]], weight[b[home[a]]], table.num_rows).astype(np.int64)
                links += np.bincount(b[home[b]], weight[a[home[b]]], table.num_rows).astype(np.int64)
                joined.append((a, b))
        if not joined:
            continue
        order = np.argsort(least, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        low = forest(len(order), *[rank[np.concatenate(x)] for x in zip(*joined)])
        low = order[low[rank]]
        has = np.flatnonzero((links > 0) | (least[low] != least))
        yield pa.RecordBatch.from_arrays(
            [pa.array(least[has]), pa.array(links[has]), pa.array(least[low[has]])], ["row", "links", "low"])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(name, label, unit(values)) for name, label, values in zip(*[c.to_pylist() for c in batch.columns])]
        found = [(name, label, v.tobytes()) for name, label, v in found if v is not None]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.string(), pa.binary()))],
                ["id", "label", "unit"])


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Only vectors with the same label (null: none) and length are compared. Null and zero vectors and those with null
    or non-finite components link with nothing, nor do rows without an id. Repeated rows are one vector; rows that
    share an id but differ are one vector that has the links of both. Equal vectors are compared as one, with the weight
    of all. Other columns are not looked at.
    """
    bounded_batches(vectors.sparkSession, 2000)
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    fit = rows.where("id is not null and label is not null and embedding is not null").distinct()
    units = fit.mapInArrow(_units, "id long, label string, unit binary").withColumn(
        "kind", F.xxhash64("label", F.length("unit")))
    members = stored(units.withColumn("key", F.unhex(F.sha2(F.col("unit"), 256))))
    # A row number of its own: an id may stand for several vectors.
    classes = stored(members.groupBy("label", "kind", "key").agg(
        F.count(F.lit(1)).alias("weight"), F.first("unit").alias("unit")).withColumn(
        "row", F.monotonically_increasing_id()))
    classes = classes.join(classes.groupBy("kind").agg(F.count(F.lit(1)).alias("size")), "kind")
    cells = stored(classes.select("row", "size", "unit", "kind").mapInArrow(
        _cells, "row long, nth int, place string, home boolean, narrow binary").join(
        classes.select("row", "kind"), "row").select(
        "row", "nth", "home", "narrow", F.xxhash64("kind", "nth", "place").alias("cell")))
    blocks = in_blocks(cells, "cell", "row", BLOCK)
    met = stored(_by_task(blocks.select("cell", "lo", "hi", "block", "row", "home", "narrow")).mapInArrow(
        _met, "cell long, row long").distinct())
    whole = in_blocks(cells.select("cell", "row", "nth", "home").join(met, ["cell", "row"]), "cell", "row", BLOCK).join(
        classes.select("row", "size", "weight", "unit"), "row")
    found = stored(_by_task(whole).mapInArrow(_links, "row long, links long, low long"))
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    own = stored(members.join(classes.select("label", "kind", "key", "row", "weight"), ["label", "kind", "key"]).join(
        links, "row", "left").select("id", "row", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n")))
    several = own.groupBy("id").agg(F.min("row").alias("a"), F.max("row").alias("z")).where("a < z")
    edges = found.select(F.col("row").alias("a"), F.col("low").alias("b")).where("a <> b").union(
        own.join(several, "id").where("row > a").select("row", "a"))
    # Components over classes; the smallest id in them is the name.
    placed = own.join(components(edges).withColumnRenamed("id", "row"), "row", "left").withColumn(
        "group", F.coalesce("component", "row"))
    smallest = placed.groupBy("group").agg(F.min("id").alias("component_id"))
    known = placed.join(smallest, "group").groupBy("id").agg(
        F.sum("n").alias("n_links"), F.min("component_id").alias("component_id"))
    component = F.coalesce("component_id", "id")
    return rows.select("id").join(known, "id", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _by_task(rows: DataFrame) -> DataFrame:
    return rows.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi", "block", "row")
