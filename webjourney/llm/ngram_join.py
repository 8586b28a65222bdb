"""Similarity join of texts on word shingles with Bayesian candidate pruning.

Texts with the same set of shingles form a class, and one of each class is compared. Banding of MinHash values finds
candidates: two sets of similarity 0.8 agree in none of 24 bands of 4 values with a probability of 5e-10... 3e-6 at
most. A pair's values are compared 16 at a time; it is dropped once the posterior probability that its similarity
reaches the threshold, given the agreement so far and a uniform prior, is below ``TOLERANCE``. What is left joins
texts to neighbourhoods, inside which the surviving pairs are verified exactly on their shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webjourney.llm.common import (
    BLANKS, bounded_batches, by_task, forest, in_blocks, stored, tasks)
from webjourney.llm.components import components

WORDS, THRESHOLD, VALUES, BAND, STEP, TOLERANCE = 5, 0.8, 96, 4, 16, 1e-6
_RNG = np.random.default_rng(20240229)
_FACTORS = _RNG.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def fewest_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The least number of equal values out of ``n`` at which a pair is not dropped.

    With a uniform prior, P(similarity >= t | m of n equal) = P(Binomial(n + 1, t) <= m).
    """
    total = 0.0
    for m in range(n + 2):
        total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n + 1


_FEWEST = [(n, fewest_matches(n)) for n in range(STEP, VALUES + 1, STEP)]


def plausible(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of ``values`` that are not dropped on the way."""
    same = np.zeros(len(left), np.int16)
    for n, least in _FEWEST:
        some = slice(n - STEP, n)
        same += (values[left, some] == values[right, some]).sum(axis=1, dtype=np.int16)
        stay = same >= least
        left, right, same = left[stay], right[stay], same[stay]
    return left, right


def shingle_sets(words: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingles of each row of word hashes; a text of fewer words has one shingle, of all of them."""
    offsets = words.offsets.to_numpy()
    flat = words.values.to_numpy()[offsets[0]:offsets[-1]].view(np.uint64)
    offsets = offsets - offsets[0]
    mixed = np.zeros(max(0, len(flat)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            part = flat[k:]
            mixed[:len(part)] = (mixed[:len(part)] ^ part) * np.uint64(0x9E3779B97F4A7C15)
            mixed[:len(part)] ^= mixed[:len(part)] >> np.uint64(29)
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if b - a >= WORDS:
                out.append(np.unique(mixed[a:b - WORDS + 1]))
            elif b > a:
                one = np.uint64(b - a)
                for w in flat[a:b]:
                    one = (one ^ w) * np.uint64(0xC2B2AE3D27D4EB4F)
                out.append(np.array([one], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def min_values(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, a row for each (non-empty) set."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros((len(sets), VALUES), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(VALUES if len(sets) else 0):
            out[:, k] = np.minimum.reduceat(((flat * _FACTORS[k] + _SHIFTS[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def band_cells(values: np.ndarray) -> np.ndarray:
    """A 64-bit name of what each band holds, different for each band."""
    bands = values.reshape(len(values), VALUES // BAND, BAND).astype(np.uint64)
    cells = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=np.uint64), bands.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(BAND):
            cells = (cells ^ bands[:, :, k]) * np.uint64(0x9FB21C651E98DF25)
            cells ^= cells >> np.uint64(31)
    return cells.view(np.int64)


def _hashed(docs: DataFrame, *more: str) -> DataFrame:
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), BLANKS), "")
    return docs.select("doc_id", *more, F.transform(words, lambda w: F.xxhash64(w)).alias("words"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, set_key (null: no words), bands and 16 bits of each value, for every row with an id; stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1))
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            cells: list = [None] * len(sets)
            packed: list = [None] * len(sets)
            values = min_values([sets[i] for i in full])
            names = band_cells(values)
            for row, i in enumerate(full):
                keys[i] = set_key(sets[i])
                cells[i], packed[i] = names[row], values[row].astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(keys, pa.binary()), pa.array(cells, pa.list_(pa.int64())),
                pa.array(packed, pa.binary())], ["doc_id", "set_key", "bands", "packed"])

    bounded_batches(docs.sparkSession, 500)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    return stored(_hashed(rows).mapInArrow(
        run, "doc_id long, set_key binary, bands array<long>, packed binary"))


def _values(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, VALUES)


def candidate_edges(reps: DataFrame) -> DataFrame:
    """Edges (a, b) that join all texts that some plausible pair joins; a few per text, not one per pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, left, right in tasks(batches, "cell", 2048):
            name, values = table.column("rep").to_numpy(), _values(table.column("packed"))
            left, right = plausible(values, left, right)
            low = forest(table.num_rows, left, right)
            has = np.flatnonzero(low != np.arange(table.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(name[has]), pa.array(name[low[has]])], ["a", "b"])

    bounded_batches(reps.sparkSession, 2000)
    cells = reps.select("rep", F.explode("bands").alias("cell"))
    rows = in_blocks(cells, "cell", "rep", 512).join(reps.select("rep", "packed"), "rep")
    return by_task(rows, "cell", "rep").mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, reps: DataFrame, members: DataFrame) -> DataFrame:
    """(rep, links, low): a text's links in a task and the smallest text it reaches there. members: (id, component)."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shingle_sets(batch.column(3))
            # A row may share its id with other texts: only the one that stands for the class goes on.
            own = [i for i, (s, k) in enumerate(zip(found, batch.column(2).to_pylist())) if set_key(s) == k]
            found = [found[i] for i in own]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(own, pa.int64())), batch.column(1).take(pa.array(own, pa.int64())),
                pa.array([s.tobytes() for s in found], pa.binary()),
                pa.array([v.astype("<u2").tobytes() for v in min_values(found)], pa.binary())],
                ["rep", "cell", "shingles", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, left, right in tasks(batches, "cell", 256):
            left, right = plausible(_values(table.column("packed")), left, right)
            own = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            sizes = np.array([len(x) for x in own])
            distinct, flat = np.unique(np.concatenate(own), return_inverse=True)
            starts = np.cumsum(sizes) - sizes
            seen = np.zeros(len(distinct), bool)
            link = np.zeros(len(left), bool)
            order = np.argsort(left, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(left[order])) + 1) if len(order) else []:
                i = left[some[0]]
                mine = flat[starts[i]:starts[i] + sizes[i]]
                seen[mine] = True
                for part in np.array_split(some, -(-len(some) // 64)):
                    n = sizes[right[part]]
                    at = np.cumsum(n) - n
                    take = np.repeat(starts[right[part]] - at, n) + np.arange(n.sum())
                    both = np.add.reduceat(seen[flat[take]].astype(np.int64), at)
                    link[part] = both >= THRESHOLD * (sizes[i] + n - both) - 1e-9
                seen[mine] = False
            left, right = left[link], right[link]
            links = np.bincount(left, minlength=len(own)) + np.bincount(right, minlength=len(own))
            low = forest(len(own), left, right)
            name = table.column("rep").to_numpy()
            has = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([
                pa.array(name[has]), pa.array(links[has].astype(np.int64)), pa.array(name[low[has]])],
                ["rep", "links", "low"])

    spark = docs.sparkSession
    bounded_batches(spark, 500)
    wanted = members.withColumnRenamed("id", "rep").join(reps.select("rep", "set_key"), "rep").withColumnRenamed(
        "rep", "doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id").withColumn(
        "__text", F.xxhash64("text")).dropDuplicates(["doc_id", "set_key", "__text"])
    texts = stored(_hashed(rows, "component", "set_key").mapInArrow(
        sets, "rep long, cell long, shingles binary, packed binary"))
    blocks = in_blocks(texts.select("rep", "cell"), "cell", "rep", 256)
    wide = blocks.join(texts.drop("cell"), "rep")
    return stored(by_task(wide, "cell", "rep").mapInArrow(run, "rep long, links long, low long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` with an id: doc_id, class_id, n_links, group_id, kept.

    class_id is the smallest doc_id whose text has the same set of shingles (5 words as they are); n_links the number
    of other classes with a Jaccard similarity of 0.8 or more; group_id the smallest class_id that links reach;
    kept = (doc_id = group_id). Null, empty and blank texts have no shingles: each is a class of its own. Rows without
    an id are not compared and left out. Rows that share an id are one document with several texts. Other columns are
    not looked at.
    """
    found = signatures(docs)
    classes = found.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first(F.struct("bands", "packed")).alias("s"))
    reps = stored(classes.select("set_key", "rep", "s.bands", "s.packed"))
    members = components(candidate_edges(reps))
    links = verified(docs, reps, members)
    counts = links.groupBy("rep").agg(F.sum("links").alias("n_links"))
    groups = components(links.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    known = reps.select("set_key", "rep").join(counts, "rep", "left").join(
        groups.withColumnRenamed("id", "rep"), "rep", "left").select(
        "set_key", F.col("rep").alias("class_id"), "n_links", F.coalesce("component", "rep").alias("group_id"))
    rows = found.select("doc_id", "set_key").join(known, "set_key", "left")
    group = F.coalesce("group_id", "doc_id")
    return rows.select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), group.alias("group_id"),
        (group == F.col("doc_id")).alias("kept"))
