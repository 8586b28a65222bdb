"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import re
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are what lies between blanks: U+0020 and U+0009 to U+000D.
BLANKS = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where none is set and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, survives lost executors.

    The folder goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def positions(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``pos``, the row's place within its key in ``order`` (nulls first), and ``n``, the key's rows.

    Rows are dealt by ranges of key and order and numbered where they lie; what a key has in earlier ranges is added
    from a table with one row per key and range. A key may span any number of ranges. Equal rows take any of their
    places.
    """
    ranged = stored(
        df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    held = ranged.groupBy(*keys, part.alias("__part")).agg(
        F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    key = Window.partitionBy(*keys)
    before = key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__in"), F.sum("__n").over(key).alias("n"),
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__base"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return ranged.join(held, [*same, part == F.col("__in")]).withColumn("pos", F.col("__at") + F.col("__base")).drop(
        "__at", "__in", "__base", *[f"__{k}" for k in keys])


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Hand Python at most so many rows at once: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_key(text: Column) -> Column:
    """128 bits that tell texts of one doc_id apart."""
    return F.unhex(F.md5(text.cast("binary")))


def some_texts(docs: DataFrame, most: int) -> DataFrame:
    """At most ``most`` different (doc_id, text) of ``docs`` with a text, and their ``hash``: those hashed lowest.

    Only rows whose hash lies under a bound are looked at further, about twice as many as asked for, so neither a
    shuffle nor a task grows with the table. Copies count once.
    """
    share = min(1.0, 2 * most / max(1, docs.count()))
    rows = docs.where("text is not null").select("doc_id", "text", F.xxhash64("doc_id", "text").alias("hash"))
    rows = rows.where(F.col("hash") <= int(-(1 << 63) + share * ((1 << 64) - 1025)))
    return rows.dropDuplicates(["hash", "doc_id"]).orderBy("hash", "doc_id").limit(most)


def task_number() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that never cut a group; the input is sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        last = group_starts(table, keys)[-1]
        if last == 0:
            continue
        yield table.slice(0, last)
        rest = table.slice(last).combine_chunks()
        held, n = rest.to_batches(), rest.num_rows
    if n:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each run of equal keys starts."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For vertices 0..n-1 joined by edges: the smallest vertex each one reaches."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def in_blocks(df: DataFrame, cell: str, by: str, rows: int) -> DataFrame:
    """Prepare comparison of all rows of a cell with each other, however large the cell is.

    A cell of over ``rows`` rows is cut into blocks by a hash of ``by``; every pair of blocks is a task of its
    own. Adds ``lo`` and ``hi`` (the pair of blocks) and ``block`` (the row's own); a row comes once for every pair
    that its block belongs to. Two rows of a cell meet in exactly one task, so no task holds more than about
    ``2 * rows`` rows and no pair is a row of any table. ``df`` should be narrow; wide columns are joined afterwards.
    """
    sizes = df.groupBy(cell).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    blocks = F.ceil(F.col("__n") / rows).cast("int")
    return (
        df.join(sizes, cell)
        .withColumn("block", F.pmod(F.xxhash64(by, F.lit(rows)), blocks).cast("int"))
        .withColumn("__other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("lo", F.least("block", "__other"))
        .withColumn("hi", F.greatest("block", "__other"))
        .drop("__n", "__other")
    )


def by_task(df: DataFrame, cell: str, by: str) -> DataFrame:
    """Rows of ``in_blocks`` dealt by task and sorted, for ``tasks`` below."""
    return df.repartition(cell, "lo", "hi").sortWithinPartitions(cell, "lo", "hi", "block", by)


def tasks(batches: Iterator[pa.RecordBatch], cell: str, rows: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole tasks with the positions of all pairs to compare, the first position in the lower block."""
    for table in whole_groups(batches, [cell, "lo", "hi"], rows):
        starts = group_starts(table, [cell, "lo", "hi"])
        lo, hi, block = (table.column(c).to_numpy() for c in ("lo", "hi", "block"))
        left, right = pairs_within(starts, table.num_rows)
        apart = (lo[left] != hi[left]) & (block[left] == block[right])
        yield table, left[~apart], right[~apart]


def pairs_within(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j of all pairs inside runs that begin at ``starts``; ``n`` rows in all."""
    ends = np.append(starts[1:], n)
    end_of = np.repeat(ends, ends - starts)
    more = end_of - np.arange(n) - 1
    left = np.repeat(np.arange(n), more)
    right = np.arange(len(left)) - np.repeat(np.cumsum(more) - more, more) + left + 1
    return left, right


class Pieces(dict):
    """Piece of a text -> its token ids as little-endian bytes. Fills itself; starts anew when it is full."""

    def __init__(self, encode: Callable[[str], bytes], limit: int = 1_200_000):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(self) >= self.limit:
            self.clear()
        self[piece] = ids
        return ids


_BLANK = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Where a blank may not be cut off from the blanks before it.
_ODD_BLANKS = f"{_BLANK} ({_BLANK}|$)|  |^ $"
_BEFORE_WORD = re.compile(r"(?= \S)")


def space_pieces(text: str) -> list[str]:
    """Cut before each single space that a character follows: the byte-level pattern always cuts there too."""
    return _BEFORE_WORD.split(text)


def encode_column(texts: pa.Array, pieces: Pieces, blanks_dropped: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and how many each text has.

    Every distinct piece of the column is looked up once; the rest is array work. Pieces are the ASCII-lowered words
    between ASCII blanks if the vocabulary drops blanks, else words with the space before them.
    """
    if blanks_dropped:
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    else:
        odd = pc.match_substring_regex(texts, _ODD_BLANKS)
        if pc.any(odd).as_py():
            return _joined([
                encode_column(texts.slice(i, n), pieces, False) if not flag else
                _by_piece(texts.slice(i, n), pieces) for flag, i, n in _runs(odd.to_numpy(zero_copy_only=False))])
        split = pc.split_pattern(texts, " ")
    offsets = split.offsets.to_numpy()
    coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    codes, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    if not blanks_dropped:
        first = offsets[:-1][offsets[1:] > offsets[:-1]]
        firsts = [words[c] for c in codes[first]]
        codes = codes.copy()
        codes[first] = len(words) + np.arange(len(first))
        words = [" " + w for w in words] + firsts
    found = [pieces[w] for w in words]
    flat = np.frombuffer(b"".join(found), "<u4")
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    at = np.cumsum(sizes) - sizes
    n = sizes[codes]
    end = np.cumsum(n)
    total = int(end[-1]) if len(end) else 0
    ids = flat[np.repeat(at[codes] - (end - n), n) + np.arange(total)]
    return ids, np.diff(np.concatenate([[0], end])[offsets])


def _by_piece(texts: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    found = [b"".join([pieces[p] for p in space_pieces(t)]) for t in texts.to_pylist()]
    return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)


def _joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _runs(flags: np.ndarray) -> list[tuple[bool, int, int]]:
    """(flag, start, length) of each run of equal flags."""
    starts = np.flatnonzero(np.concatenate([[True], flags[1:] != flags[:-1]]))
    return [(bool(flags[i]), int(i), int(j - i)) for i, j in zip(starts, [*starts[1:], len(flags)])]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or U+0100 onwards."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


#: Around a single line break between other characters the byte-level pattern always cuts.
_ONE_BREAK = re.compile(r"(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")


class LibraryIds:
    """Ids by the tokenizers library, called once for each distinct piece.

    A text is cut only where the vocabulary's own pattern always cuts, so the ids of the pieces joined are the ids
    of the whole text. A piece that is one run of Latin letters is one pre-token and goes to the library's model
    directly; any other one passes its whole pipeline.
    """

    _WORD = re.compile(r"( ?[A-Za-zÀ-ɏ]*[A-Za-z])([.,;:!?]*)")
    _LATIN = re.compile(" ?[A-Za-zÀ-ɏ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.lowers = "Lowercase" in str(self.tokenizer.normalizer)
        # Special tokens are found before any cutting; texts that may hold one take the whole pipeline.
        assert all(t.content.startswith("<|") for t in self.tokenizer.get_added_tokens_decoder().values())
        self.symbols = {i: s for i, s in enumerate(byte_symbols())}
        self.pieces = Pieces(self._piece)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes:
        if not word.isascii():
            if not word.removeprefix(" ").isalpha() or (self.lowers and word != word.lower()):
                return self.whole(word)
            word = word.encode().decode("latin-1").translate(self.symbols)
        elif word[0] == " ":
            word = self.symbols[32] + word[1:]
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if found := self._WORD.fullmatch(piece):
            letters, tail = found.groups()
            return self._letters(letters) + self.pieces[tail] if tail else self._letters(letters)
        if self._LATIN.fullmatch(piece):
            return self._letters(piece)
        if not self.lowers and "\n" in piece and piece.isascii():
            parts = _ONE_BREAK.split(piece)
            if len(parts) > 1:
                return b"".join([self.pieces[x] for x in parts])
        return self.whole(piece)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) one after another, and how many each text has."""
        texts = texts.fill_null("")
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        special = pc.match_substring(texts, "<|")
        return _joined([
            encode_column(texts.slice(i, n), self.pieces, self.lowers) if not flag else
            self._wholes(texts.slice(i, n)) for flag, i, n in _runs(special.to_numpy(zero_copy_only=False))])

    def _wholes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [self.whole(t) for t in texts.to_pylist()]
        return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)
