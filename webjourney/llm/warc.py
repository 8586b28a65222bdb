"""WARC archives and their merged capture index.

Every task sorts its own captures by URL key and time and writes them as gzip members into archives of bounded size, so a
page never leaves the task that reads it. Reading an archive back gives a run of index rows in that order. The runs are
merged by ranges of URL key and time: a task gets the piece of every run that falls into its range and merges these
pieces with a loser tree, which gives globally ordered capture histories.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webjourney.llm.common import bounded_batches, shared_folder, stored, task_number

VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES, MERGE_ROWS = 64 << 20, 500_000
#: The end of the year 9999.
LAST_SECOND = 253402300799


def target_uri(url: Column) -> Column:
    """The URL as a header can hold it: blanks and control characters percent-encoded, null empty."""
    odd = "[\\x00-\\x20\\x7F]"
    coded = F.array_join(F.transform(F.split(url, ""), lambda c: F.when(
        c.rlike(odd), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")
    return F.coalesce(F.when(url.rlike(odd), coded).otherwise(url), F.lit(""))


def url_key(url: Column) -> Column:
    """Host parts in reverse, lower case, without ``www`` and port, then ``)``, path and query, without fragment."""
    form = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, form, 1)), r"^www\d*\.", "")
    rest = F.regexp_extract(url, form, 2)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"),
                    F.when(rest == "", F.lit("/")).otherwise(rest))


def captures(pages: DataFrame, seconds: Column, least: int = 100) -> DataFrame:
    """What is to be written: page_id, url, key, seconds, payload, digest, refers_to.

    Of the pages with equal payloads of ``least`` bytes or more, all but those with the smallest page_id refer to it. A
    null html is the empty payload, a null page_id refers but is not referred to, a null time is zero and any other one
    lies in 1970 to 9999 or is moved there. Repeated rows of the smallest page_id are responses, each of them.
    """
    url = target_uri(F.col("url").cast("string"))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), url.alias("url"),
        F.greatest(F.lit(0), F.least(F.lit(LAST_SECOND), F.coalesce(seconds.cast("long"), F.lit(0)))).alias("seconds"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("key", url_key(F.col("url"))).withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.length("payload") >= least).select("page_id", "digest")
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Narrow rows decide what refers to what; written, so the planner knows how much there is to join.
    later = stored(
        large.join(firsts, "digest").where(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
        .select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), F.col("first").alias("refers_to"))
        .distinct())
    same = [F.col("page_id").eqNullSafe(F.col("__id")), F.col("digest") == F.col("__digest")]
    return rows.join(later, same, "left").drop("__id", "__digest")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_id(name: str) -> int | None:
    found = name.removeprefix("<urn:page:").removesuffix(">")
    return None if found == "null" else int(found)


def _record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """One gzip member with one record."""
    named = {"WARC-Type": kind, **headers, "Content-Length": str(len(block))}
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in named.items())
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"%b\r\n%b\r\n%b\r\n\r\n" % (VERSION, head, block)) + pack.flush()


def _date(seconds: int) -> str:
    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _http(payload_bytes: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes


def write_archives(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``captures`` into gzipped archives under the shared folder; returns archive (its path) and records.

    An archive begins with a ``warcinfo`` record. A task that runs again writes archives of its own; those that no row
    names do not count. No page, no archive.
    """
    spark = rows.sparkSession
    bounded_batches(spark, 200)
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        own, nth, out, size, records = f"{task_number():05d}-{uuid.uuid4().hex[:12]}", 0, None, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({
                "archive": [f"{folder}/{own}-{nth:05d}.warc.gz"], "records": pa.array([records], pa.int64())})

        for batch in batches:
            for page, url, seconds, payload, digest, first in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    out = fs.open_output_stream(posixpath.join(base, f"{own}-{nth:05d}.warc.gz"), compression=None)
                    size, records = out.write(_record("warcinfo", {
                        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": _date(0),
                        "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")), 0
                headers = {"WARC-Record-ID": record_id(page), "WARC-Date": _date(seconds), "WARC-Target-URI": url,
                           "WARC-Payload-Digest": f"sha256:{digest}",
                           "Content-Type": "application/http;msgtype=response"}
                head = _http(len(payload))
                if first is None:
                    size += out.write(_record("response", headers, head + payload))
                else:
                    headers |= {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": record_id(first)}
                    size += out.write(_record("revisit", headers, head))
                records += 1
                if size >= archive_bytes:
                    yield close()
                    out, nth = None, nth + 1
        if out is not None:
            yield close()

    local = rows.sortWithinPartitions("key", "seconds", "page_id", "digest")
    return stored(local.select("page_id", "url", "seconds", "payload", "digest", "refers_to").mapInArrow(
        run, "archive string, records long"))


def members(stream: pa.NativeFile, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, compressed length and content of each gzip member."""
    start, raw = 0, stream.read(chunk)
    while raw:
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not raw:
                raw = stream.read(chunk)
                if not raw:
                    raise ValueError(f"archive ends inside the member at {start}")
            parts.append(unpack.decompress(raw))
            used += len(raw) - len(unpack.unused_data)
            raw = unpack.unused_data
        yield start, used, b"".join(parts)
        start += used
        raw = raw or stream.read(chunk)


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, cut, rest = content.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not cut or lines[0] != VERSION:
        raise ValueError("not a WARC record")
    headers = dict(line.decode().split(": ", 1) for line in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record of another length than it says")
    return headers, rest[:n]


_INDEX = pa.schema([
    ("archive", pa.string()), ("place", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()),
    ("page_id", pa.int64()), ("url", pa.string()), ("seconds", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_archives(archives: DataFrame) -> DataFrame:
    """Index rows of all records, one run for each archive: archive, place, offset, length, page_id, url, key, seconds,
    payload_bytes, payload_digest, record_type, refers_to.

    A response's size and digest are taken from its payload and must agree with its headers; a revisit has the headers
    only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                fs, path = FileSystem.from_uri(archive)
                with fs.open_input_stream(path, compression=None) as stream:
                    rows: list[dict] = []
                    for place, (offset, length, content) in enumerate(members(stream)):
                        headers, block = parse(content)
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(head.rsplit(b"Content-Length: ", 1)[1])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"{archive} at {offset}: the payload is not the one written")
                        date = datetime.strptime(headers["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ")
                        rows.append({
                            "archive": archive, "place": place, "offset": offset, "length": length,
                            "page_id": _page_id(headers["WARC-Record-ID"]), "url": headers["WARC-Target-URI"],
                            "seconds": int(date.replace(tzinfo=timezone.utc).timestamp()), "payload_bytes": size,
                            "payload_digest": digest, "record_type": kind,
                            "refers_to": _page_id(headers["WARC-Refers-To"]) if kind == "revisit" else None})
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist(rows, _INDEX)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _INDEX)

    # One archive a task: their names are few bytes, so the planner would put them all into one.
    n = max(1, archives.count())
    found = archives.select("archive").repartition(n).mapInArrow(
        run, "archive string, place long, offset long, length long, page_id long, url string, seconds long, "
        "payload_bytes long, payload_digest string, record_type string, refers_to long")
    return stored(found.withColumn("key", url_key(F.col("url"))))


class LoserTree:
    """Positions of several sorted runs in one order: each inner node keeps the run that lost there."""

    def __init__(self, keys: list[tuple], starts: list[int], ends: list[int]):
        self.keys, self.at, self.ends, self.k = keys, list(starts), ends, len(starts)
        self.losers = [-1] * self.k
        self.winner = -1
        for run in range(self.k):
            self._play(run)

    def _before(self, a: int, b: int) -> bool:
        if self.at[b] >= self.ends[b]:
            return self.at[a] < self.ends[a] or a < b
        return self.at[a] < self.ends[a] and (self.keys[self.at[a]], a) < (self.keys[self.at[b]], b)

    def _play(self, run: int) -> None:
        node = (run + self.k) >> 1
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = run
                return
            if self._before(other, run):
                self.losers[node], run = run, other
            node >>= 1
        self.winner = run

    def __iter__(self) -> Iterator[int]:
        while self.k and self.at[self.winner] < self.ends[self.winner]:
            run = self.winner
            yield self.at[run]
            self.at[run] += 1
            if self.at[run] < self.ends[run] and self.keys[self.at[run]] < self.keys[self.at[run] - 1]:
                raise ValueError("a run that is not sorted")
            self._play(run)


def merge_histories(index: DataFrame, rows: int = MERGE_ROWS) -> DataFrame:
    """All runs in one order of key, seconds and page_id (null first): the index rows with ``at``, which ascends in it.

    A task holds the index rows of one range, about ``rows`` of them, however many runs they come from and however often
    one URL was captured.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        archive = table.column("archive").to_pylist()
        cuts = [i for i in range(len(archive)) if not i or archive[i] != archive[i - 1]]
        keys = [(k, s, p is not None, p or 0, d) for k, s, p, d in zip(
            *[table.column(c).to_pylist() for c in ("key", "seconds", "page_id", "payload_digest")])]
        order = np.fromiter(LoserTree(keys, cuts, [*cuts[1:], len(archive)]), np.int64, len(archive))
        yield from table.take(pa.array(order)).combine_chunks().to_batches(max_chunksize=10_000)

    spark = index.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // rows))
    dealt = index.repartitionByRange(n, "key", "seconds", "page_id", "payload_digest", "archive", "place")
    merged = dealt.sortWithinPartitions("archive", "place").mapInArrow(run, index.schema)
    return merged.withColumn("at", F.monotonically_increasing_id())
