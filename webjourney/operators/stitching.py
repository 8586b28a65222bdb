"""Visits of others that share address and agent with a client, matched where they are needed.

A client has to do with every visit of its fingerprints in the hours up to one of its own, so pairs of client and visit grow
with the square of a fingerprint. They are made by the task that uses them and go through no shuffle: visits lie in blocks
by fingerprint and time, clients of a fingerprint are dealt to groups of about as many pairs, and a group gets the blocks
that it needs and the times of its own visits. How many visits of a client follow a foreign one within the hours changes at
those times only, so a client's share of a block is a few slices of it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webjourney.functions.predicates import micros
from webjourney.operators.ordered import work_table

#: Pairs of a group, about; rows matched and pairs made at once; bytes of text joined at once.
GROUP_PAIRS, ROWS, PAIRS, TEXT_BYTES = 1 << 22, 1 << 16, 1 << 17, 1 << 24
_NULL = -(1 << 63)  # stands for a missing time or id, which comes first
_CLIENT, _HELD, _TIME, _BLOCK = range(4)
_COLUMNS = {"grp": "long", "near": "long", "kind": "int", "client": "string", "fp": "string", "us": "long", "n": "long",
            "place": "int", "at": "long", "oid": "long", "look": "string", "data": "binary"}
_STORIES = ("unified_client_id string, started_us long, completed_us long, path string, p1 array<string>, p2 array<string>, "
            "f1 string, f2 string, referrer string, source string, medium string, first_us long")


def fingerprinted(visits: DataFrame, *more: str) -> DataFrame:
    """``fp, owner, us`` of visits that can match; a missing part of the fingerprint, or no time, matches nothing."""
    # A digest of address and agent keeps the rows narrow.
    return visits.where(
        F.col("ip_address").isNotNull() & F.col("user_agent").isNotNull() & F.col("timestamp").isNotNull()).select(
        F.md5(F.concat_ws("|", "ip_address", "user_agent")).alias("fp"), F.col("client_id").alias("owner"),
        micros(F.col("timestamp")).alias("us"), *more)


def _near(window: int) -> Column:
    us = F.col("us")
    return F.floor((us - F.pmod(us, F.lit(window))) / window + 0.5).cast("long")


class Meeting:
    """Who meets which blocks. ``items``: ``fp, owner, us`` and payload; ``times``: ``client, fp, us``."""

    def __init__(self, items: DataFrame, times: DataFrame, window: int) -> None:
        self.window, near = window, _near(window)
        items = items.withColumn("near", near)
        # A visit of a client concerns the block of its time and the one before.
        times = work_table(times).select("client", "fp", "us", F.explode(F.array(near, near - 1)).alias("near"))
        spots = times.select("client", "fp", "near").distinct()
        cells = spots.select("fp", "near").distinct().join(items.groupBy("fp", "near").agg(F.count("*").alias("m")), ["fp", "near"])
        volume = work_table(spots.join(cells, ["fp", "near"]).groupBy("client").agg(
            F.sum("m").alias("m"), F.min("fp").alias("main")))
        parts = volume.groupBy("main").agg(F.ceil(F.sum("m") / GROUP_PAIRS).alias("parts"))
        self.groups = volume.join(parts, "main").select(
            "client", F.xxhash64("main", F.pmod(F.xxhash64("client"), F.col("parts"))).alias("grp"))
        total = volume.agg(F.sum("m")).first()[0] or 0
        self.tasks = max(-(-total // GROUP_PAIRS), int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        cut = F.pmod(F.xxhash64("owner", "us"), F.ceil(F.col("m") / ROWS)).alias("cut")
        blocks = items.join(cells, ["fp", "near"]).select("fp", "near", cut, *[c for c in items.columns if c not in ("fp", "near")])
        blocks = blocks.repartition("fp", "near", "cut").sortWithinPartitions("fp", "near", "cut").mapInArrow(
            _packed, "fp string, near long, data binary")
        needed = spots.join(self.groups, "client").select("grp", "fp", "near").distinct()
        self.rows = [
            needed.join(blocks, ["fp", "near"]).withColumn("kind", F.lit(_BLOCK)),
            times.join(self.groups, "client").withColumn("kind", F.lit(_TIME))]

    def dealt(self, *more: DataFrame) -> DataFrame:
        """Rows by group; ``more`` come with their group and ahead of all blocks."""
        def whole(rows: DataFrame) -> DataFrame:
            return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in _COLUMNS.items()])

        rows = whole(self.rows[0])
        for r in (self.rows[1], *more):
            rows = rows.unionByName(whole(r))
        return rows.repartition(self.tasks, "grp").sortWithinPartitions("grp", "near", "kind")

    def related(self, schema: str, payload: Sequence[str]) -> DataFrame:
        """A row per client and visit: ``unified_client_id``, ``times`` and the ``payload`` of the visit."""
        return self.dealt().mapInArrow(_rows_of(self.window, ROWS, list(payload)), schema)

    def stories(self, clients: DataFrame, held: DataFrame) -> DataFrame:
        """One row per row of ``clients`` (``client, at, oid``: its start and end) from the items that it meets and those it
        holds (``held``: ``client, n, place, at, oid, look``). A look is a visit's JSON after a v or an event's text after
        an e; places are 0 for visits, 1 and 2 for the two texts of events."""
        alone = F.xxhash64("client")
        given = [r.join(self.groups, "client", "left").withColumns({"grp": F.coalesce("grp", alone), "kind": F.lit(k)})
                 for r, k in ((clients, _CLIENT), (held, _HELD))]
        return self.dealt(*given).mapInArrow(_stories_of(self.window, ROWS), _STORIES)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a cell as one Arrow stream, compressed, texts as codes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in ("fp", "near", "cut"):
            v = batch.column(c).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new).tolist()
        out = []
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            part = batch.slice(a, b - a)
            names = [c for c in batch.schema.names if c not in ("fp", "near", "cut")]
            columns = [part.column(c).dictionary_encode() if pa.types.is_string(part.column(c).type) else part.column(c)
                       for c in names]
            some = pa.RecordBatch.from_arrays(columns, names)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_batch(some)
            out.append((part.column("fp")[0].as_py(), part.column("near")[0].as_py(), sink.getvalue().to_pybytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(zip(*out), (pa.string(), pa.int64(), pa.binary()))], ["fp", "near", "data"])


def _matches(window: int, times: tuple[np.ndarray, ...], cell: np.ndarray, ahead: np.ndarray, owner: np.ndarray
             ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Clients, rows and how often they match. ``times``: cell, client and time of the clients' visits; ``cell``, ``ahead``
    and ``owner``: those of the rows. Times count from the start of the cell."""
    most, last = (1 << 62) // (window + 2), int(cell.max(initial=-1))
    for low in range(0, last + 1, most):
        own = (times[0] >= low) & (times[0] < low + most)
        c, client, at = (x[own] for x in times)
        rows = np.flatnonzero((cell >= low) & (cell < low + most))
        key = (cell[rows] - low) * (window + 2) + ahead[rows]
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        # One more from ``window`` ahead of a visit of the client on, one less just after it.
        at = np.concatenate([np.maximum(at - window, 0), np.minimum(at + 1, window)])
        c, client = np.tile(c - low, 2), np.tile(client, 2)
        change = np.repeat(np.array([1, -1]), len(at) // 2)
        order = np.lexsort((at, client, c))
        c, client, at, n = c[order], client[order], at[order], np.cumsum(change[order])
        step = np.flatnonzero(n > 0)  # the last of a client and cell is 0
        begin = np.searchsorted(key, c[step] * (window + 2) + at[step])
        size = np.searchsorted(key, c[step] * (window + 2) + at[step + 1]) - begin
        found = size > 0
        step, begin, size = step[found], begin[found], size[found]
        client, n, ends = client[step], n[step], np.cumsum(size)
        a = 0
        while a < len(step):
            done = ends[a] - size[a]
            b = max(a + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
            of = np.repeat(np.arange(a, b), size[a:b])
            row = rows[np.arange(len(of)) + (begin - (ends - size))[of] + done]
            foreign = owner[row] != client[of]
            yield client[of][foreign], row[foreign], n[of][foreign]
            a = b


class _Group:
    """Clients of a group and what has come of its blocks."""

    def __init__(self, window: int) -> None:
        self.window, self.clients = window, {}
        self.cells: dict[tuple, int] = {}
        self.times: list[tuple] = []
        self.blocks: list[tuple] = []
        self.rows = 0

    def codes(self, names: pa.Array) -> np.ndarray:
        """Numbers of clients, new ones included."""
        coded = names.dictionary_encode()
        number = [self.clients.setdefault(v, len(self.clients)) for v in coded.dictionary.to_pylist()]
        return np.array(number, np.int64)[coded.indices.to_numpy()]

    def add_times(self, near: int, part: pa.RecordBatch) -> None:
        coded = part.column("fp").dictionary_encode()
        cell = np.array([self.cells.setdefault((near, v), len(self.cells)) for v in coded.dictionary.to_pylist()], np.int64)
        self.times.append((near, part.column("fp"), cell[coded.indices.to_numpy()], self.codes(part.column("client")),
                           part.column("us").to_numpy() - near * self.window))

    def add_block(self, near: int, fp: str, data: bytes) -> None:
        block = pa.ipc.open_stream(data).read_next_batch()
        self.blocks.append((self.cells.setdefault((near, fp), len(self.cells)), near, block))
        self.rows += block.num_rows

    def matched(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Matches of the blocks so far, whose rows are numbered through."""
        names = pa.array(list(self.clients), pa.string())
        cells, aheads, owners = [], [], []
        for cell, near, block in self.blocks:
            owner = block.column("owner")
            known = pc.fill_null(pc.index_in(owner.dictionary, names), -1).to_numpy().astype(np.int64)
            known = np.append(known, -1)  # for a visit without client
            owners.append(known[pc.fill_null(owner.indices, len(known) - 1).to_numpy()])
            aheads.append(block.column("us").to_numpy() - near * self.window)
            cells.append(np.full(block.num_rows, cell, np.int64))
        if self.blocks and self.times:
            times = tuple(np.concatenate([t[i] for t in self.times]) for i in (2, 3, 4))
            yield from _matches(self.window, times, *map(np.concatenate, (cells, aheads, owners)))

    def drop(self, near: int | None) -> None:
        """Forget the blocks, and the times but for those of a cell that has more blocks to come."""
        kept = [t for t in self.times if t[0] == near]
        self.cells, self.times, self.blocks, self.rows = {}, [], [], 0
        for near, fp, _, client, at in kept:
            coded = fp.dictionary_encode()
            cell = np.array([self.cells.setdefault((near, v), len(self.cells)) for v in coded.dictionary.to_pylist()], np.int64)
            self.times.append((near, fp, cell[coded.indices.to_numpy()], client, at))


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[int, int | None, int, pa.RecordBatch]]:
    """Runs of rows of one group, cell and kind."""
    if not batch.num_rows:
        return
    grp, kind = batch.column("grp").to_numpy(), batch.column("kind").to_numpy()
    near = pc.fill_null(batch.column("near"), _NULL).to_numpy()
    new = np.ones(batch.num_rows, bool)
    new[1:] = (grp[1:] != grp[:-1]) | (near[1:] != near[:-1]) | (kind[1:] != kind[:-1])
    starts = np.flatnonzero(new).tolist()
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield int(grp[a]), int(near[a]), int(kind[a]), batch.slice(a, b - a)


def _walk(most: int, start, flush, end):
    """Feed the groups, one after another, to a state: ``start()``, ``flush(state)`` whenever there are ``most`` rows, and
    ``end(state)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for grp, near, kind, part in _segments(batch):
                if grp != now:
                    if state:
                        yield from flush(state)
                        yield from end(state)
                    now, state = grp, start()
                if kind == _BLOCK:
                    for fp, data in zip(part.column("fp").to_pylist(), part.column("data")):
                        state.add_block(near, fp, data.as_buffer())
                        if state.rows >= most:
                            yield from flush(state)
                            state.drop(near)
                elif kind == _TIME:
                    state.add_times(near, part)
                else:
                    state.add(kind, part)
        if state:
            yield from flush(state)
            yield from end(state)

    return run


def _rows_of(window: int, most: int, payload: list[str]):
    def flush(group: _Group) -> Iterator[pa.RecordBatch]:
        if not group.blocks:
            return
        plain = [pa.concat_arrays([
            x.dictionary_decode() if pa.types.is_dictionary(x.type) else x for x in (b.column(c) for _, _, b in group.blocks)])
            for c in payload]
        names = pa.array(list(group.clients), pa.string())
        for client, row, n in group.matched():
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(client)), pa.array(n), *[x.take(row) for x in plain]],
                ["unified_client_id", "times", *payload])

    return _walk(most, lambda: _Group(window), flush, lambda group: iter(()))


class _Story(_Group):
    """Also what its clients hold: ``items`` of client, place, time, id, look and number."""

    def __init__(self, window: int) -> None:
        super().__init__(window)
        self.looks: dict[str, int] = {}
        self.ends: dict[int, tuple[int, int]] = {}
        self.items: list[tuple] = []
        self.params: list[np.ndarray] = []
        self.end_of, self.asked = np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, kind: int, part: pa.RecordBatch) -> None:
        client = self.codes(part.column("client"))
        at, oid = (pc.fill_null(part.column(c), _NULL).to_numpy() for c in ("at", "oid"))
        if kind == _CLIENT:
            self.ends |= {c: (a, b) for c, a, b in zip(client.tolist(), at.tolist(), oid.tolist())}
            return
        self.hold(client, part.column("place").to_numpy(), at, oid, self.seen(part.column("look").dictionary_encode()),
                  part.column("n").to_numpy())

    def seen(self, look: pa.DictionaryArray) -> np.ndarray:
        code = [self.looks.setdefault(v, len(self.looks)) for v in look.dictionary.to_pylist()]
        return np.array(code, np.int64)[look.indices.to_numpy()]

    def hold(self, client, place, at, oid, code, n) -> None:
        if len(self.asked) < len(self.looks):
            new = list(self.looks)[len(self.asked):]
            asked = [v[0] == "v" and ('"p1":' in v or '"p2":' in v) for v in new]
            self.asked = np.append(self.asked, np.array(asked, bool))
        if len(self.end_of) < len(self.clients):
            self.end_of = np.array([self.ends.get(c, (0, _NULL))[1] for c in range(len(self.clients))], np.int64)
        with_params = np.flatnonzero((place == 0) & self.asked[code])
        if len(with_params):
            self.params.append(np.unique((client[with_params] << 32) | code[with_params]))
        n = np.where((place == 0) & (at == _NULL), 0, n)  # a visit without time can be the first, but is not on the path
        # The first row of a client is not after its end, so what comes later is wanted for its parameters only.
        kept = np.flatnonzero((place > 0) | (at <= self.end_of[client]))
        self.items.append(tuple(x[kept].astype(t) for x, t in zip(
            (client, place, at, oid, code, n), (np.int32, np.int8, np.int64, np.int64, np.int32, np.int64))))


def _stories_of(window: int, most: int):
    def flush(group: _Story) -> Iterator[pa.RecordBatch]:
        if not group.blocks:
            return iter(())
        place = np.concatenate([b.column("place").to_numpy() for _, _, b in group.blocks])
        at, oid = (np.concatenate([
            pc.fill_null(b.column(c), _NULL).to_numpy() for _, _, b in group.blocks]) for c in ("at", "oid"))
        code = np.concatenate([group.seen(b.column("look")) for _, _, b in group.blocks])
        for client, row, n in group.matched():
            group.hold(client, place[row], at[row], oid[row], code[row], n)
        return iter(())

    return _walk(most, lambda: _Story(window), flush, _told)


def _told(group: _Story) -> Iterator[pa.RecordBatch]:
    """A row per client of the group."""
    names, looks = list(group.clients), list(group.looks)
    shown = [json.loads(v[1:]) if v[0] == "v" else {"item": v[1:]} for v in looks]
    texts = pa.array([s.get("item") for s in shown], pa.string())
    filled = texts.is_valid().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
    # The rows held of a group are let go as its arrays are made.
    held, group.items = group.items, []
    client, place, at, oid, code, n = (
        np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in range(6))
    del held
    own = client.astype(np.int64) * 3 + place
    order = _ordered(own, at, oid, code, texts)
    own, code, n = own[order], code[order], n[order]
    params: dict[int, set[int]] = {}
    for c in np.unique(np.concatenate(group.params)).tolist() if group.params else ():
        params.setdefault(c >> 32, set()).add(c & 0xFFFFFFFF)

    bounds = np.searchsorted(own, np.arange(3 * len(names) + 1))
    length = np.concatenate([[0], np.cumsum(np.where(filled[code], (sizes[code] + 5) * n, 0))])
    rows: list[tuple] = []
    chosen: list[int] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows))
        told = [_joined(texts, filled, code, n, [(bounds[3 * c + p], bounds[3 * c + p + 1]) for c in chosen], sep)
                for p, sep in ((0, " → "), (1, ", "), (2, ", "))]
        text, whole, many = pa.string(), pa.int64(), pa.list_(pa.string())
        arrays = [pa.array(v, t) for v, t in zip(columns, (text, whole, whole, many, many, text, text, text, whole))]
        return pa.RecordBatch.from_arrays(
            [*arrays[:3], told[0], *arrays[3:5], *told[1:], *arrays[5:]],
            ["unified_client_id", "started_us", "completed_us", "path", "p1", "p2", "f1", "f2", "referrer", "source",
             "medium", "first_us"])

    size = 0
    for c, (started, completed) in group.ends.items():
        a, b = bounds[3 * c], bounds[3 * c + 1]
        more = length[bounds[3 * c + 3]] - length[a]
        if rows and size + more > TEXT_BYTES:
            yield out()
            rows, chosen, size = [], [], 0
        first = shown[code[a]] if a < b else {}
        first_us = int(at[order[a]]) if a < b else _NULL
        p1, p2 = ({shown[x][p] for x in params.get(c, ()) if shown[x].get(p) is not None} for p in ("p1", "p2"))
        rows.append((names[c], started, completed, list(p1), list(p2), *[first.get(x) for x in ("referrer", "source", "medium")],
                     None if first_us == _NULL else first_us))
        chosen.append(c)
        size += more
    if rows:
        yield out()


def _ordered(own: np.ndarray, at: np.ndarray, oid: np.ndarray, code: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Order by owner, time, id and text."""
    order = np.lexsort((oid, at, own))
    a, b = order[:-1], order[1:]
    if ((own[a] == own[b]) & (at[a] == at[b]) & (oid[a] == oid[b]) & (code[a] != code[b])).any():
        rank = np.empty(len(texts), np.int64)
        rank[pc.sort_indices(texts).to_numpy()] = np.arange(len(texts))
        order = np.lexsort((rank[code], oid, at, own))
    return order


def _joined(texts: pa.Array, filled: np.ndarray, code: np.ndarray, n: np.ndarray, slices: list[tuple], sep: str) -> pa.Array:
    """Per slice its texts, each as often as it counts, joined; NULL where there are none."""
    counts, codes = [], []
    for a, b in slices:
        some = code[a:b]
        kept = filled[some]
        codes.append(np.repeat(some[kept], n[a:b][kept]))
        counts.append(len(codes[-1]))
    counts = np.array(counts)
    lists = pa.LargeListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(counts)])), texts.take(pa.array(np.concatenate(codes))))
    return pc.if_else(pa.array(counts > 0), pc.binary_join(lists, sep), pa.scalar(None, pa.string()))
