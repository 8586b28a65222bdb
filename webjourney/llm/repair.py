"""Repair of conversation structure by iterative-deepening A*.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Each row is kept, given the other role or
deleted, and empty rows may be put in anywhere; blank rows and repeats must go. Of the cheapest lists of edits the one
whose initials come first in ASCII order is taken: D(elete), I(nsert), K(eep), R(erole).

The search runs depth first in that order under a cost bound that starts at a lower bound and grows to the least total
that exceeded it. A table keeps for every state what is known to be missing to the goal at least; a state that failed
is not entered again without more to spend. The first path that reaches the goal is the answer: in every state of the
roles only one role may come next, so paths and lists of initials are the same.

A conversation may be long. Its rows are cut into blocks of at most 64, each is searched from every state it may begin
in to every state it may end in, and the blocks of a conversation are put together afterwards, so no task searches
more than a block at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webjourney.llm.common import bounded_batches, stored

BLOCK_BITS = 6
WORD, LAST = r"[^\x20\x09-\x0D]", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z"
#: States of the roles so far: nothing, system, user, assistant; and what may come next by initial.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The only role that may be put in or given, and the state after it.
PUT = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
GOALS = (0, 3)
#: Faults of a row: none, blank, duplicate, truncated.
SOUND, BLANK, DUPLICATE, TRUNCATED = ".", "b", "d", "t"
DELETE, INSERT, REROLE, UNFINISHED = 3, 2, 2, 1


def plain(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text; a null conversation, role or text is one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(
        blank("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))


def damaged(rows: DataFrame, number: Column) -> DataFrame:
    """``plain`` rows after damage by ``number``: 0 drops a row, 1 empties its text, 2 takes its ``[.!?]``, 3 repeats
    it, 4 makes its role ``user``."""
    marked = rows.withColumn("__n", number).where("__n <> 0")
    return marked.select(
        "conv", "turn", F.when(F.col("__n") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("__n") == 1, F.lit("")).when(F.col("__n") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("__n") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of conv, turn, role, text with ``at``, which ascends by conversation and turn (nulls first; equal turns by
    role and text), and ``fault``: the row's first one. Extra columns go."""
    digest = F.unhex(F.md5(F.concat("role", F.lit("\0"), "text").cast("binary")))
    keyed = rows.select("conv", "turn", "role", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("by_text"),
                        digest.alias("key"), F.monotonically_increasing_id().alias("row"))
    # The row number lets a crowd of equal rows be cut, too.
    order = ["conv", "turn", "role", "by_text", "row"]
    ordered = stored(
        keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("by_text", "row")
        .withColumn("at", F.monotonically_increasing_id()))
    seen = ordered.groupBy("conv", "key").agg(F.min("at").alias("__first"), F.count(F.lit(1)).alias("__n")).where(
        "__n > 1").select("conv", "key", "__first")
    last = F.regexp_extract("text", LAST, 1)
    return ordered.join(seen, ["conv", "key"], "left").select(
        "conv", "turn", "role", "text", "at",
        F.when(~F.col("text").rlike(WORD), BLANK).when(F.col("at") > F.col("__first"), DUPLICATE)
        .when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND).alias("fault"))


def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


class Search:
    """Searches over one block of rows (initial, fault) to one goal; what is learnt about a state serves all of them."""

    def __init__(self, rows: list[tuple[str, str]], goals: tuple[int, ...]):
        self.rows, self.goals, self.n = rows, goals, len(rows)
        # A lower bound of what the rest costs: rows that must go, and rows that are unfinished.
        self.least = [0] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            fault = rows[i][1]
            self.least[i] = self.least[i + 1] + (
                DELETE if fault in (BLANK, DUPLICATE) else UNFINISHED if fault == TRUNCATED else 0)
        self.missing: dict[tuple[int, int], int] = {}

    def at_least(self, i: int, state: int) -> int:
        return self.missing.get((i, state), self.least[i])

    def edits(self, i: int, state: int) -> list[tuple[str, int, int, int]]:
        """Initial, cost, next row and state of what may be done, in ASCII order."""
        out = []
        after = PUT[state][0]
        if i < self.n:
            first, fault = self.rows[i]
            out.append(("D", DELETE, i + 1, state))
            out.append(("I", INSERT, i, after))
            if fault not in (BLANK, DUPLICATE):
                more = UNFINISHED if fault == TRUNCATED else 0
                if first in NEXT[state]:
                    out.append(("K", more, i + 1, NEXT[state][first]))
                out.append(("R", REROLE + more, i + 1, after))
        else:
            out.append(("I", INSERT, i, after))
        return out

    def run(self, state: int, most: int) -> tuple[int, str] | None:
        """Cost and initials of the first cheapest path from ``state``; None if it costs over ``most``."""
        bound = self.at_least(0, state)
        while bound <= most:
            path = self._below(state, bound)
            if path is not None:
                return bound, path
            # The failed root says what is missing at least.
            bound = max(bound + 1, self.at_least(0, state))
        return None

    def _below(self, state: int, bound: int) -> str | None:
        # A frame: row, state, what is left to spend, edits not tried yet, least that any tried one needs.
        initials: list[str] = []
        frames = [[0, state, bound, iter(self.edits(0, state)), None]]
        if self.n == 0 and state in self.goals:
            return ""
        while frames:
            i, now, left, untried, need = frame = frames[-1]
            for name, cost, j, after in untried:
                known = cost + self.at_least(j, after)
                if known <= left:
                    initials.append(name)
                    if j == self.n and after in self.goals:
                        return "".join(initials)
                    frames.append([j, after, left - cost, iter(self.edits(j, after)), None])
                    break
                frame[4] = need = known if need is None else min(need, known)
            else:
                frames.pop()
                # Failed: with up to ``left`` nothing is reached, so more is missing.
                self.missing[i, now] = max(self.at_least(i, now), left + 1, need or 0)
                if frames:
                    initials.pop()
                    above = frames[-1]
                    known = above[2] - left + self.at_least(i, now)
                    above[4] = known if above[4] is None else min(above[4], known)
        return None


def block_paths(rows: list[tuple[str, str]], begin: tuple[int, ...], goals: list[tuple[int, ...]]) -> list[tuple]:
    """State before, goal, cost and initials of the cheapest way from each state to each goal."""
    most = len(rows) * (DELETE + INSERT) + 4 * INSERT
    out = []
    for goal in goals:
        search = Search(rows, goal)
        for state in begin:
            if goal == (0,) and state or goal == (1,) and state > 1:
                continue
            found = search.run(state, most)
            if found:
                out.append((state, goal[0], *found))
    return out


_PATHS = ("conv string, block long, before array<int>, after array<int>, costs array<long>, initials array<string>, "
          "last int")


def solved_blocks(rows: DataFrame) -> DataFrame:
    """Cheapest ways through each block of ``in_order`` rows: conv, block, and lists of state before, state after,
    cost and initials. A conversation of one block is searched from nothing to its end only."""
    code = F.concat(F.coalesce(F.nullif(initial(F.col("role")), F.lit("")), F.lit("?")), "fault")
    blocks = rows.select("conv", F.shiftright("at", BLOCK_BITS).alias("block"), "at", code.alias("code")).groupBy(
        "conv", "block").agg(F.sort_array(F.collect_list(F.struct("at", "code")))["code"].alias("codes"))
    ends = blocks.groupBy("conv").agg(F.min("block").alias("__first"), F.max("block").alias("__last"))
    blocks = blocks.join(ends, "conv").select(
        "conv", "block", "codes", (F.col("block") == F.col("__first")).alias("is_first"),
        (F.col("block") == F.col("__last")).alias("is_last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for conv, block, codes, first, last in zip(*[c.to_pylist() for c in batch.columns]):
                paths = block_paths([(c[:-1], c[-1]) for c in codes], (0,) if first else (0, 1, 2, 3),
                                    [GOALS] if last else [(0,), (1,), (2,), (3,)])
                out.append((conv, block, *[list(x) for x in zip(*paths)], int(last)))
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()),
                     pa.list_(pa.string()), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["conv", "block", "before", "after", "costs", "initials", "last"])

    return blocks.mapInArrow(run, _PATHS)


def _first(a: tuple | None, b: tuple | None) -> tuple:
    """The way whose initials come first; a way is (initials of a block, block, state after, rest)."""
    texts = []
    for way in (a, b):
        def letters(way=way) -> Iterator[str]:
            while way:
                yield from way[0]
                way = way[3]
        texts.append(letters())
    for x, y in zip(*texts):
        if x != y:
            return a if x < y else b
    return a if next(texts[0], None) is None else b


def joined_blocks(solved: DataFrame) -> DataFrame:
    """One way through each conversation: conv, block, before (the state it begins in), initials, cost (the whole
    conversation's). Only the initials of a conversation's blocks are held, and each block is looked at once, from the
    last one back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, out = None, {}, []

        def close() -> None:
            if now is None:
                return
            cost, way = best[0]
            state = 0
            while way:
                initials, block, after, rest = way
                out.append((now, block, state, initials, cost))
                state, way = after, rest

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "block", "before", "after", "costs", "initials")]
            lasts = batch.column("last").to_pylist()
            for conv, block, before, after, costs, initials, last in zip(*columns, lasts):
                if conv != now:
                    close()
                    now, best = conv, {}
                ahead, best = best, {}
                for b, a, cost, text in zip(before, after, costs, initials):
                    if not last:
                        if a not in ahead:
                            continue
                        cost, rest = cost + ahead[a][0], ahead[a][1]
                    else:
                        rest = None
                    way = (text, block, a, rest)
                    if b not in best or cost < best[b][0]:
                        best[b] = (cost, way)
                    elif cost == best[b][0]:
                        best[b] = (cost, _first(best[b][1], way))
            if len(out) > 5000:
                yield _ways(out)
                out = []
        close()
        if out:
            yield _ways(out)

    return stored(
        solved.repartition("conv").sortWithinPartitions("conv", F.desc("block")).mapInArrow(
            run, "conv string, block long, before int, initials string, cost long"))


def _ways(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      ["conv", "block", "before", "initials", "cost"])


def repaired_rows(rows: DataFrame, ways: DataFrame) -> DataFrame:
    """Final rows: conv, at, nth (rows put in stand before or after the one at their place), role, text."""
    bounded_batches(rows.sparkSession, 1000)
    # The way through a block comes before its rows: one shuffle, and no join whose skewed parts may be split up.
    both = rows.select("conv", F.shiftright("at", BLOCK_BITS).alias("block"), "at", "role", "text").unionByName(
        ways.select("conv", "block", F.lit(-1).cast("long").alias("at"), "before", "initials"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, rest = None, 0, ""
        for batch in batches:
            out: list[tuple] = []
            for conv, block, at, role, text, before, initials in zip(*[c.to_pylist() for c in batch.columns]):
                if at < 0:
                    now, state, rest = (conv, block), before, initials
                    continue
                if (conv, block) != now:
                    raise ValueError(f"rows of {conv!r} without a way through them")
                nth, used, taken = 0, 0, False
                for name in rest:
                    if name != "I" and taken:
                        break
                    used += 1
                    if name == "I":
                        # After the last row's own edit, and before any other row's.
                        if taken and set(rest[used:]) - {"I"}:
                            used -= 1
                            break
                        state, given = PUT[state]
                        out.append((conv, at, nth, given, ""))
                    elif name == "K":
                        state = NEXT[state][role[:1]]
                        out.append((conv, at, nth, role, text))
                    elif name == "R":
                        state, given = PUT[state]
                        out.append((conv, at, nth, given, text))
                    taken = taken or name != "I"
                    nth += 1
                rest = rest[used:]
            if out:
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 ["conv", "at", "nth", "role", "text"])

    return (
        both.select("conv", "block", "at", "role", "text", "before", "initials").repartition("conv", "block")
        .sortWithinPartitions("conv", "block", "at")
        .mapInArrow(run, "conv string, at long, nth int, role string, text string"))


def digests(final: DataFrame) -> DataFrame:
    """conv and repaired_sha256 of its ``role:text`` rows joined by line breaks.

    A digest of one text cannot be split: the rows of a conversation pass through one task, one by one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or conv != now:
                    if state:
                        out.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (now, state.hexdigest())], names)

    names = ["conv", "repaired_sha256"]
    return final.repartition("conv").sortWithinPartitions("conv", "at", "nth").select("conv", "role", "text").mapInArrow(
        run, "conv string, repaired_sha256 string")


def report(rows: DataFrame) -> DataFrame:
    """Faults of each conversation of ``in_order`` rows: conv, gaps, blank, duplicate, truncated, illegal."""
    n = lambda fault: F.count(F.when(F.col("fault") == fault, 1))
    facts = rows.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).alias("span"), n(BLANK).alias("blank"),
        n(DUPLICATE).alias("duplicate"), n(TRUNCATED).alias("truncated"))
    turns = rows.where(F.col("turn").isNotNull()).select("conv", "turn").distinct().groupBy("conv").agg(
        F.count(F.lit(1)).alias("turns"))
    # Neighbours inside a block, and the ends of blocks that meet.
    first = initial(F.col("role"))
    bad = lambda a, b: ~F.concat(a, b).isin("su", "ua", "au")
    blocks = rows.select("conv", F.shiftright("at", BLOCK_BITS).alias("block"), "at", first.alias("i")).groupBy(
        "conv", "block").agg(F.sort_array(F.collect_list(F.struct("at", "i")))["i"].alias("s"))
    inside = F.size(F.filter(F.zip_with(
        F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s")), bad), lambda x: x))
    ends = blocks.select("conv", "block", inside.alias("inside"), F.element_at("s", 1).alias("head"),
                         F.element_at("s", -1).alias("tail"))
    before = Window.partitionBy("conv").orderBy("block")
    meet = F.lag("tail").over(before)
    illegal = ends.withColumn("met", F.when(meet.isNotNull() & bad(meet, F.col("head")), 1).otherwise(0)).groupBy(
        "conv").agg(F.sum(F.col("inside") + F.col("met")).alias("illegal"))
    return facts.join(turns, "conv", "left").join(illegal, "conv").select(
        "conv", (F.col("span") - F.coalesce("turns", F.lit(0))).alias("gaps"), "blank", "duplicate", "truncated",
        "illegal")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired rows (conv, at, nth, role, text) and a report: conv, gaps, blank, duplicate, truncated, illegal, cost,
    audit (the initials of the edits), repaired_sha256.

    ``rows`` are ``plain`` ones, damaged or not. A conversation that needs nothing has an audit of K only; one that
    loses all rows is legal, too, with the hash of the empty text. An empty table gives empty ones.
    """
    ordered = stored(in_order(rows))
    ways = joined_blocks(solved_blocks(ordered))
    final = repaired_rows(ordered, ways)
    audits = ways.groupBy("conv").agg(
        F.max("cost").alias("cost"),
        F.array_join(F.sort_array(F.collect_list(F.struct("block", "initials")))["initials"], "").alias("audit"))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    found = report(ordered).join(audits, "conv").join(digests(final), "conv", "left").withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", empty))
    return final, found


def audit(conversations: DataFrame, number: Column | None = None) -> DataFrame:
    """The report of ``repair`` for every conv_id of ``conversations``, damaged by ``number`` where that is given (see
    ``damaged``). A conversation without rows after damage has zeros, an empty audit and the empty text's hash."""
    base = plain(conversations)
    rows = base.withColumn("copy", F.lit(0)) if number is None else damaged(base, number)
    _, found = repair(rows)
    every = conversations.select("conv_id").distinct().withColumn(
        "conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return every.join(found, "conv", "left").select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
