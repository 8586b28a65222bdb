"""Chat formatting from event logs.

A log row says that a message of a conversation begins (``start``), grows by a streamed ``delta``, is replaced by an
``edit``, is generated anew (``regenerate``: its text starts again) or is taken back (``delete``). Rows are dealt by
conversation and sorted by sequence number, and one pass folds them into final messages and renders these. Only one
message is held at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webjourney.llm.common import bounded_batches

#: The template: a head per turn, an end mark, and a backslash before what could be taken for either.
HEAD, END = "### {role}: ", " </turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>|: |\n")
_ESCAPED = re.compile(r"\\(###|</turn>|: |n|\\)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\n" if m[0] == "\n" else "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def render(role: str, text: str) -> str:
    """One turn: its head ends with the first ``: ``, as that is escaped in roles and texts."""
    return HEAD.format(role=escape(role)) + escape(text) + END


def parse(turn: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    if not turn.startswith("### ") or not turn.endswith(END):
        raise ValueError("not a turn of this template")
    body = turn[4:-len(END)]
    at = re.match(r"(?:[^\\:]|\\(?:###|</turn>|: |n|\\)|:(?! ))*(?=: )", body)
    if not at:
        raise ValueError("a turn without a head")
    return unescape(at[0]), unescape(body[at.end() + 2:])


def whole_rows(conversations: DataFrame) -> DataFrame:
    """A log with one ``turn`` event for each row: a message that came at once."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("seq"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("message"), F.lit("turn").alias("kind"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, message, nth, role, text.

    Rows with equal (conversation, message) fold in the order of seq, then kind, role and text. A ``start`` or ``turn``
    of a message that is already there is a further message (repeated rows stay repeated). A delta, edit or
    regeneration before any start begins its message; a null text is empty, a null conversation is one of its own.
    """
    bounded_batches(events.sparkSession, 1000)
    order = {"start": 0, "turn": 1, "regenerate": 2, "edit": 3, "delta": 4, "delete": 5}
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in order.items()], F.lit(9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        role, parts, nth, alive = "", [], 0, False
        done: list[tuple] = []

        def close() -> None:
            if alive:
                done.append((now[0], now[1], nth, role, "".join(parts)))

        for batch in batches:
            for conv, message, kind, who, text in zip(*[c.to_pylist() for c in batch.columns]):
                if (conv, message) != now:
                    close()
                    now, role, parts, nth, alive = (conv, message), who, [], 0, False
                elif kind in ("start", "turn") and alive:
                    close()
                    parts, nth = [], nth + 1
                role = who or role
                alive = kind != "delete"
                if kind == "delta":
                    parts.append(text)
                else:
                    parts = [text]
            if len(done) > 500:
                yield _messages(done)
                done = []
        close()
        if done:
            yield _messages(done)

    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    # A conversation may hold a large part of all rows, so its messages are dealt out, too.
    return (
        events.select("conv_id", "message", "kind", role.alias("role"), text.alias("text"), "seq")
        .repartition("conv_id", "message")
        .sortWithinPartitions("conv_id", "message", "seq", rank, "role", "text")
        .select("conv_id", "message", "kind", "role", "text")
        .mapInArrow(run, "conv_id long, message long, nth int, role string, text string"))


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()))],
        ["conv_id", "message", "nth", "role", "text"])


def format_turns(messages: DataFrame) -> DataFrame:
    """Rendered turns: conv_id, message, nth, turn, and loss_from/loss_to: the code points training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            role, text = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            turns = [render(r, t) for r, t in zip(role, text)]
            begin = [len(t) - len(END) if r != "assistant" else len(HEAD.format(role=r)) for r, t in zip(role, turns)]
            yield pa.RecordBatch.from_arrays([
                batch.column("conv_id"), batch.column("message"), batch.column("nth"), pa.array(turns, pa.string()),
                pa.array(begin, pa.int64()), pa.array([len(t) - len(END) for t in turns], pa.int64()),
            ], ["conv_id", "message", "nth", "turn", "loss_from", "loss_to"])

    return messages.mapInArrow(
        run, "conv_id long, message long, nth int, turn string, loss_from long, loss_to long")


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the output back gives for each conversation; texts pass one by one, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        rows: list[tuple] = []

        def close() -> None:
            if state:
                rows.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "loss_from", "loss_to")]
            for conv, turn, begin, end in zip(*columns):
                if now != (conv,):
                    close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(turn)
                loss = unescape(turn[begin:end])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(turn)
            if rows:
                yield _digest_rows(rows)
                rows = []
        close()
        if rows:
            yield _digest_rows(rows)

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "message", "nth").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names)
