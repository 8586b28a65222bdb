"""Order-dependent steps by one plan, whatever the keys look like.

A window over a visitor, session or address puts all rows of that key into one task. Here the rows are dealt by ranges of
key and order, so a key may span any number of slices and even rows of one instant are cut. Each slice is an ordinary
window. What a slice needs from the earlier ones (last row, running total, last known value) comes from a summary of the
keys that span slices: two neighbouring slices share one key at most, so there are fewer such keys than slices, and the
tables that carry their state have at most two rows for each slice. Results are those of one window per key.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SLICE, _SPANS = "_slice", "_spans"


def work_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared one, gone when the driver's JVM ends.

    A temporary one only where Spark runs in one process; on a cluster each executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="webjourney-")
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def left_join_nulls(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which a NULL key meets a NULL key; ``right`` adds its other columns."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    return left.join(renamed, same, "left").drop(*[f"__right_{k}" for k in keys])


def left_join_spread(left: DataFrame, right: DataFrame, key: str, row_id: str = "id") -> DataFrame:
    """Left join on ``key`` in which the rows of ``left`` without one, which match nothing, are dealt out by ``row_id``."""
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(row_id), F.lit(9973)) + 1).otherwise(F.lit(0))
    return left.withColumn("__spread", spread).join(
        right.withColumn("__spread", F.lit(0).cast("long")), [key, "__spread"], "left").drop("__spread")


def work_table(df: DataFrame) -> DataFrame:
    """The rows written once and read back: later steps share them and survive lost executors."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Timeline:
    """Rows of a key in order (nulls first). ``order`` must be unique; a NULL key is a key."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> None:
        self.keys, self.order = list(keys), list(order)
        # Derived once, as the ranges are found in a pass of their own, and written in slices, as all steps and summaries
        # must see the same ones.
        sliced = work_table(
            work_table(df).repartitionByRange(*self.keys, *self.order).withColumn(_SLICE, F.spark_partition_id()))
        key = F.struct(*self.keys)
        ends = sliced.groupBy(_SLICE).agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
        # Fewer rows than slices, so the hint below is safe.
        spanning = ends.select(_SLICE, F.explode(F.array("_low", "_high")).alias("_key")).groupBy("_key").agg(
            F.min(_SLICE).alias("_a"), F.max(_SLICE).alias("_b")).where("_a < _b")
        self.spanning = spanning.select(*[F.col(f"_key.{k}").alias(k) for k in self.keys], F.lit(True).alias(_SPANS))
        self.df = left_join_nulls(sliced, F.broadcast(self.spanning), self.keys)

    @property
    def slice_keys(self) -> list[str]:
        return [*self.keys, _SLICE]

    def _add(self, name: str, value: Column, local, summary: Column, carried, merge) -> "Timeline":
        """Window column ``local``; where the key spans slices merged with what ``carried`` takes from the summaries of
        the earlier ones."""
        base = self.df.withColumn("__value", value)
        # The flag is a key, too, so that the summaries below read the spanning keys only.
        window = Window.partitionBy(*self.slice_keys, _SPANS).orderBy(*self.order)
        slices = base.where(F.col(_SPANS)).groupBy(*self.slice_keys).agg(summary.alias("_sum"))
        by_slice = Window.partitionBy(*self.keys).orderBy(_SLICE)
        carry = slices.select(*self.slice_keys, carried(by_slice).alias("_in"))
        self.df = left_join_nulls(
            base.withColumn(name, local(window)), F.broadcast(carry), self.slice_keys
        ).withColumn(name, merge(F.col(name), F.col("_in"))).drop("_in", "__value")
        return self

    def previous(self, name: str, value: Column) -> "Timeline":
        """``value`` (a struct) of the row before; NULL on the first row of a key."""
        return self._add(
            name, value,
            lambda w: F.lag("__value").over(w),
            F.max_by("__value", F.struct(*self.order)),
            lambda w: F.lag("_sum").over(w),
            lambda own, carry: F.coalesce(own, carry))

    def running_sum(self, name: str, value: Column) -> "Timeline":
        """Sum of ``value`` up to and including the row."""
        return self._add(
            name, value,
            lambda w: F.sum("__value").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            F.sum("__value"),
            lambda w: F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)),
            lambda own, carry: own + F.coalesce(carry, F.lit(0)))

    def last_known(self, name: str, value: Column) -> "Timeline":
        """Latest non-NULL ``value`` up to and including the row."""
        return self._add(
            name, value,
            lambda w: F.last("__value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(*self.order))),
            lambda w: F.last("_sum", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            lambda own, carry: F.coalesce(own, carry))

    def done(self) -> DataFrame:
        return self.df.drop(_SLICE, _SPANS)

    def texts(self, text: Column, sep: str, name: str) -> DataFrame:
        """Per key, the non-NULL ``text`` of its rows in order joined by ``sep``; keys without any are left out.

        Joined slice by slice, so no task sorts more than one slice; only the finished slice texts meet in the one cell
        that is the result.
        """
        rows = self.df.withColumn("_t", text).where(F.col("_t").isNotNull())
        parts = rows.groupBy(*self.slice_keys).agg(_joined(F.struct(*self.order, "_t"), sep).alias("_t"))
        return parts.groupBy(*self.keys).agg(_joined(F.struct(_SLICE, "_t"), sep).alias(name))

    def summary(self, text: Column, sep: str, name: str, aggregates: Sequence[Column]) -> DataFrame:
        """``aggregates`` per key together with its ordered text."""
        return left_join_nulls(
            self.df.groupBy(*self.keys).agg(*aggregates), self.texts(text, sep, name), self.keys)


def _joined(item: Column, sep: str) -> Column:
    """The texts of the collected items in order, NULL when there are none."""
    texts = F.transform(F.sort_array(F.collect_list(item)), lambda e: e["_t"])
    return F.when(F.count(item) > 0, F.array_join(texts, sep))


def running_counts(rows: DataFrame, probes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each probe, how many rows of its key lie at or before / strictly before its time.

    ``rows``: keys and ``at``. ``probes``: keys, ``at``, ``inclusive`` and any further columns.
    Returns the probes with ``n``. One sort per key instead of a sliding frame, so the cost
    does not grow with the number of rows inside a frame.
    """
    extra = [c for c in probes.columns if c not in (*keys, "at", "inclusive")]
    spark_null = [F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra]
    # Rows of one rank and time are alike; the number only lets a crowd of them be cut.
    union = rows.select(*keys, "at", F.lit(1).alias("_rank"), *spark_null).unionByName(
        probes.select(*keys, "at", F.when(F.col("inclusive"), 2).otherwise(0).alias("_rank"), *extra))
    t = Timeline(union.withColumn("_row", F.monotonically_increasing_id()), keys, ["at", "_rank", "_row"])
    t.running_sum("n", (F.col("_rank") == 1).cast("long"))
    return t.done().where(F.col("_rank") != 1).drop("_rank", "_row")


def keep_spaced(
    df: DataFrame, keys: Sequence[str], ts: str, row_id: str, seconds: float, inclusive: bool = True,
) -> DataFrame:
    """Fold each row into the last *kept* row of its key if that is at most ``seconds`` old.

    Returns ``keys, ts, row_id, kept_id, kept_at``; a row is kept when ``kept_id`` is its own id. The
    time of a kept row does not move, so the rule cannot be told from the previous row alone.
    Rows further than ``seconds`` from their predecessor start a fresh island whatever came
    before; islands are independent. Within an island the rows are scanned in order, slice by slice.
    """
    gap = int(seconds * 1_000_000)
    limit = gap if inclusive else gap - 1
    t = Timeline(df.select(*keys, ts, row_id), keys, [ts, row_id])
    t.previous("_p", F.struct(F.col(ts).alias("t")))
    wide = F.col("_p").isNull() | (F.unix_micros(ts) - F.unix_micros(F.col("_p.t")) > limit)
    t.running_sum("_island", wide.cast("long"))
    islands = t.df.drop("_p").withColumn("_us", F.unix_micros(ts))
    skeys = [*keys, "_island", _SLICE]
    schema = ", ".join(
        f"`{c}` {islands.schema[c].dataType.simpleString()}" for c in (*keys, ts, row_id)
    ) + f", kept_id {islands.schema[row_id].dataType.simpleString()}, kept_us long"
    entered = left_join_nulls(islands, F.broadcast(_entries(islands, list(keys), ts, row_id, limit)), skeys)
    return (
        entered.repartition(*skeys).sortWithinPartitions(*skeys, ts, row_id)
        .mapInPandas(_spaced_scan(skeys, row_id, limit, [*keys, ts, row_id]), schema)
        .select(*keys, ts, row_id, "kept_id", F.timestamp_micros("kept_us").alias("kept_at"))
    )


def _spaced_scan(skeys, row_id: str, limit: int, out_cols):
    """Scan sorted rows across Arrow batches, carrying the current group and its kept row."""

    def scan(batches):
        group, kept_ts, kept_id = None, None, None
        for pdf in batches:
            kept, times = [], []
            ids = pdf[row_id].tolist()
            entries = zip(pdf["_in_ts"].tolist(), pdf["_in_id"].tolist())
            for g, us, rid, (in_ts, in_id) in zip(
                    zip(*[pdf[c].tolist() for c in skeys]), pdf["_us"].tolist(), ids, entries):
                if g != group:
                    group, kept_ts, kept_id = g, None, None
                    if in_id is not None and in_id == in_id:
                        kept_ts, kept_id = int(in_ts), type(rid)(in_id)
                if kept_ts is None or us - kept_ts > limit:
                    kept_ts, kept_id = us, rid
                kept.append(kept_id)
                times.append(kept_ts)
            out = pdf[out_cols].copy()
            out["kept_id"] = kept
            out["kept_id"] = out["kept_id"].astype(pdf[row_id].dtype)
            out["kept_us"] = times
            yield out

    return scan


def _entries(islands: DataFrame, keys: list[str], ts: str, row_id: str, limit: int) -> DataFrame:
    """The kept row that each slice of an island starts from, for the islands that span slices.

    Per slice, the row kept last depends on the entry only through the first row it keeps, which
    lies within one gap of the slice start. Those possible starts share very few last rows, so a
    slice is summarised by a handful of (latest start, last kept row) runs; the entries of all
    slices follow from the runs alone. Two slices share one island at most, so there are no more
    entries than slices.
    """
    ikeys, skeys = [*keys, "_island"], [*keys, "_island", _SLICE]
    of_spanning = islands.where(F.col(_SPANS))
    spans = of_spanning.groupBy(*ikeys).agg(F.min(_SLICE).alias("_a"), F.max(_SLICE).alias("_b")).where(
        "_a < _b").select(*ikeys, F.lit(True).alias("_cut"))
    rows = left_join_nulls(of_spanning, F.broadcast(spans), ikeys).where(F.col("_cut"))
    key_types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in skeys)

    def runs(batches):
        import pandas as pd

        group, us, ids, out = None, [], [], []

        def close():
            n = len(us)
            if not n:
                return
            last, nxt = list(range(n)), n
            for i in range(n - 1, -1, -1):
                while nxt > i + 1 and us[nxt - 1] - us[i] > limit:
                    nxt -= 1
                if nxt < n:
                    last[i] = last[nxt]
            starts = 1
            while starts < n and us[starts - 1] - us[0] <= limit:
                starts += 1
            for i in range(starts):
                if i + 1 == starts or last[i + 1] != last[i]:
                    out.append((*group, us[i], us[last[i]], str(ids[last[i]])))

        for pdf in batches:
            for g, u, rid in zip(zip(*[pdf[c].tolist() for c in skeys]),
                                 pdf["_us"].tolist(), pdf[row_id].tolist()):
                if g != group:
                    close()
                    group, us, ids = g, [], []
                us.append(u)
                ids.append(rid)
            if out:
                yield pd.DataFrame(out, columns=[*skeys, "start_us", "last_us", "last_id"])
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=[*skeys, "start_us", "last_us", "last_id"])

    summary = (
        rows.repartition(*skeys).sortWithinPartitions(*skeys, ts, row_id)
        .mapInPandas(runs, f"{key_types}, start_us long, last_us long, last_id string")
    )

    def entries(pdf):
        import pandas as pd

        pdf = pdf.sort_values([_SLICE, "start_us"])
        out, state = [], (None, None)
        for s, part in pdf.groupby(_SLICE, sort=True):
            out.append((*(pdf[c].iloc[0] for c in ikeys), s, *state))
            for start, last, rid in zip(part["start_us"], part["last_us"], part["last_id"]):
                if state[0] is None or start - state[0] > limit:
                    state = (last, rid)
                    break
        return pd.DataFrame(out, columns=[*skeys, "_in_ts", "_in_id"])

    return summary.groupBy(*ikeys).applyInPandas(entries, f"{key_types}, _in_ts long, _in_id string")
