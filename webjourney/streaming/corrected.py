"""Streams that come out right whatever order their rows arrive in.

There is no watermark, so no row is too late. A micro-batch writes rows of its own number; a row that makes earlier
results wrong brings newer versions of them along, and a reader takes the newest version of each. Three forms:

* counts and extremes: a batch writes partial aggregates, a reader merges them;
* folds that only look back: the rows of a key from its first new one on are folded again, starting from the state that
  the results before it hold; a batch that is on time redoes nothing;
* rules that look a bounded time back and ahead: rows within that reach of a new row of their key are computed again.

Results lie by day, so a batch reads the days it may touch and no others. A batch that runs again replaces itself.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webjourney.functions.journeys import Families, live_boundary, session_id, user_key
from webjourney.functions.predicates import micros
from webjourney.operators import location, sessions
from webjourney.operators.ordered import keep_spaced, left_join_nulls, work_table

Handler = Callable[[DataFrame, int], None]


def _write(df: DataFrame, root: str, batch_id: int) -> None:
    df.withColumn("day", F.to_date("timestamp")).write.mode("overwrite").partitionBy("day").parquet(
        f"{root}/batch={batch_id}")


def _batches(spark: SparkSession, root: str, before: int | None = None) -> list[str]:
    """Complete batches under ``root``, those with a lower number than ``before``."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{root}/batch=*/_SUCCESS")
    done = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    found = [f.getPath().getParent() for f in done]
    return [p.toString() for p in found if before is None or int(p.getName().removeprefix("batch=")) < before]


def read_batches(spark: SparkSession, root: str, schema: str, before: int | None = None) -> DataFrame:
    """What the batches wrote (only those before a number where one is given), with ``batch`` and ``day``; an empty table
    where there is nothing."""
    paths = _batches(spark, root, before)
    full = f"{schema}, batch int, day date"
    if not paths:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", root).parquet(*paths)


def newest(rows: DataFrame, row_id: str = "id") -> DataFrame:
    """The newest version of each row. Versions of a row share its time, so reading some days reads all of them."""
    rest = [c for c in rows.columns if c not in (row_id, "batch", "day")]
    return rows.groupBy(row_id).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(
        row_id, *[F.col(f"_r.{c}").alias(c) for c in rest])


def _days(rows: DataFrame, low: dt.datetime | None, high: dt.datetime | None = None) -> DataFrame:
    """Rows of the days from ``low`` to ``high``: the reader skips the others."""
    if low is not None:
        rows = rows.where(F.col("day") >= F.to_date(F.lit(low)))
    return rows if high is None else rows.where(F.col("day") <= F.to_date(F.lit(high)))


def _later(c: str, seconds: float) -> Column:
    return F.timestamp_micros(micros(F.col(c)) + int(seconds * 1_000_000))


# --- counts and extremes ----------------------------------------------------------------

def partial_batch(aggregate: Callable[[DataFrame], DataFrame], root: str) -> Handler:
    """Handler that writes ``aggregate`` of each batch; its rows carry the ``timestamp`` they belong to."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        _write(aggregate(batch), root, batch_id)

    return handle


def count_parts(keys: Sequence[str], width: str = "1 hour") -> Callable[[DataFrame], DataFrame]:
    def aggregate(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.window("timestamp", width).alias("w"), *keys).agg(F.count("*").alias("count")).select(
            F.col("w.start").alias("timestamp"), *keys, "count")

    return aggregate


def windowed_counts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per window and keys, all windows, whatever arrived when."""
    return parts.groupBy(F.col("timestamp").alias("window_start"), *keys).agg(F.sum("count").alias("count"))


def threshold_alerts(parts: DataFrame, threshold: int = 100) -> DataFrame:
    """Windows with more rows than ``threshold``."""
    return windowed_counts(parts, []).where(F.col("count") > threshold)


def engagement_parts(events: DataFrame) -> DataFrame:
    return sessions.engagement(events.withColumn("timestamp", F.date_trunc("day", "timestamp")), by=("timestamp",))


def engagement(parts: DataFrame) -> DataFrame:
    """Time on page and idle time per session, page and day."""
    return parts.groupBy(F.col("timestamp").alias("day"), "session_id", "page_url").agg(
        F.sum("beats").alias("beats"), F.max("time_on_page_ms").alias("time_on_page_ms"),
        F.max("max_idle_ms").alias("max_idle_ms"), F.sum("engaged_beats").alias("engaged_beats"))


def first_view_parts(events: DataFrame) -> DataFrame:
    views = events.where(F.col("event_type") == "page_view")
    return views.groupBy("session_id", "page_url").agg(F.min(F.struct("timestamp", "id")).alias("k")).select(
        "session_id", "page_url", "k.timestamp", "k.id")


def first_page_views(parts: DataFrame) -> DataFrame:
    """One page view per session and URL: the earliest of all, also if it arrived last."""
    return parts.groupBy("session_id", "page_url").agg(F.min(F.struct("timestamp", "id")).alias("k")).select(
        "session_id", "page_url", "k.timestamp", "k.id")


# --- folds that look back ---------------------------------------------------------------

def _key_types(rows: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f", `{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)


def spaced_batch(keys: Sequence[str], seconds: float, root: str, inclusive: bool = True) -> Handler:
    """Handler that folds rows (``keys``, timestamp, id) like ``keep_spaced``; see ``spaced_view``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.select(*keys, "timestamp", "id")
        low = fresh.agg(F.min("timestamp")).first()[0]
        if low is None:
            return
        first = fresh.groupBy(*keys).agg(F.min(F.struct("timestamp", "id")).alias("_first"))
        old = read_batches(fresh.sparkSession, root, spaced_schema(fresh, keys), batch_id)
        # A kept row further back than the spacing takes in nothing more.
        near = newest(_days(old, low - dt.timedelta(seconds=seconds)))
        touched = left_join_nulls(near, first, keys).where(F.col("_first").isNotNull()).withColumn(
            "_at", F.struct("timestamp", "id"))
        redo = touched.where(F.col("_at") > F.col("_first")).select(*keys, "timestamp", "id")
        seeds = touched.where(F.col("_at") < F.col("_first")).groupBy(*keys).agg(
            F.max_by(F.struct(F.col("kept_at").alias("timestamp"), F.col("kept_id").alias("id")), "_at").alias("s")
        ).select(*keys, "s.timestamp", "s.id")
        seeds = work_table(seeds)
        folded = keep_spaced(fresh.unionByName(redo).unionByName(seeds), keys, "timestamp", "id", seconds, inclusive)
        _write(folded.join(seeds.select("id"), "id", "left_anti"), root, batch_id)

    return handle


def spaced_schema(rows: DataFrame, keys: Sequence[str]) -> str:
    kind = rows.schema["id"].dataType.simpleString()
    return f"id {kind}, timestamp timestamp{_key_types(rows, keys)}, kept_id {kind}, kept_at timestamp"


def spaced_view(spark: SparkSession, root: str, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """id, timestamp, keys, kept_id, kept_at as they stand; ``rows`` gives the types."""
    return newest(read_batches(spark, root, spaced_schema(rows, keys)))


LIVE = ("id long, timestamp timestamp, user_key string, entry boolean, journey_seq long, is_new boolean, "
        "opened_at timestamp, opened_id long")
USERS = "user_key string, timestamp timestamp, id long, journey_seq long, opened_at timestamp, opened_id long"


def live_sessions_batch(root: str, families: Families, race_seconds: float = 30) -> Handler:
    """Handler that assigns sessions in time order; see ``live_sessions_view``.

    The newest state of every user lies in a table of its own; results before a batch are read only for the users with a
    row that is older than that, whose later rows are assigned again.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select(
            "id", "timestamp", user_key().alias("user_key"),
            live_boundary(F.col("event_type"), F.col("referrer_domain"), F.col("source"), F.col("medium"),
                          F.col("campaign"), families).alias("entry"))
        low = fresh.agg(F.min("timestamp")).first()[0]
        if low is None:
            return
        first = work_table(fresh.groupBy("user_key").agg(F.min(F.struct("timestamp", "id")).alias("_first")))
        users = read_batches(spark, f"{root}/users", USERS, batch_id)
        known = newest(users, "user_key").join(first, "user_key")
        state = ("journey_seq", "opened_at", "opened_id")
        on_time = known.where(F.struct("timestamp", "id") < F.col("_first")).select("user_key", *state)
        late = work_table(known.where(F.struct("timestamp", "id") > F.col("_first")).select("user_key", "_first"))
        past = newest(read_batches(spark, f"{root}/rows", LIVE, batch_id).join(
            late.select("user_key"), "user_key", "left_semi")).join(late, "user_key").withColumn(
            "_at", F.struct("timestamp", "id"))
        redo = past.where(F.col("_at") > F.col("_first")).select("id", "timestamp", "user_key", "entry")
        before = past.where(F.col("_at") < F.col("_first")).groupBy("user_key").agg(
            F.max_by(F.struct(*state), "_at").alias("s")).select("user_key", "s.*")
        states = on_time.unionByName(before)
        # The row that opened the running session stands for all before it.
        seeds = work_table(states.select(
            F.col("opened_id").alias("id"), F.col("opened_at").alias("timestamp"), "user_key",
            F.lit(True).alias("entry"), F.col("journey_seq").alias("_base")))
        rows = fresh.unionByName(redo).unionByName(seeds.drop("_base"))
        assigned = sessions.assign_entries(rows, race_seconds, opened=True).join(
            seeds.select("user_key", "_base", F.col("id").alias("_seed")), "user_key", "left").where(
            F.col("_seed").isNull() | (F.col("id") != F.col("_seed"))).withColumn(
            "journey_seq", F.col("journey_seq") + F.coalesce("_base", F.lit(0)))
        out = work_table(assigned.select("id", "timestamp", "user_key", "entry", "journey_seq", "is_new", "opened_at",
                                         "opened_id"))
        _write(out, f"{root}/rows", batch_id)
        _write(out.groupBy("user_key").agg(F.max_by(F.struct("timestamp", "id", *state), F.struct("timestamp", "id"))
                                           .alias("s")).select("user_key", "s.*"), f"{root}/users", batch_id)

    return handle


def live_sessions_view(spark: SparkSession, root: str) -> DataFrame:
    """id, timestamp, user_key, journey_seq, is_new, live_session_id as they stand."""
    rows = newest(read_batches(spark, f"{root}/rows", LIVE))
    return rows.select("id", "timestamp", "user_key", "journey_seq", "is_new",
                       session_id(F.col("user_key"), F.col("journey_seq")).alias("live_session_id"))


# --- rules with a bounded reach ---------------------------------------------------------

def reach_batch(
    rule: Callable[[DataFrame], DataFrame], root: str, schema: str, key: str, back: float, ahead: float,
) -> Handler:
    """Handler for a ``rule`` whose result for a row depends on the rows of its ``key`` from ``back`` seconds before it to
    ``ahead`` seconds after it.

    ``rule`` takes rows of ``schema`` (with a unique ``row``, and timestamp) and returns ``row``, timestamp and its
    results for some of them. The batches' rows are kept under ``rows``, results under ``out``.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    reach = dt.timedelta(seconds=back + ahead)
    step = max(int((back + ahead) * 1_000_000), 1)
    cell = lambda t: F.floor(micros(t) / step)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _write(batch.select(*names), f"{root}/rows", batch_id)
        low, high = batch.agg(F.min("timestamp"), F.max("timestamp")).first()
        if low is None:
            return
        # A new row changes rows of its cell and the next ones, and these need the cells around them.
        marks = batch.select(F.col(key).alias("_k"), F.col("timestamp").alias("_t"), F.explode(
            F.array(*[F.lit(i) for i in range(-2, 3)])).alias("_off"))
        beside = F.when(F.abs("_off") <= 1, F.col("_t"))
        cells = marks.groupBy("_k", (cell(F.col("_t")) + F.col("_off")).alias("_c")).agg(
            F.min(beside).alias("_low"), F.max(beside).alias("_high"))
        kept = _days(read_batches(spark, f"{root}/rows", schema, batch_id + 1), low - 3 * reach, high + 3 * reach)
        near = work_table(kept.withColumn("_cell", cell(F.col("timestamp"))).join(
            cells, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_cell") == F.col("_c"))).select(
            *names, (F.col("timestamp").between(_later("_low", -ahead), _later("_high", back))).alias("_touched")))
        result = rule(near.select(*names))
        _write(result.join(near.where("_touched").select("row"), "row", "left_semi"), f"{root}/out", batch_id)

    return handle


HITS = "row string, id long, timestamp timestamp, kind string, visit_id long, ip_address string, session_id string"
MERGES = "row string, id long, timestamp timestamp, old_session_id string, session_id string"


def hits_of(visits: DataFrame, events: DataFrame) -> DataFrame:
    """Visits and events in one stream."""
    def shape(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.concat(F.lit(kind[0]), "id").alias("row"), F.col("id").cast("long").alias("id"), "timestamp",
                         F.lit(kind).alias("kind"), F.col("visit_id").cast("long").alias("visit_id"), "ip_address",
                         "session_id")

    return shape(visits.withColumn("visit_id", F.lit(None).cast("long")), "visit").unionByName(shape(events, "event"))


def merge_batch(root: str, seconds: float = 180) -> Handler:
    """Handler that pulls visits into the session of the first unlinked event from their address within ``seconds``,
    over the stream of ``hits_of``; see ``merge_view``."""
    def rule(hits: DataFrame) -> DataFrame:
        visits = hits.where("kind = 'visit'")
        merged = location.merge_recent_visits(hits.where("kind = 'event'"), visits, seconds)
        # Visits that stay have a row, too: it may replace an earlier one that moved them.
        return visits.select("row", "id", "timestamp").join(merged, "id", "left")

    return reach_batch(rule, root, HITS, "ip_address", 0, seconds)


def merge_view(spark: SparkSession, root: str) -> DataFrame:
    """The visits that change as it stands: id, old_session_id, session_id."""
    return newest(read_batches(spark, f"{root}/out", MERGES), "row").where(F.col("session_id").isNotNull()).select(
        "id", "old_session_id", "session_id")
