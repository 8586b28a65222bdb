"""Structured Streaming versions of the steps that run on arrival.

Whatever can be an expression is computed before the stateful step; the state functions only
fold sorted rows of one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from webjourney.functions import agents, forms, url
from webjourney.functions.jsontext import quoted, set_fields
from webjourney.functions.journeys import Families, live_boundary, session_id, user_key
from webjourney.operators import linking, location, summaries


def run_available(stream: DataFrame, out: str, checkpoint: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Process what is there into Parquet files and return them."""
    writer = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


# --- intake ---------------------------------------------------------------------------

def enrich_intake(raw: DataFrame) -> DataFrame:
    """Event rows from raw hits (see ``schemas.intake``): rows without type and noise dropped,
    page, attribution, crawler and client-side fields filled, payload extended. Works on
    batches and streams."""
    client = raw.where(F.col("event_type").isNotNull()).where(
        ~forms.is_ingest_noise(F.col("event_type"), F.col("data"))
    ).withColumnRenamed("received_at", "timestamp").withColumn("ip_address", url.client_ip(
        F.col("x_forwarded_for"), F.col("x_real_ip"), F.col("forwarded"), F.col("peer")))
    page = F.col("page_url")
    named = url.with_attribution(client).select(
        "*", url.path(page).alias("path"), url.authority(page).alias("page_domain"),
        url.referrer_domain(F.col("referrer")).alias("referrer_domain"), F.col("cid").alias("client_id"))
    rows = agents.classify(named)
    text = lambda c: quoted(F.col(c))
    payload = set_fields(F.coalesce("data", F.lit("{}")), {
        "tracking_id": text("tracking_id"), "source": text("source"), "medium": text("medium"),
        "campaign": text("campaign"), "crawler_type": text("crawler_name"),
        "is_bot": F.col("is_crawler").cast("string"), "tracking_method": F.lit('"javascript"')})
    device = ("timezone", "language", "screen_resolution", "viewport_size", "device_memory", "connection_type")
    return rows.select(
        "id", "timestamp", "visit_id", "client_id", "ip_address", "user_agent", "event_type",
        "page_url", "referrer",
        "path", "page_domain", "referrer_domain", "tracking_id", "source", "medium", "campaign",
        payload.alias("event_data"),
        *[F.col("client_side_data")[d].alias(f"client_side_{d}") for d in device])


def append_by_day(events: DataFrame, path: str, checkpoint: str, interval: str = "250 milliseconds"):
    """Micro-batch append into day partitions; returns the running query."""
    return (
        events.withColumn("event_date", F.to_date("timestamp")).writeStream.format("parquet")
        .partitionBy("event_date").option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval).outputMode("append").start(path))


def live_stream(events: DataFrame) -> DataFrame:
    """The feed of new events without heartbeats; source offsets take the place of a last id."""
    return events.where(F.col("event_type") != "heartbeat").select(
        "id", "timestamp", "event_type", "page_url", "path", "referrer", "client_id", "session_id", "source",
        "medium", "campaign", "event_data", "page_domain", "referrer_domain")


# --- stateful folds -------------------------------------------------------------------

def live_sessions(events: DataFrame, families: Families, race_seconds: float = 30) -> DataFrame:
    """Sessions assigned on arrival; the state per user is the number of sessions and when the
    last one was opened (one small row per user, kept for good since ids count up from it)."""
    race = int(race_seconds * 1_000_000)
    rows = events.select(
        "id", "timestamp", user_key().alias("user_key"), F.unix_micros("timestamp").alias("us"),
        live_boundary(F.col("event_type"), F.col("referrer_domain"), F.col("source"), F.col("medium"),
                      F.col("campaign"), families).alias("entry"))

    def fold(key, batches, state) -> Iterator:
        import pandas as pd

        pdf = pd.concat(list(batches)).sort_values(["us", "id"])
        seq, opened = state.get if state.exists else (-1, None)
        seqs, new = [], []
        for us, entry in zip(pdf["us"].tolist(), pdf["entry"].tolist()):
            opens = opened is None or (entry and us - opened > race)
            if opens:
                seq, opened = seq + 1, us
            seqs.append(seq)
            new.append(opens)
        state.update((seq, opened))
        yield pd.DataFrame({
            "id": pdf["id"], "timestamp": pdf["timestamp"], "user_key": key[0], "journey_seq": seqs, "is_new": new})

    out = rows.groupBy("user_key").applyInPandasWithState(
        fold, "id long, timestamp timestamp, user_key string, journey_seq long, is_new boolean",
        "seq long, opened long", "append", GroupStateTimeout.NoTimeout)
    return out.withColumn("live_session_id", session_id(F.col("user_key"), F.col("journey_seq")))


def spaced(
    rows: DataFrame, keys: Sequence[str], seconds: float, inclusive: bool = True, watermark: str = "10 minutes",
) -> DataFrame:
    """Streaming twin of ``keep_spaced``: each row with the kept row it folds into.

    The state of a key is its last kept row; it is dropped once the watermark is past the
    spacing, when it could no longer matter.
    """
    gap = int(seconds * 1_000_000)
    limit = gap if inclusive else gap - 1
    names = [f"k{i}" for i in range(len(keys))]
    df = rows.withWatermark("timestamp", watermark).select(
        "id", "timestamp", F.unix_micros("timestamp").alias("us"),
        *[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(n) for k, n in zip(keys, names)])

    def fold(key, batches, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["us", "id"])
        kept_us, kept_id = state.get if state.exists else (None, None)
        kept = []
        for us, rid in zip(pdf["us"].tolist(), pdf["id"].tolist()):
            if kept_us is None or us - kept_us > limit:
                kept_us, kept_id = us, rid
            kept.append(kept_id)
        state.update((kept_us, kept_id))
        expires = (kept_us + gap) // 1000 + 1
        if expires > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(expires)
        else:
            state.remove()
        yield pd.DataFrame({"id": pdf["id"], "timestamp": pdf["timestamp"], "kept_id": kept})

    return df.groupBy(*names).applyInPandasWithState(
        fold, "id long, timestamp timestamp, kept_id long", "kept_us long, kept_id long", "append",
        GroupStateTimeout.EventTimeTimeout)


def dedup_visits(visits: DataFrame, seconds: float = 30, watermark: str = "10 minutes") -> DataFrame:
    """Which visit each visit folds into (visits without a URL are not part of it)."""
    return spaced(visits.where(F.col("page_url") != ""), ["session_id", "page_url"], seconds, True, watermark)


def debounce_submits(events: DataFrame, seconds: float = 1, watermark: str = "10 minutes") -> DataFrame:
    """Kept form submits."""
    folded = spaced(events.where(F.col("event_type") == "form_submit"),
                    ["client_id", "session_id", "page_url"], seconds, False, watermark)
    return folded.where(F.col("kept_id") == F.col("id")).select("id", "timestamp")


def first_page_views(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """One page view per session and URL within the watermark."""
    return (
        events.where(F.col("event_type") == "page_view").withWatermark("timestamp", watermark)
        .dropDuplicatesWithinWatermark(["session_id", "page_url"]))


def link_or_create(rows: DataFrame, same_ip_seconds: float = 90, same_user_seconds: float = 600) -> DataFrame:
    """Streaming twin of ``linking.link_or_create`` for events that name no visit: ``id, timestamp, linked_visit_id,
    link_rule``, in the order of arrival.

    ``rows`` are those of ``linking.rows_to_fold``. The state of a page is its visits of the last tolerance.
    """
    same_ip, same_user = int(same_ip_seconds * 1_000_000), int(same_user_seconds * 1_000_000)
    names = ["us", "rank", "id", "page_url", "ip_address", "client", "device"]
    df = rows.withColumn("us", F.unix_micros("timestamp")).select(*names, "timestamp")

    def fold(key, batches, state) -> Iterator:
        import pandas as pd

        pdf = pd.concat(list(batches)).sort_values(["us", "rank", "id"])
        now = linking.Fold(same_ip, same_user)
        if state.exists:
            now.restore(state.get[0])
        out = []
        for us, rank, rid, page, ip, client, device in zip(*[pdf[c].tolist() for c in names]):
            if rank:
                out.append((rid, us, *now.event(us, rid, page, ip, client, device)))
            else:
                now.visit(us, rid, page, ip, client, device)
        state.update((now.saved(),))
        yield pd.DataFrame(out, columns=["id", "us", "linked_visit_id", "link_rule"])

    out = df.groupBy("page_url").applyInPandasWithState(
        fold, "id long, us long, linked_visit_id long, link_rule string", "seen string", "append",
        GroupStateTimeout.NoTimeout)
    return out.select("id", F.timestamp_micros("us").alias("timestamp"), "linked_visit_id", "link_rule")


# --- windowed counts ------------------------------------------------------------------

def windowed_counts(rows: DataFrame, keys: Sequence[str], width: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Rows per event-time window and keys, emitted when the watermark closes the window."""
    return (
        rows.withWatermark("timestamp", watermark).groupBy(F.window("timestamp", width).alias("w"), *keys)
        .agg(F.count("*").alias("count")).select(F.col("w.start").alias("window_start"), *keys, "count"))


def threshold_alerts(visits: DataFrame, width: str = "1 hour", threshold: int = 100, watermark: str = "10 minutes") -> DataFrame:
    return windowed_counts(visits, [], width, watermark).where(F.col("count") > threshold)


def engagement(events: DataFrame, watermark: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Time on page and idle time per session, page and day from heartbeats."""
    on_page = F.get_json_object("event_data", "$.time_on_page_ms").try_cast("bigint")
    idle = F.get_json_object("event_data", "$.idle_time_ms").try_cast("bigint")
    return (
        events.where(F.col("event_type").isin("heartbeat", "navigate")).withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", width).alias("w"), "session_id", "page_url").agg(
            F.count("*").alias("beats"), F.max(on_page).alias("time_on_page_ms"),
            F.max(idle).alias("max_idle_ms"), F.count(F.when(idle < 30_000, 1)).alias("engaged_beats"))
        .select(F.col("w.start").alias("day"), "session_id", "page_url", "beats", "time_on_page_ms",
                "max_idle_ms", "engaged_beats"))


# --- micro-batches against stored tables ----------------------------------------------

def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
               interval: str | None = None):
    """Run ``handle`` per micro-batch: what is available, or every ``interval``."""
    def cached(batch: DataFrame, batch_id: int) -> None:
        # Handlers read their batch more than once.
        batch.persist()
        try:
            handle(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(cached).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def link_batch(visits: Callable[[], DataFrame], out: str, same_ip_seconds: float = 90,
               same_user_seconds: float = 600) -> Callable[[DataFrame, int], None]:
    """Handler that links the events of a batch to stored visits.

    ``visits`` reads the stored visits; only those inside the tolerance before the batch are
    scanned. A batch is written under its own number, so a repeated batch replaces itself.
    """
    horizon = int(max(same_ip_seconds, same_user_seconds)) + 1

    def handle(batch: DataFrame, batch_id: int) -> None:
        span = batch.agg(F.min("timestamp"), F.max("timestamp")).first()
        if span[0] is None:
            return
        recent = visits().where(
            (F.col("timestamp") >= F.lit(span[0]) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(horizon)))
            & (F.col("timestamp") <= F.lit(span[1])))
        location.link_events_to_visits(batch, recent, same_ip_seconds, same_user_seconds).write.mode(
            "overwrite").parquet(f"{out}/batch={batch_id}")

    return handle


def locate_batch(visits: Callable[[], DataFrame], sessions: Callable[[], DataFrame], out: str,
                 hours: float = 24) -> Callable[[DataFrame, int], None]:
    """Handler that gives the visits of a batch an inherited location, from the batch itself and
    from stored visits and sessions of the last ``hours``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        span = batch.agg(F.min("timestamp"), F.max("timestamp")).first()
        if span[0] is None:
            return
        since = F.lit(span[0]) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0))
        before = visits().where((F.col("timestamp") >= since) & (F.col("timestamp") <= F.lit(span[1])))
        known = batch.unionByName(before.join(batch.select("id"), "id", "left_anti"), allowMissingColumns=True)
        located = location.inherit_location(known, sessions(), hours)
        located.join(batch.select("id"), "id", "left_semi").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return handle


def intake_batch(visits: Callable[[], DataFrame], sessions: Callable[[], DataFrame], ranges: DataFrame, out: str,
                 hours: float = 24) -> Callable[[DataFrame, int], None]:
    """Handler that enriches the raw hits of a batch and puts their place into the payload.

    ``session_id`` must have been assigned. Stored visits and sessions are read for the hours before the batch only, apart
    from those that its rows name.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        span = batch.agg(F.min("received_at"), F.max("received_at")).first()
        if span[0] is None:
            return
        since = F.lit(span[0]) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0))
        names = batch.select("id", "session_id", "visit_id")
        rows = enrich_intake(batch).join(names.select("id", "session_id"), "id")
        v, s = visits(), sessions()
        near_v = v.where((F.col("timestamp") >= since) & (F.col("timestamp") <= F.lit(span[1]))).unionByName(
            v.where(F.col("timestamp") < since).join(
                names.select(F.col("visit_id").alias("id")).distinct(), "id", "left_semi").select(v.columns))
        places = location.intake_places(rows, near_v, s, ranges, hours)
        location.with_places(rows, places).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return handle


def latest_batch(root: str, n: int = 100) -> Callable[[DataFrame, int], None]:
    """Handler keeping the newest ``n`` events; version ``v<batch>`` is complete when written."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        newest = [F.desc("timestamp"), F.desc("id")]
        rows = live_stream(batch).orderBy(*newest).limit(n)
        if batch_id > 0:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{root}/v{batch_id - 1}"))
        rows.orderBy(*newest).limit(n).write.mode("overwrite").parquet(f"{root}/v{batch_id}")

    return handle


def newest_version(spark: SparkSession, root: str, schema: StructType | None = None) -> DataFrame:
    """The complete version ``v<batch>`` of the latest batch; without any, an empty table of ``schema``."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{root}/v*/_SUCCESS")
    done = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    versions = [int(f.getPath().getParent().getName()[1:]) for f in done]
    if not versions and schema is not None:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{root}/v{max(versions)}")


def summary_batch(
    visits: Callable[[], DataFrame], events: Callable[[], DataFrame], root: str,
) -> Callable[[DataFrame, int], None]:
    """Handler that rebuilds the summaries of the clients with a new real form in the batch.

    Version ``v<batch>`` of each summary is the previous one with those clients replaced.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        clients = summaries.real_forms(batch).select("client_id").distinct()
        wide = summaries.client_summaries(visits(), events(), clients=clients)
        fills = summaries.form_fills(events()).join(clients, "client_id", "left_semi")
        fresh = {"journeys": summaries.journeys(wide), "leads": summaries.leads(wide), "form_fills": fills}
        for name, df in fresh.items():
            if batch_id > 0:
                old = spark.read.parquet(f"{root}/{name}/v{batch_id - 1}")
                df = summaries.replace_clients(old, df, clients)
            df.write.mode("overwrite").parquet(f"{root}/{name}/v{batch_id}")

    return handle
