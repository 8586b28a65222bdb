"""Reading, exporting, extracting and merging the stored tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webjourney.config import CLIENT_SIDE_FIELDS
from webjourney.functions.predicates import Moment, between, days_before, moment
from webjourney.functions.text import or_else
from webjourney.operators.reports import with_session_place


# --- storage by day -------------------------------------------------------------------

def write_by_day(df: DataFrame, path: str, ts: str = "timestamp", mode: str = "append") -> None:
    """Write Parquet partitioned by day.

    Rebalancing puts few files into a small day and splits a large one over several tasks.
    """
    (df.withColumn("event_date", F.to_date(ts)).hint("rebalance", "event_date")
     .write.mode(mode).partitionBy("event_date").parquet(path))


def read_days(
    spark: SparkSession, path: str, schema: T.StructType | None = None,
    start: Moment | None = None, end: Moment | None = None, ts: str = "timestamp",
) -> DataFrame:
    """Bounded scan: prunes day partitions and filters the exact range."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(T.StructType([*schema.fields, T.StructField("event_date", T.DateType())]))
    df = reader.parquet(path)
    if start is not None:
        df = df.where(F.col("event_date") >= F.to_date(moment(start)))
    if end is not None:
        df = df.where(F.col("event_date") <= F.to_date(moment(end)))
    return df.where(between(F.col(ts), start, end)).drop("event_date")


def on_day(df: DataFrame, day: str, ts: str = "timestamp") -> DataFrame:
    """Rows of one calendar day."""
    return df.where((F.col(ts) >= moment(day)) & (F.col(ts) < moment(day) + F.make_dt_interval(F.lit(1))))


# --- exports --------------------------------------------------------------------------

def iso(ts: Column) -> Column:
    """ISO 8601 with offset; microseconds only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(F.unix_micros(ts) % 1_000_000 != 0, F.date_format(ts, ".SSSSSS")).otherwise("")
    return F.concat(whole, fraction, F.lit("+00:00"))


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _flag(c: Column) -> Column:
    return F.when(c, "True").when(~c, "False").otherwise("")


def export_visits(visits: DataFrame, sessions: DataFrame, start: Moment | None = None,
                  end: Moment | None = None) -> DataFrame:
    """27 text columns per visit, location falling back to the session."""
    df = with_session_place(visits.where(between(F.col("timestamp"), start, end)), sessions)
    plain = ("session_id client_id user_agent page_url page_domain path crawler_type country city tracking_id "
             "source medium campaign referrer page_title request_method ip_address").split()
    return df.select(
        "id", _text(iso(F.col("timestamp"))).alias("timestamp"), *[_text(c).alias(c) for c in plain],
        _flag(F.col("is_bot")).alias("is_bot"),
        _text(F.col("response_status").cast("string")).alias("response_status"),
        *[_text(c).alias(c) for c in CLIENT_SIDE_FIELDS])


def export_events(events: DataFrame, sessions: DataFrame, start: Moment | None = None,
                  end: Moment | None = None) -> DataFrame:
    """26 text columns per event; location, attribution and bot fields fall back to the payload
    and, for the location, to the session."""
    df = events.where(between(F.col("timestamp"), start, end))
    s = sessions.select(F.col("id").alias("session_id"), F.lit(True).alias("_known"),
                        F.col("country").alias("_c"), F.col("city").alias("_t"))
    df = df.withColumn("_p", F.from_json("event_data", ", ".join(f"{c} string" for c in (
        "country", "city", "source", "medium", "campaign", "tracking_id", "crawler_type", "is_bot"))))
    payload = lambda name: F.nullif(F.col(f"_p.{name}"), F.lit(""))
    country, city = payload("country"), payload("city")
    use_session = (country.isNull() | (country == "XX")) & F.coalesce("_known", F.lit(False))
    either = lambda c: _text(F.coalesce(F.nullif(F.col(c), F.lit("")), payload(c))).alias(c)
    has_data = F.col("event_data").isNotNull() & (F.col("event_data") != "{}")
    bot = payload("is_bot")
    plain = ("session_id client_id event_type page_url referrer path page_domain referrer_domain").split()
    return df.join(s, "session_id", "left").select(
        "id", _text(iso(F.col("timestamp"))).alias("timestamp"),
        _text(F.col("visit_id").cast("string")).alias("visit_id"), *[_text(c).alias(c) for c in plain],
        _text(F.when(use_session, F.col("_c")).otherwise(country)).alias("country"),
        _text(F.when(use_session, F.col("_t")).otherwise(city)).alias("city"),
        either("source"), either("medium"), either("campaign"), either("tracking_id"),
        _text(payload("crawler_type")).alias("crawler_type"), _text(F.initcap(bot)).alias("is_bot"),
        _text(F.when(has_data, F.col("event_data"))).alias("event_data_json"),
        *[_text(c).alias(c) for c in CLIENT_SIDE_FIELDS])


def export_leads(leads: DataFrame) -> DataFrame:
    """Lead list for files; ``form_values`` carries the captured data."""
    plain = "client_id captured_page captured_path email name".split()
    return leads.select(
        *[_text(c).alias(c) for c in plain], _text(iso(F.col("captured_at"))).alias("captured_at"),
        or_else(F.col("source"), "direct").alias("source"), or_else(F.col("medium"), "none").alias("medium"),
        or_else(F.col("campaign"), "none").alias("campaign"), _text("captured_data").alias("form_values"))


def export_journeys(journeys: DataFrame) -> DataFrame:
    """Journey list for files."""
    plain = "client_id entry_page exit_page email name path_sequence".split()
    return journeys.select(
        *[_text(c).alias(c) for c in plain], "visit_count", "form_fill_count",
        _text(iso(F.col("first_seen"))).alias("first_seen"), _text(iso(F.col("last_seen"))).alias("last_seen"),
        or_else(F.col("source"), "direct").alias("source"), or_else(F.col("medium"), "none").alias("medium"),
        or_else(F.col("campaign"), "none").alias("campaign"),
        _flag(F.col("has_captured_data") == 1).alias("has_captured_data"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header, quotes doubled; one file per task, nothing passes through the driver."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What :func:`write_csv` wrote. Empty texts are quoted there and stay empty texts, cells with nothing are NULL."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("nullValue", "\0").csv(path)


# --- extract, reload, merge, purge ----------------------------------------------------

FULL_TABLES = ("funnel_configs",)
TIME_COLUMNS = {"sessions": "last_visit", "visits": "timestamp", "events": "timestamp"}
SUMMARY_TABLES = ("journeys", "leads", "form_fills")


def partial_extract(
    tables: Mapping[str, DataFrame], since: Moment | None = None, as_of: Moment | None = None,
    days: int = 7,
) -> dict[str, DataFrame]:
    """Recent part of every table: small tables whole, facts by time, summaries of the clients
    with recent visits."""
    cutoff = moment(since) if since is not None else days_before(as_of, days)
    recent = tables["visits"].where(
        (F.col("timestamp") >= cutoff) & F.col("client_id").isNotNull()).select("client_id")
    out = {}
    for name, df in tables.items():
        if name in TIME_COLUMNS:
            out[name] = df.where(F.col(TIME_COLUMNS[name]) >= cutoff)
        elif name in SUMMARY_TABLES:
            out[name] = df.join(recent, "client_id", "left_semi")
        else:
            out[name] = df
    return out


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def reload(tables: Mapping[str, DataFrame], root: str) -> DataFrame:
    """Replace stored tables and report their rows as stored."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    spark = next(iter(tables.values())).sparkSession
    return row_counts({name: spark.read.parquet(f"{root}/{name}") for name in tables})


def absent(new: DataFrame, current: DataFrame, key: Sequence[str] = ("id",)) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet; of equal new keys one is kept."""
    fresh = new.join(current.select(*key), list(key), "left_anti")
    return fresh.dropDuplicates(list(key))


def merge_absent(new: DataFrame, path: str, key: Sequence[str] = ("id",)) -> None:
    """Append the rows whose key is not stored yet."""
    current = new.sparkSession.read.parquet(path)
    absent(new, current, key).write.mode("append").parquet(path)


def purge(spark: SparkSession, visits_path: str, sessions_path: str) -> DataFrame:
    """Empty the stored visits and sessions (events stay); returns how many rows went."""
    counts = {}
    for name, path in (("visits", visits_path), ("sessions", sessions_path)):
        df = spark.read.parquet(path)
        counts[name] = df.count()
        spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)
    return spark.createDataFrame([(counts["visits"], counts["sessions"])],
                                 "deleted_visits long, deleted_sessions long")
