"""Day storage, exports, extracts, merges, purge."""

import csv
import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from webjourney.functions.predicates import between, contains_all, has_prefix, target_regex
from webjourney.operators import ips, reports
from webjourney.sources import io, schemas, weblog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    return weblog.log(spark, SF)


def test_write_and_read_days(spark, log, tmp_path):
    events = weblog.visit_events(log)
    io.write_by_day(events, str(tmp_path / "e"))
    back = io.read_days(spark, str(tmp_path / "e"), start="2024-01-05", end="2024-01-07")
    want = events.where(between(F.col("timestamp"), "2024-01-05", "2024-01-07"))
    assert back.count() == want.count() > 0
    plan = back._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert io.on_day(events, "2024-01-06").count() == back.where("to_date(timestamp) = date'2024-01-06'").count()


def test_bounded_range_is_inclusive(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 23, 59, 59),), (dt.datetime(2024, 1, 3),), (dt.datetime(2024, 1, 1),)], "t timestamp")
    assert df.where(between(F.col("t"), "2024-01-01", "2024-01-02")).count() == 2
    assert df.where(between(F.col("t"), None, dt.date(2024, 1, 2))).count() == 2


def test_csv_export(spark, log, tmp_path):
    out = io.export_visits(weblog.visits(log), weblog.sessions(log))
    assert len(out.columns) == 27
    assert len(io.export_events(weblog.visit_events(log), weblog.sessions(log)).columns) == 26
    io.write_csv(out, str(tmp_path / "v"))
    assert not io.read_csv(spark, str(tmp_path / "v"), out.schema).exceptAll(out).count()
    rows = []
    for f in glob.glob(str(tmp_path / "v" / "*.csv")):
        with open(f, newline="") as fh:
            rows += list(csv.DictReader(fh))
    assert len(rows) == weblog.visits(log).count()
    assert set(rows[0]) == set(out.columns) and rows[0]["timestamp"].endswith("+00:00")


def test_event_export_falls_back_to_payload(spark):
    events = spark.createDataFrame(
        [(1, "s1", None, '{"source":"p","is_bot":true,"country":"XX","crawler_type":"GPTBot"}'), (2, "gone", "own", '{"country":"XX","city":"C"}')],
        "id long, session_id string, source string, event_data string")
    for f in schemas.visit_events().fields:
        if f.name not in events.columns:
            events = events.withColumn(f.name, F.lit(None).cast(f.dataType))
    sessions = spark.createDataFrame([("s1", "DE", "Berlin")], "id string, country string, city string")
    got = {r.id: r for r in io.export_events(events, sessions).collect()}
    assert (got[1].source, got[1].is_bot, got[1].country, got[1].city, got[1].crawler_type) == ("p", "True", "DE", "Berlin", "GPTBot")
    assert (got[2].source, got[2].country, got[2].city) == ("own", "XX", "C")


def test_merge_reload_purge(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.range(5).withColumn("x", F.lit("old")).write.parquet(path)
    new = spark.range(3, 8).withColumn("x", F.lit("new"))
    io.merge_absent(new.unionByName(new), path)
    got = {r.id: r.x for r in spark.read.parquet(path).collect()}
    assert got == {0: "old", 1: "old", 2: "old", 3: "old", 4: "old", 5: "new", 6: "new", 7: "new"}
    counts = {r.table_name: r.rows for r in io.reload({"a": new, "b": new.limit(2)}, str(tmp_path / "r")).collect()}
    assert counts == {"a": 5, "b": 2}
    gone = io.purge(spark, str(tmp_path / "r/a"), str(tmp_path / "r/b")).first()
    assert (gone.deleted_visits, gone.deleted_sessions) == (5, 2)
    assert spark.read.parquet(str(tmp_path / "r/a")).count() == 0


def test_upsert_and_failures(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    cols = schemas.ip_enrichment().names

    def frame(rows):
        return spark.createDataFrame(
            [tuple(r.get(c) for c in cols) for r in rows], schemas.ip_enrichment())

    current = frame([
        {"ip": "a", "status": "error", "attempt_count": 2, "first_seen_at": day(1), "last_seen_at": day(2)},
        {"ip": "b", "status": "success", "attempt_count": 0, "first_seen_at": day(5), "company_name": "B"}])
    errors = spark.createDataFrame([("a", "e" * 60, "m", day(3), day(4)), ("c", "e", "m", day(3), day(4))],
                                   "ip string, error_code string, error_message string, first_seen_at timestamp, last_seen_at timestamp")
    got = {r.ip: r for r in ips.upsert(current, ips.failures(errors, current, "2024-01-31")).collect()}
    assert (got["a"].status, got["a"].attempt_count, got["a"].first_seen_at, len(got["a"].error_code)) == ("failed", 3, day(1), 60)
    assert (got["c"].status, got["c"].attempt_count) == ("error", 1) and got["b"].company_name == "B"


def test_filters(spark):
    df = spark.createDataFrame([("/Demo/x",), ("/pricing",), (None,)], "p string")
    assert df.where(has_prefix(F.col("p"), "/demo")).count() == 1
    assert df.where(contains_all(F.col("p"), "demo, X")).count() == 1
    assert target_regex("/schedule") == "^.*/schedule([/?#]|$)" == target_regex("^.*/schedule([/?#]|$)")
    assert target_regex(" .*/a$ ") == "^.*/a([/?#]|$)"


def test_paging(spark):
    df = spark.range(25)
    assert [r.id for r in reports.page(df, ["id"], 10, 20).collect()] == [20, 21, 22, 23, 24]
    info = reports.page_info(df, 10, 20).first()
    assert tuple(info) == (25, False, True, 3, 3)
    assert [r.id for r in reports.after_id(df, 21, 2).collect()] == [22, 23]
