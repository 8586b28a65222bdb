"""Named queries over the driver's tables and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webjourney.plans.sql_views import FORMS, with_views
from webjourney.sources import weblog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The views of one data folder, built when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def log(self) -> DataFrame:
        return weblog.log(self.spark, self.dir)

    @cached_property
    def visits(self) -> DataFrame:
        return weblog.visits(self.log)

    @cached_property
    def events(self) -> DataFrame:
        return weblog.visit_events(self.log)

    @cached_property
    def sessions(self) -> DataFrame:
        return weblog.sessions(self.log)

    @cached_property
    def ips(self) -> DataFrame:
        return weblog.ip_enrichment(self.log)


def flat(df: DataFrame) -> DataFrame:
    """Timestamps without zone (UTC), whole numbers as BIGINT."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz").alias(f.name)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint").alias(f.name)
        out.append(c)
    return df.select(*out)


def query(name: str, sql: str | None = None, *ctes: str, views: bool = True):
    """Register ``fn(Tables) -> DataFrame``; ``sql`` is the final SELECT over the view CTEs."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: flat(fn(Tables(spark, sf_dir)))
        if sql is not None:
            parts = [FORMS if c == "FORMS" else c for c in ctes]
            ORACLES[name] = with_views(sql, *parts) if views else sql.strip()
        return fn

    return wrap
