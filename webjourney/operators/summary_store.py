"""Journeys, leads and form fills kept in hash buckets of clients.

A refresh rebuilds the summaries of the clients that changed and writes the buckets they lie in, and no others. Every
refresh can run again: it follows from the facts and the clients alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webjourney.operators import summaries
from webjourney.operators.ordered import work_table

TABLES = ("journeys", "leads", "form_fills")


class SummaryStore:
    """Three tables under ``root``, each in ``buckets`` parts by client."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root, buckets

    def bucket(self, client: Column) -> Column:
        return F.pmod(F.xxhash64(client), F.lit(self.buckets)).cast("int")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _there(self, name: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def read(self, name: str, like: DataFrame, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table (of some buckets); ``like`` gives the columns where nothing is written yet."""
        if not self._there(name):
            return like.where(F.lit(False))
        # Written types are nullable, whatever the expressions say.
        rows = self.spark.read.parquet(self._path(name))
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows.where(F.col("client_id").isNotNull()).select(*like.columns)

    def refresh(self, visits: DataFrame, events: DataFrame, clients: DataFrame) -> list[int]:
        """Rebuild ``clients`` (client_id) on their whole history; returns the buckets written.

        A changed client without real forms loses its rows.
        """
        clients = work_table(clients.where(F.col("client_id").isNotNull()).select("client_id").distinct())
        # At most as many numbers as there are buckets.
        touched = sorted(r.b for r in clients.select(self.bucket(F.col("client_id")).alias("b")).distinct().collect())
        if not touched:
            return []
        wide = work_table(summaries.client_summaries(visits, events, clients=clients))
        fresh = {"journeys": summaries.journeys(wide), "leads": summaries.leads(wide),
                 "form_fills": summaries.form_fills(events).join(clients, "client_id", "left_semi")}
        for name in TABLES:
            old = self.read(name, fresh[name], touched)
            self._write(name, summaries.replace_clients(old, fresh[name].select(*old.columns), clients), touched)
        return touched

    def _write(self, name: str, rows: DataFrame, buckets: list[int]) -> None:
        # Before the buckets it may come from are replaced.
        rows = work_table(rows)
        # A row without client in each bucket: one that loses all its rows is written, too.
        marks = self.spark.createDataFrame([(b,) for b in buckets], "bucket int")
        kept = rows.withColumn("bucket", self.bucket(F.col("client_id"))).unionByName(marks, allowMissingColumns=True)
        # A bucket may be large: it is written by as many tasks as its rows ask for.
        kept.repartition("bucket", F.pmod(F.xxhash64("client_id"), F.lit(self.buckets * 8))).write.mode(
            "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self._path(name))

    def overwrite(self, name: str, rows: DataFrame) -> None:
        """Replace a whole table."""
        self._write(name, rows, list(range(self.buckets)))

    def reconcile(self, visits: DataFrame, events: DataFrame) -> DataFrame:
        """Rebuild all clients that have captured data and no lead; returns them."""
        like = summaries.client_summaries(visits, events)
        missing = work_table(summaries.unreconciled(
            self.read("journeys", summaries.journeys(like)), self.read("leads", summaries.leads(like))))
        self.refresh(visits, events, missing)
        return missing

    def batch(self, visits: Callable[[], DataFrame], events: Callable[[], DataFrame]):
        """Micro-batch handler: the clients with a real form in the batch are rebuilt."""
        def handle(batch: DataFrame, batch_id: int) -> None:
            self.refresh(visits(), events(), summaries.real_forms(batch).select("client_id"))

        return handle
