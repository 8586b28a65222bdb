"""Bookkeeping of IP-to-company enrichment; the web lookups themselves happen elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webjourney.functions.predicates import Moment, is_routable, moment

# Texts that mean "no value" in lookup responses.
NO_VALUE = ("", "nan", "null", "none", "n/a", "unknown")


def _human_ips(visits: DataFrame) -> DataFrame:
    return visits.where(~F.col("is_bot") & is_routable(F.col("ip_address")))


def candidates(
    visits: DataFrame, enrichment: DataFrame, as_of: Moment, batch: int | None = None,
    max_attempts: int = 3, exclude_failed: bool = False,
) -> DataFrame:
    """Addresses of human visits without a valid success and without exhausted errors.

    An address that ended as ``failed`` comes back unless ``exclude_failed``.
    """
    ips = _human_ips(visits).groupBy(F.col("ip_address").alias("ip")).agg(
        F.min("timestamp").alias("first_seen_at"), F.max("timestamp").alias("last_seen_at"))
    valid = (F.col("status") == "success") & (F.col("ttl_expires_at") > moment(as_of))
    spent = (F.col("status") == "error") & (F.col("attempt_count") >= max_attempts)
    if exclude_failed:
        spent = spent | (F.col("status") == "failed")
    done = enrichment.where(valid | spent).select("ip")
    open_ips = ips.join(done, "ip", "left_anti")
    return open_ips if batch is None else open_ips.orderBy("ip").limit(batch)


def coverage(visits: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Distinct human addresses by enrichment state."""
    ips = _human_ips(visits).select(F.col("ip_address").alias("ip")).distinct()
    state = ips.join(enrichment.select("ip", "status"), "ip", "left")

    def n(status: str) -> Column:
        return F.count(F.when(F.col("status") == status, 1))

    total, ok = F.col("candidates_total"), F.col("enriched_success_total")
    return state.agg(
        F.count("*").alias("candidates_total"), n("success").alias("enriched_success_total"),
        n("error").alias("enriched_error_total"), n("failed").alias("enriched_failed_total")).select(
        "*", (total - ok - F.col("enriched_error_total") - F.col("enriched_failed_total"))
        .alias("enriched_skipped_total"),
        F.when(total > 0, F.round(ok / total * 100, 1)).otherwise(F.lit(0.0)).alias("coverage_percent"))


def clean(c: Column, lower: bool = True) -> Column:
    text = F.trim(c)
    kept = F.when(~F.lower(text).isin(*NO_VALUE), text)
    return F.lower(kept) if lower else kept


def normalize(responses: DataFrame, as_of: Moment, provider: str = "lookup", ttl_days: int = 30) -> DataFrame:
    """Enrichment rows from raw responses (``ip, raw, first_seen_at, last_seen_at``)."""
    part = lambda path: F.get_json_object("raw", path)
    flag = lambda name: part(f"$.{name}").try_cast("boolean").alias(name)
    none = F.lit(None).cast("string")
    return responses.select(
        "ip", clean(part("$.company.domain")).alias("company_domain"),
        clean(part("$.company.name"), lower=False).alias("company_name"),
        clean(part("$.company.type")).alias("company_type"),
        clean(part("$.location.country_code")).alias("country"),
        flag("is_datacenter"), flag("is_vpn"), flag("is_proxy"), flag("is_tor"),
        F.lit(provider).alias("source"), moment(as_of).alias("enriched_at"),
        (moment(as_of) + F.make_dt_interval(F.lit(ttl_days))).alias("ttl_expires_at"),
        F.lit("success").alias("status"), none.alias("error_code"), none.alias("error_message"),
        F.lit(0).alias("attempt_count"), "first_seen_at", "last_seen_at")


def failures(errors: DataFrame, current: DataFrame, as_of: Moment, provider: str = "lookup",
             max_attempts: int = 3) -> DataFrame:
    """Enrichment rows of failed lookups (``ip, error_code, error_message, first/last_seen_at``):
    one attempt more, ``failed`` when the attempts are used up."""
    known = current.select("ip", F.col("attempt_count").alias("_n"))
    attempts = F.coalesce(F.col("_n") + 1, F.lit(1))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return errors.join(known, "ip", "left").select(
        "ip", *[none("string", c) for c in ("company_domain", "company_name", "company_type", "country")],
        *[none("boolean", c) for c in ("is_datacenter", "is_vpn", "is_proxy", "is_tor")],
        F.lit(provider).alias("source"), moment(as_of).alias("enriched_at"),
        none("timestamp", "ttl_expires_at"),
        F.when(attempts < max_attempts, "error").otherwise("failed").alias("status"),
        "error_code", "error_message",
        attempts.alias("attempt_count"), "first_seen_at", "last_seen_at")


def upsert(current: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace current ones by ``ip``, keeping the earliest ``first_seen_at``."""
    cols = current.columns
    kept = [c for c in cols if c not in ("ip", "first_seen_at")]
    rows = current.withColumn("_new", F.lit(0)).unionByName(new.select(*cols).withColumn("_new", F.lit(1)))
    return rows.groupBy("ip").agg(
        F.max_by(F.struct(*kept), "_new").alias("_r"), F.min("first_seen_at").alias("first_seen_at")).select(
        *[F.col(c) if c in ("ip", "first_seen_at") else F.col(f"_r.{c}").alias(c) for c in cols])


def enrich_visits(visits: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Visits with company data of their address."""
    dim = enrichment.where(F.col("status") == "success").select(
        F.col("ip").alias("ip_address"), "company_domain", "company_name", "company_type")
    return visits.join(dim, "ip_address", "left")
