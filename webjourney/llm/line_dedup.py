"""Removal of lines that stand in the texts of many sites.

How many sites a line is found in comes from HyperLogLog sketches that aggregation merges. Where the estimate is near
the threshold, distinct sites are counted exactly, so the outcome is that of exact counting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webjourney.llm.common import stored, text_key

HAS_WORD = r"[^\x20\x09-\x0D]"
SALTS = 32


def _among(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``lines`` whose key is among ``keys``; a line that fills much of the corpus is dealt out by salt."""
    salted = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return lines.join(salted, ["key", "salt"], "left_semi")


def lines_of(docs: DataFrame, site: str = "source") -> DataFrame:
    """doc_id, text_key, site, key and salt of each line that has a word."""
    line = F.explode(F.split("text", "\n", -1)).alias("line")
    rows = docs.select(F.col("doc_id"), text_key(F.col("text")).alias("text_key"), F.col(site).cast("string").alias("site"),
                       "text").select("doc_id", "text_key", "site", line).where(F.col("line").rlike(HAS_WORD))
    return rows.select("doc_id", "text_key", "site", text_key(F.col("line")).alias("key")).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int"))


def boilerplate(lines: DataFrame, min_sites: int, precision: int = 12) -> DataFrame:
    """Keys of lines in ``min_sites`` or more sites; a null site counts as none."""
    spread = 4 * 1.04 / 2 ** (precision / 2)  # four standard errors
    low, high = min_sites * (1 - spread) - 1, min_sites * (1 + spread) + 1
    sketches = lines.groupBy("key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", precision)).alias("sites"))
    found = stored(sketches.where(F.col("sites") >= low))
    near = found.where(F.col("sites") <= high).select("key")
    # Distinct pairs first: a row per site and task is left of a line that a site repeats.
    exact = _among(lines, near).groupBy("key", "site").agg(F.lit(1).alias("one")).groupBy("key").agg(
        F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    return found.where(F.col("sites") > high).select("key").union(exact.select("key"))


def removable(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, text_key and the keys of that text's lines that are among ``keys``."""
    return _among(lines, keys).groupBy("doc_id", "text_key").agg(F.collect_set("key").alias("__drop"))


def clean(docs: DataFrame, min_sites: int = 10, site: str = "source") -> DataFrame:
    """``docs`` with cross-site lines cut out of ``text``, plus ``__n_lines`` and ``__n_removed``.

    Lines are compared as they are; blank ones never go. A null text stays null; rows may share an id or have none;
    other columns are carried along.
    """
    lines = stored(lines_of(docs, site))
    drop = removable(lines, boilerplate(lines, min_sites)).withColumnsRenamed(
        {"doc_id": "__doc_id", "text_key": "__text_key"})
    same = docs["doc_id"].eqNullSafe(drop["__doc_id"]) & (text_key(docs["text"]) == drop["__text_key"])
    rows = docs.join(drop, same, "left")
    split = F.split("text", "\n", -1)
    gone = F.col("__drop").isNotNull()
    kept = F.filter(split, lambda x: ~F.array_contains("__drop", text_key(x)))
    rows = rows.withColumn("__kept", F.when(gone, F.array_join(kept, "\n")).otherwise(F.col("text")))
    has_word = F.size(F.filter(split, lambda x: x.rlike(HAS_WORD)))
    removed = F.when(gone, F.size(F.filter(split, lambda x: F.array_contains("__drop", text_key(x))))).otherwise(0)
    return rows.withColumns({
        "__n_lines": F.when(F.col("text").isNull(), 0).otherwise(has_word).cast("long"),
        "__n_removed": F.when(F.col("text").isNull(), 0).otherwise(removed).cast("long"),
    }).withColumn("text", F.col("__kept")).drop("__kept", "__drop", "__doc_id", "__text_key")
