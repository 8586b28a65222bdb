"""Quality rules as a cascade that stops at the first rejection.

All counting happens inside the row with SQL functions: no shuffle, no Python. Which rule runs first follows from a
sample: the rules' times and rejections there give each one's rejections per second of work, what a rule needs counted
first included. The order decides how much is computed, never what is kept.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webjourney.llm.common import BLANKS, some_texts, stored

WINDOW = 8
HAS_WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """Rejects where ``reject`` is true: a condition over text, words, joined, n_words, word_chars and what ``needs``
    names of n_symbols, n_dup_lines and n_repeat_words."""

    name: str
    reject: Column
    needs: str | None = None


def default_rules() -> list[Rule]:
    n, chars = F.col("n_words"), F.col("word_chars")
    upper = F.length("joined") - F.length(F.regexp_replace("joined", r"\p{Lu}", ""))
    marks = F.length("joined") - F.length(F.regexp_replace("joined", "[!?.;:]", ""))
    letterless = F.size(F.filter("words", lambda w: ~w.rlike(r"\p{L}")))
    repeated = F.size(F.filter("words", lambda w, i: w == F.get("words", i - 1)))
    lines = F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(HAS_WORD)))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n, "n_symbols"),
        Rule("word_length", (chars > 14 * n) | (chars < 2 * n)),
        Rule("capitals", 10 * upper > 4 * chars),
        Rule("marks", marks > n),
        Rule("letterless_words", 2 * letterless > n),
        Rule("word_runs", 5 * repeated > n),
        Rule("duplicate_lines", 2 * F.col("n_dup_lines") > lines, "n_dup_lines"),
    ]


def base_rules() -> list[Rule]:
    n = F.col("n_words")
    return [Rule("few_words", n < 20), Rule("repeats", 100 * F.col("n_repeat_words") > 30 * n, "n_repeat_words")]


#: The same conditions for SQL that has the columns text, words, joined and the base columns.
RULES_SQL = r"""(10 * n_symbols > n_words OR word_chars > 14 * n_words OR word_chars < 2 * n_words
  OR 10 * (length(joined) - length(regexp_replace(joined, '\p{Lu}', '', 'g'))) > 4 * word_chars
  OR length(joined) - length(regexp_replace(joined, '[!?.;:]', '', 'g')) > n_words
  OR 2 * len(list_filter(words, lambda w: NOT regexp_matches(w, '\p{L}'))) > n_words
  OR 5 * len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) > n_words
  OR 2 * n_dup_lines > len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))"""


def with_words(docs: DataFrame) -> DataFrame:
    """doc_id, text without null, words, n_words, joined (the words' characters) and word_chars."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
    rows = rows.withColumn("n_words", F.size("words").cast("long")).withColumn("joined", F.array_join("words", ""))
    return rows.withColumn("word_chars", F.length("joined").cast("long"))


def with_repeats(rows: DataFrame) -> DataFrame:
    # Hashes of windows; only a text with a window that comes twice is looked at more closely. The words' hashes are named
    # more than once, as Catalyst would copy what is named once into the lambda and hash all words again in every window.
    rows = rows.withColumn("__hash", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("__windows", F.when(
        F.size("__hash") > WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("__hash") - (WINDOW - 1)),
                    lambda i: F.xxhash64(F.slice("__hash", i, WINDOW)))))
    rows = rows.drop("__hash").withColumn(
        "__sorted", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.sort_array(
            F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter("__sorted", lambda x, i: (
        F.coalesce(x.h == F.get("__sorted", i - 1).h, F.lit(False))
        | F.coalesce(x.h == F.get("__sorted", i + 1).h, F.lit(False))))
    rows = rows.drop("__windows").withColumn("__at", F.sort_array(F.transform(again, lambda x: x.i)))
    covered = F.transform("__at", lambda p, k: F.when(k == 0, WINDOW).otherwise(
        F.least(F.lit(WINDOW), p - F.get("__at", k - 1))))
    covered = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return rows.drop("__sorted").withColumn("n_repeat_words", covered).drop("__at")


def with_dup_lines(rows: DataFrame) -> DataFrame:
    with_word = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(HAS_WORD))
    return rows.withColumn("__lines", with_word).withColumn(
        "n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")).drop("__lines")


def with_symbols(rows: DataFrame) -> DataFrame:
    marks = F.length("joined") - F.length(F.regexp_replace("joined", r"[#*$%&|<>]", ""))
    return rows.withColumn("n_symbols", marks.cast("long"))


COUNTED: dict[str, Callable[[DataFrame], DataFrame]] = {
    "n_symbols": with_symbols, "n_dup_lines": with_dup_lines, "n_repeat_words": with_repeats}


def measured(docs: DataFrame) -> DataFrame:
    """Adds text without null, words, joined (the words' characters) and the base columns to ``doc_id, text``."""
    rows = with_words(docs)
    for count in COUNTED.values():
        rows = count(rows)
    return rows


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def ordered_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = 400) -> list[Rule]:
    """Rules by rejections per second on a sample of at most ``sample_rows`` rows, the best first.

    A rule's time is that of counting its rejections, and what it needs, the lesser of two runs, less that of reading
    the sample alone. Times below 30 ms count as equal, above they go by powers of two, and equal ratios by the rules'
    order, so that small differences between runs seldom change the outcome.
    """
    sample = stored(with_words(some_texts(docs.select("doc_id", "text"), sample_rows)))

    def timed(rows: DataFrame, counted: Column) -> tuple[float, int]:
        times = []
        for _ in range(2):
            begun = time.perf_counter()
            n = rows.agg(F.count(counted).alias("n")).first().n
            times.append(time.perf_counter() - begun)
        return min(times), n

    # All columns are read by the empty run, too.
    idle, _ = timed(sample, F.when(F.length("text") + F.size("words") + F.length("joined") >= 0, 1))
    scored = []
    for place, rule in enumerate(rules):
        seconds, rejected = timed(COUNTED[rule.needs](sample) if rule.needs else sample, F.when(rule.reject, 1))
        cost = 2.0 ** round(math.log2(max(seconds - idle, 0.03)))
        scored.append((-rejected / cost, cost, place))
    return [rules[place] for _, _, place in sorted(scored)]


def judge(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 400) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base columns, base_failed, rejected_by (null: none), kept.

    A null or blank text has no words and fails the base. Repeated rows and null ids stay as they are; an empty table
    gives an empty result; other columns are not looked at.
    """
    chosen = ordered_rules(docs, rules or default_rules(), sample_rows)
    verdict = F.when(F.col("base_failed"), "base")
    for rule in chosen:  # the branches of a CASE are evaluated one after another, up to the first that holds
        verdict = verdict.when(rule.reject, rule.name)
    rows = measured(docs).withColumn("base_failed", base_failed()).withColumn("rejected_by", verdict)
    return rows.select(
        "doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "rejected_by", F.col("rejected_by").isNull().alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` without the rows the cascade, its base rules included, rejects; all columns stay.

    Each rule sees only what the rules before it left, and a count is made when the first rule that needs it comes up.
    """
    chosen = ordered_rules(docs, [*base_rules(), *(rules or default_rules())])
    rows = with_words(docs.select(F.struct("*").alias("doc_id"), "text"))  # the row travels in place of its id
    for rule in chosen:
        if rule.needs and rule.needs not in rows.columns:
            rows = COUNTED[rule.needs](rows)
        # Spark would push the filter below what was counted and so count twice; the row number is what it cannot move.
        rows = rows.withColumn("__row", F.monotonically_increasing_id()).where(
            ~F.coalesce(rule.reject, F.lit(False)) & (F.col("__row") >= 0)).drop("__row")
    return rows.select("doc_id.*")
