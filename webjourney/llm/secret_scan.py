"""Scan for secrets: wide candidate patterns, and a random forest that takes the false positives out.

Candidates are all long runs of key-like characters. The forest sees their length, character transitions, how much of
them common words cover, whether they are part of a path, and what stands next to them. It learns from labelled
findings; where there are none, ``made_findings`` makes some of both kinds in the style of the corpus. Everything runs
as DataFrame operations in the JVM.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webjourney.llm.common import BLANKS, some_texts, stored, text_key

CORE = r"[A-Za-z0-9+/_=\-]{16,}"
#: A name and its equals sign at the start of a run whose rest is long enough: ``token=...``.
NAMED = r"(?<![A-Za-z0-9+/_=\-])([A-Za-z_\-]+=)(?=[A-Za-z0-9+/_=\-]{16})"
#: What stands before the second and third part of a signed web token.
TOKEN_PART = r"(^|[^A-Za-z0-9+/_=\-])eyJ[A-Za-z0-9_=\-]+\.([A-Za-z0-9_=\-]+\.)?$"
#: Word parts that prose and identifiers are made of.
COMMON = ("the and ing ion tion ent for ter ati her tha ere hat his con pro com per sta est ver all ith str able "
          "user data file name test example sample demo value index config path item page list image main home src "
          "doc lib bin var tmp log http www key id type class func table model version release build").split()
#: Formats by which issuers mark their keys.
ISSUED = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|rk_live_|sk-|xox[abprs]-|AIza|ya29|eyJhbGci|SG_)"
KEY_NAMES = r"(?i)(secret|token|passw|pwd|api.?key|access.?key|private|credential|bearer|auth)"
OTHER_NAMES = r"(?i)(sha\d*|md5|commit|checksum|digest|hash|uuid|guid|etag|revision|isbn|card|phone|version|build|rev)\W*$"

FEATURES = ("length digits uppers lowers symbols runs distinct vowels hexadecimal coverage slashes in_url issued "
            "key_name other_name assigned quoted").split()


def _share(text: str, pattern: str) -> Column:
    """Part of the characters that the pattern covers."""
    return 1 - F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, at (word number from 0), nth (run number in the word from 0), finding, left, word, before, after.

    Findings are all key-like runs of a word, if the word has a digit or an inner capital; ``name=`` in front of a run
    is a run of its own. ``left`` is what stands between the run and the one before it in the word, that one included;
    ``word`` goes on to the next run, so a long word is not repeated for each of its runs. ``before`` are the two words
    before, their end for all runs but the first. Null texts have none; repeated rows repeat theirs.
    """
    words = F.array_remove(F.split("text", BLANKS), "")
    looks = F.transform("words", lambda w, i: F.when(
        (F.length(w) >= 16) & w.rlike("[0-9]|[a-z][A-Z]") & w.rlike(CORE), i))
    rows = docs.select("doc_id", words.alias("words")).withColumn("hits", F.filter(looks, lambda i: i.isNotNull()))
    rows = rows.where(F.size("hits") > 0).select("doc_id", "words", F.explode("hits").alias("at"))
    rows = rows.select(
        "doc_id", F.col("at").cast("int").alias("at"),
        F.regexp_replace(F.get("words", F.col("at")), NAMED, "$1\0").alias("cut"),
        F.concat_ws(" ", F.get("words", F.col("at") - 2), F.get("words", F.col("at") - 1)).alias("before"),
        F.coalesce(F.get("words", F.col("at") + 1), F.lit("")).alias("after"))
    # As many texts between runs as runs, and one more.
    rows = rows.select("doc_id", "at", "before", "after", F.expr(f"regexp_extract_all(cut, r'{CORE}', 0)").alias("runs"),
                       F.transform(F.split("cut", CORE, -1), lambda x: F.replace(x, F.lit("\0"), F.lit(""))).alias("between"))
    each = F.transform("runs", lambda run, i: F.struct(
        i.alias("nth"), run.alias("finding"),
        F.concat(F.when(i > 0, F.get("runs", i - 1)).otherwise(""), F.get("between", i)).alias("left"),
        F.get("between", i + 1).alias("right")))
    rows = rows.select("doc_id", "at", "before", "after", F.explode(each).alias("r"))
    return rows.select(
        "doc_id", "at", "r.nth", "r.finding", "r.left", F.concat("r.left", "r.finding", "r.right").alias("word"),
        F.when(F.col("r.nth") == 0, F.col("before")).otherwise(F.expr("right(before, 100)")).alias("before"), "after")


def with_features(found: DataFrame) -> DataFrame:
    """Adds the forest's features as double columns ``f_<name>``. Without ``left``, a finding is the first in its word."""
    if "left" not in found.columns:
        found = found.withColumn("left", F.expr("substring(word, 1, greatest(0, instr(word, finding) - 1))"))
    shape = "finding"
    for some, mark in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0")):
        shape = F.regexp_replace(shape, some, mark)
    head = F.concat_ws(" ", "before", "left")
    columns = {
        "length": F.length("finding"), "digits": _share("finding", "[0-9]"), "uppers": _share("finding", "[A-Z]"),
        "lowers": _share("finding", "[a-z]"), "symbols": _share("finding", r"[+/_=\-]"),
        "runs": F.length(shape) / F.length("finding"),
        "distinct": F.size(F.array_distinct(F.split("finding", ""))) / F.length("finding"),
        "vowels": _share("finding", "[aeiouAEIOU]"), "hexadecimal": F.col("finding").rlike("^[0-9a-f]+$"),
        "coverage": _share("finding", f"(?i)({'|'.join(sorted(COMMON, key=len, reverse=True))})"),
        "slashes": F.length("word") - F.length(F.regexp_replace("word", r"[/\\]", "")),
        "in_url": F.col("word").rlike(r"://|www\.|\.(html?|php|png|jpe?g|js|css|py|txt|pdf)\b"),
        "issued": F.col("finding").rlike(ISSUED) | F.col("left").rlike(TOKEN_PART), "key_name": head.rlike(KEY_NAMES), "other_name": head.rlike(OTHER_NAMES),
        "assigned": head.rlike(r"[=:]\W*$"), "quoted": F.col("word").rlike("[\"'`]"),
    }
    return found.withColumns({f"f_{k}": columns[k].cast("double") for k in FEATURES})


def made_findings(docs: DataFrame, most_docs: int = 1000) -> DataFrame:
    """Labelled findings (finding, word, before, after, label) written with words of at most ``most_docs`` documents.

    Secrets are keys in issuers' formats or random strings given to a name such as token; the others are paths,
    addresses, identifiers, numbers, dates, checksums and placeholders.
    """
    words = F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: F.length(w) >= 4)
    rows = some_texts(docs, most_docs).select(
        F.slice(F.concat(words, F.array(*map(F.lit, ("some", "more", "words", "here")))), 1, 4).alias("w"),
        F.sha2("text", 256).alias("h"))
    rows = rows.select(*[F.get("w", F.lit(i)).alias(x) for i, x in enumerate("abcd")], "h",
                       F.base64(F.unhex("h")).alias("b64"))
    rows = rows.withColumn("alnum", F.regexp_replace("b64", r"[+/=]", "x")).withColumn(
        "pick", F.pmod(F.xxhash64("h"), F.lit(4)))
    name = "element_at(array('token', 'api_key', 'secret', 'password'), cast(pick as int) + 1)"
    other = "element_at(array('commit', 'sha1', 'md5', 'checksum'), cast(pick as int) + 1)"
    made = [  # (label, finding, what stands before it in its word, what after, the words before)
        (1, "concat('AKIA', upper(substr(translate(h, '01', 'gz'), 1, 16)))", "''", "''", "concat(a, ' ', b)"),
        (1, "concat('AKIA', upper(substr(translate(h, '01', 'gz'), 9, 16)))", "''", "','", "concat(b, ' ', c)"),
        (1, "substr(h, 1, 40)", "'\"'", "'\"'", f"concat({name}, ' =')"),
        (1, "substr(alnum, 1, 40)", "'\"'", "'\",'", f"concat({name}, ':')"),
        (1, "substr(h, 1, 32)", f"concat({name}, '=')", "''", "concat(a, ' ', b)"),
        (1, "substr(b64, 1, 40)", f"concat({name}, '=\"')", "'\"'", "concat(a, ' ', c)"),
        (1, "concat('ghp_', substr(alnum, 1, 36))", "''", "'.'", "concat(c, ' ', d)"),
        (1, "concat('sk_live_', substr(alnum, 3, 24))", "''", "''", "concat(a, ' ', d)"),
        (1, "substr(alnum, 2, 32)", "''", "''", f"concat('the ', {name})"),
        (0, "concat(a, '/', b, '/', c, '/', cast(pick as string), d)", "'/'", "'.html'", "concat(a, ' ', b)"),
        (0, "concat(a, '/', b, '/', substr(h, 1, 20))", "'https://example.org/'", "''", "concat(c, ' at')"),
        (0, "concat(a, '_', b, '_', c, '_', substr(h, 1, 2), '2')", "''", "''", "concat(c, ' ', d)"),
        (0, "concat(a, initcap(b), initcap(c), initcap(d))", "''", "'()'", "concat(a, ' ', d)"),
        (0, "concat(a, '-', b, '-', c, '-', d, '-2024')", "''", "','", "concat(a, ' ', d)"),
        (0, "substr(translate(h, 'abcdef', '123456'), 1, 16)", "''", "''", "concat(a, ' ', b)"),
        (0, "substr(translate(h, 'abcdef', '123456'), 5, 16)", "''", "'###'", "'card number'"),
        (0, "substr(h, 1, 40)", "''", "''", f"concat(a, ' ', {other})"),
        (0, "substr(h, 9, 32)", f"concat({other}, ':')", "''", "concat(a, ' ', b)"),
        (0, "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 12))",
         "''", "''", "'uuid ='"),
        (0, "concat('2024-01-', cast(10 + pick as string), 'T10-20-30')", "''", "'Z'", "concat('on ', a)"),
        (0, "concat('YOUR_', upper(a), '_KEY_', upper(b), '1')", "'\"'", "'\"'", f"concat({name}, ' =')"),
        (0, "concat(repeat('x', 20), cast(pick as string))", "'\"'", "'\"'", f"concat({name}, ' =')"),
        (0, "concat(repeat('=', 20), cast(pick as string))", "''", "''", "concat(a, ' ', b)"),
    ]
    each = F.explode(F.array(*[F.struct(
        F.lit(float(label)).alias("label"), F.expr(value).alias("finding"),
        F.expr(f"concat({left}, {value}, {right})").alias("word"), F.expr(before).alias("before"))
        for label, value, left, right, before in made])).alias("m")
    return rows.select(each, "d").select("m.*", F.col("d").alias("after"))


def train(findings: DataFrame, trees: int = 30, depth: int = 8, seed: int = 11) -> PipelineModel:
    """A forest for labelled findings (finding, word, before, after, label)."""
    names = [f"f_{k}" for k in FEATURES]
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label",
                                    featuresCol="features", featureSubsetStrategy="sqrt")
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), forest]).fit(
        stored(with_features(findings).select("label", *names)))


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5,
         sample: DataFrame | None = None) -> DataFrame:
    """All candidates of all texts: doc_id, at, finding, probability, secret.

    ``findings`` are labelled ones to learn from; by default they are made from a bounded sample of ``sample``, which
    is ``docs`` if not given. An empty table gives an empty result; other columns are not looked at.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = rows if sample is None else sample.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    labelled = stored(made_findings(words)) if findings is None else findings
    found = stored(with_features(candidates(rows)))  # few rows, which the forest reads several times
    if findings is None and labelled.isEmpty():
        return found.select("doc_id", "at", "finding", F.lit(None).cast("double").alias("probability"),
                            F.lit(False).alias("secret"))
    judged = train(labelled).transform(found)
    probability = F.round(F.get(vector_to_array("probability"), F.lit(1)), 6)
    return judged.select("doc_id", "at", "finding", probability.alias("probability")).withColumn(
        "secret", F.col("probability") >= threshold)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of a text replaced in it; all rows and columns stay.

    Secrets are gathered by doc_id and digest, so a cell holds those of one text, however many rows share its id.
    """
    texts = docs.select(F.struct("doc_id", text_key(F.col("text")).alias("text_key")).alias("doc_id"), "text")
    found = scan(texts, sample=docs).where("secret").groupBy(
        F.col("doc_id.doc_id").alias("__doc_id"), F.col("doc_id.text_key").alias("__text_key")).agg(
        F.collect_set("finding").alias("__secrets"))
    same = docs["doc_id"].eqNullSafe(found["__doc_id"]) & (text_key(docs["text"]) == found["__text_key"])
    rows = docs.join(found, same, "left")
    longest_first = F.reverse(F.array_sort(F.transform("__secrets", lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))))
    clean = F.aggregate(longest_first, F.col("text"), lambda text, s: F.replace(text, s.s, F.lit(mark)))
    return rows.withColumn("text", F.coalesce(clean, F.col("text"))).drop("__doc_id", "__text_key", "__secrets")
