"""URL filters: rules by host and path, and for URLs without a rule gradient-boosted trees on lexical features."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalink.llm.common import Scratch
from catalink.llm.samples import bounded_sample

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = [
    "length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "sign_ratio", "entropy", "parameters",
    "query_length", "fragment", "secure", "suffix_log_count", "suffix_labelled", "suffix_blocked",
]


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting (rule, verdict) as a struct, else null. A rule is a host and a path prefix such as ``example.net/en/``; it fits
    its host and all subdomains. Of equally long rules the first by code point is taken."""
    known = F.array(*(
        F.struct(
            F.lit(-len(rule)).alias("rank"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"),
            F.lit(rule.split("/", 1)[0]).alias("host"), F.lit("/" + rule.split("/", 1)[1]).alias("path"),
        )
        for rule, verdict in rules
    ))
    fits = F.filter(known, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    best = F.array_min(fits)
    return F.when(F.size(fits) > 0, F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def lexical(df: DataFrame, url: str) -> DataFrame:
    """``df`` with the lexical FEATURES of its URLs and ``suffix``, the last two labels of the host; a null URL has those of an empty one."""
    u = F.coalesce(F.col(url), F.lit(""))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    size = F.greatest(F.length(u), F.lit(1))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    letters = F.array_distinct(F.split(u, ""))
    times = F.transform(letters, lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))).cast("double"))
    entropy = F.aggregate(times, F.lit(0.0), lambda total, n: total - F.when(n > 0, n / size * F.log2(n / size)).otherwise(0.0))
    made = {
        "length": F.length(u),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": _count(path, "/"),
        "labels": _count(host, ".") + F.when(host == "", 0).otherwise(1),
        "digit_ratio": _count(u, string.digits) / size,
        "host_digit_ratio": _count(host, string.digits) / F.greatest(F.length(host), F.lit(1)),
        "sign_ratio": _count(u, "-_%~+=&@!") / size,
        "entropy": entropy,
        "parameters": F.when(query == "", 0).otherwise(_count(query, "&;") + 1),
        "query_length": F.length(query),
        "fragment": F.contains(u, F.lit("#")).cast("int"),
        "secure": F.startswith(F.lower(u), F.lit("https:")).cast("int"),
        "suffix": F.substring_index(host, ".", -2),
    }
    return df.withColumns({n: c if n == "suffix" else c.cast("double") for n, c in made.items()})


@dataclass
class Filter:
    """Boosted trees and the table of suffix statistics (suffix and its features); without trees one verdict for all."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame
    constant: float


def fit(
    df: DataFrame, scratch: Scratch, url: str = "url", label: str = "label", train_rows: int = 20_000, trees: int = 20, depth: int = 4,
    folds: int = 5,
) -> Filter:
    """A filter learned from the rows with a label (1 block, 0 allow), about ``train_rows`` of them, chosen by a hash of URL and label.

    Suffix statistics (number of URLs, of labelled ones, smoothed share of blocked ones) are counted over all rows; they are a table
    joined by suffix. A row that is learned from has those of the rows outside its own fold, one of ``folds`` by a hash of its URL, so that
    no label is a feature of its own row or of a copy. With labels of one kind only, or none, every URL is judged alike: as labelled, or allowed.
    """
    rows = lexical(df.select(F.col(url).alias("url"), F.col(label).cast("int").alias("label")), "url")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(folds)))
    counts = rows.groupBy("suffix", "fold").agg(
        F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")
    )
    counts = scratch.write(counts, "suffix_folds")
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]

    def statistics(n: Column, labelled: Column, blocked: Column) -> list[Column]:
        return [F.log1p(n).alias("suffix_log_count"), F.log1p(labelled).alias("suffix_labelled"), ((blocked + 1.0) / (labelled + 2.0)).alias("suffix_blocked")]

    totals = counts.groupBy("suffix").agg(*sums)
    suffixes = scratch.write(totals.select("suffix", *statistics(*(F.col(c) for c in ("n", "labelled", "blocked")))), "suffixes")
    outside = counts.alias("c").join(totals.alias("t"), "suffix").select(
        "suffix", "fold", *statistics(*(F.col(f"t.{c}") - F.col(f"c.{c}") for c in ("n", "labelled", "blocked")))
    )
    kinds = {r["label"]: r["n"] for r in rows.filter("label IN (0, 1)").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return Filter(None, suffixes, float(next(iter(kinds), 0)))
    sample = bounded_sample(rows.filter("label IN (0, 1)"), train_rows, "url", "label").join(outside, ["suffix", "fold"])
    sample = scratch.write(sample.select("label", *FEATURES), "labelled")
    train = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample)
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7).fit(train)
    return Filter(model, suffixes, 0.0)


def judge(df: DataFrame, model: Filter, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, url, score): the probability to be blocked of each row's URL."""
    rows = lexical(df.select(F.col(key).alias("key"), F.col(url).alias("url")), "url")
    if model.trees is None:
        return rows.select(F.col("key").alias(key), F.col("url").alias(url), F.lit(model.constant).alias("score"))
    rows = rows.join(model.suffixes, "suffix", "left").fillna(0.0, ["suffix_log_count", "suffix_labelled"]).fillna(0.5, ["suffix_blocked"])
    rows = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(rows)
    model.trees.setFeaturesCol("__features").setProbabilityCol("__p").setPredictionCol("__v").setRawPredictionCol("__r")
    scored = model.trees.transform(rows)
    return scored.select(F.col("key").alias(key), F.col("url").alias(url), vector_to_array("__p")[1].alias("score"))


def filter_urls(
    df: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", threshold: float = 0.5, train_rows: int = 20_000
) -> DataFrame:
    """(key, host, path, rule, verdict, score) for each row: the verdict of its longest fitting rule, else that of boosted trees.

    The trees learn from the URLs that a rule decides; a score of ``threshold`` or more blocks. Null URLs and URLs without ``://`` have
    an empty host and path and fit no rule; the trees judge them as an empty URL. Repeated rows and null keys stay; an empty table gives
    an empty result; extra columns are ignored.
    """
    scratch = Scratch(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    decided = rule_for(host_of(F.col("url")), path_of(F.col("url")), rules)
    label = F.when(decided["verdict"] == "block", 1).when(decided["verdict"] == "allow", 0)
    model = fit(rows.select("url", label.alias("label")), scratch, train_rows=train_rows)
    scored = judge(rows, model, "key", "url").withColumn("r", decided)
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(
        F.col("key").alias(key), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), own).alias("verdict"), "score",
    )
