"""URL verdicts by rules and gradient-boosted trees on lexical features (DataFrame functions only)."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: (verdict, host, path prefix): a rule fits its host and all subdomains; the longest that fits wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Most labelled URLs that the trees learn from, and the trees.
TRAIN_ROWS = 20_000
TREES = {"maxIter": 16, "maxDepth": 4, "stepSize": 0.25, "maxBins": 32, "seed": 11}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "entropy", "host_entropy", "parameters", "query_length",
            "hyphens", "secure", "has_fragment", "suffix_length", "suffix_rate", "suffix_seen"]


def parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path); both empty for a null url or one without ://."""
    known = F.coalesce(url, F.lit(""))
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(known, pattern, 1), UPPER, LOWER), F.regexp_extract(known, pattern, 2)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. The rules are a short list that is part of the plan."""
    name = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    empty = F.lit(None).cast("string")
    return (empty, empty) if name is None else (name, verdict)


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    share = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, -F.aggregate(share, F.lit(0.0), lambda acc, p: acc + F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def count_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def lexical(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, label (the rule's verdict), suffix and the lexical features of each url."""
    host, path = parts(F.col("url"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")) \
        .withColumns({"host": host, "path": path})
    rule, verdict = longest_rule(F.col("host"), F.col("path"))
    url, h, p = F.col("url"), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    number = {
        "length": F.length(url), "host_length": F.length(h), "path_length": F.length(p), "depth": count_of(p, "/"), "labels": count_of(h, "[.]"),
        "digit_ratio": F.when(F.length(url) > 0, count_of(url, "[0-9]") / F.length(url)).otherwise(0.0), "host_digits": count_of(h, "[0-9]"),
        "entropy": entropy(url), "host_entropy": entropy(h), "parameters": F.when(F.length(query) > 0, count_of(query, "&") + 1).otherwise(0),
        "query_length": F.length(query), "hyphens": count_of(h, "-"), "secure": F.when(url.startswith("https://"), 1).otherwise(0),
        "has_fragment": F.when(url.contains("#"), 1).otherwise(0)}
    return base.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("label"), F.regexp_extract(h, "([^.]*)$", 1).alias("suffix"),
                       *[v.cast("double").alias(k) for k, v in number.items()]) \
        .withColumn("suffix_length", F.length("suffix").cast("double"))


def block_share(labelled: DataFrame) -> float:
    """Share of blocked urls among all labelled ones; one half without any."""
    share = labelled.agg(F.avg(F.when(F.col("label") == "block", 1.0).otherwise(0.0))).first()[0]
    return 0.5 if share is None else share


def suffix_statistics(labelled: DataFrame, share: float) -> DataFrame:
    """suffix, suffix_rate (share of blocked urls, drawn towards ``share``), suffix_seen (log of the labelled urls), from all labelled urls."""
    blocked = F.sum(F.when(F.col("label") == "block", 1).otherwise(0))
    n = F.count(F.lit(1))
    return labelled.groupBy("suffix").agg(((blocked + 2 * share) / (n + 2)).alias("suffix_rate"), F.log1p(n).alias("suffix_seen"))


def with_vector(rows: DataFrame, statistics: DataFrame, share: float) -> DataFrame:
    """Adds the feature vector; a suffix without labelled urls has the rate ``share``."""
    full = rows.join(statistics, "suffix", "left").fillna({"suffix_rate": share, "suffix_seen": 0.0})
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(full)


def learn(labelled: DataFrame, statistics: DataFrame, share: float, rows: int = TRAIN_ROWS) -> GBTClassificationModel | str | None:
    """Trees from a bounded sample of labelled urls (the smallest hashes); with labels of one kind, that verdict; none without labels."""
    sample = labelled.orderBy(F.xxhash64("url", "page_id"), "page_id").limit(rows)
    train = materialize(with_vector(sample, statistics, share).select("features", (F.col("label") == "block").cast("double").alias("y")), "url-sample")
    kinds = [r[0] for r in train.select("y").distinct().collect()]
    if len(kinds) < 2:
        return ("block" if kinds[0] else "allow") if kinds else None
    return GBTClassifier(featuresCol="features", labelCol="y", **TREES).fit(train)


def judge(pages: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per page: page_id, host, path, rule (null if none fits), verdict, score (the trees' probability to block).

    The urls that a rule fits are the labelled ones: the trees learn from a bounded sample of them, the suffix statistics
    from all, and the verdict of every other url is the trees'. Null urls and urls without :// have empty host and path
    and are judged like any other. Without a labelled url all verdicts are ``allow`` with score 0; with labels of one
    kind that is the verdict. Repeated rows stay. Empty input gives an empty result. Only page_id and url are read.
    """
    rows = lexical(pages)
    labelled = rows.where(F.col("label").isNotNull())
    share = block_share(labelled)
    statistics = materialize(suffix_statistics(labelled, share), "suffixes")
    model = learn(labelled, statistics, share, train_rows)
    if not isinstance(model, GBTClassificationModel):
        scored = rows.withColumn("score", F.lit(1.0 if model == "block" else 0.0))
    else:
        scored = model.transform(with_vector(rows, statistics, share)).withColumn("score", vector_to_array("probability")[1])
    by_method = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("label", by_method).alias("verdict"), "score")


def op4_boosted_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
