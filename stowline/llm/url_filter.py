"""URL verdicts: host and path rules first, gradient-boosted trees on lexical features for the rest.

Everything runs as DataFrame functions and JVM-side trees. Features: lengths, depth, digit ratio, entropy of
characters, parameter counts, and blocked shares among labelled URLs of the host's suffixes, alone and with the path's
first segment. Suffixes are hashed into `SUFFIX_BUCKETS` buckets each, so the statistics, taken over all labelled URLs,
are a table of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from stowline.llm.tables import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUFFIX_BUCKETS = 4096
TRAIN_ROWS = 20_000
PRIOR_ROWS = 20.0
_LEXICAL = (
    "url_length host_length path_length query_length path_depth host_depth digit_ratio host_digit_ratio hyphens host_hyphens "
    "entropy host_entropy parameters has_fragment is_https longest_label"
).split()
_SUFFIXES = ("suffix_1", "suffix_2", "suffix_3", "segment", "suffix_1_segment", "suffix_3_segment")
FEATURES = [*_LEXICAL, *(f"{name}_share" for name in _SUFFIXES)]


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty for null or without "://"."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none. A rule "host/path" fits the host and its subdomains."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda one: len(one[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _entropy(text: Column) -> Column:
    size = F.length(text)
    each = F.transform(F.array_distinct(F.split(text, "")), lambda one: size - F.length(F.replace(text, one, F.lit(""))))
    return F.coalesce(F.aggregate(F.filter(each, lambda n: n > 0), F.lit(0.0), lambda total, n: total - n / size * F.log2(n / size)), F.lit(0.0))


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    ratio = lambda part, whole: F.coalesce(part / F.nullif(F.length(whole), F.lit(0)), F.lit(0.0))
    return {
        "url_length": F.length(text),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "query_length": F.length(query),
        "path_depth": _count(path, "/"),
        "host_depth": _count(host, "."),
        "digit_ratio": ratio(_count(text, "0123456789"), text),
        "host_digit_ratio": ratio(_count(host, "0123456789"), host),
        "hyphens": _count(text, "-"),
        "host_hyphens": _count(host, "-"),
        "entropy": _entropy(text),
        "host_entropy": _entropy(host),
        "parameters": _count(query, "&") + (query != "").cast("int"),
        "has_fragment": F.contains(text, F.lit("#")).cast("int"),
        "is_https": F.startswith(text, F.lit("https:")).cast("int"),
        "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.length)),
    }


def _with_features(urls: DataFrame, url: str) -> DataFrame:
    host, path = F.col("_host"), F.col("_path")
    made = {name: column.cast("double") for name, column in lexical_features(F.col(url), host, path).items()}
    segment = F.substring_index(F.substring(path, 2, 1 << 30), "/", 1)
    for name in _SUFFIXES:
        parts = [F.substring_index(host, ".", -int(name[7]))] if name.startswith("suffix") else []
        parts += [segment] if name.endswith("segment") else []
        made[name] = F.pmod(F.xxhash64(F.lit(name), *parts), F.lit(SUFFIX_BUCKETS)).cast("int")
    return urls.withColumns({"_host": host_of(F.col(url)), "_path": path_of(F.col(url))}).withColumns(made)


@dataclass
class UrlModel:
    trees: GBTClassificationModel | None
    statistics: DataFrame
    base: float

    def scored(self, urls: DataFrame, url: str) -> DataFrame:
        """Adds `score`, the probability of "block"."""
        made = _with_shares(_with_features(urls, url), self.statistics, self.base, None)
        if self.trees is None:
            return made.withColumn("score", F.lit(self.base))
        vector = VectorAssembler(inputCols=FEATURES, outputCol="_vector").transform(made)
        return self.trees.transform(vector).withColumn("score", vector_to_array("_probability")[1])


def _with_shares(made: DataFrame, statistics: DataFrame, base: float, own: Column | None) -> DataFrame:
    """Smoothed blocked shares of the suffix buckets; the labels of a labelled row and its copies are left out of its shares."""
    for name in _SUFFIXES:
        table = statistics.filter(F.col("name") == name).select(F.col("bucket").alias(name), F.col("n").alias("_n"), F.col("blocked").alias("_blocked"))
        made = made.join(F.broadcast(table), name, "left")  # at most SUFFIX_BUCKETS rows
        rows, blocked = F.coalesce("_n", F.lit(0)), F.coalesce("_blocked", F.lit(0.0))
        if own is not None:
            rows, blocked = rows - F.col("weight"), blocked - own * F.col("weight")
        made = made.withColumn(f"{name}_share", (blocked + base * PRIOR_ROWS) / (rows + PRIOR_ROWS)).drop("_n", "_blocked")
    return made


def fit(labelled: DataFrame, url: str = "url", label: str = "blocked", train_rows: int = TRAIN_ROWS) -> UrlModel:
    """Fit on labelled URLs (label 1 for block, 0 for allow; other rows are left out).

    Suffix statistics cover all labelled rows; the trees see at most about `train_rows` distinct ones with their counts as
    weights, drawn by the URL's hash.
    Without labelled rows every URL scores 0; with one class, that class.
    """
    rows = labelled.filter(F.col(label).isin(0, 1)).select(url, F.col(label).cast("double").alias("label"))
    # equal rows are one row with a weight, so a URL of many rows is worked out, and drawn, once
    rows = stored(rows.groupBy(url, "label").agg(F.count("*").cast("double").alias("weight")), "labelled")
    made = _with_features(rows, url)
    total, weight, blocked = rows.agg(F.count("*"), F.sum("weight"), F.sum(F.col("weight") * F.col("label"))).first()
    base = blocked / weight if total else 0.0
    pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).alias("bucket")) for name in _SUFFIXES)))
    counted = made.select("label", "weight", pairs.alias("_pair")).groupBy("_pair.name", "_pair.bucket")
    counted = counted.agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("blocked"))
    statistics = stored(counted, "suffixes")
    if not 0 < base < 1:
        return UrlModel(None, statistics, base)
    share = min(1.0, train_rows / total)
    drawn = F.pmod(F.xxhash64(F.lit("train"), url), F.lit(1 << 20)) < int(share * (1 << 20))
    train = stored(_with_shares(made.filter(drawn), statistics, base, F.col("label")).select(*FEATURES, "label", "weight"), "drawn")
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_vector").transform(train).select("_vector", "label", "weight")
    booster = GBTClassifier(
        featuresCol="_vector", labelCol="label", weightCol="weight", predictionCol="_prediction", maxIter=12, maxDepth=4, maxBins=32, stepSize=0.2, seed=7, checkpointInterval=-1
    )
    booster.setRawPredictionCol("_raw").setProbabilityCol("_probability")
    return UrlModel(booster.fit(vectors.coalesce(4)), statistics, base)  # the drawn rows are stored: train_rows at most, by expectation


def judge_urls(urls: DataFrame, rules: list[tuple[str, str]], model: UrlModel, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keep, host, path, rule, verdict, score) of every row: the rule's verdict, else the trees'.

    Null urls and urls without "://" have empty host and path and go to the trees. Rows repeat as they are given; columns
    other than `keep` are left out. An empty table gives no rows.
    """
    narrow = urls.select(*keep, F.col(url).alias("_url"))
    found = matching_rule(F.col("_host"), F.col("_path"), rules)
    judged = model.scored(narrow, "_url").withColumn("_rule", found)
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return judged.select(*keep, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")


def labelled_by_rules(urls: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """(url, blocked) of the urls that a rule decides: the labels that the rules themselves provide."""
    found = matching_rule(host_of(F.col(url)), path_of(F.col(url)), rules)
    return urls.select(url, (found["verdict"] == "block").cast("int").alias("blocked")).filter(F.col("blocked").isNotNull())
