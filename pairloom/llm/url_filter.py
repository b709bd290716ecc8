"""URL filters: host/path rules first, then gradient-boosted trees on lexical features.

Features are SQL expressions over the url alone (lengths, depth, digit ratio, entropy,
parameter count, dashes, host labels, suffix statistics). Trees are fitted on labelled
urls: their features, cut into quantile bins, go to the driver for at most
about ``sample_rows`` rows (a documented bound, twice that at most; rows are taken by hash
of their position), suffix statistics are
counted over all labelled rows in ``SUFFIX_BUCKETS`` buckets. A row that is fitted on sees
the statistics of the other ``FOLDS`` - 1 parts of the hosts only, so that no label is an
input of its own prediction; urls to be judged see all. The model comes back as one
CASE expression per tree, so scoring is a projection inside whole-stage codegen.

Defined results: a null url, or one without ``://``, has empty host and path, matches no
rule and is scored like any other; repeated rows are judged alike; an empty table gives
an empty result; with no labelled rows, or labels of one class only, every unruled url
gets that class (``allow`` without labels). Other columns are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER

SUFFIX_BUCKETS = 256
FOLDS = 5
FEATURES = (
    "url_len", "host_len", "path_len", "depth", "digit_ratio", "entropy", "n_params",
    "n_dashes", "n_labels", "host_digits", "longest_label", "suffix_rate", "domain_rate",
)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
MAX_RULES = 500


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__u, instr(__u, '://') + 3)"))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def match_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Name of the longest rule that fits, else null. Rule lists are bounded by MAX_RULES."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; an expression holds at most {MAX_RULES}")
    name = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
    return name


def bucket(host: Column, labels: int) -> Column:
    return F.pmod(F.xxhash64(F.substring_index(host, ".", -labels)), F.lit(SUFFIX_BUCKETS)).cast("int")


def fold(host: Column) -> Column:
    """All urls of a host are of one fold."""
    return F.pmod(F.xxhash64(host, F.lit("fold")), F.lit(FOLDS)).cast("int")


def rates(labelled: DataFrame, labels: int) -> tuple[list[float], list[float], int]:
    """Smoothed share of blocked urls by suffix bucket, the same without each fold (fold by fold), and the number of urls."""
    per = labelled.groupBy(bucket(F.col("__host"), labels).alias("b"), fold(F.col("__host")).alias("f")).agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    sums = np.zeros((2, FOLDS, SUFFIX_BUCKETS))
    for b, f, s, n in per.collect():
        sums[:, f, b] = s, n
    total = sums.sum(1)
    share = lambda x: ((x[0] + 1.0) / (x[1] + 2.0)).ravel().tolist()
    return share(total), share(total[:, None] - sums), int(total[1].sum())


def features(url: Column, host: Column, path: Column, suffix: list[float], domain: list[float], out_of_fold: bool = False) -> list[Column]:
    length = F.greatest(F.char_length(url), F.lit(1)).cast("double")
    chars = F.split(url, "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / length)
    entropy = F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    occurrences = lambda text, c: (F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))).cast("double")
    digits = lambda text: F.char_length(F.regexp_replace(text, "[^0-9]", "")).cast("double")
    table = lambda rate: F.array(*map(F.lit, rate))
    at = fold(host) * SUFFIX_BUCKETS if out_of_fold else F.lit(0)
    query = F.when(F.instr(url, "?") > 0, F.expr("substring(__u, instr(__u, '?') + 1)")).otherwise("")
    values = (
        F.char_length(url).cast("double"), F.char_length(host).cast("double"), F.char_length(path).cast("double"),
        occurrences(path, "/"), digits(url) / length, entropy,
        F.when(query == "", 0.0).otherwise(occurrences(query, "&") + 1), occurrences(url, "-"),
        F.when(host == "", 0.0).otherwise(occurrences(host, ".") + 1), digits(host),
        F.array_max(F.transform(F.split(host, r"\."), lambda x: F.char_length(x))).cast("double"),
        F.element_at(table(suffix), at + bucket(host, 1) + 1), F.element_at(table(domain), at + bucket(host, 2) + 1),
    )
    return [v.alias(f"f_{n}") for n, v in zip(FEATURES, values, strict=True)]


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, bins: int = 32, rate: float = 0.2) -> tuple[float, list]:
    """Logistic gradient boosting on quantile bins: (bias, trees); a tree is a leaf value or (feature, cut, left, right)."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(prior / (1 - prior)))
    score, trees = np.full(len(y), bias), []

    def grow(rows: np.ndarray, level: int):
        g, h = grad[rows], hess[rows]
        leaf = float(rate * g.sum() / (h.sum() + 1.0))
        best = (1e-6, None, None)
        if level < depth and len(rows) >= 10:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                gs = np.cumsum(np.bincount(binned[rows, j], g, len(c) + 1))
                hs = np.cumsum(np.bincount(binned[rows, j], h, len(c) + 1))
                gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
        if best[1] is None:
            score[rows] += leaf
            return leaf
        _, j, k = best
        left = binned[rows, j] <= k
        return (j, float(cuts[j][k]), grow(rows[left], level + 1), grow(rows[~left], level + 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        trees.append(grow(np.arange(len(y)), 0))
    return bias, trees


def tree_expression(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    j, cut, left, right = tree
    return F.when(F.col(f"f_{FEATURES[j]}") <= cut, tree_expression(left)).otherwise(tree_expression(right))


def classify(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, sample_rows: int = 20_000) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, block_score.

    ``labelled`` has url and y (1: block). The trees are fitted on about ``sample_rows``
    different urls (twice that at most) with the smallest hashes.
    """
    def prepared(df: DataFrame) -> DataFrame:
        df = df.withColumn("__u", F.coalesce(F.col("__u"), F.lit("")))
        host, path = host_and_path(F.col("__u"))
        return df.withColumns({"__host": host, "__path": path})

    known = prepared(labelled.select(F.col("url").alias("__u"), F.col("y").cast("double").alias("y")).where("y is not null"))
    (suffix, suffix_folds, _), (domain, domain_folds, _) = rates(known, 1), rates(known, 2)
    columns = features(F.col("__u"), F.col("__host"), F.col("__path"), suffix, domain)
    fitted = features(F.col("__u"), F.col("__host"), F.col("__path"), suffix_folds, domain_folds, out_of_fold=True)
    # drawn by the url, each once, so neither the order of rows nor their splits matter
    own = known.select("__u", "__host", "__path", "y").distinct()
    draw = F.pmod(F.xxhash64("__u", F.lit("url sample")), F.lit(1 << 30))
    own = own.withColumn("__draw", draw).where(F.col("__draw") < F.lit((1 << 30) * sample_rows / max(1, own.count())))
    sample = own.orderBy("__draw", "__u", "y").limit(2 * sample_rows).select("y", *fitted).collect()
    table = np.array(sorted(tuple(r) for r in sample), dtype=float).reshape(len(sample), len(FEATURES) + 1)
    y = table[:, 0]
    rows = prepared(pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__u"))).select("__id", "__host", "__path", *columns)
    if len(y) and 0 < y.mean() < 1:
        bias, trees = fit_trees(table[:, 1:], y)
        margin = F.lit(bias)
        for t in trees:
            margin = margin + tree_expression(t)
        score = 1 / (1 + F.exp(-margin))
    else:
        score = F.lit(float(y.mean()) if len(y) else 0.0)
    verdicts = F.create_map(*[F.lit(v) for r in rules for v in (r.name, r.verdict)]) if rules else F.create_map().cast("map<string,string>")
    judged = rows.withColumns({"rule": match_rule(F.col("__host"), F.col("__path"), rules), "block_score": score})
    by_model = F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.when(F.col("rule").isNull(), by_model).otherwise(F.element_at(verdicts, F.col("rule")))
    return judged.select(F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"), "rule", verdict.alias("verdict"), "block_score")


def ruled(pages: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Urls that a rule decides, as labelled rows: url, y."""
    df = pages.select(F.coalesce(F.col(url_col), F.lit("")).alias("__u"))
    host, path = host_and_path(F.col("__u"))
    blocks = [r.name for r in rules if r.verdict == "block"]
    df = df.withColumns({"__h": host, "__p": path})
    df = df.withColumn("__r", match_rule(F.col("__h"), F.col("__p"), rules)).where("__r is not null")
    return df.select(F.col("__u").alias("url"), F.col("__r").isin(blocks).cast("int").alias("y"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are the verdicts of the rules on the urls that they decide."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return classify(pages, ruled(pages)).drop("block_score")
