"""URL filter: longest matching host/path rule, else gradient-boosted trees on lexical features.

The URLs that a rule decides are the labelled ones; the trees learn from a bounded, hash-chosen part
of them and judge the rest. A labelled URL's suffix statistics leave out its own fold of five, so they
never hold its label, and the last fold is kept out of training: p_block there measures the trees.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlens.llm.common import Names, Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_host_digits", "f_entropy", "f_params", "f_param_length", "f_marks", "f_fragment"]
LEVELS = 3  # labels of the longest host suffix that has statistics
SUFFIX_FEATURES = [f"f_suffix{i}_{c}" for i in range(1, LEVELS + 1) for c in ("rate", "count")]


FOLDS = 5


def url_fold(url: Column) -> Column:
    """Fold of a url, 0 to 4; the trees never learn from the last."""
    return F.pmod(F.xxhash64(F.lit("fold"), url), F.lit(FOLDS))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a subdomain of it and starts the path; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, tail = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def lexical(df: DataFrame) -> DataFrame:
    """Adds the lexical features of ``url``, ``host`` and ``path`` (all but the suffix statistics)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    share = F.transform(F.array_distinct(F.split(url, "")), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size)
    entropy = F.aggregate(share, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    made = {
        "f_length": size, "f_host_length": F.length("host"), "f_path_length": F.length("path"), "f_depth": _count(F.col("path"), "/"),
        "f_labels": _count(F.col("host"), "."), "f_digits": _count(url, "0123456789") / size,
        "f_host_digits": _count(F.col("host"), "0123456789"), "f_entropy": F.when(F.length(url) > 0, entropy).otherwise(0.0),
        "f_params": F.when(query == "", 0).otherwise(_count(query, "&") + 1), "f_param_length": F.length(query),
        "f_marks": _count(url, "-_%~@"), "f_fragment": F.instr(url, "#") > 0,
    }
    return df.select("*", *(c.cast("double").alias(n) for n, c in made.items()))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], scratch: Scratch, max_rows: int = 20_000, trees: int = 12, depth: int = 4) -> DataFrame:
    """(page_id, url) -> page_id, host, path, rule, verdict, p_block; one row per input row.

    At most about ``max_rows`` rule-labelled urls outside the last fold, chosen by a hash of page_id and url, fit
    the trees; suffix statistics count all labelled rows (of the other folds, for a labelled url). Without both classes among the labelled urls the trees are
    left out: every other url then gets the labelled class (allow, if there is none). Null urls are
    judged by the features of an empty text. Other columns are not read.
    """
    df = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    df = df.withColumns({"host": host, "path": path})
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    df = scratch.save(lexical(df.withColumns({"rule": rule, "label": verdict})), "lexical")
    fold, blocked = url_fold(F.col("url")), F.col("label") == "block"
    per_fold = [c for i in range(FOLDS) for c in (F.count_if((fold == i) & F.col("label").isNotNull()).alias(f"n{i}"), F.count_if((fold == i) & blocked).alias(f"b{i}"))]
    others = lambda c: sum((F.when(F.col("label").isNotNull() & (fold == i), 0).otherwise(F.coalesce(f"{c}{i}", F.lit(0))) for i in range(FOLDS)), F.lit(0))
    for level in range(1, LEVELS + 1):
        columns, suffix = df.columns, F.substring_index("host", ".", -level).alias("suffix")
        stats = Names(df.groupBy(suffix).agg(F.count("*").alias("n"), *per_fold), scratch, f"suffixes-{level}")
        rate, count = (others("b") + 1) / (others("n") + 2), F.log1p(others("n").cast("double"))
        df = stats.join(df.withColumn("suffix", suffix), ["suffix"], "left").select(*columns, rate.alias(f"f_suffix{level}_rate"), count.alias(f"f_suffix{level}_count"))
    known = df.filter(F.col("label").isNotNull() & (fold < FOLDS - 1)).select("page_id", *FEATURES, *SUFFIX_FEATURES, "url", (F.col("label") == "block").cast("double").alias("y"))
    seen = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    vector = VectorAssembler(inputCols=FEATURES + SUFFIX_FEATURES, outputCol="features", handleInvalid="keep")
    if len(seen) == 2:
        share = min(1.0, max_rows / sum(seen.values()))
        part = known.filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
        part = scratch.save(vector.transform(part).select("features", "y").coalesce(4), "labelled")
        model = GBTClassifier(featuresCol="features", labelCol="y", maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=7, subsamplingRate=1.0).fit(part)
        df = model.transform(vector.transform(df)).withColumn("p_block", vector_to_array("probability")[1])
    else:
        df = df.withColumn("p_block", F.lit(1.0 if 1.0 in seen else 0.0))
    learned = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return df.select("page_id", "host", "path", "rule", F.coalesce("label", learned).alias("verdict"), "p_block")
