"""Mixing sources to target weights by iterative proportional fitting, native.

Documents fall into cells (source, language, topic). Token weights of the cells are raked to the three
marginals in turn; a document's probability is its cell's raked weight per token, scaled so that the
expected tokens meet the budget, at most 1. Only the cells are raked, and each is one row however many
documents it holds.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlens.llm.common import Scratch

DIMS = ("source", "lang", "topic")
UNKNOWN = "unknown"
BROADCAST_CELLS = 1 << 16
Target = float | Mapping[str, float]


def tokens(text: Column) -> Column:
    """Spaces and newlines plus one; null and empty texts have none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    gaps = F.length(text) - F.length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(gaps + 1).cast("long")


def topic(text: Column) -> Column:
    """Kind of content: the first that fits of licence, table, contact, marked, long, short."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    kind = F.when(text.contains("icense"), "licence").when(text.contains(" | "), "table").when(text.contains("@"), "contact")
    return kind.when(text.contains("!!") | text.contains("$$$"), "marked").when(F.length(text) >= 2000, "long").otherwise("short")


def _shares(cells: DataFrame, dim: str, target: Target) -> Column:
    """Target share of each cell's category in one dimension.

    A number tempers the categories' own tokens by that power; a mapping states shares, and categories
    it leaves out divide the rest by their tokens.
    """
    own = F.col(f"_{dim}")
    if isinstance(target, Mapping):
        if any(v < 0 for v in target.values()) or sum(target.values()) > 1 + 1e-9:
            raise ValueError(f"shares of {dim} must be 0 or more and 1 together at most")
        given = F.lit(None).cast("double")
        for name, share in target.items():
            given = F.when(F.col(dim) == name, F.lit(float(share))).otherwise(given)
        rest = cells.filter(~F.col(dim).isin(list(target))).agg(F.sum("t")).first()[0] or 1
        return F.coalesce(given, F.lit(max(0.0, 1 - sum(target.values()))) * own / F.lit(float(rest)))
    whole = cells.agg(F.sum(F.col("t") * F.pow(own, F.lit(float(target) - 1)))).first()[0] or 1.0
    return F.pow(own, F.lit(float(target))) / F.lit(float(whole))


def marginal_gap(cells: DataFrame) -> float:
    """Largest deviation of a raked marginal from its target, as a share of all tokens."""
    total, gap = cells.agg(F.sum("t")).first()[0] or 1, 0.0
    for dim in DIMS:
        off = cells.groupBy(dim).agg(F.abs(F.sum("w") - F.first(f"target_{dim}")).alias("off")).agg(F.max("off")).first()[0]
        gap = max(gap, float(off or 0) / float(total))
    return gap


def rake(cells: DataFrame, targets: Mapping[str, Target], scratch: Scratch, rounds: int = 10, tolerance: float | None = None, turns: int = 100) -> DataFrame:
    """(source, lang, topic, t) with t > 0 -> the same and w, raked to the target shares of all tokens.

    ``rounds`` rounds; with a ``tolerance`` as many times ``rounds`` as the marginals take to be that
    close to their targets, and an error if they aren't after ``turns`` times (targets that contradict each
    other). Up to ``BROADCAST_CELLS`` cells are raked in one task, more by shuffles.
    """
    for dim in DIMS:
        cells = cells.withColumn(f"_{dim}", F.sum("t").over(Window.partitionBy(dim)).cast("double"))
    cells = scratch.save(cells, "cells")
    count, total = cells.agg(F.count("*"), F.sum("t")).first()
    total, near = float(total or 0), (lambda df: df.coalesce(1)) if count <= BROADCAST_CELLS else (lambda df: df)
    cells = cells.select("*", F.col("t").cast("double").alias("w"), *((_shares(cells, d, targets[d]) * total).alias(f"target_{d}") for d in DIMS))
    for turn in range(turns):
        for i in range(rounds):
            cells = near(cells)
            for dim in DIMS:
                cells = cells.withColumn("w", F.col("w") * F.col(f"target_{dim}") / F.sum("w").over(Window.partitionBy(dim)))
            if i % 5 == 4 or i == rounds - 1:
                cells = scratch.save(cells, f"raked-{turn}-{i}")
        if tolerance is None or marginal_gap(cells) <= tolerance:
            return cells
    raise ValueError("the target shares contradict each other")


def _scale(cells: DataFrame, budget: float) -> float | None:
    """The c for which the sum of t * min(1, c * f) is the budget's share of all tokens; None if no c gives so much.

    Starts with no factor cut at 1 and cuts those above 1 / c until none is new; each step is one sum
    over the cells, and c only grows.
    """
    total = float(cells.agg(F.sum("t")).first()[0] or 0)
    cut, c = -1, 0.0
    while True:
        free = F.col("f") * F.lit(c) <= 1
        n, full, rest = cells.agg(F.count_if(~free), F.sum(F.when(~free, F.col("t"))), F.sum(F.when(free, F.col("w")))).first()
        if n == cut:
            return c
        left = budget * total - float(full or 0)
        if not rest or left < 0:
            return None
        cut, c = n, left / float(rest)


def mix_sources(docs: DataFrame, scratch: Scratch, targets: Mapping[str, Target] | None = None, budget: float = 0.5, rounds: int = 10, seed: int = 17, tolerance: float | None = None) -> DataFrame:
    """``docs`` with topic, tokens, p (probability to be sampled) and sampled (boolean).

    ``targets`` gives each of source, lang and topic a power or a mapping of shares (default: powers
    0.5, 0.7 and 0.7). ``budget`` is the share of all tokens to expect in the sample; if the shares
    asked for can't fill it because every probability is at most 1, all that they allow is taken. Null
    categories count as "unknown". Null and empty texts have no tokens: they take the probability of
    their cell, 0 if the whole cell has none. A document is sampled if a hash of the seed and its
    doc_id (null: the word null) is below p, so repeated ids share their fate. Existing columns named
    topic, tokens, p or sampled are replaced; others pass through.
    """
    targets = {"source": 0.5, "lang": 0.7, "topic": 0.7} | dict(targets or {})
    docs = docs.drop("topic", "tokens", "p", "sampled")
    rows = docs.withColumns({"topic": topic(F.col("text")), "tokens": tokens(F.col("text"))})
    cell = [F.coalesce(F.col(d).cast("string"), F.lit(UNKNOWN)) for d in ("source", "lang")] + [F.col("topic")]
    cells = rows.groupBy(*(c.alias(d) for c, d in zip(cell, DIMS, strict=True))).agg(F.sum("tokens").alias("t")).filter("t > 0")
    cells = rake(cells, targets, scratch, rounds, tolerance).withColumn("f", F.col("w") / F.col("t"))
    scale = _scale(cells, budget)
    p = F.least(F.lit(1.0), F.col("f") * F.lit(scale)) if scale is not None else F.when(F.col("f") > 0, 1.0).otherwise(0.0)
    chosen = scratch.save(cells.select(*(F.col(d).alias(f"_{d}") for d in DIMS), F.round(p, 9).alias("p")), "probabilities")
    few = chosen.count() <= BROADCAST_CELLS
    on = [c == F.col(f"_{d}") for c, d in zip(cell, DIMS, strict=True)]
    out = rows.join(F.broadcast(chosen) if few else chosen, on, "left").drop(*(f"_{d}" for d in DIMS))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    u = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return out.withColumn("p", F.coalesce("p", F.lit(0.0))).withColumn("sampled", u < F.col("p"))


def mixing_sql(budget: float = 0.5, rounds: int = 10, seed: int = 17) -> str:
    """DuckDB SQL of mix_sources with default targets."""
    power = {"source": 0.5, "lang": 0.7, "topic": 0.7}
    steps, last = [], "c1"
    for i in range(rounds):
        for dim in DIMS:
            steps.append(f"s{i}{dim} AS (SELECT * REPLACE (w * target_{dim} / sum(w) OVER (PARTITION BY {dim}) AS w) FROM {last})")
            last = f"s{i}{dim}"
    own = ", ".join(f"CAST(sum(t) OVER (PARTITION BY {d}) AS DOUBLE) AS own_{d}" for d in DIMS)
    target = ", ".join(f"pow(own_{d}, {power[d]}) / (SELECT sum(t * pow(own_{d}, {power[d] - 1:.12g})) FROM c0) * (SELECT sum(t) FROM c0) AS target_{d}" for d in DIMS)
    return f"""
WITH r AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, coalesce(text, '') AS x FROM documents),
d AS (SELECT doc_id, source, lang, CASE WHEN contains(x, 'icense') THEN 'licence' WHEN contains(x, ' | ') THEN 'table' WHEN contains(x, '@') THEN 'contact'
    WHEN contains(x, '!!') OR contains(x, '$$$') THEN 'marked' WHEN length(x) >= 2000 THEN 'long' ELSE 'short' END AS topic,
  CAST(CASE WHEN x = '' THEN 0 ELSE length(x) - length(replace(replace(x, ' ', ''), chr(10), '')) + 1 END AS BIGINT) AS tokens FROM r),
g AS (SELECT source, lang, topic, sum(tokens) AS t FROM d GROUP BY ALL HAVING sum(tokens) > 0),
c0 AS (SELECT *, {own} FROM g),
c1 AS (SELECT *, CAST(t AS DOUBLE) AS w, {target} FROM c0),
{", ".join(steps)},
f AS (SELECT *, w / t AS f FROM {last}),
k AS (SELECT f, ({budget} * (SELECT sum(t) FROM f) - coalesce(sum(t) OVER (ORDER BY f DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY f DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM f),
p AS (SELECT source, lang, topic, round(least(1.0, f * (SELECT max(c) FROM k WHERE c * f <= 1)), 9) AS p FROM f)
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, coalesce(p.p, 0.0) AS p,
  CAST(('0x' || substr(md5('{seed}:' || CAST(d.doc_id AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0 < coalesce(p.p, 0.0) AS sampled
FROM d LEFT JOIN p USING (source, lang, topic)
"""
