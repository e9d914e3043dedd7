"""Metering: call cost by rate card, as-of rates, credits and fallback pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BROADCAST_RATES = 1 << 16


def if_small(rates: DataFrame) -> DataFrame:
    """Rates marked for broadcast if there are few enough, which is counted."""
    return F.broadcast(rates) if rates.limit(BROADCAST_RATES + 1).count() <= BROADCAST_RATES else rates


def current_rates(history: DataFrame) -> DataFrame:
    """The latest rate of each model."""
    last = F.max_by(F.struct("rate_in", "rate_out"), "effective_from").alias("r")
    return history.groupBy("model").agg(last).select("model", "r.rate_in", "r.rate_out")


def _cost() -> Column:
    return (F.coalesce("prompt_tokens", F.lit(0)) * F.col("rate_in") + F.coalesce("output_tokens", F.lit(0)) * F.col("rate_out")) / 1e6


def cost_calls(calls: DataFrame, rates: DataFrame, primary_is_free: bool = False) -> DataFrame:
    """Calls with cost_usd; null where the model has no rate."""
    cost = F.bround(_cost(), 9)
    if primary_is_free:
        cost = F.when(F.col("provider") == "primary", 0.0).otherwise(cost)
    return calls.join(if_small(rates), "model", "left").withColumn("cost_usd", cost).drop("rate_in", "rate_out")


def cost_calls_asof(calls: DataFrame, history: DataFrame) -> DataFrame:
    """Cost at the rate in force when the call was made: an interval join on a small rate history, ``carried_rates`` beyond.

    Null where the model or the time is null or has no rate yet.
    """
    if history.limit(BROADCAST_RATES + 1).count() > BROADCAST_RATES:
        return carried_rates(calls, history).withColumn("cost_usd", F.bround(_cost(), 9)).drop("rate_in", "rate_out")
    until = F.lead("effective_from").over(Window.partitionBy("model").orderBy("effective_from"))
    spans = history.withColumn("until", until).withColumnRenamed("model", "m")
    on = (F.col("model") == F.col("m")) & (F.col("ts") >= F.col("effective_from")) & (F.col("until").isNull() | (F.col("ts") < F.col("until")))
    return calls.join(F.broadcast(spans), on, "left").withColumn("cost_usd", F.bround(_cost(), 9)).drop("m", "rate_in", "rate_out", "effective_from", "until")


def carried_rates(calls: DataFrame, history: DataFrame, slice: str = "hour") -> DataFrame:
    """Calls with the rate_in and rate_out last set before them, for a history of any size.

    Calls and rates are one sequence, cut into slices of time. The last rate of each slice is carried on to the
    later ones, a window over slices; within a slice a window over its rows finds nearer ones. So a
    model with a third of all calls spreads over its slices, and nothing meets on the model alone.
    """
    rate = F.struct("rate_in", "rate_out")
    cut = lambda df, ts: df.withColumn("_at", F.col(ts).cast("timestamp")).withColumn("_slice", F.date_trunc(slice, "_at"))
    rates = cut(history.filter("model is not null and effective_from is not null"), "effective_from")
    ends = rates.groupBy("model", "_slice").agg(F.max_by(rate, F.struct("_at", "rate_in", "rate_out")).alias("_last"))
    asked = cut(calls, "ts")
    slices = ends.unionByName(asked.select("model", "_slice").distinct(), allowMissingColumns=True).groupBy("model", "_slice").agg(F.first("_last", ignorenulls=True).alias("_last"))
    past = Window.partitionBy("model").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = slices.select("model", "_slice", F.last("_last", ignorenulls=True).over(past).alias("_before"))
    rows = asked.withColumn("_rate", F.lit(None).cast("struct<rate_in:double,rate_out:double>")).unionByName(rates.select("model", "_at", "_slice", rate.cast("struct<rate_in:double,rate_out:double>").alias("_rate"), F.lit(True).alias("_set")), allowMissingColumns=True)
    near = Window.partitionBy("model", "_slice").orderBy("_at", F.col("_set").desc_nulls_last(), "_rate").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_near", F.last("_rate", ignorenulls=True).over(near)).filter("_set is null")
    known = before.filter("_before is not null")
    out = rows.join(known, ["model", "_slice"], "left").withColumn("_near", F.coalesce("_near", "_before"))
    return out.select(*calls.columns, F.col("_near.rate_in").alias("rate_in"), F.col("_near.rate_out").alias("rate_out"))


def metered(calls: DataFrame) -> DataFrame:
    """Calls that draw credit: a user key, not Pro, some tokens."""
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return calls.withColumn("tokens", tokens).filter((F.trim(F.coalesce("user_key", F.lit(""))) != "") & ~F.coalesce("is_pro", F.lit(False)) & (F.col("tokens") > 0))


def remaining(tokens: Column, credits: int = 20, per_credit: int = 1000) -> Column:
    return F.greatest(F.lit(0.0), F.rint((F.lit(float(credits)) - tokens / float(per_credit)) * 100) / 100)


def credit_daily(calls: DataFrame) -> DataFrame:
    return metered(calls).groupBy("user_key", F.to_date("ts").alias("day")).agg(F.sum("tokens").alias("tokens"))


def credit_balance(calls: DataFrame, as_of: str, credits: int = 20) -> DataFrame:
    today = credit_daily(calls.filter(F.to_date("ts") == F.to_date(F.lit(as_of))))
    return today.select("user_key", "tokens", remaining(F.col("tokens"), credits).alias("remaining"))


def credit_ledger(calls: DataFrame, credits: int = 20) -> DataFrame:
    """Running tokens and credit left after each metered call of a user's UTC day."""
    w = Window.partitionBy("user_key", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    run = metered(calls).withColumn("running", F.sum("tokens").over(w))
    return run.select("event_id", "user_key", F.to_date("ts").alias("day"), "running", remaining(F.col("running"), credits).alias("remaining"), (F.col("running") > credits * 1000).alias("over"))


def fallback_pairs(calls: DataFrame) -> DataFrame:
    """A failed primary call followed at once by a fallback of the same job (of the same user, where no job is known) and purpose."""
    job = F.coalesce(F.concat(F.lit("job:"), F.col("job_id")), F.concat(F.lit("user:"), F.col("user_key")))
    w = Window.partitionBy(job, F.coalesce("purpose", F.lit("unknown"))).orderBy("ts", "event_id")
    rows = calls.withColumns({"next_provider": F.lead("provider").over(w), "next_id": F.lead("event_id").over(w), "next_ok": F.lead("ok").over(w)})
    return rows.filter((F.col("provider") == "primary") & ~F.coalesce("ok", F.lit(False)) & (F.col("next_provider") == "fallback")).select("event_id", "next_id", "user_key", "next_ok")


def usage_tokens(df: DataFrame) -> DataFrame:
    """prompt/input, completion/output and total with the usual fallbacks."""
    first = lambda *c: F.coalesce(*(F.nullif(F.col(x), F.lit(0)) for x in c), F.lit(0))
    p, o = first("prompt_tokens", "input_tokens"), first("completion_tokens", "output_tokens")
    return df.select("event_id", p.alias("p"), o.alias("o"), F.coalesce(F.nullif(F.col("total_tokens"), F.lit(0)), p + o).alias("total"))


def clean_rates(df: DataFrame) -> DataFrame:
    """Text rates: blank names, non-numbers, negatives and NaN go; null counts as 0."""
    num = lambda c: F.coalesce(F.col(c).try_cast("double"), F.when(F.col(c).isNull(), 0.0))
    out = df.select(F.trim("model").alias("model"), num("rate_in").alias("rate_in"), num("rate_out").alias("rate_out"))
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0)
    return out.filter((F.coalesce("model", F.lit("")) != "") & good("rate_in") & good("rate_out"))


def rate_card_from_json(df: DataFrame, column: str = "value") -> DataFrame:
    """{"models": {id: {"in": x, "out": y}}} -> model, rate_in, rate_out; broken text gives no rows."""
    parsed = F.from_json(F.col(column), "struct<models:map<string,struct<`in`:double,out:double>>>")
    return df.select(F.explode(parsed["models"]).alias("model", "r")).select("model", F.coalesce("r.in", F.lit(0.0)).alias("rate_in"), F.coalesce("r.out", F.lit(0.0)).alias("rate_out"))
