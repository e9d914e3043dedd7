"""Product analytics: heatmaps, dense series, money, reliability, accounts, clients and security."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens.functions.core import browser, device_kind, error_class, is_handwriting, is_reported, label_or, os_name, pct, shift
from formlens.operators.metering import if_small

DOW = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
NONE = "—"


def calendar(spark: SparkSession, as_of: str, days: int, tz: float = 0.0) -> DataFrame:
    """The last ``days`` dates, ending with as_of's date in the display zone."""
    last = F.to_date(shift(F.lit(as_of).cast("timestamp"), tz))
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))


def densify(daily: DataFrame, as_of: str, days: int, tz: float = 0.0, value: str = "n") -> DataFrame:
    """(day, value) -> a row for every date of the window, 0 where nothing happened."""
    zero = F.lit(0).cast(daily.schema[value].dataType)
    return calendar(daily.sparkSession, as_of, days, tz).join(daily, "day", "left").select("day", F.coalesce(value, zero).alias(value))


def daily_counts(df: DataFrame, as_of: str, days: int, tz: float = 0.0, ts: str = "ts") -> DataFrame:
    daily = df.filter(F.col(ts).isNotNull()).groupBy(F.to_date(shift(F.col(ts), tz)).alias("day")).agg(F.count("*").alias("n"))
    return densify(daily, as_of, days, tz)


def _slots(df: DataFrame, tz: float, ts: str = "ts") -> DataFrame:
    at = shift(F.col(ts), tz)
    return df.filter(F.col(ts).isNotNull()).select(F.weekday(at).alias("dow"), F.hour(at).alias("hour"))


def _grid(spark: SparkSession) -> DataFrame:
    return spark.range(168).select((F.col("id") / 24).cast("int").alias("dow"), (F.col("id") % 24).cast("int").alias("hour"))


def heatmap(df: DataFrame, tz: float = 0.0) -> DataFrame:
    """Dense 7 x 24 counts, Monday first."""
    found = _slots(df, tz).groupBy("dow", "hour").agg(F.count("*").alias("n"))
    return _grid(df.sparkSession).join(F.broadcast(found), ["dow", "hour"], "left").select("dow", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def heatmap_margins(df: DataFrame, tz: float = 0.0) -> DataFrame:
    """Counts by (dow, hour), dow, hour and in all; a null stands for all."""
    return _slots(df, tz).groupingSets([["dow", "hour"], ["dow"], ["hour"], []], "dow", "hour").agg(F.count("*").alias("n"))


def hour_counts(df: DataFrame, tz: float = 0.0) -> DataFrame:
    found = _slots(df, tz).groupBy("hour").agg(F.count("*").alias("n"))
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(F.broadcast(found), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def peaks(df: DataFrame, tz: float = 0.0) -> DataFrame:
    """Busiest hour and weekday; the first of equals, a dash if there is nothing."""
    cells = _slots(df, tz).groupBy("dow", "hour").agg(F.count("*").alias("n"))
    hour = cells.groupBy("hour").agg(F.sum("n").alias("n")).agg(F.max_by("hour", F.struct("n", -F.col("hour"))).alias("peak_hour"))
    dow = cells.groupBy("dow").agg(F.sum("n").alias("n")).agg(F.max_by("dow", F.struct("n", -F.col("dow"))).alias("d"))
    return hour.join(dow).select(
        "peak_hour",
        F.coalesce(F.concat(F.lpad(F.col("peak_hour").cast("string"), 2, "0"), F.lit(":00")), F.lit(NONE)).alias("peak_hour_label"),
        F.coalesce(F.when(F.col("d").isNotNull(), F.get(F.array(*map(F.lit, DOW)), F.col("d"))), F.lit(NONE)).alias("peak_dow_label"),
    )


def devices_daily(devices: DataFrame) -> DataFrame:
    return devices.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("devices"))


def devices_hourly(devices: DataFrame) -> DataFrame:
    """By weekday (0 is Sunday) and hour."""
    return devices.groupBy((F.dayofweek("ts") - 1).alias("dow"), F.hour("ts").alias("hour")).agg(F.count("*").alias("devices"))


def device_heatmap(hourly: DataFrame) -> DataFrame:
    """Sunday-first rows onto the Monday-first grid; hours outside the day are left out."""
    rows = hourly.filter(F.col("hour").between(0, 23)).groupBy(((F.col("dow") + 6) % 7).alias("dow"), "hour").agg(F.sum("devices").alias("n"))
    return _grid(hourly.sparkSession).join(F.broadcast(rows), ["dow", "hour"], "left").select("dow", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def devices_series(daily: DataFrame, as_of: str, days: int, order: str = "ord") -> DataFrame:
    """The last row of each day counts, not the sum."""
    last = daily.filter("day is not null").groupBy("day").agg(F.max_by("devices", order).alias("n"))
    return densify(last, as_of, days)


def live(payments: DataFrame) -> DataFrame:
    return payments.filter(F.coalesce("livemode", F.lit(False)))


def revenue_total(payments: DataFrame) -> DataFrame:
    total = live(payments).agg(F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("cents"), F.count("*").alias("payment_count"))
    usd = F.col("cents") / 100.0
    return total.select(F.col("cents").alias("revenue_cents"), usd.alias("revenue"), "payment_count", F.when(F.col("payment_count") > 0, F.bround(usd / F.col("payment_count"), 6)).otherwise(0.0).alias("arpu"))


def revenue_by_currency(payments: DataFrame) -> DataFrame:
    return live(payments).groupBy("currency").agg(F.sum("amount_cents").alias("revenue_cents"), F.count("*").alias("payment_count"))


def revenue_daily(payments: DataFrame, as_of: str, days: int, tz: float = 0.0) -> DataFrame:
    daily = live(payments).filter("ts is not null").groupBy(F.to_date(shift(F.col("ts"), tz)).alias("day")).agg(F.bround(F.sum("amount_cents") * 0.01, 6).alias("revenue"))
    return densify(daily, as_of, days, tz, "revenue")


def sum_cost(cost: Column) -> Column:
    """Sum of known costs in whole billionths, so the order of rows can't matter, rounded to millionths."""
    billionths = F.coalesce(F.sum(F.round(cost * 1e9).cast("bigint")), F.lit(0))
    return F.floor((billionths + 500) / 1000) / 1e6


def _tokens() -> list[Column]:
    return [F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("tokens_out")]


def cost_total(calls: DataFrame) -> DataFrame:
    """Unknown costs are counted, never averaged as nothing."""
    out = calls.agg(sum_cost(F.col("cost_usd")).alias("cost"), F.count_if(F.col("cost_usd").isNull()).alias("uncosted_calls"), *_tokens())
    return out.withColumn("tokens_total", F.col("tokens_in") + F.col("tokens_out"))


def cost_daily(calls: DataFrame, as_of: str, days: int, tz: float = 0.0) -> DataFrame:
    daily = calls.filter("ts is not null").groupBy(F.to_date(shift(F.col("ts"), tz)).alias("day")).agg(sum_cost(F.col("cost_usd")).alias("cost"))
    return densify(daily, as_of, days, tz, "cost")


def pnl(calls: DataFrame, payments: DataFrame) -> DataFrame:
    both = revenue_total(payments).select("revenue", "payment_count", "arpu").join(cost_total(calls))
    profit = F.bround(F.col("revenue") - F.col("cost"), 6)
    return both.select("revenue", "cost", profit.alias("profit"), F.when(F.col("revenue") != 0, pct(profit, F.col("revenue"))).otherwise(0.0).alias("margin_pct"), "payment_count", "arpu", "uncosted_calls", "tokens_total")


def spend_by(calls: DataFrame, column: str, default: str) -> DataFrame:
    """Calls, tokens and known cost of each purpose or model, most tokens first."""
    name = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default)).alias("name")
    both = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return calls.groupBy(name).agg(F.count("*").alias("calls"), F.sum(both).alias("tokens"), sum_cost(F.col("cost_usd")).alias("cost")).orderBy(F.desc("tokens"), "name")


def budget_draw(calls: DataFrame, rates: DataFrame, as_of: str, cap: float = 3.0) -> DataFrame:
    """Draw on the primary provider's allowance on as_of's UTC day, at list rates."""
    today = calls.filter((F.col("provider") == "primary") & (F.to_date("ts") == F.to_date(F.lit(as_of))))
    rows = today.join(if_small(rates.select("model", "rate_in", "rate_out")), "model", "left")
    cost = (F.coalesce("prompt_tokens", F.lit(0)) * F.col("rate_in") + F.coalesce("output_tokens", F.lit(0)) * F.col("rate_out")) / 1e6
    total = rows.agg(sum_cost(cost).alias("spent"), F.count_if(F.col("rate_in").isNull()).alias("uncosted_calls"))
    return total.select(F.lit(cap).alias("cap"), "spent", F.greatest(F.lit(0.0), F.bround(F.lit(cap) - F.col("spent"), 6)).alias("remaining"), pct(F.col("spent"), F.lit(cap)).alias("pct_used"), "uncosted_calls", (F.col("spent") >= cap).alias("exhausted"))


def reliability(calls: DataFrame) -> DataFrame:
    out = calls.agg(F.count("*").alias("total"), F.count_if(F.coalesce("ok", F.lit(False))).alias("ok"), F.count_if(F.col("provider") == "fallback").alias("fallback_calls"))
    return out.select("total", "ok", (F.col("total") - F.col("ok")).alias("failed"), pct(F.col("ok"), F.col("total")).alias("success_pct"), "fallback_calls", pct(F.col("fallback_calls"), F.col("total")).alias("fallback_pct"))


def _timed(calls: DataFrame) -> DataFrame:
    return calls.filter(F.coalesce("ok", F.lit(False)) & (F.coalesce("latency_ms", F.lit(0)) != 0))


def _rank(p: float) -> Column:
    return F.coalesce(F.expr(f"percentile_disc({p}) within group (order by latency_ms)").cast("bigint"), F.lit(0))


def latency(calls: DataFrame) -> DataFrame:
    """Nearest-rank percentiles of answered calls with a latency."""
    return _timed(calls).agg(_rank(0.5).alias("p50_ms"), _rank(0.95).alias("p95_ms"))


def latency_by_purpose(calls: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.col("purpose"), F.lit("")), F.lit("unknown")).alias("name")
    return _timed(calls).groupBy(name).agg(_rank(0.5).alias("p50"), _rank(0.95).alias("p95"), F.count("*").alias("calls")).orderBy(F.desc("calls"), "name")


def top_k(df: DataFrame, name: Column, k: int | None, ts: str = "ts") -> DataFrame:
    """Most frequent names; equals by first appearance, then by name."""
    out = df.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.min(ts).alias("_first")).orderBy(F.desc("n"), "_first", "name")
    return (out if k is None else out.limit(k)).select("name", "n")


def top_errors(calls: DataFrame, k: int = 6) -> DataFrame:
    failed = calls.filter(~F.coalesce("ok", F.lit(False)) & (F.coalesce("error", F.lit("")) != ""))
    return top_k(failed, error_class(F.col("error")), k)


def accounts(users: DataFrame, assignments: DataFrame, payments: DataFrame) -> DataFrame:
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    own = users.agg(F.count("*").alias("total"), yes("is_pro").alias("pro"), yes("email_verified").alias("verified"), F.count_if(F.coalesce("google_sub", F.lit("")) != "").alias("google"))
    one = own.join(assignments.agg(F.count("*").alias("fills"))).join(payments.agg(F.count("*").alias("paid")))
    total = F.col("total")
    return one.select(
        "total", "pro", (total - F.col("pro")).alias("free"), pct(F.col("pro"), total).alias("pro_pct"), "verified", pct(F.col("verified"), total).alias("verified_pct"),
        "google", (total - F.col("google")).alias("email"), "paid", pct(F.col("paid"), total).alias("paid_pct"),
        F.when(total > 0, F.bround(F.col("fills").cast("double") / total.cast("double"), 1)).otherwise(0.0).alias("fills_per_user"),
    )


def product(assignments: DataFrame) -> DataFrame:
    one = assignments.agg(F.count("*").alias("total"), F.count_if(is_reported(F.col("feedback"))).alias("reported"), F.count_if(is_handwriting(F.col("style"))).alias("handwriting"))
    return one.select("total", "reported", pct(F.col("reported"), F.col("total")).alias("report_pct"), "handwriting", pct(F.col("handwriting"), F.col("total")).alias("handwriting_pct"))


def top_styles(assignments: DataFrame, k: int = 8) -> DataFrame:
    return top_k(assignments, label_or(F.col("style"), "Typed text"), k)


def ip_usage(assignments: DataFrame) -> DataFrame:
    """Distinct addresses, and the share of fills from addresses with more than one."""
    ips = assignments.groupBy(F.coalesce(F.nullif(F.col("ip"), F.lit("")), F.lit("?")).alias("ip")).agg(F.count("*").alias("n"))
    one = ips.agg(F.count("*").alias("unique_ips"), F.coalesce(F.sum("n"), F.lit(0)).alias("fills"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeat"))
    return one.select("unique_ips", pct(F.col("repeat"), F.col("fills")).alias("repeat_pct"))


def clients(signins: DataFrame) -> DataFrame:
    """Counts by browser, system and kind in one pass: (facet, name, n)."""
    ua = F.col("ua")
    facet = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), c.alias("name")) for f, c in (("browser", browser(ua)), ("os", os_name(ua)), ("kind", device_kind(ua))))))
    return signins.select(facet.alias("x")).groupBy("x.facet", "x.name").agg(F.count("*").alias("n"))


def security(signins: DataFrame) -> DataFrame:
    of = lambda r: F.count_if(F.col("result") == r).alias(r)
    one = signins.agg(F.count("*").alias("total"), of("user"), of("admin"), of("failed"), F.count_distinct(F.coalesce(F.nullif(F.col("ip"), F.lit("")), F.lit("?"))).alias("unique_ips"))
    return one.select("total", "user", "admin", "failed", pct(F.col("failed"), F.col("total")).alias("fail_pct"), "unique_ips")


def top_failed_ips(signins: DataFrame, k: int = 6) -> DataFrame:
    return top_k(signins.filter("result = 'failed'"), F.coalesce(F.nullif(F.col("ip"), F.lit("")), F.lit("?")), k)


def long_form(section: str, one: DataFrame) -> DataFrame:
    """A one-row summary as (section, metric, value)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns)))
    return one.select(F.lit(section).alias("section"), pairs.alias("x")).select("section", "x.metric", "x.value")


def dashboard(signins: DataFrame, assignments: DataFrame, users: DataFrame, calls: DataFrame, payments: DataFrame) -> DataFrame:
    """All one-row sections as a long table."""
    parts = {"money": pnl(calls, payments), "reliability": reliability(calls), "latency": latency(calls), "accounts": accounts(users, assignments, payments), "product": product(assignments), "ips": ip_usage(assignments), "security": security(signins)}
    out = None
    for name, one in parts.items():
        rows = long_form(name, one)
        out = rows if out is None else out.unionByName(rows)
    return out


def dashboard_series(signins: DataFrame, assignments: DataFrame, users: DataFrame, calls: DataFrame, as_of: str, days: int) -> DataFrame:
    """The sections with several rows as a long table: section, metric (day, hour, "weekday hour" or name) and value."""
    day, name = F.col("day"), F.col("name")
    parts = {
        "fills_daily": (daily_counts(assignments, as_of, days), day), "signins_daily": (daily_counts(signins, as_of, days), day),
        "failed_daily": (daily_counts(signins.filter("result = 'failed'"), as_of, days), day), "signups_daily": (daily_counts(users, as_of, days, ts="created_at"), day),
        "usage_heatmap": (heatmap(assignments), F.concat_ws(" ", "dow", "hour")), "signin_hours": (hour_counts(signins), F.col("hour")),
        "top_errors": (top_errors(calls), name), "top_styles": (top_styles(assignments), name), "top_failed_ips": (top_failed_ips(signins), name),
    }
    out = None
    for section, (rows, metric) in parts.items():
        rows = rows.select(F.lit(section).alias("section"), metric.cast("string").alias("metric"), F.col("n").cast("double").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out
