"""Analytics and metering queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from formlens.functions import core as c
from formlens.operators import analytics as a
from formlens.operators import sketches as k
from formlens.operators import metering as m
from formlens.plans.registry import AS_OF, DAYS, ORACLES, query

CAL = f"cal AS (SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(range(DATE '2024-01-30' - INTERVAL {DAYS - 1} DAY, DATE '2024-01-31', INTERVAL 1 DAY)) AS d))"
CAL_TZ = CAL.replace("2024-01-30", "2024-01-31").replace("DATE '2024-01-31', INTERVAL", "DATE '2024-02-01', INTERVAL")
GRID = "g AS (SELECT CAST(i // 24 AS INT) AS dow, CAST(i % 24 AS INT) AS hour FROM (SELECT unnest(range(168)) AS i))"


def PCT(p: str, w: str) -> str:
    return f"CASE WHEN coalesce({w}, 0) = 0 THEN 0.0 ELSE CAST(round_even(100.0 * CAST({p} AS DOUBLE) / CAST({w} AS DOUBLE), 1) AS DOUBLE) END"


def _heat(ts: str) -> str:
    return f"WITH {GRID}, n AS (SELECT isodow({ts}) - 1 AS dow, hour({ts}) AS hour, count(*) AS n FROM assignments GROUP BY ALL) SELECT g.dow, g.hour, coalesce(n.n, 0) AS n FROM g LEFT JOIN n ON n.dow = g.dow AND n.hour = g.hour"


query("usage_heatmap", a.heatmap, "assignments", _heat("ts"))
query("usage_heatmap_tz", lambda x: a.heatmap(x, 5.5), "assignments", _heat("(ts + INTERVAL 330 MINUTE)"))
query("heatmap_margins", a.heatmap_margins, "assignments", "SELECT CAST(isodow(ts) - 1 AS INT) AS dow, CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM assignments GROUP BY GROUPING SETS ((isodow(ts) - 1, hour(ts)), (isodow(ts) - 1), (hour(ts)), ())")
query("signin_hours", a.hour_counts, "signins", "WITH n AS (SELECT hour(ts) AS hour, count(*) AS n FROM signins GROUP BY ALL) SELECT CAST(h AS INT) AS hour, coalesce(n, 0) AS n FROM (SELECT unnest(range(24)) AS h) LEFT JOIN n ON n.hour = h")
query("usage_peaks", a.peaks, "assignments", """WITH h AS (SELECT CAST(hour(ts) AS INT) AS h, count(*) AS n FROM assignments GROUP BY ALL ORDER BY n DESC, h LIMIT 1),
d AS (SELECT isodow(ts) AS d, count(*) AS n FROM assignments GROUP BY ALL ORDER BY n DESC, d LIMIT 1)
SELECT h AS peak_hour, lpad(CAST(h AS VARCHAR), 2, '0') || ':00' AS peak_hour_label, (['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'])[d] AS peak_dow_label FROM h, d""")


def _daily(table: str, ts: str = "ts", where: str = "true", cal: str = CAL) -> str:
    return f"WITH {cal}, n AS (SELECT CAST({ts} AS DATE) AS day, count(*) AS n FROM {table} WHERE {where} GROUP BY ALL) SELECT cal.day, coalesce(n, 0) AS n FROM cal LEFT JOIN n ON n.day = cal.day"


query("fills_daily", lambda x: a.daily_counts(x, AS_OF, DAYS), "assignments", _daily("assignments"))
query("fills_daily_tz", lambda x: a.daily_counts(x, AS_OF, DAYS, 5.5), "assignments", _daily("assignments", "(ts + INTERVAL 330 MINUTE)", cal=CAL_TZ))
query("signins_daily", lambda x: a.daily_counts(x, AS_OF, DAYS), "signins", _daily("signins"))
query("failed_daily", lambda x: a.daily_counts(x.filter("result = 'failed'"), AS_OF, DAYS), "signins", _daily("signins", where="result = 'failed'"))
query("signups_daily", lambda x: a.daily_counts(x, AS_OF, DAYS, ts="created_at"), "users", _daily("users", "created_at"))
query("devices_daily", a.devices_daily, "devices", "SELECT CAST(ts AS DATE) AS day, count(*) AS devices FROM devices GROUP BY ALL")
query("devices_hourly", a.devices_hourly, "devices", "SELECT CAST(dayofweek(ts) AS INT) AS dow, CAST(hour(ts) AS INT) AS hour, count(*) AS devices FROM devices GROUP BY ALL")
query("device_heatmap", lambda x: a.device_heatmap(a.devices_hourly(x)), "devices", f"WITH {GRID}, n AS (SELECT isodow(ts) - 1 AS dow, hour(ts) AS hour, count(*) AS n FROM devices GROUP BY ALL) SELECT g.dow, g.hour, coalesce(n.n, 0) AS n FROM g LEFT JOIN n ON n.dow = g.dow AND n.hour = g.hour")
query("devices_series", lambda x: a.devices_series(x.groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("ord")).agg(F.count("*").alias("devices")), AS_OF, DAYS), "devices",
      f"WITH {CAL}, n AS (SELECT CAST(ts AS DATE) AS day, hour(ts) AS o, count(*) AS n FROM devices GROUP BY ALL), l AS (SELECT day, arg_max(n, o) AS n FROM n GROUP BY day) SELECT cal.day, coalesce(n, 0) AS n FROM cal LEFT JOIN l ON l.day = cal.day")
query("device_total", lambda x: x.agg(F.count(F.lit(1)).alias("n")), "devices", "SELECT count(*) AS n FROM devices")

REVENUE = "SELECT sum(amount_cents) AS revenue_cents, sum(amount_cents) / 100.0 AS revenue, count(*) AS payment_count, CAST(round_even(sum(amount_cents) / 100.0 / count(*), 6) AS DOUBLE) AS arpu FROM payments WHERE livemode"
query("revenue_total", a.revenue_total, "payments", REVENUE)
query("live_revenue", lambda x: a.live(x).select("event_id", "email", "amount_cents", "currency"), "payments", "SELECT event_id, email, amount_cents, currency FROM payments WHERE livemode")
query("revenue_by_currency", a.revenue_by_currency, "payments", "SELECT currency, sum(amount_cents) AS revenue_cents, count(*) AS payment_count FROM payments WHERE livemode GROUP BY currency")


def _money(tz: str, cal: str) -> str:
    return f"WITH {cal}, n AS (SELECT CAST({tz} AS DATE) AS day, CAST(round_even(sum(amount_cents) * 0.01, 6) AS DOUBLE) AS v FROM payments WHERE livemode GROUP BY ALL) SELECT cal.day, coalesce(v, 0.0) AS revenue FROM cal LEFT JOIN n ON n.day = cal.day"


query("revenue_daily", lambda x: a.revenue_daily(x, AS_OF, DAYS), "payments", _money("ts", CAL))
query("revenue_daily_tz", lambda x: a.revenue_daily(x, AS_OF, DAYS, 5.5), "payments", _money("(ts + INTERVAL 330 MINUTE)", CAL_TZ))

SUMCOST = "floor((coalesce(sum(CAST(round(cost_usd * 1e9) AS BIGINT)), 0) + 500) / 1000) / 1e6"
SPAN = "h AS (SELECT *, lead(effective_from) OVER (PARTITION BY model ORDER BY effective_from) AS until FROM rate_card)"
COSTED = f"{SPAN}, k AS (SELECT c.*, CAST(round_even((prompt_tokens * rate_in + output_tokens * rate_out) / 1e6, 9) AS DOUBLE) AS cost_usd FROM ai_calls c LEFT JOIN h ON h.model = c.model AND ts >= effective_from AND (until IS NULL OR ts < until))"
CURRENT = "r AS (SELECT model, arg_max(rate_in, effective_from) AS rate_in, arg_max(rate_out, effective_from) AS rate_out FROM rate_card GROUP BY model)"
asof = m.cost_calls_asof
query("call_cost", lambda x, r: m.cost_calls(x, m.current_rates(r)).select("event_id", "model", "cost_usd"), "ai_calls rate_card", f"WITH {CURRENT} SELECT event_id, c.model, CAST(round_even((prompt_tokens * rate_in + output_tokens * rate_out) / 1e6, 9) AS DOUBLE) AS cost_usd FROM ai_calls c LEFT JOIN r ON r.model = c.model")
query("call_cost_primary_free", lambda x, r: m.cost_calls(x, m.current_rates(r), True).select("event_id", "model", "cost_usd"), "ai_calls rate_card", f"WITH {CURRENT} SELECT event_id, c.model, CASE WHEN provider = 'primary' THEN 0.0 ELSE CAST(round_even((prompt_tokens * rate_in + output_tokens * rate_out) / 1e6, 9) AS DOUBLE) END AS cost_usd FROM ai_calls c LEFT JOIN r ON r.model = c.model")
query("call_cost_asof", lambda x, r: asof(x, r).select("event_id", "model", "cost_usd"), "ai_calls rate_card", f"WITH {COSTED} SELECT event_id, model, cost_usd FROM k")
query("cost_total", lambda x, r: a.cost_total(asof(x, r)), "ai_calls rate_card", f"WITH {COSTED} SELECT {SUMCOST} AS cost, count(*) FILTER (WHERE cost_usd IS NULL) AS uncosted_calls, sum(prompt_tokens) AS tokens_in, sum(output_tokens) AS tokens_out, sum(prompt_tokens) + sum(output_tokens) AS tokens_total FROM k")
query("cost_daily", lambda x, r: a.cost_daily(asof(x, r), AS_OF, DAYS), "ai_calls rate_card", f"WITH {CAL}, {COSTED}, n AS (SELECT CAST(ts AS DATE) AS day, {SUMCOST} AS v FROM k GROUP BY ALL) SELECT cal.day, coalesce(v, 0.0) AS cost FROM cal LEFT JOIN n ON n.day = cal.day")
PNL = f"{COSTED}, rv AS ({REVENUE}), co AS (SELECT {SUMCOST} AS cost, count(*) FILTER (WHERE cost_usd IS NULL) AS uncosted_calls, sum(prompt_tokens) + sum(output_tokens) AS tokens_total FROM k), pl AS (SELECT revenue, cost, CAST(round_even(revenue - cost, 6) AS DOUBLE) AS profit, payment_count, arpu, uncosted_calls, tokens_total FROM rv, co)"
query("pnl_summary", lambda x, r, p: a.pnl(asof(x, r), p), "ai_calls rate_card payments", f"WITH {PNL} SELECT revenue, cost, profit, {PCT('profit', 'revenue')} AS margin_pct, payment_count, arpu, uncosted_calls, tokens_total FROM pl")
for name, column, default in (("spend_by_purpose", "purpose", "unknown"), ("spend_by_model", "model", "—")):
    query(name, lambda x, r, column=column, default=default: a.spend_by(asof(x, r), column, default), "ai_calls rate_card", f"WITH {COSTED} SELECT coalesce(nullif({column}, ''), '{default}') AS name, count(*) AS calls, sum(prompt_tokens + output_tokens) AS tokens, {SUMCOST} AS cost FROM k GROUP BY 1")
query("budget_draw", lambda x, r: a.budget_draw(x, m.current_rates(r), AS_OF), "ai_calls rate_card", f"""WITH {CURRENT}, t AS (SELECT c.*, rate_in, rate_out FROM ai_calls c LEFT JOIN r ON r.model = c.model WHERE provider = 'primary' AND CAST(ts AS DATE) = DATE '2024-01-30'),
s AS (SELECT {SUMCOST.replace('cost_usd', '((prompt_tokens * rate_in + output_tokens * rate_out) / 1e6)')} AS spent, count(*) FILTER (WHERE rate_in IS NULL) AS uncosted_calls FROM t)
SELECT CAST(3.0 AS DOUBLE) AS cap, spent, greatest(0.0, CAST(round_even(3.0 - spent, 6) AS DOUBLE)) AS remaining, {PCT('spent', '3.0')} AS pct_used, uncosted_calls, spent >= 3.0 AS exhausted FROM s""")
RELIABLE = f"SELECT total, ok, total - ok AS failed, {PCT('ok', 'total')} AS success_pct, fallback_calls, {PCT('fallback_calls', 'total')} AS fallback_pct FROM (SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE provider = 'fallback') AS fallback_calls FROM ai_calls)"
LATENCY = "SELECT CAST(quantile_disc(latency_ms, 0.5) AS BIGINT) AS p50_ms, CAST(quantile_disc(latency_ms, 0.95) AS BIGINT) AS p95_ms FROM ai_calls WHERE ok AND latency_ms <> 0"
query("call_reliability", a.reliability, "ai_calls", RELIABLE)
query("latency_global", a.latency, "ai_calls", LATENCY)
query("latency_by_purpose", a.latency_by_purpose, "ai_calls", "SELECT coalesce(nullif(purpose, ''), 'unknown') AS name, CAST(quantile_disc(latency_ms, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(latency_ms, 0.95) AS BIGINT) AS p95, count(*) AS calls FROM ai_calls WHERE ok AND latency_ms <> 0 GROUP BY 1")


def _top(name: str, table: str, k: int | None, where: str = "true") -> str:
    return f"SELECT name, n FROM (SELECT {name} AS name, count(*) AS n, min(ts) AS f FROM {table} WHERE {where} GROUP BY 1 ORDER BY n DESC, f, name" + (f" LIMIT {k})" if k else ")")


query("top_errors", a.top_errors, "ai_calls", _top("split_part(error, ':', 1)", "ai_calls", 6, "NOT ok AND error <> ''"))
query("top_styles", a.top_styles, "assignments", _top("coalesce(nullif(trim(style), ''), 'Typed text')", "assignments", 8))
query("top_ips", lambda x: a.top_k(x, F.coalesce("ip", F.lit("?")), 8), "assignments", _top("coalesce(ip, '?')", "assignments", 8))
query("top_failed_ips", a.top_failed_ips, "signins", _top("ip", "signins", 6, "result = 'failed'"))
ACCOUNTS = f"""SELECT total, pro, total - pro AS free, {PCT('pro', 'total')} AS pro_pct, verified, {PCT('verified', 'total')} AS verified_pct, google, total - google AS email, paid, {PCT('paid', 'total')} AS paid_pct,
  CAST(round_even(CAST(fills AS DOUBLE) / total, 1) AS DOUBLE) AS fills_per_user
FROM (SELECT count(*) AS total, count(*) FILTER (WHERE is_pro) AS pro, count(*) FILTER (WHERE email_verified) AS verified, count(google_sub) AS google FROM users),
  (SELECT count(*) AS fills FROM assignments), (SELECT count(*) AS paid FROM payments)"""
HAND = "lower(trim(coalesce(style, ''))) NOT IN ('', 'typed text', 'none', 'typed')"
PRODUCT = f"SELECT total, reported, {PCT('reported', 'total')} AS report_pct, handwriting, {PCT('handwriting', 'total')} AS handwriting_pct FROM (SELECT count(*) AS total, count(*) FILTER (WHERE trim(coalesce(feedback, '')) <> '') AS reported, count(*) FILTER (WHERE {HAND}) AS handwriting FROM assignments)"
IPS = f"SELECT unique_ips, {PCT('rep', 'fills')} AS repeat_pct FROM (SELECT count(*) AS unique_ips, sum(n) AS fills, coalesce(sum(n) FILTER (WHERE n > 1), 0) AS rep FROM (SELECT ip, count(*) AS n FROM assignments GROUP BY ip))"
SECURE = f"SELECT total, \"user\", admin, failed, {PCT('failed', 'total')} AS fail_pct, unique_ips FROM (SELECT count(*) AS total, count(*) FILTER (WHERE result = 'user') AS \"user\", count(*) FILTER (WHERE result = 'admin') AS admin, count(*) FILTER (WHERE result = 'failed') AS failed, count(DISTINCT ip) AS unique_ips FROM signins)"
query("account_funnel", a.accounts, "users assignments payments", ACCOUNTS)
query("product_summary", a.product, "assignments", PRODUCT)
query("ip_usage", a.ip_usage, "assignments", IPS)
query("signin_security", a.security, "signins", SECURE)
U = "lower(coalesce(ua, ''))"
BROWSER = f"CASE WHEN contains({U}, 'edg/') THEN 'Edge' WHEN contains({U}, 'chrome') AND NOT contains({U}, 'chromium') THEN 'Chrome' WHEN contains({U}, 'safari') AND NOT contains({U}, 'chrome') THEN 'Safari' WHEN contains({U}, 'firefox') THEN 'Firefox' ELSE 'Other' END"
OS = f"CASE WHEN contains({U}, 'iphone') OR contains({U}, 'ipad') THEN 'iOS' WHEN contains({U}, 'android') THEN 'Android' WHEN contains({U}, 'mac os') OR contains({U}, 'macintosh') THEN 'macOS' WHEN contains({U}, 'windows') THEN 'Windows' WHEN contains({U}, 'linux') THEN 'Linux' ELSE 'Other' END"
KIND = f"CASE WHEN contains({U}, 'mobile') OR contains({U}, 'iphone') OR contains({U}, 'android') THEN 'Mobile' ELSE 'Desktop' END"
for name, f, sql in (("client_browsers", c.browser, BROWSER), ("client_os", c.os_name, OS), ("client_kinds", c.device_kind, KIND)):
    query(name, lambda x, f=f: a.top_k(x, f(F.col("ua")), None), "signins", f"SELECT {sql} AS name, count(*) AS n FROM signins GROUP BY 1")
query("client_mix", a.clients, "signins", f"SELECT 'browser' AS facet, {BROWSER} AS name, count(*) AS n FROM signins GROUP BY 2 UNION ALL SELECT 'os', {OS}, count(*) FROM signins GROUP BY 2 UNION ALL SELECT 'kind', {KIND}, count(*) FROM signins GROUP BY 2")
SECTIONS = {"money": (f"SELECT revenue, cost, profit, {PCT('profit', 'revenue')} AS margin_pct, payment_count, arpu, uncosted_calls, tokens_total FROM pl"), "reliability": RELIABLE, "latency": LATENCY, "accounts": ACCOUNTS, "product": PRODUCT, "ips": IPS, "security": SECURE}
query("dashboard_kpis", lambda s, f, u, x, r, p: a.dashboard(s, f, u, asof(x, r), p), "signins assignments users ai_calls rate_card payments",
      f"WITH {PNL}, " + ", ".join(f"x_{n} AS ({s})" for n, s in SECTIONS.items()) + " " + " UNION ALL ".join(f"SELECT '{n}' AS section, metric, value FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM x_{n}) ON COLUMNS(*) INTO NAME metric VALUE value)" for n in SECTIONS))
SERIES = {"fills_daily": "day", "signins_daily": "day", "failed_daily": "day", "signups_daily": "day", "usage_heatmap": "concat_ws(' ', dow, hour)", "signin_hours": "hour", "top_errors": "name", "top_styles": "name", "top_failed_ips": "name"}
query("dashboard_series", lambda s, f, u, x: a.dashboard_series(s, f, u, x, AS_OF, DAYS), "signins assignments users ai_calls", " UNION ALL ".join(f"SELECT '{n}' AS section, CAST({by} AS VARCHAR) AS metric, CAST(n AS DOUBLE) AS value FROM ({ORACLES[n]})" for n, by in SERIES.items()))
query("admin_counts", lambda s, f: s.agg(*(F.count_if(F.col("result") == r).alias(r) for r in ("user", "admin", "failed"))).join(f.agg(F.count_if(c.is_reported(F.col("feedback"))).alias("reports"))), "signins assignments", "SELECT * FROM (SELECT count(*) FILTER (WHERE result = 'user') AS \"user\", count(*) FILTER (WHERE result = 'admin') AS admin, count(*) FILTER (WHERE result = 'failed') AS failed FROM signins), (SELECT count(*) FILTER (WHERE trim(coalesce(feedback, '')) <> '') AS reports FROM assignments)")
query("style_split", lambda x: x.groupBy(c.is_handwriting(F.col("style")).alias("handwriting")).agg(F.count("*").alias("n")), "assignments", f"SELECT {HAND} AS handwriting, count(*) AS n FROM assignments GROUP BY 1")
query("report_rate", lambda x: x.agg(F.count_if(c.is_reported(F.col("feedback"))).alias("reported"), F.count("*").alias("total")), "assignments", "SELECT count(*) FILTER (WHERE trim(coalesce(feedback, '')) <> '') AS reported, count(*) AS total FROM assignments")
query("style_labels", lambda x: x.select("job_id", F.when(F.col("style").isNull(), "Typed text").when(F.col("style").startswith("font:"), "Your handwriting").otherwise(F.col("style")).alias("label")), "assignments", "SELECT job_id, CASE WHEN style IS NULL THEN 'Typed text' WHEN starts_with(style, 'font:') THEN 'Your handwriting' ELSE style END AS label FROM assignments")

METERED = "t AS (SELECT *, prompt_tokens + output_tokens AS tokens FROM ai_calls WHERE user_key <> '' AND NOT is_pro AND prompt_tokens + output_tokens > 0)"
LEFT = "greatest(0.0, CAST(round_even(20.0 - {} / 1000.0, 2) AS DOUBLE))"
query("credit_daily", m.credit_daily, "ai_calls", f"WITH {METERED} SELECT user_key, CAST(ts AS DATE) AS day, sum(tokens) AS tokens FROM t GROUP BY ALL")
query("credit_balance", lambda x: m.credit_balance(x, AS_OF), "ai_calls", f"WITH {METERED} SELECT user_key, sum(tokens) AS tokens, {LEFT.format('sum(tokens)')} AS remaining FROM t WHERE CAST(ts AS DATE) = DATE '2024-01-30' GROUP BY user_key")
query("credit_ledger", m.credit_ledger, "ai_calls", f"WITH {METERED}, r AS (SELECT event_id, user_key, CAST(ts AS DATE) AS day, sum(tokens) OVER (PARTITION BY user_key, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM t) SELECT *, {LEFT.format('running')} AS remaining, running > 20000 AS over FROM r")
query("fallback_pairs", lambda x: m.fallback_pairs(x.withColumn("job_id", F.when(F.col("is_pro"), F.concat(F.lit("j"), (F.col("event_id") % 50).cast("string"))))), "ai_calls", "SELECT event_id, next_id, user_key, next_ok FROM (SELECT *, lead(provider) OVER w AS np, lead(event_id) OVER w AS next_id, lead(ok) OVER w AS next_ok FROM ai_calls WINDOW w AS (PARTITION BY is_pro, CASE WHEN is_pro THEN 'j' || CAST(event_id % 50 AS VARCHAR) ELSE user_key END, coalesce(purpose, 'unknown') ORDER BY ts, event_id)) WHERE provider = 'primary' AND NOT ok AND np = 'fallback'")
query("usage_tokens", lambda x: m.usage_tokens(x.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("prompt_tokens")).alias("prompt_tokens"), F.col("prompt_tokens").alias("input_tokens"), F.lit(None).cast("bigint").alias("completion_tokens"), "output_tokens", F.when(F.col("event_id") % 2 == 0, F.lit(0)).otherwise(F.col("prompt_tokens") * 2).alias("total_tokens"))), "ai_calls",
      "SELECT event_id, prompt_tokens AS p, output_tokens AS o, coalesce(CASE WHEN event_id % 2 = 0 THEN NULL ELSE nullif(prompt_tokens * 2, 0) END, prompt_tokens + output_tokens) AS total FROM ai_calls")
query("oldest_signins", lambda x: x.orderBy("ts", "event_id").limit(500).withColumn("place", F.row_number().over(Window.orderBy("ts", "event_id"))).select("place", "event_id", "ts", "ip"), "signins", "SELECT CAST(row_number() OVER (ORDER BY ts, event_id) AS INT) AS place, event_id, ts, ip FROM signins ORDER BY ts, event_id LIMIT 500")
query("newest_calls", lambda x: x.orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "ts", "model", "provider"), "ai_calls", "SELECT event_id, ts, model, provider FROM ai_calls ORDER BY ts DESC, event_id DESC LIMIT 500")
query("known_models", lambda x, r: r.select("model").union(x.select(F.coalesce("model", F.lit("—")))).distinct().filter("model <> '—'"), "ai_calls rate_card", "SELECT model FROM rate_card UNION SELECT model FROM ai_calls WHERE model IS NOT NULL")
for name, table, columns in (("scan_signins", "signins", "ts ip ua result"), ("scan_assignments", "assignments", "job_id ts ip style feedback"), ("scan_payments", "payments", "ts email amount_cents currency stripe_event_id livemode"), ("scan_users", "users", "email name is_pro email_verified created_at")):
    query(name, lambda x, columns=columns: x.select(*columns.split()), table, f"SELECT {', '.join(columns.split())} FROM {table}")
query("model_routing", lambda x: x.select("event_id", F.when(F.coalesce("is_pro", F.lit(False)), F.coalesce("model", F.lit("base"))).otherwise("base").alias("model")), "ai_calls", "SELECT event_id, CASE WHEN is_pro THEN coalesce(model, 'base') ELSE 'base' END AS model FROM ai_calls")
query("hourly_reliability", lambda x: x.groupBy(F.window("ts", "1 hour").start.alias("hour")).agg(F.count("*").alias("total"), F.count_if("ok").alias("ok"), F.count_if(F.col("provider") == "fallback").alias("fallback")), "ai_calls", "SELECT date_trunc('hour', ts) AS hour, count(*) AS total, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE provider = 'fallback') AS fallback FROM ai_calls GROUP BY 1")
query("latency_narrowed", lambda c: k.exact_percentiles(c.filter("coalesce(ok, false) and coalesce(latency_ms, 0) <> 0"), "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95}), "ai_calls", LATENCY)
# How far the merged sketches are off: the rank of each percentile, and the count, against the exact ones.
ranked = lambda c: c.filter("coalesce(ok, false) and coalesce(latency_ms, 0) <> 0 and ts is not null").crossJoin(k.merged_latency(k.daily_latency(c)).withColumnRenamed("calls", "seen")).agg(F.count("*").alias("calls"), F.max("seen").alias("seen"), *((F.abs(F.avg((F.col("latency_ms") <= F.col(p)).cast("double")) - s) <= k.RANK_ERROR).alias(f"{p}_near") for p, s in (("p50", 0.5), ("p95", 0.95))))
query("latency_sketches", ranked, "ai_calls", "SELECT count(*) AS calls, count(*) AS seen, true AS p50_near, true AS p95_near FROM ai_calls WHERE ok AND latency_ms <> 0")
query("ip_sketches", lambda x: x.filter("ts is not null").agg(F.count_distinct("ip").alias("exact")).crossJoin(k.merged_distinct(k.daily_distinct(x, "ip"))).select("exact", (F.abs(F.col("n") - F.col("exact")) <= F.ceil(F.col("exact") * k.COUNT_ERROR)).alias("near")), "assignments", "SELECT count(DISTINCT ip) AS exact, true AS near FROM assignments WHERE ts IS NOT NULL")
