"""Ledger queries: dedupe, upserts, matching, entitlement, routing and account helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from formlens.functions import core as c
from formlens.operators import ledger as l
from formlens.plans.registry import AS_OF, query

FIRST = "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY ts, event_id) AS n FROM {t} WHERE {k} IS NOT NULL) WHERE n = 1"
query("payments_dedup", lambda p: l.first_per_key(p, "stripe_event_id", ["ts", "event_id"]), "payments", FIRST.format(k="stripe_event_id", t="payments") + " UNION ALL SELECT * FROM payments WHERE stripe_event_id IS NULL")
query("devices_first_touch", lambda d: l.first_per_key(d, "device_id", ["ts", "event_id"]), "devices", FIRST.format(k="device_id", t="devices"))
query("job_latest", lambda x: l.latest_per_key(x.withColumn("job", F.concat(F.lit("j"), (F.col("event_id") % 97).cast("string"))).select("job", "event_id", "ts", "ip"), "job", ["ts", "event_id"]), "assignments", "SELECT job, event_id, ts, ip FROM (SELECT 'j' || CAST(event_id % 97 AS VARCHAR) AS job, event_id, ts, ip, row_number() OVER (PARTITION BY event_id % 97 ORDER BY ts DESC, event_id DESC) AS n FROM assignments) WHERE n = 1")
query("assignments_upsert", lambda x: l.upsert_columns(x.withColumn("job", (F.col("event_id") % 97).cast("string")), "job", ["ts", "event_id"], ["style", "feedback", "ip"]), "assignments",
      "SELECT CAST(event_id % 97 AS VARCHAR) AS job, arg_max(style, (ts, event_id)) FILTER (WHERE style IS NOT NULL) AS style, arg_max(feedback, (ts, event_id)) FILTER (WHERE feedback IS NOT NULL) AS feedback, arg_max(ip, (ts, event_id)) FILTER (WHERE ip IS NOT NULL) AS ip FROM assignments GROUP BY event_id % 97")
query("payment_match", lambda p, u: l.payments_to_users(p, u).select("event_id", "email", "user_id"), "payments users", "SELECT event_id, p.email, user_id FROM payments p LEFT JOIN users u ON lower(u.email) = lower(p.email)")
query("payment_orphans", lambda p, u: l.unmatched_payments(p, u).select("event_id", "email"), "payments users", "SELECT event_id, email FROM payments p WHERE NOT EXISTS (SELECT 1 FROM users u WHERE lower(u.email) = lower(p.email))")
query("upsert_users", l.get_or_create, "users payments", "SELECT email, is_pro, email_verified, false AS created FROM users UNION ALL SELECT DISTINCT email, false, false, true FROM payments WHERE email NOT IN (SELECT email FROM users)")
GRANTS = lambda p: p.select("event_id", "ts", "email", F.when(F.col("event_id") % 5 == 0, "free").otherwise("pro").alias("state"))
STATES = "e AS (SELECT event_id, ts, email, CASE WHEN event_id % 5 = 0 THEN 'free' ELSE 'pro' END AS state FROM payments)"
query("entitlement_state", lambda p: l.entitlement_now(GRANTS(p)), "payments", f"WITH {STATES} SELECT email, arg_max(state, (ts, event_id)) AS state, count(*) AS events FROM e GROUP BY email")
query("entitlement_spans", lambda p: l.entitlement_spans(GRANTS(p)), "payments", f"WITH {STATES}, b AS (SELECT *, lag(state) OVER (PARTITION BY email ORDER BY ts, event_id) AS before FROM e), k AS (SELECT * FROM b WHERE before IS NULL OR before <> state) SELECT email, state, ts AS from_ts, lead(ts) OVER (PARTITION BY email ORDER BY ts, event_id) AS to_ts FROM k")
query("patch_users", lambda u, p: l.patch(u.select("email", "name", "google_sub"), l.upsert_columns(p.select("email", "ts", "event_id", F.nullif(F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("g_"), F.col("currency"))), F.lit("")).alias("google_sub")), "email", ["ts", "event_id"], ["google_sub"]), "email", ["google_sub"]), "users payments",
      "WITH x AS (SELECT email AS e, arg_max('g_' || currency, (ts, event_id)) FILTER (WHERE event_id % 2 <> 0) AS g FROM payments GROUP BY email) SELECT u.email, name, coalesce(g, google_sub) AS google_sub, e IS NOT NULL AS matched FROM users u LEFT JOIN x ON e = u.email")
KINDS = "CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'checkout.session.completed' WHEN 1 THEN 'customer.subscription.deleted' WHEN 2 THEN 'invoice.paid' END"
query("event_routing", lambda p: p.select("event_id", l.route(F.expr(KINDS)).alias("route")), "payments", "SELECT event_id, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'book' WHEN 1 THEN 'end' ELSE 'ignore' END AS route FROM payments")
query("stale_events", lambda p: p.select("event_id", l.fresh(F.col("ts"), F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 700 - 350).cast("decimal(18,6)"))).alias("accepted")), "payments", "SELECT event_id, abs(event_id % 700 - 350) <= 300 AS accepted FROM payments")
query("sub_ended", lambda p, u: p.filter("event_id % 4 = 1").join(u.select("email", "user_id"), "email", "left").select("event_id", "email", "user_id", F.col("user_id").isNotNull().alias("known")), "payments users", "SELECT event_id, p.email, user_id, user_id IS NOT NULL AS known FROM payments p LEFT JOIN users u ON u.email = p.email WHERE event_id % 4 = 1")
PAYLOAD = lambda: F.to_json(F.struct(F.coalesce("stripe_event_id", F.lit(" ")).alias("id"), F.expr(KINDS).alias("type"), "livemode", F.struct(F.struct(F.col("amount_cents").alias("amount_total"), F.upper("currency").alias("currency"), F.struct(F.when(F.col("event_id") % 3 == 0, F.lit(" ")).otherwise(F.upper("email")).alias("email")).alias("customer_details"), F.col("email").alias("customer_email")).alias("object")).alias("data")))
query("payments_parse", lambda p: l.parse_checkout(p.select(F.when(F.col("event_id") % 8 == 0, F.lit("{broken")).otherwise(PAYLOAD()).alias("payload"))), "payments", "SELECT stripe_event_id, lower(email) AS email, amount_cents, lower(currency) AS currency, livemode FROM payments WHERE event_id % 4 = 0 AND event_id % 8 <> 0")
query("role_counts", lambda u: u.groupBy(l.role(F.col("email"), ["USER1@example.com", "user7@example.com"]).alias("role")).agg(F.count("*").alias("n")), "users", "SELECT CASE WHEN lower(email) IN ('user1@example.com', 'user7@example.com') THEN 'admin' ELSE 'user' END AS role, count(*) AS n FROM users GROUP BY 1")
query("tier_counts", lambda u: u.groupBy((F.coalesce("is_pro", F.lit(False)) | (l.role(F.col("email"), ["user1@example.com"]) == "admin")).alias("pro")).agg(F.count("*").alias("n")), "users", "SELECT is_pro OR email = 'user1@example.com' AS pro, count(*) AS n FROM users GROUP BY 1")
query("account_lookup", lambda u: u.filter(F.lower("email") == F.lower(F.lit("User42@Example.com"))).select("user_id", "email", "name"), "users", "SELECT user_id, email, name FROM users WHERE lower(email) = 'user42@example.com'")
query("token_validity", lambda u: u.select("user_id", c.token_live(F.when(F.col("user_id") % 7 == 0, "soon").otherwise((F.col("created_at") + F.make_dt_interval(F.lit(1))).cast("string")), F.lit(AS_OF).cast("timestamp")).alias("valid")), "users", f"SELECT user_id, CASE WHEN user_id % 7 = 0 THEN true ELSE created_at + INTERVAL 1 DAY >= TIMESTAMP '{AS_OF}' END AS valid FROM users")
query("signup_check", lambda p, u: p.select("email").distinct().join(u.select("email"), "email", "left_anti").filter(F.col("email").contains("@") & F.substring_index("email", "@", -1).contains(".")), "payments users", "SELECT DISTINCT email FROM payments WHERE email NOT IN (SELECT email FROM users) AND contains(email, '@') AND contains(split_part(email, '@', -1), '.')")
query("retention_sweep", lambda x: l.retained(x, AS_OF), "assignments", f"SELECT job_id, max(ts) AS last_activity, max(ts) >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS kept FROM assignments GROUP BY job_id")
query("account_hash", lambda u: u.select("user_id", c.account_hash(F.col("email")).alias("h")), "users", "SELECT user_id, 'u' || left(sha256(email), 16) AS h FROM users")
query("user_keys", lambda u: u.select("user_id", F.coalesce(F.nullif(F.trim("google_sub"), F.lit("")), F.concat(F.lit("email:"), F.lower("email"))).alias("key")), "users", "SELECT user_id, coalesce(nullif(trim(google_sub), ''), 'email:' || lower(email)) AS key FROM users")
query("ts_labels", lambda p: p.select("event_id", F.coalesce(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")), F.lit("")).alias("label")), "payments", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' AS label FROM payments")
query("parse_timestamps", lambda p: p.select("event_id", c.parse_ts(F.when(F.col("event_id") % 3 == 0, F.lit("bad")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, F.lit("Z")).otherwise(F.lit("+02:00"))))).alias("t")), "payments", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN date_trunc('second', ts) - CASE WHEN event_id % 2 = 0 THEN INTERVAL 0 HOUR ELSE INTERVAL 2 HOUR END END AS t FROM payments")
RAN = lambda x: x.filter("event_id % 3 <> 0").select("job_id", F.array(F.lit("table"), F.concat(F.lit("extra"), (F.col("event_id") % 4).cast("string")), F.lit("inline_blanks")).alias("formats"))
query("report_detail", lambda x: l.reports_enriched(x, RAN(x)).withColumn("format_labels", F.array_join("format_labels", ", ")), "assignments", "SELECT job_id, ts, trim(feedback) AS feedback, coalesce(nullif(trim(style), ''), 'Typed text') AS style, CASE WHEN event_id % 3 <> 0 THEN 'Table / chart, extra' || CAST(event_id % 4 AS VARCHAR) || ', Fill-in-the-blank' END AS format_labels FROM assignments WHERE trim(coalesce(feedback, '')) <> ''")
query("valid_job_ids", lambda x: x.select("event_id", c.valid_job_id(F.expr("CASE CAST(event_id % 6 AS INT) WHEN 0 THEN job_id || '/x' WHEN 1 THEN '' WHEN 2 THEN repeat(job_id, 20) WHEN 3 THEN NULL WHEN 4 THEN job_id || '-_Z' ELSE job_id END")).alias("valid")), "assignments", "SELECT event_id, event_id % 6 >= 4 OR event_id % 6 = 2 AND length(job_id) * 20 <= 64 AS valid FROM assignments")
query("short_uas", lambda x: x.select("event_id", c.short_ua(F.when(F.col("event_id") % 9 != 0, F.repeat("ua", F.lit(4)))).alias("ua")), "signins", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '' ELSE left(repeat(ua, 4), 200) END AS ua FROM signins")
query("error_texts", lambda x: x.filter("error is not null").select("event_id", c.error_text(F.concat("error", F.repeat(F.lit(" again"), (F.col("event_id") % 60).cast("int")))).alias("text")), "ai_calls", "SELECT event_id, split_part(error, ':', 1) || ': ' || left(trim(substr(error || repeat(' again', CAST(event_id % 60 AS INT)), strpos(error, ':') + 1)), 200) AS text FROM ai_calls WHERE error IS NOT NULL")
query("report_snapshots", lambda x: x.filter(c.is_reported(F.col("feedback"))).join(x.filter("event_id % 20 = 0").select("job_id", F.lit(True).alias("hit")), "job_id", "left").select("job_id", F.coalesce("hit", F.lit(False)).alias("has_snapshot")), "assignments", "SELECT job_id, event_id % 20 = 0 AS has_snapshot FROM assignments WHERE trim(coalesce(feedback, '')) <> ''")
RAW = {"letter_spacing": "CASE WHEN user_id % 9 = 0 THEN 'x' ELSE CAST(user_id % 400 AS STRING) END", "font_size": "CASE WHEN user_id % 4 <> 0 THEN CAST(user_id % 60 AS STRING) END", "word_spacing": "CAST(-(user_id % 7) AS STRING)", "pen_thickness": "CAST(user_id % 30 AS STRING)"}
query("settings_clamp", lambda u: l.coerce_settings(u.select("user_id", *(F.expr(e).alias(k) for k, e in RAW.items()))), "users", """SELECT user_id, CASE WHEN user_id % 9 = 0 THEN 100.0 ELSE least(greatest(user_id % 400, 2.0), 300.0) END AS letter_spacing, CASE WHEN user_id % 4 = 0 THEN 100.0 ELSE greatest(user_id % 60, 2.0) END AS font_size,
2.0 AS word_spacing, least(greatest(user_id % 30, 0.1), 2.0) AS pen_thickness FROM users""")
