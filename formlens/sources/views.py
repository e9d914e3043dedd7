"""Typed tables of the product, derived from the driver's base tables with the same SQL in both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: name -> (base table, SQL). Text is valid in Spark SQL and DuckDB.
VIEWS: dict[str, tuple[str, str]] = {
    "signins": ("events", """
SELECT event_id, ts, '10.0.0.' || CAST(user_id % 40 AS STRING) AS ip,
  CASE CAST(user_id % 6 AS INT) WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36 Edg/120.0'
    WHEN 1 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15) Chrome/120.0 Safari/537.36'
    WHEN 2 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Version/17.0 Mobile Safari/604.1'
    WHEN 3 THEN 'Mozilla/5.0 (X11; Linux x86_64; rv:120.0) Gecko Firefox/120.0'
    WHEN 4 THEN 'Mozilla/5.0 (Linux; Android 14) Chrome/120.0 Mobile Safari/537.36' ELSE '' END AS ua,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 50 = 0 THEN 'admin' ELSE 'user' END AS result
FROM events"""),
    "assignments": ("events", """
SELECT event_id, 'job' || CAST(event_id AS STRING) AS job_id, ts, '10.0.0.' || CAST(user_id % 40 AS STRING) AS ip,
  CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'Typed text' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'Your handwriting' END AS style,
  CASE CAST(event_id % 10 AS INT) WHEN 0 THEN 'wrong answers' WHEN 1 THEN '   ' ELSE NULL END AS feedback
FROM events WHERE event_type IN ('view', 'click')"""),
    "ai_calls": ("events", """
SELECT event_id, ts, CAST(user_id AS STRING) AS user_key, user_id % 5 = 0 AS is_pro,
  CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'vision_fill' WHEN 1 THEN 'text_fill' WHEN 2 THEN 'detect' WHEN 3 THEN 'ocr' ELSE NULL END AS purpose,
  'm' || CAST(event_id % 4 AS STRING) AS model,
  CASE WHEN event_id % 5 = 0 THEN 'fallback' ELSE 'primary' END AS provider,
  CAST(floor(value * 10) AS BIGINT) AS prompt_tokens, CAST(floor(value * 3) AS BIGINT) AS output_tokens,
  event_type <> 'error' AS ok, CASE WHEN event_id % 20 = 0 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS latency_ms,
  CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'APIError: boom' ELSE 'Timeout: slow' END END AS error
FROM events"""),
    "payments": ("events", """
SELECT event_id, ts, lower(CASE WHEN event_id % 9 = 0 THEN 'Stranger@Example.com' ELSE 'User' || CAST(user_id AS STRING) || '@Example.com' END) AS email,
  CAST(floor(value * 100) AS BIGINT) AS amount_cents, CASE WHEN event_id % 6 = 0 THEN 'gbp' ELSE 'usd' END AS currency,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'evt_' || CAST(CAST(floor(event_id / 10) AS BIGINT) AS STRING) END AS stripe_event_id,
  event_id % 4 <> 0 AS livemode FROM events WHERE event_type = 'purchase'"""),
    "users": ("customer", """
SELECT c_custkey AS user_id, 'user' || CAST(c_custkey AS STRING) || '@example.com' AS email, c_name AS name,
  c_custkey % 5 = 0 AS is_pro, c_acctbal > 0 AS email_verified,
  CASE WHEN c_custkey % 3 = 0 THEN 'g' || CAST(c_custkey AS STRING) END AS google_sub,
  CAST(DATE '2024-01-01' + CAST(c_custkey % 30 AS INT) AS TIMESTAMP) AS created_at
FROM customer"""),
    "devices": ("events", """
SELECT event_id, ts, 'd' || CAST(user_id AS STRING) AS device_id, '10.0.0.' || CAST(user_id % 40 AS STRING) AS ip FROM events"""),
    "rate_card": ("", """
SELECT * FROM (VALUES ('m0', 1.0e0, 3.0e0, TIMESTAMP '2024-01-01 00:00:00'), ('m0', 2.0e0, 6.0e0, TIMESTAMP '2024-01-15 00:00:00'),
  ('m1', 0.5e0, 1.0e0, TIMESTAMP '2024-01-01 00:00:00'), ('m2', 4.0e0, 12.0e0, TIMESTAMP '2024-01-10 00:00:00')) AS t(model, rate_in, rate_out, effective_from)"""),
}

LINES = """
SELECT doc_id, CAST(floor(line_no / 20) AS INT) AS page, CAST(line_no AS INT) AS line_no, CAST(line_no % 20 AS INT) AS k,
  CASE WHEN doc_id % 5 = 0 AND line_no % 20 = 11 THEN left(text, 12)
       WHEN line_no % 20 BETWEEN 10 AND 13 THEN split_part(CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'A__B_C' WHEN 1 THEN 'a_b_c_d' WHEN 2 THEN 'I_II_III_IV' WHEN 3 THEN 'А_Β_C_d' ELSE 'A_B_C_D' END, '_', CAST(line_no % 20 - 9 AS INT))
         || CASE WHEN doc_id % 2 = 0 THEN '. ' ELSE ') ' END || left(text, 12)
       WHEN line_no % 20 = 15 THEN CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'A. one  B. two  C. three' WHEN 1 THEN 'i) one ii) two iii) three' ELSE 'a. one c. two b. three' END
       WHEN line_no % 8 = 0 THEN @RR@ WHEN line_no % 8 = 1 THEN '● ' || text WHEN line_no % 8 = 2 THEN '○'
       WHEN line_no % 8 = 3 THEN CAST(line_no AS STRING) || '. ' || text WHEN line_no % 8 = 4 THEN left(text, 20) || ' - ' ELSE text END AS text,
  CAST(72 + 18 * (line_no % 3) AS DOUBLE) AS x0, CAST(40 + 14 * (line_no % 20) + 30 * floor((line_no % 20) / 5) - CASE WHEN doc_id % 2 = 0 AND line_no % 20 BETWEEN 10 AND 14 THEN 20 ELSE 0 END AS DOUBLE) AS y0,
  CAST(300 AS DOUBLE) AS x1, CAST(51 + 14 * (line_no % 20) + 30 * floor((line_no % 20) / 5) - CASE WHEN doc_id % 2 = 0 AND line_no % 20 BETWEEN 10 AND 14 THEN 20 ELSE 0 END AS DOUBLE) AS y1 FROM raw_lines"""
RAW_SPARK = "SELECT doc_id, pos AS line_no, col AS text FROM (SELECT doc_id, posexplode(split(text, '\\n')) AS (pos, col) FROM {documents})"
RAW_DUCK = "SELECT doc_id, generate_subscripts(a, 1) - 1 AS line_no, unnest(a) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A product table by name; ``lines`` and ``raw_lines`` derive from documents, other names are base tables."""
    if name in ("lines", "raw_lines"):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
        raw = spark.sql(RAW_SPARK, documents=docs)
        return raw if name == "raw_lines" else spark.sql(LINES.replace("@RR@", "regexp_replace(text, '[a-z]{{7,}}', '____')").replace("FROM raw_lines", "FROM {raw_lines}"), raw_lines=raw)
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base, text = VIEWS[name]
    if not base:
        return spark.sql(text)
    return spark.sql(text.replace(f"FROM {base}", f"FROM {{{base}}}"), **{base: spark.read.parquet(f"{sf_dir}/{base}.parquet")})


def with_views(sql: str) -> str:
    """DuckDB SQL preceded by the definitions of the views that it names."""
    texts = {n: t for n, (_, t) in VIEWS.items()} | {"raw_lines": RAW_DUCK, "lines": LINES.replace("@RR@", "regexp_replace(text, '[a-z]{7,}', '____', 'g')")}
    named: list[str] = []

    def need(text: str) -> None:
        for n in texts:
            if n not in named and re.search(rf"\b(FROM|JOIN)\s+{n}\b", text, re.I):
                need(texts[n])
                named.append(n)

    need(sql)
    if not named:
        return sql
    ctes = ",\n".join(f"{n} AS ({texts[n]})" for n in named)
    body = sql.strip()
    return f"WITH RECURSIVE {ctes},\n{body[4:].lstrip()}" if body[:5].upper() == "WITH " else f"WITH {ctes}\n{body}"
