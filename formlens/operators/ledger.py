"""Event ledger: idempotent ingest, upserts, patches, entitlement, matching and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlens.functions.core import clamp, format_label, is_reported, label_or


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Insert ignoring duplicates: the first row of each key; rows whose key is null all stay."""
    w = Window.partitionBy(key).orderBy(*order)
    first = df.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return first.unionByName(df.filter(F.col(key).isNull()))


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest version of each key: one aggregate, no sort."""
    last = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return last.select("r.*")


def upsert_columns(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Per column the last value that was given: an absent column keeps what was there."""
    given = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c)
    return df.groupBy(key).agg(*map(given, columns))


def patch(base: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Apply the last given non-blank value of each column by key; ``matched`` tells whether a patch existed."""
    new = patches.select(F.col(key).alias("_k"), F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = base.join(new, F.col(key) == F.col("_k"), "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns), F.coalesce("_hit", F.lit(False)).alias("matched"))


def payments_to_users(payments: DataFrame, users: DataFrame) -> DataFrame:
    """Every payment with its account, matched on the lower-case address; unmatched ones stay."""
    own = users.select(F.lower("email").alias("_e"), "user_id")
    return payments.join(own, F.lower("email") == F.col("_e"), "left").drop("_e")


def unmatched_payments(payments: DataFrame, users: DataFrame) -> DataFrame:
    return payments.join(users.select(F.lower("email").alias("_e")), F.lower("email") == F.col("_e"), "left_anti")


def get_or_create(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Existing accounts, and one with defaults for each unknown address: email, is_pro, email_verified, created."""
    kept = users.select("email", "is_pro", "email_verified", F.lit(False).alias("created"))
    new = logins.select("email").distinct().join(users.select("email"), "email", "left_anti")
    return kept.unionByName(new.select("email", F.lit(False).alias("is_pro"), F.lit(False).alias("email_verified"), F.lit(True).alias("created")))


def entitlement_spans(events: DataFrame) -> DataFrame:
    """Grant and revoke events -> state spans by account: email, state, from_ts, to_ts."""
    w = Window.partitionBy("email").orderBy("ts", "event_id")
    changed = events.withColumn("_before", F.lag("state").over(w)).filter("_before is null or _before <> state")
    return changed.select("email", "state", F.col("ts").alias("from_ts"), F.lead("ts").over(w).alias("to_ts"))


def entitlement_now(events: DataFrame) -> DataFrame:
    return events.groupBy("email").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("events"))


def route(kind: Column) -> Column:
    return F.when(kind == "checkout.session.completed", "book").when(kind == "customer.subscription.deleted", "end").otherwise("ignore")


def fresh(sent: Column, received: Column, seconds: int = 300) -> Column:
    return F.abs(F.unix_timestamp(received) - F.unix_timestamp(sent)) <= seconds


def parse_checkout(df: DataFrame, column: str = "payload") -> DataFrame:
    """Checkout events as payment rows; other types and broken text are left out."""
    schema = "struct<id:string,type:string,livemode:boolean,data:struct<object:struct<amount_total:bigint,currency:string,customer_email:string,customer_details:struct<email:string>>>>"
    e = df.select(F.from_json(F.col(column), schema).alias("e")).filter("e.type = 'checkout.session.completed'").select("e.*")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    email = F.coalesce(blank(F.col("data.object.customer_details.email")), blank(F.col("data.object.customer_email")))
    return e.select(blank(F.col("id")).alias("stripe_event_id"), F.lower(email).alias("email"), F.coalesce("data.object.amount_total", F.lit(0)).alias("amount_cents"), F.lower(F.coalesce(blank(F.col("data.object.currency")), F.lit("usd"))).alias("currency"), F.coalesce("livemode", F.lit(False)).alias("livemode"))


#: Handwriting settings with their range and default.
SETTINGS = {"letter_spacing": (2.0, 300.0, 100.0), "font_size": (2.0, 300.0, 100.0), "word_spacing": (2.0, 300.0, 100.0), "pen_thickness": (0.1, 2.0, 0.4)}


def coerce_settings(df: DataFrame) -> DataFrame:
    """Texts of the settings as numbers within their ranges; the default where one is missing or no number."""
    return df.withColumns({k: clamp(F.col(k).try_cast("double"), low, high, default) for k, (low, high, default) in SETTINGS.items()})


def reports_enriched(assignments: DataFrame, settings: DataFrame) -> DataFrame:
    """Reported jobs with the settings (job_id, formats) they ran with, formats by their labels; null where none are stored."""
    told = assignments.filter(is_reported(F.col("feedback"))).select("job_id", "ts", F.trim("feedback").alias("feedback"), label_or(F.col("style"), "Typed text").alias("style"))
    return told.join(settings.select("job_id", F.transform("formats", format_label).alias("format_labels")), "job_id", "left")


def role(email: Column, admins: list[str]) -> Column:
    return F.when(F.lower(F.trim(F.coalesce(email, F.lit("")))).isin([a.lower() for a in admins]), "admin").otherwise("user")


def retained(df: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Last activity of each job, and whether it is kept."""
    last = df.groupBy("job_id").agg(F.max("ts").alias("last_activity"))
    return last.withColumn("kept", F.col("last_activity") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))
