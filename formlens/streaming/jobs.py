"""Structured Streaming jobs; each runs on any stream of the same columns and, with availableNow, over files."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from formlens.functions.core import shift
from formlens.operators.ledger import fresh
from formlens.operators.metering import metered, remaining
from formlens.sources.io import append_new, exists


def payments_once(payments: DataFrame, delay: str = "7 days") -> DataFrame:
    """One payment per event id within the watermark; payments without an id bypass the state."""
    ids = payments.filter("stripe_event_id is not null").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["stripe_event_id"])
    return ids.unionByName(payments.filter("stripe_event_id is null").withWatermark("ts", delay))


def payments_sink(payments: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Payments appended once each, however late they are redelivered: stored ids are left out per batch, and a batch that is run again replaces its rows."""
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    return payments.writeStream.foreachBatch(lambda df, batch: append_new(df, path, "stripe_event_id", run, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_totals(df: DataFrame, value: str, tz: float = 0.0, delay: str = "1 day") -> DataFrame:
    """Sum by local day. The shift comes first, so the watermark sits on the column that is grouped."""
    local = df.withColumn("local_ts", shift(F.col("ts"), tz)).withWatermark("local_ts", delay)
    return local.groupBy(F.window("local_ts", "1 day")).agg(F.sum(value).alias("total"), F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "total", "n")


def credit_state(calls: DataFrame, delay: str = "1 day", credits: int = 20) -> DataFrame:
    """Metered tokens per user and UTC day, and the credit they leave (0 at least)."""
    rows = metered(calls).withWatermark("ts", delay)
    sums = rows.groupBy("user_key", F.window("ts", "1 day")).agg(F.sum("tokens").alias("tokens"))
    return sums.select("user_key", F.to_date("window.start").alias("day"), "tokens", remaining(F.col("tokens"), credits).alias("remaining"))


def split_stale(events: DataFrame, seconds: int = 300) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected events by the gap of ``sent_at`` and ``received_at``."""
    ok = F.coalesce(fresh(F.col("sent_at"), F.col("received_at"), seconds), F.lit(False))
    return events.filter(ok), events.filter(~ok)


def first_touch(devices: DataFrame, delay: str | None = None) -> DataFrame:
    """Each device once: for ever without ``delay`` (the state then grows with the devices), else within it."""
    if delay is None:
        return devices.dropDuplicates(["device_id"])
    return devices.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["device_id"])


def devices_sink(devices: DataFrame, path: str, checkpoint: str, delay: str = "1 day", buckets: int = 64) -> StreamingQuery:
    """Each device stored once for ever with bounded state: repeats within ``delay`` end in the stream's state, later ones at the stored ids of their buckets."""
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    return first_touch(devices, delay).writeStream.foreachBatch(lambda df, batch: append_new(df, path, "device_id", run, batch, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_reliability(calls: DataFrame, delay: str = "2 hours") -> DataFrame:
    w = F.window("ts", "1 hour")
    agg = calls.withWatermark("ts", delay).groupBy(w).agg(F.count("*").alias("total"), F.count_if("ok").alias("ok"), F.count_if(F.col("provider") == "fallback").alias("fallback"), F.percentile_approx("latency_ms", 0.5).alias("p50_ms"))
    return agg.select(F.col("window.start").alias("hour"), "total", "ok", "fallback", "p50_ms")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete snapshot versions under a path, oldest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(root)] if store.exists(root) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and exists(spark, f"{path}/{n}/_SUCCESS"))


def entitlement_sink(events: DataFrame, path: str, checkpoint: str, kept: int = 2) -> StreamingQuery:
    """Latest state per account as one plain folder, for few accounts (``snapshots.entitlement_log`` writes what changed only): each batch merges into the newest complete version and writes the next one.

    Merging a batch twice changes nothing, so a batch that is run again is safe, and so is a new
    checkpoint over old versions. All but the last ``kept`` versions are deleted.
    """

    def merge(df: DataFrame, batch: int) -> None:
        spark, old = df.sparkSession, versions(df.sparkSession, path)
        rows = df.select("email", "state", "ts", "event_id")
        if old:
            rows = rows.unionByName(spark.read.parquet(f"{path}/v{old[-1]}"))
        newest = rows.groupBy("email").agg(F.max_by(F.struct("state", "ts", "event_id"), F.struct("ts", "event_id")).alias("r")).select("email", "r.*")
        newest.write.mode("overwrite").parquet(f"{path}/v{old[-1] + 1 if old else 0}")
        for v in old[: 1 - kept] if kept > 1 else old:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now into an in-memory table of that name."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """Stream of a Parquet folder; times without a zone count as UTC, as watermarks need a zone."""
    df = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})
