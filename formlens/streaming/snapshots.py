"""Account states as a log of changes in buckets, under versioned manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _store(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def manifests(spark: SparkSession, path: str) -> list[int]:
    """Versions that are complete, oldest first: those whose manifest has its final name."""
    root, store = _store(spark, f"{path}/manifests")
    names = [f.getPath().getName() for f in store.listStatus(root)] if store.exists(root) else []
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    """One manifest: the number of buckets, and for each bucket the versions that wrote to it, oldest first."""
    return json.loads(spark.read.text(f"{path}/manifests/v{version}.json", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    """A manifest appears whole or not at all: it is written beside its place and then renamed."""
    half, store = _store(spark, f"{path}/manifests/.v{version}.half")
    out = store.create(half, True)
    out.write(bytearray(json.dumps(manifest), "utf-8"))
    out.close()
    if not store.rename(half, _store(spark, f"{path}/manifests/v{version}.json")[0]):
        raise OSError(f"version {version} of {path} was published by another writer")


def _newest(rows: DataFrame) -> DataFrame:
    latest = F.max_by(F.struct("state", "ts", "event_id"), F.struct("ts", "event_id", "state"))
    return rows.groupBy("bucket", "email").agg(latest.alias("r")).select("bucket", "email", "r.*")


def _read(spark: SparkSession, path: str, held: dict[str, list[int]], schema: str) -> DataFrame:
    files = [f"{path}/data/v={v}/bucket={b}" for b, versions in held.items() for v in versions]
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*files).drop("v") if files else spark.createDataFrame([], schema)


def merge_states(df: DataFrame, path: str, buckets: int = 64, deltas: int = 8, kept: int = 2) -> None:
    """Add a batch of states (email, state, ts, event_id) to the log under a path.

    A batch writes its own accounts, in folders by account hash; a bucket to which ``deltas`` versions wrote is
    read and written anew with it, and no other. So bytes written grow with the batch. A version counts once its
    manifest is published; a batch that fails before that leaves files that its next run overwrites, and merging a batch twice
    changes nothing. Versions that none of the last ``kept`` manifests names are deleted. One writer at a time;
    rows without an email are left out; of states with the same time and event id the greatest counts.
    """
    spark, old = df.sparkSession, manifests(df.sparkSession, path)
    last = _manifest(spark, path, old[-1]) if old else {"buckets": buckets, "held": {}}
    version, held = (old[-1] + 1 if old else 0), last["held"]
    bucket = F.pmod(F.xxhash64("email"), F.lit(last["buckets"])).cast("int")
    rows = df.filter("email is not null").select("email", "state", "ts", "event_id").withColumn("bucket", bucket)
    touched = [str(r.bucket) for r in rows.select("bucket").distinct().collect()]
    full = {b: held[b] for b in touched if len(held.get(b, [])) >= deltas}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    if full:
        rows = rows.unionByName(_read(spark, path, full, schema))
    _newest(rows).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v={version}")
    held = held | {b: [version] if b in full else [*held.get(b, []), version] for b in touched}
    _publish(spark, path, version, {"buckets": last["buckets"], "schema": schema, "held": held})
    _sweep(spark, path, kept)


def _sweep(spark: SparkSession, path: str, kept: int) -> None:
    """Delete old manifests, then the bucket folders that none of the rest names."""
    all_versions = manifests(spark, path)
    for v in all_versions[:-kept]:
        gone, store = _store(spark, f"{path}/manifests/v{v}.json")
        store.delete(gone, False)
    named = {(v, b) for m in all_versions[-kept:] for b, versions in _manifest(spark, path, m)["held"].items() for v in versions}
    root, store = _store(spark, f"{path}/data")
    for data in store.listStatus(root):
        v = int(data.getPath().getName()[2:])
        folders = [f.getPath() for f in store.listStatus(data.getPath()) if f.getPath().getName().startswith("bucket=")]
        unused = [f for f in folders if (v, f.getName()[7:]) not in named]
        for f in [data.getPath()] if len(unused) == len(folders) else unused:
            store.delete(f, True)


def account_states(spark: SparkSession, path: str) -> DataFrame:
    """Latest state of each account in the newest version: email, state, ts, event_id."""
    last = _manifest(spark, path, manifests(spark, path)[-1])
    return _newest(_read(spark, path, last["held"], last["schema"])).drop("bucket")


def entitlement_log(events: DataFrame, path: str, checkpoint: str, buckets: int = 64, deltas: int = 8) -> StreamingQuery:
    """Account states of a stream, merged batch by batch; see ``merge_states``."""
    return events.writeStream.foreachBatch(lambda df, _: merge_states(df, path, buckets, deltas)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
