import uuid

import pytest
from pyspark.sql import functions as F


from formlens.sources.views import view
from formlens.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def stream(spark, tmp_path):
    def make(df, parts=5):
        path = str(tmp_path / f"s{uuid.uuid4().hex[:6]}")
        df.repartition(parts).write.parquet(path)
        return jobs.file_stream(spark, path)

    return make


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def run(df, tmp_path, mode="complete"):
    return jobs.drain(df, f"q{uuid.uuid4().hex[:8]}", str(tmp_path / uuid.uuid4().hex), mode)


def test_daily_totals_equal_batch(spark, stream, tmp_path):
    p = view(spark, SF, "payments").filter("livemode")
    got = run(jobs.daily_totals(stream(p), "amount_cents", 5.5), tmp_path)
    want = p.groupBy(F.to_date(F.expr("ts + interval 330 minutes")).alias("day")).agg(F.sum("amount_cents"), F.count("*"))
    assert rows(got) == rows(want)


def test_payments_once_keeps_rows_without_id(spark, stream, tmp_path):
    p = view(spark, SF, "payments")
    got = run(jobs.payments_once(stream(p.union(p.filter("stripe_event_id is not null"))), "90 days"), tmp_path, "append")
    assert got.filter("stripe_event_id is not null").count() == p.select("stripe_event_id").distinct().filter("stripe_event_id is not null").count()
    assert got.filter("stripe_event_id is null").count() == p.filter("stripe_event_id is null").count()


def test_payments_sink_is_idempotent(spark, stream, tmp_path):
    p, path = view(spark, SF, "payments"), str(tmp_path / "stored")
    for i in range(2):
        jobs.payments_sink(stream(p.filter("stripe_event_id is not null")), path, str(tmp_path / f"c{i}")).awaitTermination()
    assert spark.read.parquet(path).count() == p.select("stripe_event_id").distinct().filter("stripe_event_id is not null").count()


def test_a_repeated_batch_replaces_its_rows(spark, tmp_path):
    from formlens.sources.io import append_new

    p, path = view(spark, SF, "payments").select("event_id", "ts", "stripe_event_id"), str(tmp_path / "stored")
    ids, none = p.select("stripe_event_id").distinct().filter("stripe_event_id is not null").count(), p.filter("stripe_event_id is null").count()
    for batch, n in ((0, ids + none), (0, ids + none), (1, none), (1, none)):
        assert append_new(p, path, "stripe_event_id", "r", batch) == n
    assert spark.read.parquet(path).count() == ids + 2 * none


def test_credit_state_and_reliability_equal_batch(spark, stream, tmp_path):
    from formlens.operators.metering import credit_daily, remaining

    calls = view(spark, SF, "ai_calls")
    assert rows(run(jobs.credit_state(stream(calls)), tmp_path)) == rows(credit_daily(calls).select("user_key", "day", "tokens", remaining(F.col("tokens"))))
    got = run(jobs.hourly_reliability(stream(calls)), tmp_path).drop("p50_ms")
    want = calls.groupBy(F.date_trunc("hour", "ts")).agg(F.count("*"), F.count_if("ok"), F.count_if(F.col("provider") == "fallback"))
    assert rows(got) == rows(want)


def test_first_touch_and_stale_events(spark, stream, tmp_path):
    d = view(spark, SF, "devices")
    assert run(jobs.first_touch(stream(d)), tmp_path, "append").count() == d.select("device_id").distinct().count()
    e = d.selectExpr("event_id", "ts as sent_at", "ts + make_interval(0,0,0,0,0,0, event_id % 700 - 350) as received_at")
    for part, want in zip(jobs.split_stale(stream(e)), jobs.split_stale(e), strict=True):
        assert rows(run(part.select("event_id"), tmp_path, "append")) == rows(want.select("event_id"))
    good, bad = jobs.split_stale(e)
    assert good.count() + bad.count() == e.count() and bad.count() == e.filter("abs(event_id % 700 - 350) > 300").count() > 0


def test_entitlement_snapshots(spark, stream, tmp_path):
    from formlens.operators.ledger import entitlement_now

    e = view(spark, SF, "payments").selectExpr("event_id", "ts", "email", "if(event_id % 5 = 0, 'free', 'pro') as state")
    path = str(tmp_path / "snap")
    jobs.entitlement_sink(stream(e, 9), path, str(tmp_path / "c")).awaitTermination()
    last = max(int(p.name[1:]) for p in (tmp_path / "snap").iterdir() if p.name.startswith("v"))
    assert rows(spark.read.parquet(f"{path}/v{last}").select("email", "state")) == rows(entitlement_now(e).select("email", "state"))

    # A new checkpoint over the old versions keeps their state; old versions go.
    late = spark.createDataFrame([(10**9, "new@example.com", "pro")], "event_id long, email string, state string").withColumn("ts", F.lit("2025-01-01").cast("timestamp"))
    jobs.entitlement_sink(stream(late, 1), path, str(tmp_path / "c2")).awaitTermination()
    left = jobs.versions(spark, path)
    assert len(left) == 2 and left[-1] == last + 1
    assert rows(spark.read.parquet(f"{path}/v{left[-1]}").select("email", "state")) == rows(entitlement_now(e.unionByName(late.select(*e.columns))).select("email", "state"))


def test_devices_once_with_bounded_state(spark, stream, tmp_path):
    d, path = view(spark, SF, "devices"), str(tmp_path / "devices")
    n = d.select("device_id").distinct().count()
    for i, rows_ in enumerate((d, d.withColumn("ts", F.expr("ts + interval 400 days")))):
        jobs.devices_sink(stream(rows_), path, str(tmp_path / f"d{i}"), "1 day", 8).awaitTermination()
        stored = spark.read.parquet(path)
        assert stored.count() == n and stored.select("device_id").distinct().count() == n


def test_entitlement_log_writes_what_changed_and_survives_a_crash(spark, stream, tmp_path, monkeypatch):
    from formlens.operators.ledger import entitlement_now
    from formlens.streaming import snapshots as s

    e = view(spark, SF, "payments").selectExpr("event_id", "cast(ts as timestamp) ts", "email", "if(event_id % 5 = 0, 'free', 'pro') as state")
    path = str(tmp_path / "log")
    s.entitlement_log(stream(e, 9), path, str(tmp_path / "c"), 16, 2).awaitTermination()
    assert rows(s.account_states(spark, path).select("email", "state")) == rows(entitlement_now(e).select("email", "state"))

    # A late account touches one bucket, and only that account is written.
    last = s.manifests(spark, path)[-1]
    assert len(s.manifests(spark, path)) == 2 and last > 0
    late = spark.createDataFrame([(10**9, "new@example.com", "pro")], "event_id long, email string, state string").withColumn("ts", F.lit("2025-01-01").cast("timestamp"))
    publish = s._publish
    monkeypatch.setattr(s, "_publish", lambda *_: (_ for _ in ()).throw(OSError("crash before the manifest")))
    with pytest.raises(OSError):
        s.merge_states(late, path, 16, 100)
    assert s.manifests(spark, path)[-1] == last and s.account_states(spark, path).filter("email = 'new@example.com'").count() == 0
    monkeypatch.setattr(s, "_publish", publish)
    for _ in range(2):
        s.merge_states(late, path, 16, 100)
    assert spark.read.parquet(f"{path}/data/v={last + 1}").count() == 1
    assert rows(s.account_states(spark, path).select("email", "state")) == rows(entitlement_now(e.unionByName(late.select(*e.columns))).select("email", "state"))

    # Compaction leaves one version in the bucket; an empty batch changes nothing.
    s.merge_states(late, path, 16, 1)
    s.merge_states(late.limit(0), path, 16, 1)
    newest = s._manifest(spark, path, s.manifests(spark, path)[-1])
    assert [last + 3] in newest["held"].values()
    assert s.account_states(spark, path).filter("email = 'new@example.com'").count() == 1


@pytest.mark.parametrize("ordered", [False, True])
def test_one_overspend_alert_a_day_also_after_a_restart(spark, stream, tmp_path, ordered):
    from formlens.operators.metering import credit_daily
    from formlens.streaming.alerts import ROCKSDB, overspend_alerts

    old = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    calls, path, out = view(spark, SF, "ai_calls"), str(tmp_path / "calls"), str(tmp_path / "alerts")
    sums = credit_daily(calls)
    credits = int(sums.approxQuantile("tokens", [0.7], 0.01)[0] // 1000)
    want = rows(sums.filter(F.col("tokens") > credits * 1000).select("user_key", "day"))
    try:
        # In order of time, a short delay expires the days in between; in any order, a long one keeps them.
        half = F.col("ts") < F.expr("timestamp'2024-01-16'") if ordered else F.col("event_id") % 2 == 0
        for part in (half, ~half):
            calls.filter(part).repartition(1 if ordered else 2).write.mode("append").parquet(path)
            alerts = overspend_alerts(jobs.file_stream(spark, path, 1), "1 day" if ordered else "400 days", credits)
            alerts.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(out)
        assert rows(got.select("user_key", "day")) == want and 0 < len(want) < sums.count()
        assert got.select("credit_tokens").distinct().count() == 1
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
