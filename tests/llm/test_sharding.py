import zlib

import pytest
from pyspark.sql import functions as F

from formlens.llm.common import Scratch
from formlens.llm.sharding import scatter, shard_rows, shuffle_buckets, write_shards


def placed(spark, docs, **options):
    return [r.asDict() for r in shard_rows(docs, Scratch(spark, "shards"), **options).collect()]


def test_law_rows_against_plain_python(spark):
    texts = {i: "é" * (i % 7) + "x" * i for i in range(500)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = placed(spark, docs, n_shards=7, bucket_bytes=4000)
    assert sorted(r["doc_id"] for r in rows) == list(range(500))
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    slots = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(7)]
    assert all(x == list(range(len(x))) for x in slots) and {len(x) for x in slots} == {71, 72}


def test_same_seed_same_order_whatever_the_partitions(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    key = lambda rows: {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    one, two = key(placed(spark, docs.repartition(1), least=4)), key(placed(spark, docs.repartition(7), least=4))
    assert one == two
    other = key(placed(spark, docs, least=4, seed=14))
    assert sum(one[i] == other[i] for i in one) < 20


def test_buckets_are_permuted_uniformly(spark):
    """Where a record lands in its bucket doesn't depend on its place by hash: each of 4 quarters gets a quarter."""
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = shuffle_buckets(docs, Scratch(spark, "uniform"), least=4)
    rank = F.expr("ntile(4) over (partition by _bucket order by xxhash64(13, doc_id, text))")
    where = F.expr("ntile(4) over (partition by _bucket order by _at)")
    seen = [r["n"] for r in rows.select(rank.alias("a"), where.alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")).collect()]
    assert len(seen) == 16 and all(400 < n < 600 for n in seen)


def test_repeated_rows_spread_over_buckets(spark):
    """A third of all rows are one row: none of them goes, and no bucket holds over twice its size of them."""
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("text "), "id")).otherwise(F.lit("copy " * 20)).alias("text"))
    rows, n = scatter(docs, 8000, 4, 13)
    load = [r["s"] for r in rows.groupBy("_bucket").agg(F.sum("_size").alias("s")).collect()]
    assert n > 18 and max(load) < 2 * 8000 + 108
    out = placed(spark, docs, bucket_bytes=8000, least=4)
    assert len(out) == 3000 and sum(r["doc_id"] is None for r in out) == 1000
    assert sorted((r["shard"], r["slot"]) for r in out) == [(s, i) for s in range(24) for i in range(125)]


def test_odd_rows(spark):
    long = "word " * 200_000
    rows = [(None, None, 1), (None, "", 2), (1, long, 3), (1, long, 4), (2, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int").withColumn("_row", F.lit("mine")).withColumn("slot", F.lit(9))
    out = placed(spark, docs, bucket_bytes=400_000, least=4)
    assert sorted(r["size"] for r in out) == [8, 8, 8, 1000008, 1000008]
    assert {r["text_crc32"] for r in out if not r["text"]} == {0} and {r["_row"] for r in out} == {"mine"}
    assert all(r["slot"] == 0 for r in out) and len({r["shard"] for r in out}) == 5
    assert placed(spark, docs.limit(0), least=4) == []


def test_files_hold_the_order(spark, tmp_path):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    rows = shard_rows(docs, Scratch(spark, "files"), n_shards=3, least=4)
    write_shards(rows, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).withColumn("file", F.input_file_name()).withColumn("i", F.monotonically_increasing_id())
    assert back.count() == 300 and {p.name for p in (tmp_path / "out").glob("shard=*")} == {"shard=0", "shard=1", "shard=2"}
    gaps = back.selectExpr("slot - lag(slot) over (partition by file order by i) as step").filter("step < 1")
    assert gaps.count() == 0


@pytest.mark.parametrize("n", [1, 23, 25])
def test_fewer_rows_than_shards(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = placed(spark, docs, least=4)
    counts = [sum(r["shard"] == s for r in rows) for s in range(24)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1
