"""Random shards of a corpus by a two-pass external shuffle; DataFrame functions only.

Pass one scatters the records by a seeded hash into buckets that fit in memory: Spark's shuffle files
are the buckets, partition b of the exchange is bucket b. Pass two reads each bucket, permutes it by
Fisher-Yates (``shuffle`` draws its random indices that way) and writes it. The buckets one after the
other are the shuffled corpus, cut into shards whose numbers of rows differ by one at most.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from formlens.llm.common import Scratch

RECORD_BYTES = 8  # counted for a record besides its text
BLOCK = 1 << 12  # buckets in one window of the running counts


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """``_size`` of a record and ``_key``, its seeded hash: equal for equal rows only."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + RECORD_BYTES
    return docs.withColumn("_size", size).withColumn("_key", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")))


def scatter(docs: DataFrame, bucket_bytes: int, least: int, seed: int) -> tuple[DataFrame, int]:
    """Rows with ``_bucket`` and the number of buckets: the hash decides, of about ``bucket_bytes`` each.

    Repeated rows share a hash. A bucket of over twice ``bucket_bytes`` (its longest record apart) can only
    come from those; it is cut in several, dealt by the row's place in the input instead. There are at most
    half as many of these as buckets, so their list is broadcast.
    """
    rows = _sized(docs, seed)
    total = rows.agg(F.sum("_size")).first()[0] or 0
    n = max(least, -(-total // bucket_bytes))
    rows = rows.withColumn("_bucket", F.pmod("_key", F.lit(n)).cast("int"))
    load = rows.groupBy("_bucket").agg(F.sum("_size").alias("_load"), F.max("_size").alias("_most"))
    parts = F.ceil(F.col("_load") / bucket_bytes).cast("int")
    heavy = sorted(tuple(r) for r in load.filter(F.col("_load") - F.col("_most") > 2 * bucket_bytes).select("_bucket", parts).collect())
    if not heavy:
        return rows, n
    since = [n, *accumulate((parts for _, parts in heavy), initial=n)][1:]
    cuts = docs.sparkSession.createDataFrame([(*x, at) for x, at in zip(heavy, since)], "_bucket int, _parts int, _since int")
    rows = rows.withColumn("_place", F.monotonically_increasing_id()).join(F.broadcast(cuts), "_bucket", "left")
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("_place")), F.col("_parts"))
    rows = rows.withColumn("_bucket", F.coalesce((F.col("_since") + place).cast("int"), F.col("_bucket"))).drop("_parts", "_since", "_place")
    return rows, since[-1]


def shuffle_buckets(docs: DataFrame, scratch: Scratch, bucket_bytes: int = 32 << 20, least: int = 48, seed: int = 13) -> DataFrame:
    """``docs`` with ``_bucket`` and ``_at`` (place in the bucket, from 0), stored in that order.

    Before it is permuted a bucket is sorted by the seeded hash, and its random numbers start from the
    seed and the bucket, so the same rows and seed give the same order whatever the partitions of the
    input and however often a task is run again; rows that are equal may change places.
    """
    columns = docs.columns
    rows, n = scatter(docs, bucket_bytes, least, seed)
    rows = rows.select("_bucket", "_key", F.struct("_size", *columns).alias("_row")).repartitionById(n, F.col("_bucket"))
    held = rows.sortWithinPartitions("_bucket", "_key").groupBy("_bucket").agg(F.collect_list("_row").alias("_rows"))
    dealt = held.select("_bucket", F.posexplode(F.shuffle("_rows", seed)).alias("_at", "_row"))
    return scratch.save(dealt.select("_bucket", F.col("_at").cast("long").alias("_at"), "_row.*"), "buckets")


def running_starts(buckets: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(_bucket, _start): records before each bucket, by sums within blocks of buckets and over the blocks; and the number of records."""
    counts = scratch.save(buckets.groupBy("_bucket").agg(F.count("*").alias("_n")), "counts").withColumn("_block", F.col("_bucket").cast("long").bitwiseAND(~(BLOCK - 1)))
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_n"))
    total = blocks.agg(F.sum("_n")).first()[0] or 0
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_inner", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    return counts.join(blocks, "_block").select("_bucket", (F.col("_base") + F.col("_inner")).alias("_start")), total


def shard_rows(docs: DataFrame, scratch: Scratch, n_shards: int = 24, bucket_bytes: int = 32 << 20, least: int = 48, seed: int = 13) -> DataFrame:
    """``docs`` (doc_id, text and any others) in random order over ``n_shards`` shards, law "rows".

    Adds size (UTF-8 bytes of the text, none for null, plus 8), text_crc32 (unsigned; of null that of the
    empty text), law, shard, slot (from 0 without gaps in each shard) and grown_shard (null: a further
    shard moves rows between all). Columns of these names are replaced. Numbers of rows differ by one at
    most; with fewer rows than shards some stay empty. Null and repeated doc_ids, null and empty texts and
    repeated rows are records of their own; a very long text makes its bucket as much larger. An empty
    table gives no rows. The order is a function of the seed, the rows and the number of buckets.
    """
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    columns = [c for c in docs.columns if c not in added]
    buckets = shuffle_buckets(docs.select(*columns), scratch, bucket_bytes, least, seed)
    starts, total = running_starts(buckets, scratch)
    at, n = F.col("_start") + F.col("_at"), F.lit(max(total, 1)).cast("long")
    # Shard s holds the places from s * total div n_shards up to the next shard's first.
    placed = buckets.join(F.broadcast(starts), "_bucket").withColumn("_place", at)
    placed = placed.withColumn("shard", F.expr(f"int(((_place + 1) * {n_shards} - 1) div {max(total, 1)})"))
    first = F.expr(f"(shard * {total}L) div {n_shards}")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return placed.select(*columns, F.col("_size").alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", (F.col("_place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(placed: DataFrame, path: str) -> None:
    """The shards as Parquet below ``path``/shard=N; records of a file are in the order of their slots.

    Stored buckets are read as they lie, so there is no further shuffle: a file holds what one task has read of a shard.
    """
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
