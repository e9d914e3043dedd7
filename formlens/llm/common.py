"""Shared scratch tables, row numbers and session settings of the training-data operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import accumulate
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one only where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="formlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Tables of one operator run, written to the shared folder so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        importable(spark)
        self.path = f"{shared_dir(spark)}/formlens/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._leave)  # results are lazy: they may read these tables as long as the session lives

    def write(self, df: DataFrame, table: str, **options: str) -> str:
        path = f"{self.path}/{table}"
        df.write.options(**options).parquet(path)
        return path

    def save(self, df: DataFrame, table: str, **options: str) -> DataFrame:
        """Write ``df`` and return the stored table: cuts lineage."""
        schema = df.schema
        return self.spark.read.schema(schema).parquet(self.write(df, table, **options))

    def append(self, df: DataFrame, table: str) -> DataFrame:
        """``save`` of a table that is made piece by piece: adds a piece and returns all so far. Take the one returned last."""
        path = f"{self.path}/{table}"
        df.write.mode("append").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def measured(self, df: DataFrame, table: str, *figures: Column) -> tuple[DataFrame, dict]:
        """``save``, and aggregates of the rows that come along with the write (for sizes only: a repeated task may count twice)."""
        seen = Observation()
        stored = self.save(df.observe(seen, *figures), table)
        return stored, seen.get

    def qualified(self, table: str) -> str:
        """URI of a folder of files that tasks write themselves."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(path).toString()

    def drop(self, table: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _leave(self) -> None:
        if SparkContext._active_spark_context is not None:
            self.drop()


def row_numbers(df: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """``df`` stored with the column ``name``: numbers from 0 without gaps in the given order, unique for each row.

    A distributed sort; the driver sees one count for each partition of it.
    """
    rows = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = scratch.save(rows, f"numbered{name}").withColumn("_part", F.shiftright("_at", 33))
    counts = sorted(tuple(r) for r in rows.groupBy("_part").agg(F.count("*")).collect())
    if not counts:
        return rows.select(*df.columns, F.col("_at").alias(name))
    since = dict(zip((p for p, _ in counts), [0, *accumulate(n for _, n in counts)]))
    starts = F.broadcast(df.sparkSession.createDataFrame(list(since.items()), "_part long, _since long"))
    within = F.col("_at").bitwiseAND((1 << 33) - 1)
    return rows.join(starts, "_part").select(*df.columns, (F.col("_since") + within).alias(name))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did (a cluster has it installed, which wins)."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Arrow batches of about ``size`` in what runs inside: of long texts, Spark's own take much memory in the JVM and in Python at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Names:
    """Stored names, one row for each key, with their number of rows n."""

    def __init__(self, names: DataFrame, scratch: Scratch, table: str, broadcast_rows: int = 1 << 16, hot_parts: int = 1 << 10):
        self.rows, seen = scratch.measured(names, table, F.count("*").alias("count"), F.sum("n").alias("total"))
        self.count, self.few = seen["count"], seen["count"] <= broadcast_rows
        self.hot = max((seen["total"] or 0) // hot_parts, 1)

    def join(self, rows: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
        """``rows`` with the columns of their names but n.

        Up to ``broadcast_rows`` names are broadcast. Of more, those with over a ``hot_parts``-th of all
        rows are (there can't be more than ``hot_parts``), so a frequent key never meets in one task.
        """
        if self.few:
            return rows.join(F.broadcast(self.rows.drop("n")), by, how)
        hot, rest = self.rows.filter(F.col("n") > self.hot).drop("n"), self.rows.filter(F.col("n") <= self.hot).drop("n")
        others = rows.join(F.broadcast(hot.select(*by)), by, "left_anti")
        return rows.join(F.broadcast(hot), by).unionByName(others.join(rest, by, how))


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str, scratch: Scratch, name: str, hot_parts: int = 1 << 10) -> DataFrame:
    """``rows`` joined with ``table`` (one row for each ``key``), a key with over a ``hot_parts``-th of the rows in several tasks.

    Such a key's row of the table is repeated, and its rows are dealt over the repeats by a hash of ``by``. There
    can't be more than ``hot_parts`` of these keys, so their counts are broadcast. All other keys are joined as they are.
    """
    counts, seen = scratch.measured(rows.groupBy(key).agg(F.count("*").alias("_n")), f"per-{name}", F.sum("_n").alias("total"), F.max("_n").alias("most"))
    most = max((seen["total"] or 0) // hot_parts, 64)
    if (seen["most"] or 0) <= most:
        return rows.join(table, key)
    hot = F.broadcast(counts.filter(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).cast("int").alias("_parts")))
    dealt = rows.join(hot, key).withColumn("_part", F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")).drop("_parts")
    copies = table.join(hot, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    rest = rows.join(hot.select(key), key, "left_anti").join(table, key)
    return rest.unionByName(dealt.join(copies, [key, "_part"]).drop("_part"))
