"""Sources and sinks: typed scans, append and merge sinks, rate cards, text files and nested layouts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from formlens.operators.metering import rate_card_from_json

#: Extensions that are read as text.
TEXT = ["txt", "md", "csv", "tsv", "json", "html", "xml", "log"]


def append_daily(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append events, partitioned by their UTC date."""
    df.withColumn("dt", F.to_date(ts)).write.mode("append").partitionBy("dt").parquet(path)


def append_new(df: DataFrame, path: str, key: str, run: str | None = None, batch: int = 0, buckets: int = 0) -> int:
    """Append rows whose key is not stored yet (null keys always); returns how many.

    With a ``run`` the rows are batch ``batch`` of it: repeating the batch replaces what it wrote, rows
    without a key included, so a batch that fails halfway can be run again. One writer at a time. With
    ``buckets`` rows lie in folders by the hash of their key, and only those that the batch touches are
    looked up; always give one store the same number.
    """
    spark, here, names = df.sparkSession, f"{path}/run={run}/batch={batch}" if run else path, df.columns
    if buckets:
        df = df.withColumn("bucket", F.coalesce(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)), F.lit(-1)).cast("int"))
    rows = df.filter(F.col(key).isNotNull()).dropDuplicates([key])
    if exists(spark, path):
        stored = spark.read.parquet(path)
        if run and "run" in stored.columns:
            stored = stored.filter((F.col("run") != run) | (F.col("batch") != batch))
        if buckets:
            stored = stored.filter(F.col("bucket").isin([r.bucket for r in rows.select("bucket").distinct().collect()]))
        rows = rows.join(stored.select(key), key, "left_anti")
    seen = Observation()
    rows = rows.select(df.columns).unionByName(df.filter(F.col(key).isNull()))
    out = rows.observe(seen, F.count("*").alias("n")).write.mode("overwrite" if run else "append")
    (out.partitionBy("bucket") if len(df.columns) > len(names) else out).parquet(here)
    return seen.get["n"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the folder all executors share (``spark.checkpoint.dir``) and read from there, for plans that read it in several branches.

    A local folder where that is unset and Spark runs in one process. Results are lazy, so it is deleted when the process ends.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="formlens-")
    path = f"{base.rstrip('/')}/formlens/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    if SparkContext._active_spark_context is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_rate_card(spark: SparkSession, path: str) -> DataFrame:
    """A JSON rate card file as rows; no rows if it is missing or broken."""
    if not exists(spark, path):
        return spark.range(0).selectExpr("'' as model", "0D as rate_in", "0D as rate_out")
    return rate_card_from_json(spark.read.text(path, wholetext=True))


def primary_is_free(spark: SparkSession, path: str) -> bool:
    """Whether calls of the primary provider cost nothing: what the rate card says, else yes, as for a missing or broken card."""
    if not exists(spark, path):
        return True
    said = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<_provider_primary_is_free:boolean>")["_provider_primary_is_free"]).first()
    return said is None or said[0] is None or said[0]


def decoded(content: Column) -> Column:
    """UTF-8 text, or Latin-1 where the bytes aren't UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def read_text_files(spark: SparkSession, glob: str) -> DataFrame:
    """path, name, text of files; a mark instead of the text for extensions that aren't text."""
    files = spark.read.format("binaryFile").load(glob)
    name = F.substring_index("path", "/", -1)
    known = F.lower(F.substring_index(name, ".", -1)).isin(TEXT)
    return files.select("path", name.alias("name"), F.when(known, decoded(F.col("content"))).otherwise(F.concat(F.lit("[unsupported file: "), name, F.lit("]"))).alias("text"))


def context_blocks(files: DataFrame, by: str, limit: int = 6000) -> DataFrame:
    """Non-blank sources, cut to ``limit`` characters, labelled and joined in name order."""
    text = F.when(F.length("text") > limit, F.concat(F.rtrim(F.left("text", F.lit(limit))), F.lit(" [truncated]"))).otherwise(F.col("text"))
    parts = F.sort_array(F.collect_list(F.struct("name", text.alias("text"))))
    return files.filter(F.trim("text") != "").groupBy(by).agg(F.array_join(F.transform(parts, lambda p: F.concat(F.lit("### "), p["name"], F.lit("\n"), p["text"])), "\n\n").alias("context"))


PAGES = "pages array<struct<index:int,width:double,height:double,markers:array<array<double>>,cells:array<struct<glyph:string,draw:array<double>>>>>"


def _boxes(box: Column) -> list[Column]:
    return [F.get(box, i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]


def flatten_geometry(layouts: DataFrame, *by: str) -> DataFrame:
    """Nested template layouts (column pages) as by, page, glyph, x0, y0, x1, y1, descends."""
    cells = layouts.select(*by, F.explode("pages").alias("p")).select(*by, F.col("p.index").alias("page"), F.explode("p.cells").alias("c"))
    return cells.select(*by, "page", F.col("c.glyph").alias("glyph"), *_boxes(F.col("c.draw")), F.col("c.glyph").isin(list("gjpqy")).alias("descends"))


def template_markers(layouts: DataFrame, *by: str) -> DataFrame:
    """Registration marks of the pages of nested template layouts, in order."""
    marks = layouts.select(*by, F.explode("pages").alias("p")).select(*by, F.col("p.index").alias("page"), F.posexplode("p.markers").alias("mark", "m"))
    return marks.select(*by, "page", "mark", *_boxes(F.col("m")))


def glyph_set(cells: DataFrame, *by: str) -> DataFrame:
    """Distinct glyphs that a layout has cells for."""
    return cells.select(*by, "glyph").distinct()


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    """Cells of a template layout file; see ``flatten_geometry``."""
    return flatten_geometry(spark.read.json(path, multiLine=True, schema=PAGES))


def write_structure(units: DataFrame, path: str) -> None:
    """One nested row per document with its units in order."""
    unit = F.struct("page", "line_no", "kind", "unit_id")
    units.groupBy("doc_id").agg(F.count("*").alias("unit_count"), F.sort_array(F.collect_list(unit)).alias("units")).write.parquet(path)
