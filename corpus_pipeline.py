"""Corpus pipeline over ``documents``: quality, line dedup, near duplicates, mixing, subword encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents, whatever they are.

In every stage null and empty texts are documents without lines, words or tokens: quality scores them
as a text without features, line dedup and near duplicates leave them alone, mixing gives them their
cell's probability, and they have one empty segmentation. Rows with equal or null doc_ids are documents
of their own (mixing and sampling seed them alike). An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens.llm.common import Scratch, row_numbers, table
from formlens.llm.jaccard_join import BROADCAST_ROWS, near_duplicates
from formlens.llm.line_dedup import dedup_lines
from formlens.llm.mixing import mix_sources
from formlens.llm.quality import score_quality, train_quality
from formlens.llm.queries import PIECES
from formlens.llm.subword import encode_samples

_used: list[Scratch] = []


def _scratch(spark: SparkSession, name: str) -> Scratch:
    """Scratch of a stage; that of stages before goes, as their results are written by now."""
    while _used:
        _used.pop().drop()
    _used.append(Scratch(spark, name))
    return _used[0]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from their labels outside the held-out fold."""
    columns = docs.columns
    _scratch(spark, "quality")
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, score="_score", predicted="_predicted").filter("_predicted = 1").select(*columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those of which no line is left go."""
    columns = docs.columns
    out = dedup_lines(docs, _scratch(spark, "lines")).filter("n_removed < n_lines or n_removed = 0")
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", size).select(*columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least doc_id.

    Repeated or null doc_ids: rows are numbered by doc_id (null last) and text first, so that exactly
    one row of a group stays. Documents without words are alone and stay.
    """
    scratch, columns = _scratch(spark, "near"), docs.columns
    n, distinct = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == distinct:
        docs = docs.withColumn("_row", F.col("doc_id").cast("long"))
    else:
        docs = row_numbers(docs.drop("_row"), [F.asc_nulls_last("doc_id"), F.sha2("text", 256)], scratch, "_row")
    gone = near_duplicates(docs.select(F.col("_row").alias("doc_id"), "text"), scratch).filter("doc_id <> component_id").select(F.col("doc_id").alias("_row"))
    gone, seen = scratch.measured(gone, "gone", F.count("*").alias("n"))
    few = seen["n"] <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, "_row", "left_anti").select(*columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled towards the target weights of sources, languages and topics."""
    return mix_sources(docs, _scratch(spark, "mixing")).filter("sampled").select(*docs.columns)


def subwords(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each document."""
    _scratch(spark, "subwords")
    return encode_samples(docs, PIECES, k=2, chunk_bytes=1 << 18)


STAGES = [("quality", quality), ("line dedup", line_dedup), ("near duplicates", one_of_each), ("mixing", mixing), ("subwords", subwords)]
#: The first stage is a trained model, so SQL can't express the rows; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of sf_dir, each written and read again."""
    docs, kept = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = kept.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
