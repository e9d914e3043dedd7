"""Line deduplication: suffix array over line-ID sequences by distributed prefix doubling, native.

A line's place is one number, document order first, so "earlier" is "smaller".

* Prefix doubling. Level 0 ranks the lines that occur twice or more; level j + 1 sorts the pairs of
  level-j ranks 2**j apart, and a pair's rank is its number in that order: the suffix array by 2**j
  lines. Pairs that occur once drop out, as no other suffix shares them. Pairs are counted before
  they are sorted, so a frequent one is one row there.
* Longest-common-prefix intervals. From the highest level down, suffixes that share a prefix of l
  lines ("branch") and the rank of the next 2**i lines share l + 2**i: a child branch. Its least place
  also stays in the parent, where it stands for the child. After level 0 each branch is an interval
  with its exact longest common prefix, and the intervals have no more than two rows a place.
* Maximal runs. A rank whose suffixes all follow the same repeated line is left out: each of its runs
  goes on to the left, and the longer run is found there.
* Each suffix of an interval but its least place starts a run that stands earlier. Runs of
  ``min_words`` words together are deleted.

A line goes exactly if it lies in a run of consecutive lines of at least ``min_words`` words together
that stands earlier as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlens.llm.common import Names, Scratch, row_numbers

ROOM = 62  # bits of a place: document number and line number
BROADCAST_ROWS = 1 << 16


def _keyed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """``docs`` with _d, the number of each row's document in order, and the bits that a line number takes.

    Small unique ids are their own numbers; else rows are numbered by id (null last) and text, so that
    repeated and null ids are told apart.
    """
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    low, high, n, distinct, most = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*"), F.count_distinct("doc_id"), F.max(newlines)).first()
    bits = ((most or 0) + 1).bit_length()
    if n == 0 or (n == distinct and low >= 0 and high < 1 << (ROOM - bits)):
        return docs.withColumn("_d", F.col("doc_id").cast("long")), bits
    if n >= 1 << (ROOM - bits):
        raise ValueError(f"{n} documents of up to {most} lines need more than {ROOM} bits")
    return row_numbers(docs, [F.asc_nulls_last("doc_id"), F.sha2("text", 256)], scratch, "_d"), bits


def _ranks(lines: DataFrame, scratch: Scratch, min_words: int, broadcast_rows: int) -> list[DataFrame]:
    """For each level the places whose 2**level lines stand twice: d, g, r (rank), w (their words), left, f (first place with r), varied (r has several left neighbours)."""
    number = F.monotonically_increasing_id()  # after a sort: increasing in the sort's order
    by = ["k1", "k2", "k3"]
    names = lines.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").orderBy(*by).withColumn("r", number)
    places = Names(names, scratch, "names-0", broadcast_rows).join(lines, by).select("d", "g", "r", "w")
    # Stretches of consecutive repeated lines that can't hold a run of min_words words go.
    line = Window.partitionBy("d").orderBy("g")
    places = places.withColumn("s", F.col("g") - F.row_number().over(line))
    places = places.withColumn("total", F.sum("w").over(Window.partitionBy("d", "s"))).filter(F.col("total") >= min_words)
    places = scratch.save(places.select("d", "g", "r", "w", F.max("r").over(line.rangeBetween(-1, -1)).alias("left")), "places")
    figures = [F.count("*").alias("n"), F.min("g").alias("f"), ((F.count("left") < F.count("*")) | (F.min("left") < F.max("left"))).alias("varied")]
    names = Names(places.groupBy("r").agg(*figures).filter("n > 1"), scratch, "first-0", broadcast_rows)
    levels = []
    rows, by = places, ["r"]
    while names.count:
        levels.append(scratch.save(names.join(rows, by).select("d", "g", "r", "w", "left", "f", "varied"), f"rank-{len(levels)}"))
        step, by = 1 << (len(levels) - 1), ["r1", "r2"]
        there = Window.partitionBy("d").orderBy("g").rangeBetween(step, step)
        rows = levels[-1].select("d", "g", F.col("r").alias("r1"), "left", (F.col("w") + F.max("w").over(there)).alias("w"), F.max("r").over(there).alias("r2")).filter("r2 is not null")
        names = rows.groupBy(*by).agg(*figures).filter("n > 1").orderBy(*by).withColumn("r", number)
        names = Names(names, scratch, f"names-{len(levels)}", broadcast_rows)
    return levels


def _intervals(levels: list[DataFrame], scratch: Scratch, broadcast_rows: int) -> DataFrame | None:
    """Rows of the longest-common-prefix intervals: b (interval), g, l (lines shared), w (their words)."""
    rows, none = None, F.lit(0).cast("long")
    for level in range(len(levels) - 1, -1, -1):
        # Suffixes that share no more than this level's lines, and those that stand for a longer prefix.
        ranks = fresh = levels[level]
        if level + 1 < len(levels):
            fresh = fresh.join(levels[level + 1].filter("g <> f").select("g"), "g", "left_anti")
        fresh = fresh.filter("varied").select(F.lit(-1).cast("long").alias("b"), "g", none.alias("l"), none.alias("w"), "r", F.col("w").alias("w2"))
        if rows is not None:
            at = ranks.select(F.col("g").alias("at"), "r", F.col("w").alias("w2"))
            fresh = rows.withColumn("at", F.col("g") + F.col("l")).join(at, "at", "left").drop("at").unionByName(fresh)
        rows = scratch.save(fresh, f"branch-{level}")
        known, alone = rows.filter("r is not null"), rows.filter("r is null and b >= 0")
        child = known.groupBy("b", "r").agg(F.count("*").alias("n"), F.min("g").alias("f")).filter("n > 1")
        child = Names(child.withColumn("child", F.monotonically_increasing_id() + F.lit(level << 56)), scratch, f"child-{level}", broadcast_rows)
        # A row goes to its child; what has none stays in its branch, and so does the least place of each child.
        row = lambda b, l, w: F.struct(b.alias("b"), F.col("g").alias("g"), l.alias("l"), w.alias("w"))
        deeper = F.when(F.col("child").isNotNull(), row(F.col("child"), F.col("l") + (1 << level), F.col("w") + F.col("w2")))
        stay = F.when((F.col("b") >= 0) & (F.col("child").isNull() | (F.col("g") == F.col("f"))), row(F.col("b"), F.col("l"), F.col("w")))
        rows = child.join(known, ["b", "r"], "left").select(F.inline(F.array_compact(F.array(deeper, stay))))
        rows = rows.unionByName(alone.select("b", "g", "l", "w"))
    return rows


def repeated_runs(keyed: DataFrame, bits: int, scratch: Scratch, min_words: int = 50, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(_d, text) -> maximal stretches of lines to delete: d, first, end (line numbers, end exclusive)."""
    lines = keyed.filter("text <> ''").select(F.col("_d").alias("d"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    words = F.when(F.col("line") == "", 0).otherwise(F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    place = F.shiftleft("d", bits) + F.col("i")
    lines = lines.select("d", place.alias("g"), F.xxhash64("line").alias("k1"), F.hash("line").alias("k2"), F.length("line").alias("k3"), words.cast("long").alias("w"))
    lines = scratch.save(lines, "lines")
    rows = _intervals(_ranks(lines, scratch, min_words, broadcast_rows), scratch, broadcast_rows)
    schema = "d long, first int, end int"
    if rows is None:
        return keyed.sparkSession.createDataFrame([], schema)
    rows = scratch.save(rows.filter(F.col("w") >= min_words), "intervals")
    least = rows.groupBy("b").agg(F.count("*").alias("n"), F.min("g").alias("least")).filter("n > 1")
    runs = Names(least, scratch, "least", broadcast_rows).join(rows, ["b"]).filter("g > least")
    runs = runs.select(F.shiftright("g", bits).alias("d"), F.col("g").bitwiseAND((1 << bits) - 1).alias("a"), "l")
    runs = runs.groupBy("d", "a").agg((F.col("a") + F.max("l")).alias("z"))
    before = Window.partitionBy("d").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    fresh = (F.col("a") > F.coalesce(F.max("z").over(before), F.lit(-1))).cast("int")
    runs = runs.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(Window.partitionBy("d").orderBy("a").rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("d", "run").agg(F.min("a").cast("int").alias("first"), F.max("z").cast("int").alias("end"))
    return scratch.save(merged.select("d", "first", "end"), "spans")


def dedup_lines(docs: DataFrame, scratch: Scratch, min_words: int = 50, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text``, and two more columns: n_lines and n_removed.

    Lines are split at newlines; a line's words are its spaces plus one, an empty line has none.
    Documents are ordered by doc_id, rows with equal ids by a hash of their texts, null ids last; each
    row is a document of its own, so of equal rows one keeps its lines. Null and empty texts have no
    line and stay as they are; a document whose lines all go has an empty text. Other columns pass
    through; columns called n_lines, n_removed, _d or _spans are replaced or dropped. An empty table
    gives no rows. Spans are broadcast if there are at most ``broadcast_rows``, else joined by a shuffle.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed", "_d", "_spans")]
    keyed, bits = _keyed(docs.select(*columns), scratch)
    runs = repeated_runs(keyed.select("_d", F.col("text").cast("string").alias("text")), bits, scratch, min_words, broadcast_rows)
    few = runs.count() <= broadcast_rows
    spans = runs.groupBy(F.col("d").alias("_d")).agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("_spans"))
    joined = keyed.join(F.broadcast(spans) if few else spans, "_d", "left")
    lines = F.split(F.col("text"), "\n")
    kept = F.filter(lines, lambda x, i: ~F.exists("_spans", lambda s: (i >= s["first"]) & (i < s["end"])))
    gone = F.aggregate("_spans", F.lit(0), lambda n, s: n + s["end"] - s["first"])
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    count = F.when(F.coalesce(F.col("text"), F.lit("")) == "", 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    out: list[Column] = [text.alias("text") if c == "text" else F.col(c) for c in columns]
    return joined.select(*out, count.cast("int").alias("n_lines"), F.coalesce(gone, F.lit(0)).alias("n_removed"))
