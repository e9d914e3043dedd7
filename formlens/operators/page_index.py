"""Anchors placed on a page's text: a map from normalised characters to glyphs, and a fold over the page's anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlens.functions.core import DASHES, DOUBLE_QUOTES, SINGLE_QUOTES, ZERO_WIDTH, alnum_only, occurrences
from formlens.operators.layout import PAGE

GONE = "\u0001"  # stands for a zero-width character, so that places stay
GLYPH = "struct<pos:int,line_no:int,char_no:int,ch:string>"
SPAN = f"struct<first:{GLYPH},last:{GLYPH}>"


def _folded(text: Column) -> Column:
    """Dashes and quotes folded and lower case, one character for each."""
    kept = "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + GONE * len(ZERO_WIDTH) + "i"
    return F.lower(F.translate(text, DASHES + SINGLE_QUOTES + DOUBLE_QUOTES + ZERO_WIDTH + "İ", kept))


def _page_lines(lines: DataFrame) -> DataFrame:
    """doc_id, page and l, the page's lines in order with their folded text, all blanks as spaces: the glyphs are made of it where they are needed, not carried."""
    text = F.regexp_replace(_folded(F.coalesce("text", F.lit(""))), r"\s", " ")
    return lines.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(F.col("line_no").cast("int").alias("line_no"), text.alias("t")))).alias("l"))


def _exact(pages: DataFrame) -> DataFrame:
    """Adds flat, all glyphs of ``_page_lines``, and exact, those with one blank for a run of blanks."""
    def marks(x: Column) -> Column:
        glyph = lambda ch, i: F.struct(x["line_no"].alias("line_no"), i.alias("char_no"), ch.alias("ch"))
        between = F.array(F.struct(x["line_no"].alias("line_no"), F.lit(-1).alias("char_no"), F.lit(" ").alias("ch")))
        return F.concat(between, F.filter(F.transform(F.split(x["t"], ""), glyph), lambda g: ~g["ch"].isin("", GONE)))

    pages = pages.withColumn("_flat", F.flatten(F.transform("l", marks)))
    pages = pages.withColumn("flat", F.transform("_flat", lambda g, i: F.struct(i.alias("pos"), g["line_no"].alias("line_no"), g["char_no"].alias("char_no"), g["ch"].alias("ch")))).drop("_flat", "l")
    again = lambda i: F.coalesce(F.get(F.col("flat"), i - 1)["ch"], F.lit(" ")) == " "
    return pages.withColumn("exact", F.filter("flat", lambda g, i: (g["ch"] != " ") | ~again(i)))


def _loose(flat: Column) -> Column:
    return F.filter(flat, lambda g: g["ch"].rlike(r"^[\p{L}\p{N}]$"))


def page_index(lines: DataFrame) -> DataFrame:
    """doc_id, page, exact and loose: glyphs of each page in reading order, with one blank for a run of blanks, and its letters and digits only.

    A glyph is its place on the page, its line, its character there (-1 for the blank between lines) and
    its folded character. Zero-width characters are left out.
    """
    return _exact(_page_lines(lines)).select(*PAGE, "exact", _loose(F.col("flat")).alias("loose"))


def _spans(glyphs: Column, hay: Column, needle: Column) -> Column:
    return F.transform(occurrences(hay, needle), lambda s: F.struct(F.get(glyphs, s - 1).alias("first"), F.get(glyphs, s + F.length(needle) - 2).alias("last")))


def _chosen(asked: Column) -> Column:
    """Each anchor's span, in order: the state is the furthest end so far and the places taken."""
    state = F.struct(F.lit(-1).alias("reached"), F.array().cast("array<int>").alias("taken"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def place(at: Column, anchor: Column) -> Column:
        free = F.filter(anchor["spans"], lambda s: ~F.array_contains(at["taken"], s["first"]["pos"]))
        ahead = F.filter(free, lambda s: s["first"]["pos"] >= at["reached"])
        span = F.coalesce(F.get(ahead, F.lit(0)), F.get(free, F.lit(0)))
        taken = F.when(span.isNull(), at["taken"]).otherwise(F.array_append(at["taken"], span["first"]["pos"]))
        return F.struct(F.greatest(at["reached"], span["last"]["pos"]).alias("reached"), taken.alias("taken"), F.array_append(at["spans"], span).alias("spans"))

    return F.aggregate(asked, state, place, lambda at: at["spans"])


def resolve_anchors(anchors: DataFrame, lines: DataFrame) -> DataFrame:
    """First and last glyph of each anchor's text in the joined page text: line_no, first_char, last_line, last_char; without one the reason it is dropped.

    A page's anchors go in order of item_no: each takes the first unused occurrence at or after the end of
    those before, else the first unused one. An anchor without an exact occurrence (of normalised text) is
    looked up by its ASCII letters and digits, three at least, in the page's letters and digits.
    """
    needle = F.trim(F.regexp_replace(F.replace(_folded(F.coalesce("anchor_text", F.lit(""))), F.lit(GONE), F.lit("")), r"\s+", " "))
    asked = anchors.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("item_no", needle.alias("needle"), alnum_only(F.coalesce("anchor_text", F.lit(""))).alias("bare")))).alias("a"))
    none = F.array().cast(f"array<{GLYPH}>")
    rows = _exact(asked.join(_page_lines(lines), PAGE, "left")).withColumns({"flat": F.coalesce("flat", none), "exact": F.coalesce("exact", none)})
    joined = lambda glyphs: F.array_join(F.transform(glyphs, lambda g: g["ch"]), "")
    rows = rows.withColumn("hay", joined(F.col("exact")))
    # The page's letters and digits are wanted only by an anchor without an exact occurrence.
    missed = F.exists("a", lambda a: (F.length(a["bare"]) >= 3) & ((a["needle"] == "") | ~F.contains(F.col("hay"), a["needle"])))
    rows = rows.withColumn("loose", F.when(missed, _loose(F.col("flat"))).otherwise(none)).drop("flat")
    rows = rows.withColumn("letters", joined(F.col("loose")))

    def spans(a: Column) -> Column:
        whole = _spans(F.col("exact"), F.col("hay"), a["needle"])
        bare = F.when(F.length(a["bare"]) >= 3, _spans(F.col("loose"), F.col("letters"), a["bare"]))
        return F.when(F.size(whole) > 0, whole).otherwise(F.coalesce(bare, F.array().cast(f"array<{SPAN}>")))

    rows = rows.withColumn("asked", F.transform("a", lambda a: F.struct(a["item_no"].alias("item_no"), spans(a).alias("spans"))))
    hit = rows.select(*PAGE, F.explode(F.arrays_zip(F.col("a.item_no").alias("item_no"), _chosen(F.col("asked")).alias("span"))).alias("h"))
    first, last = F.col("h.span.first"), F.col("h.span.last")
    out = hit.select(*PAGE, F.col("h.item_no").alias("item_no"), first["line_no"].alias("line_no"), first["char_no"].alias("first_char"), last["line_no"].alias("last_line"), last["char_no"].alias("last_char"))
    return out.withColumn("dropped", F.when(F.col("line_no").isNull(), "anchor not found"))


def anchor_boxes(resolved: DataFrame, lines: DataFrame, advance: float = 5.0) -> DataFrame:
    """``resolved`` with the common box of the glyphs of each span: x0, y0, x1, y1 (null for dropped anchors)."""
    l = lines.select(*PAGE, F.col("line_no").alias("_line"), "x0", "y0", "y1", F.length("text").alias("_n"))
    rows = resolved.join(l, PAGE).filter(F.col("_line").between(F.col("line_no"), F.col("last_line")) & (F.col("_n") > 0))
    begin = F.when(F.col("_line") == F.col("line_no"), F.greatest("first_char", F.lit(0))).otherwise(0)
    end = F.when(F.col("_line") == F.col("last_line"), F.col("last_char")).otherwise(F.col("_n") - 1)
    boxes = rows.groupBy(*PAGE, "item_no").agg(F.min(F.col("x0") + advance * begin).alias("x0"), F.min("y0").alias("y0"), F.max(F.col("x0") + advance * (end + 1)).alias("x1"), F.max("y1").alias("y1"))
    return resolved.join(boxes, [*PAGE, "item_no"], "left")
