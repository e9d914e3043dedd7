"""Anchors, tables and answers on the layout tables: the joins that place and fill answer spaces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlens.functions.core import ZERO_WIDTH, clamp, is_empty_bullet, is_question_start, placeholder_text, strip_bullet, underscore_runs
from formlens.operators.layout import BOTTOM, LETTERS, MARGIN, PAGE, ROMAN, ROOM, by_buckets, cell_chars, grows, json_object, option_lines, stems


def page_base(anchors: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages counted from 1 (none below 1, the highest equal to the page count) are shifted to count from 0."""
    n = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    seen = anchors.groupBy("doc_id").agg(F.min("page").alias("low"), F.max("page").alias("high"))
    shift = seen.join(n, "doc_id").select("doc_id", ((F.col("low") >= 1) & (F.col("high") == F.col("n"))).cast("int").alias("s"))
    return anchors.join(shift, "doc_id").select("doc_id", "item_no", (F.col("page") - F.col("s")).alias("page"))


def slots(anchors: DataFrame, advance: float = 5.0, reach: float = 60.0, made: float = 130.0, margin: float = 572.0) -> DataFrame:
    """Blank beside each anchor (first and last character a0 and a1, position before or after) on its line: position, sx0, sx1, underscores.

    The nearest underscore run on the anchor's side within ``reach``; else a box made there: after the
    anchor up to the next printed text or the margin, before it at most ``made`` wide.
    """
    left = lambda i: F.col("x0") + advance * i
    after = F.get(F.filter("runs", lambda r: r["start"] > F.col("a1")), 0)
    before = F.try_element_at(F.filter("runs", lambda r: r["start"] + r["length"] <= F.col("a0")), F.lit(-1))
    is_after = F.col("position") == "after"
    rows = anchors.withColumn("runs", underscore_runs(F.col("text"))).withColumn("run", F.when(is_after, after).otherwise(before))
    gap = F.when(is_after, left(F.col("run.start")) - left(F.col("a1") + 1)).otherwise(left(F.col("a0")) - left(F.col("run.start") + F.col("run.length")))
    near = F.coalesce(gap <= reach, F.lit(False))
    rest = F.substr("text", F.col("a1") + 2)
    printed = F.when(F.trim(rest) != "", F.col("a1") + 1 + F.length(rest) - F.length(F.ltrim(rest)))
    limit, start = F.least(F.lit(margin), left(printed) - 4), left(F.col("a1") + 1) + 3
    end = F.when(limit - start >= 8, limit).otherwise(start + made)
    sx0 = F.when(near, left(F.col("run.start"))).when(is_after, start).otherwise(F.greatest(F.col("x0"), left(F.col("a0")) - made))
    sx1 = F.when(near, left(F.col("run.start") + F.col("run.length"))).when(is_after, end).otherwise(left(F.col("a0")) - 2)
    return rows.select(*PAGE, "line_no", "position", sx0.alias("sx0"), sx1.alias("sx1"), F.when(near, F.col("run.length")).otherwise(0).alias("underscores"))


def regions(anchors: DataFrame, lines: DataFrame) -> DataFrame:
    """Room under an anchor's line down to the next line with content, 25 points at least."""
    content = lines.filter(F.trim("text") != "").select(*PAGE, F.col("y0").alias("oy"))
    below = anchors.join(content, PAGE).filter(F.col("oy") >= F.col("y1")).groupBy(*PAGE, "line_no").agg(F.min("oy").alias("bottom"))
    out = anchors.join(below, [*PAGE, "line_no"], "left").withColumn("bottom", F.coalesce("bottom", F.lit(BOTTOM)))
    return out.filter(F.col("bottom") - F.col("y1") >= ROOM).select(*PAGE, "line_no", F.col("y1").alias("top"), "bottom")


def bullets_between(lines: DataFrame) -> DataFrame:
    """Empty bullets between a question and the next one of the page."""
    q = lines.filter(is_question_start(F.col("text"))).select(*PAGE, "line_no", F.coalesce(F.lead("line_no").over(Window.partitionBy(*PAGE).orderBy("line_no")), F.lit(2**31 - 1)).alias("until"))
    b = lines.filter(is_empty_bullet(F.col("text"))).select(*PAGE, F.col("line_no").alias("bullet"))
    return q.join(b, PAGE).filter((F.col("bullet") > F.col("line_no")) & (F.col("bullet") < F.col("until"))).select(*PAGE, "line_no", "bullet")


def choice_options(lines: DataFrame, advance: float = 5.0) -> DataFrame:
    """Options of each run: first_line, opt, label, system, text (wrapped lines joined) and the box of the label."""
    rows = option_lines(lines)
    end = F.regexp_instr(F.left("text", F.lit(8)), F.lit("[.)]"))
    label = F.col("token").isNotNull()
    size = F.when(end > 0, end).otherwise(F.least(F.length("text"), F.lit(8)))
    only = lambda c: F.when(label, F.col(c))
    boxes = [F.min(only("x0")).alias("x0"), F.min(only("y0")).alias("y0"), F.max(F.when(label, F.col("x0") + advance * size)).alias("x1"), F.max(only("y1")).alias("y1")]
    parts = F.sort_array(F.collect_list(F.struct("y0", "x0", "line_no", F.trim("text").alias("text"))))
    each = rows.groupBy(*PAGE, "first_line", "opt").agg(*boxes, F.first("system").alias("system"), F.max("token").alias("label"), parts.alias("p"))
    return each.select(*PAGE, "first_line", "opt", "label", "system", F.array_join(F.transform("p", lambda s: s["text"]), " ").alias("text"), "x0", "y0", "x1", "y1")


def choice_units(lines: DataFrame) -> DataFrame:
    """Runs of options with their stem, texts and the common box of their labels."""
    options = F.sort_array(F.collect_list(F.struct("opt", "text")))
    out = choice_options(lines).groupBy(*PAGE, "first_line").agg(F.count("*").alias("n"), F.first("system").alias("system"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), options.alias("o"))
    out = out.select(*PAGE, "first_line", "n", "system", "x0", "y0", "x1", "y1", F.array_join(F.transform("o", lambda x: x["text"]), " | ").alias("options"))
    return out.join(stems(lines).select(*PAGE, "first_line", "stem"), [*PAGE, "first_line"], "left")


def suppress(units: DataFrame, bands: DataFrame) -> DataFrame:
    """Units (y) whose centre lies in no multiple-choice band (first_line, y0, y1) of their page."""
    b = bands.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("y0").alias("b0"), F.col("y1").alias("b1"))
    return units.join(b, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & F.col("y").between(F.col("b0"), F.col("b1")), "left_anti")


def chosen_option(units: DataFrame, answers: DataFrame) -> DataFrame:
    """Option label that an answer names: its leading letters, else their first; null if it isn't offered."""
    token = F.nullif(F.regexp_extract(F.upper(F.trim("answer")), r"^\(?([A-Z]+)", 1), F.lit(""))
    rows = units.join(answers, [*PAGE, "first_line"]).withColumn("token", token)
    labels = lambda system: F.slice(F.array(*map(F.lit, system)), F.lit(1), F.col("n").cast("int"))
    offered = F.when(F.col("system") == "roman", labels(ROMAN)).otherwise(labels(LETTERS))
    first = F.left("token", F.lit(1))
    return rows.select(*PAGE, "first_line", F.when(F.array_contains(offered, F.col("token")), F.col("token")).when(F.array_contains(offered, first), first).alias("label"))


def clamped_regions(lines: DataFrame, obstacles: DataFrame) -> DataFrame:
    """Room under each question down to the next question or the nearest obstacle that overlaps it sideways."""
    q = lines.filter(is_question_start(F.col("text"))).select(*PAGE, "line_no", "x0", "x1", F.col("y1").alias("top"), F.lead("y0").over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "line_no")).alias("next"))
    o = obstacles.select(*PAGE, F.col("x0").alias("ox0"), F.col("x1").alias("ox1"), F.col("y0").alias("oy"))
    hit = q.join(o, PAGE).filter((F.col("oy") >= F.col("top")) & (F.col("ox0") < F.col("x1")) & (F.col("ox1") > F.col("x0"))).groupBy(*PAGE, "line_no").agg(F.min("oy").alias("oy"))
    return q.join(hit, [*PAGE, "line_no"], "left").select(*PAGE, "line_no", "top", F.least(F.coalesce("next", F.lit(BOTTOM)), F.coalesce("oy", F.lit(BOTTOM))).alias("bottom"))


def table_prompts(cells: DataFrame) -> DataFrame:
    """Cells (row, col, n, text with placeholders) as the lines of a prompt.

    The first row is the header if none of its cells has a blank; the others' lines then name it, else
    every line names its row and column. Empty cells have no line.
    """
    head = F.max(F.when(F.col("row") == 0, F.col("n"))).over(Window.partitionBy(*PAGE))
    name = F.max(F.when(F.col("row") == 0, F.col("text"))).over(Window.partitionBy(*PAGE, "col"))  # not a join: it would make the cells twice
    rows = cells.withColumns({"has_header": F.coalesce(head, F.lit(0)) == 0, "h": name})
    body = rows.filter("text <> '' and (row > 0 or not has_header)")
    named = F.concat(F.lit('  [under "'), F.coalesce("h", F.lit("")), F.lit('"] '), F.col("text"))
    placed = F.concat(F.lit("  [r"), F.col("row").cast("string"), F.lit("c"), F.col("col").cast("string"), F.lit("] "), F.col("text"))
    parts = F.sort_array(F.collect_list(F.struct("row", "col", F.when(F.col("has_header"), named).otherwise(placed).alias("t"))))
    return body.groupBy(*PAGE).agg(F.concat(F.lit("TABLE:\n"), F.array_join(F.transform(parts, lambda p: p["t"]), "\n")).alias("prompt"))


def table_regions(chars: DataFrame, cells: DataFrame, room: float = 30.0) -> DataFrame:
    """Free room at the foot of each cell, where there is enough."""
    used = cell_chars(chars, cells).groupBy(*PAGE, "row", "col").agg(F.max("y1").alias("u"))
    out = cells.join(used, [*PAGE, "row", "col"], "left").withColumn("top", F.coalesce("u", "cy0"))
    return out.filter(F.col("cy1") - F.col("top") >= room).select(*PAGE, "row", "col", "top", F.col("cy1").alias("bottom"))


def cell_lines(lines: DataFrame, cells: DataFrame, advance: float = 5.0, size: float = 64.0) -> DataFrame:
    """Text of each line within each table cell, where it begins (x0), the line's y0 and y1, and n, the text's number of blanks.

    The same cells and edges as in ``cell_chars``, but lines meet cells and each pair is a cut of the line, so no
    row stands for a character.
    """
    y = (F.col("y0") + F.col("y1")) / 2
    held = lines.withColumn("_y", F.floor(y / size)).join(grows(by_buckets(cells, "y", size=size)), [*PAGE, "_y"]).filter((y >= F.col("cy0")) & (y < F.col("cy1")))
    # Character i has its centre at x0 + (i + 1/2) advance: how many centres lie left of an edge.
    left_of = lambda edge: F.greatest(F.lit(0), F.ceil((F.col(edge) - F.col("x0")) / advance - 0.5)).cast("int")
    held = held.withColumns({"_a": left_of("cx0"), "_b": left_of("cx1")})
    held = held.withColumn("cut", F.substring("text", F.col("_a") + 1, F.col("_b") - F.col("_a"))).filter("cut <> ''")
    return held.select(*PAGE, "row", "col", "line_no", F.col("cut").alias("text"), (F.col("x0") + advance * F.col("_a")).alias("x0"), "y0", "y1", F.regexp_count("cut", F.lit("_+")).alias("n"))


def slot_rows(cells: DataFrame, found: DataFrame) -> DataFrame:
    """``slot_registry`` of all rows, with their text (of cells only); first_slot is null for rows without blanks."""
    none = F.lit(None).cast("int")
    inline = found.filter("kind = 'inline_blank'").select(*PAGE, F.lit(1).alias("after_table"), none.alias("row"), none.alias("col"), "line_no", F.lit(None).cast("string").alias("text"), F.col("blanks").alias("n"))
    inside = cells.select(*PAGE, F.lit(0).alias("after_table"), "row", "col", "line_no", "text", "n")
    before = Window.partitionBy("doc_id").orderBy("page", "after_table", "row", "col", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = inside.unionByName(inline).withColumn("through", F.sum("n").over(before))
    return rows.withColumn("first_slot", F.when(F.col("n") > 0, F.col("through") - F.col("n") + 1)).drop("through")


def slot_registry(cells: DataFrame, found: DataFrame) -> DataFrame:
    """The one numbering of a document's blanks: on each page those of its table's cells, then those of its inline units, in order.

    ``cells`` are cell_lines, ``found`` detected lines. Rows with blanks only: doc_id, page, after_table (0 or
    1), row and col (null outside the table), line_no, n, first_slot. Slots count from 1 in each document, in one running
    pass over its rows.
    """
    return slot_rows(cells, found).filter("n > 0").drop("text")


def filled_cells(rows: DataFrame) -> DataFrame:
    """Cells of ``slot_rows`` with their text, blanks as {{sN}}: row, col, n, first_slot (null without blanks), text."""
    rows = rows.filter("after_table = 0")
    rows = rows.select(*PAGE, "row", "col", "line_no", placeholder_text(F.col("text"), F.coalesce("first_slot", F.lit(1))).alias("t"), F.col("n").alias("blanks"), F.col("first_slot").alias("first"))
    parts = F.sort_array(F.collect_list(F.struct("line_no", "t")))
    out = rows.groupBy(*PAGE, "row", "col").agg(F.sum("blanks").alias("n"), F.min("first").alias("first_slot"), parts.alias("p"))
    text = F.array_join(F.transform("p", lambda p: p["t"]), " ")
    return out.select(*PAGE, "row", "col", "n", "first_slot", F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"))


def slot_ids(first: Column, n: Column) -> Column:
    """Ids of n slots from the first on."""
    return F.when(n > 0, F.transform(F.sequence(first, first + n - 1), lambda i: F.concat(F.lit("s"), i.cast("string")))).otherwise(F.array().cast("array<string>"))


def cell_slots(cells: DataFrame) -> DataFrame:
    """Filled cells with blanks: their text with placeholders and their slot ids."""
    return cells.filter("n > 0").withColumn("slots", F.array_join(slot_ids(F.col("first_slot"), F.col("n")), ","))


def table_slots(cells: DataFrame) -> DataFrame:
    """All slot ids of each page's table, in order of its cells."""
    parts = F.sort_array(F.collect_list(F.struct("row", "col", slot_ids(F.col("first_slot"), F.col("n")).alias("s"))))
    return cells.filter("n > 0").groupBy(*PAGE).agg(F.array_join(F.flatten(F.transform(parts, lambda p: p["s"])), ",").alias("slots"))


#: Kinds and blank positions of a model's items.
ITEM_KINDS, ITEM_POSITIONS = ["inline", "open"], ["after", "before", "none"]


def anchor_items(df: DataFrame, column: str = "reply") -> DataFrame:
    """Items of a model's reply, {"items": [...]}, that keep to the schema, and their place by page and the model's order.

    Kind and blank position must come from their lists, the anchor text must not be blank, nor the page
    below 0; item_no counts all items of the reply. Thoughts, fences and prose round the object are
    passed over; a reply without such an object has no items.
    """
    schema = "struct<items:array<struct<page:int,kind:string,anchor_text:string,blank_position:string>>>"
    rows = df.select("doc_id", F.posexplode(F.from_json(json_object(F.col(column)), schema)["items"]).alias("item_no", "i")).select("doc_id", "item_no", "i.*")
    rows = rows.filter(F.col("kind").isin(ITEM_KINDS) & F.col("blank_position").isin(ITEM_POSITIONS) & (F.trim("anchor_text") != "") & (F.col("page") >= 0))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "item_no")))


def _slot_boxes(rows: DataFrame, advance: float) -> DataFrame:
    """A box just above each underscore run of lines (text, x0, y1, first_slot), keyed by its slot."""
    runs = rows.select(*PAGE, "x0", "y1", "first_slot", F.posexplode(underscore_runs(F.col("text"))).alias("i", "r"))
    left = F.col("x0") + advance * F.col("r.start")
    return runs.select(*PAGE, F.concat(F.lit("s"), (F.col("first_slot") + F.col("i")).cast("string")).alias("key"), left.alias("x0"), (F.col("y1") - 13).alias("y0"), (left + advance * F.col("r.length")).alias("x1"), (F.col("y1") + 1).alias("y1"))


def overlays(lines: DataFrame, units: DataFrame, cells: DataFrame, bullets: DataFrame, answers: DataFrame, advance: float = 5.0) -> DataFrame:
    """Editable boxes of numbered units and answers (doc_id, slot, answer): kind, key, box and text.

    ``units`` are detected lines with their numbers, ``cells`` cell_lines, ``bullets`` bullet_answers. Each blank of
    a unit or a table cell has a box just above its underscores and the text of its slot. An open response has
    the room below its group, an empty bullet and a label with a dash what is right of them on their line,
    each with the text of its unit; all are empty without an answer. A choice is a circle round the
    label that the answer to its unit names, and nothing without one.
    """
    lines, units, cells, bullets, answers = map(grows, (lines, units, cells, bullets, answers))
    said = answers.withColumnRenamed("slot", "key")
    slots = slot_registry(cells, units)
    blanks = units.filter("kind = 'inline_blank'").join(slots.filter("after_table = 1").select(*PAGE, "line_no", "first_slot"), [*PAGE, "line_no"])
    inside = cells.join(slots.filter("after_table = 0").select(*PAGE, "row", "col", "line_no", "first_slot"), [*PAGE, "row", "col", "line_no"])
    box = lambda rows, x0, y0, x1, y1: rows.select(*PAGE, F.col("unit_id").alias("key"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    edge, right = F.lit(MARGIN), F.col("x1") + 6
    spaces = box(units.filter("kind = 'open_response' and line_no = unit_line"), F.col("gx0") + 4, F.col("gy1") + 4, F.greatest("gx1", edge), F.col("bottom") - 6)
    dashes = box(units.filter("kind = 'trailing_dash'"), right, F.col("y0"), edge, F.col("y1"))
    dots = units.filter("kind = 'bullet'").drop("bottom").join(bullets.select(*PAGE, "line_no", "bottom"), [*PAGE, "line_no"])
    dots = box(dots, right, F.col("y0"), edge, F.greatest("y1", F.col("bottom") - 2))
    parts = [_slot_boxes(blanks, advance), _slot_boxes(inside, advance), spaces, dashes, dots]
    texts = reduce(DataFrame.unionByName, parts).withColumn("kind", F.lit("text")).join(said, ["doc_id", "key"], "left").withColumn("text", F.coalesce("answer", F.lit(""))).drop("answer")
    asked = units.filter("kind = 'multiple_choice' and line_no = unit_line").select(*PAGE, F.col("line_no").alias("first_line"), F.col("unit_id").alias("key")).join(said, ["doc_id", "key"])
    options = choice_options(lines)
    runs = options.groupBy(*PAGE, "first_line", "system").agg(F.count("*").alias("n"))
    named = chosen_option(runs, asked.select(*PAGE, "first_line", "answer")).join(asked.drop("answer"), [*PAGE, "first_line"])
    circles = named.join(options, [*PAGE, "first_line", "label"]).select(*PAGE, F.lit("circle").alias("kind"), "key", "x0", "y0", "x1", "y1", F.lit("").alias("text"))
    return texts.unionByName(circles)


def model_units(lines: DataFrame, units: DataFrame, cells: DataFrame, bullets: DataFrame) -> DataFrame:
    """What a model is shown of numbered units, without geometry: unit_id, kind, prompt, and how to answer.

    Inline units have slots by the registry, placed in the joined text of their lines as well; a choice has its
    stem and options; an open response the text of its group, an empty bullet that of the line it answers, a label
    its own without the bullet. All but inline units are answered by answer_key. ``lines`` are those outside tables, marked (``page_marks``) or not.
    """
    lines, units, cells, bullets = map(grows, (lines, units, cells, bullets))
    none = F.lit(None).cast("string")
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", "line_no", c.alias("t")))), lambda s: s["t"]), " ")
    slots = slot_registry(cells, units).filter("after_table = 1").select(*PAGE, "line_no", "n", "first_slot")
    own = units.filter("kind = 'inline_blank'").join(slots, [*PAGE, "line_no"], "left")
    text = F.when(F.col("n") > 0, placeholder_text(F.col("text"), F.coalesce("first_slot", F.lit(1)))).otherwise(F.col("text"))
    blanks = own.groupBy("doc_id", "unit_id", "kind").agg(joined(text).alias("t"), F.min("first_slot").alias("f"), F.sum("n").alias("n"))
    blanks = blanks.select("doc_id", "unit_id", "kind", tidy(strip_bullet(F.col("t"))).alias("prompt"), none.alias("answer_key"), F.array_join(slot_ids(F.col("f"), F.col("n")), ",").alias("slots"), none.alias("options"))
    options = F.sort_array(F.collect_list(F.struct("opt", "label", "text")))
    runs = choice_options(lines).groupBy(*PAGE, "first_line").agg(options.alias("o")).join(stems(lines).drop("stem_line"), [*PAGE, "first_line"], "left")
    runs = units.filter("kind = 'multiple_choice' and line_no = unit_line").select(*PAGE, "unit_id", "kind", F.col("line_no").alias("first_line")).join(runs, [*PAGE, "first_line"])
    prompt = F.trim(F.concat(F.coalesce("stem", F.lit("")), F.lit("  "), F.array_join(F.transform("o", lambda x: x["text"]), "  ")))
    offered = F.array_join(F.transform("o", lambda x: F.concat(x["label"], F.lit(": "), x["text"])), " | ")
    by_key = lambda rows, prompt, options=none: rows.select("doc_id", "unit_id", "kind", prompt.alias("prompt"), F.col("unit_id").alias("answer_key"), none.alias("slots"), options.alias("options"))
    groups = units.filter("kind = 'open_response'").groupBy("doc_id", "unit_id", "kind").agg(joined(F.col("text")).alias("t"))
    dots = units.filter("kind = 'bullet'").join(bullets.select(*PAGE, "line_no", "prompt"), [*PAGE, "line_no"])
    rest = units.filter("kind in ('trailing_dash', 'multiple_choice_inline')")
    label = F.when(F.col("kind") == "trailing_dash", tidy(F.regexp_replace(strip_bullet(F.col("text")), f"[{ZERO_WIDTH}]", ""))).otherwise(F.trim("text"))
    parts = [blanks, by_key(runs, prompt, offered), by_key(groups, tidy(F.col("t"))), by_key(dots, F.col("prompt")), by_key(rest, label)]
    return reduce(DataFrame.unionByName, parts)


def answer_centres(units: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """y-centre of every answer space of detected lines: one for each inline blank, one for each other unit but choices.

    With ``cells`` (cell_lines) also one for each blank of the tables' cells: slots of a line count through its cells.
    """
    own = units.filter("kind = 'inline_blank' or line_no = unit_line and kind not in ('multiple_choice', 'multiple_choice_inline')")
    many = F.when(F.col("kind") == "inline_blank", F.col("blanks")).otherwise(1)
    y = (F.col("y0") + F.col("y1")) / 2
    rows = own.select(*PAGE, "line_no", y.alias("y"), many.cast("long").alias("many"))
    if cells is not None:
        rows = rows.unionByName(cells.groupBy(*PAGE, "line_no", y.alias("y")).agg(F.sum("n").alias("many")))
    return rows.filter("many > 0").select(*PAGE, "line_no", "y", F.explode(F.sequence(F.lit(1).cast("long"), F.col("many"))).alias("slot"))


def clean_overlays(df: DataFrame, pages: DataFrame, most_points: int = 2000) -> DataFrame:
    """Overlays of the editor as they are kept: page inside the document, sizes, fonts, colours and widths within their ranges.

    Ink (points, color, width) needs two points at least and keeps the first ``most_points``; every other
    kind (bbox, size, font) needs a box of four numbers.
    """
    n = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    ink = F.coalesce("kind", F.lit("")) == "ink"
    points = F.slice("points", 1, most_points)
    color = F.lower(F.coalesce("color", F.lit("")))
    ok = F.when(ink, F.coalesce(F.size(points) >= 2, F.lit(False)) & ~F.exists(points, lambda p: F.size(p) != 2)).otherwise(F.coalesce(F.size("bbox") == 4, F.lit(False)))
    rows = df.join(n, "doc_id").filter((F.col("page") >= 0) & (F.col("page") < F.col("n")) & ok)
    of = lambda is_ink, c: F.when(ink == is_ink, c)
    return rows.select(
        "doc_id", "page", "line_no", F.when(F.col("kind").isin("ink", "circle"), F.col("kind")).otherwise("text").alias("kind"),
        of(True, F.size(points)).alias("n_points"), of(True, F.when(color.rlike(r"\A#[0-9a-f]{6}\z"), color).otherwise("#1a1a1a")).alias("color"), of(True, clamp(F.col("width"), 0.5, 20.0, 2.0)).alias("width"),
        of(False, clamp(F.col("size"), 6.0, 48.0, 11.0)).alias("size"), of(False, F.when(F.col("font").isin("sans", "serif", "mono"), F.col("font")).otherwise("sans")).alias("font"),
    )
