"""Document layout over line tables: groups, options, bullets, answer regions, anchors and scoring.

Every window and join has the equi key (doc_id, page), so a long document spreads over its pages.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlens.functions.core import FORMATS, LOOK_ALIKES, ZERO_WIDTH, is_bulleted, is_empty_bullet, is_question_start, strip_bullet

PAGE = ["doc_id", "page"]
BOTTOM, ROOM, MARGIN = 732.0, 25.0, 572.0
#: Fixed value: what an answer without a prompt is asked for.
NO_PROMPT = "Fill in this answer."
CONTINUED = 6.0  # how close below its label a wrapped line may stand
#: The dashes that end a label.
LABEL_DASHES = "-‐‑‒–—―"
#: The labels of the two systems, in order.
LETTERS = list("ABCDEFGH")
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII"]


def by_page(*along: str) -> Window:
    """A page's lines from the top. ``along``: an ascending number of pieces of the page, by which the rows are sorted already."""
    return Window.partitionBy(*PAGE).orderBy(*along, "y0", "x0", "line_no")


def piece(name: str) -> Window:
    """All lines of a numbered piece of the page; it needs the same sort as ``by_page(name)``."""
    return Window.partitionBy(*PAGE, name).orderBy("y0", "x0", "line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def grows(table: DataFrame) -> DataFrame:
    """A table with rows for each page or line, to be joined by sort and merge.

    Where it comes from a stored file, Spark takes the size of that file, which is compressed and may lack what is made from each
    row, for the table's. By that it would broadcast tables of many times its limit, which the driver collects whole.
    """
    return table.hint("merge")


def reading_order(lines: DataFrame) -> DataFrame:
    """Rank of each line by rows of three points, then from the left."""
    rank = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.bround(F.col("y0") / 3) * 3, "x0", "line_no"))
    return lines.select(*PAGE, "line_no", rank.alias("rank"))


def _islands(lines: DataFrame, starts: Column, name: str, *along: str) -> DataFrame:
    run = F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(by_page(*along).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn(name, run)


def logical_units(lines: DataFrame, gap: float = 14.0) -> DataFrame:
    """A unit starts at a bullet, a number or a gap."""
    above = F.lag("y1").over(by_page())
    return _islands(lines, is_bulleted(F.col("text")) | is_question_start(F.col("text")) | (F.col("y0") - above > gap), "unit").select(*PAGE, "line_no", "unit")


def prompt_groups(lines: DataFrame, gap: float = 10.0, indent: float = 30.0) -> DataFrame:
    """Lines close below each other with about the same indent, joined."""
    near = (F.col("y0") - F.lag("y1").over(by_page()) < gap) & (F.abs(F.col("x0") - F.lag("x0").over(by_page())) < indent)
    rows = _islands(lines, ~near, "grp")
    parts = F.sort_array(F.collect_list(F.struct("y0", "x0", "line_no", "text")))
    out = rows.groupBy(*PAGE, "grp").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), parts.alias("p"))
    return out.select(*PAGE, "grp", "n_lines", "first_line", "x0", "y0", "x1", "y1", F.array_join(F.transform("p", lambda s: s["text"]), " ").alias("text"))


def group_bbox(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*PAGE).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def glyphs(lines: DataFrame, advance: float = 5.0, run: int = 1) -> DataFrame:
    """Characters with a fixed advance, one row each, or one row for a run of up to ``run`` that adjoin: char_no is its first, ch all of them."""
    pieces = F.split("text", "") if run == 1 else F.regexp_extract_all("text", F.lit(f"(?s).{{1,{run}}}"), F.lit(0))
    rows = lines.select(*PAGE, "line_no", "x0", "y0", "y1", F.posexplode(pieces).alias("i", "ch")).filter("ch <> ''").withColumn("char_no", F.col("i") * run)
    x = F.col("x0") + advance * F.col("char_no")
    return rows.select(*PAGE, "line_no", "char_no", "ch", x.alias("x0"), "y0", (x + advance * F.length("ch")).alias("x1"), "y1")


def line_text(chars: DataFrame) -> DataFrame:
    """Characters, or runs of them, assembled into lines in order, with the lines' boxes."""
    parts = F.sort_array(F.collect_list(F.struct("char_no", "ch")))
    return chars.groupBy(*PAGE, "line_no").agg(F.array_join(F.transform(parts, lambda s: s["ch"]), "").alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def label_box(chars: DataFrame) -> DataFrame:
    """Box of an option label: the characters through the first . or ) of the first eight."""
    parts = F.sort_array(F.collect_list(F.struct("char_no", "ch", "x0", "x1")))
    rows = chars.filter("char_no < 8").groupBy(*PAGE, "line_no").agg(parts.alias("p"))
    text = F.array_join(F.transform("p", lambda s: s["ch"]), "")
    end = F.nullif(F.least(*(F.when(F.instr(text, c) > 0, F.instr(text, c)) for c in ".)")), F.lit(0))
    return rows.withColumn("n", end).filter("n is not null").select(*PAGE, "line_no", F.col("p")[0]["x0"].alias("x0"), F.element_at("p", F.col("n")).getField("x1").alias("x1"))


def bullet_answers(lines: DataFrame) -> DataFrame:
    """Empty bullets with the last line of text above as prompt, its own bullet left out, and room down to the next line; blank lines don't count."""
    text = F.col("text")
    real = lambda c: F.last(F.when(~is_empty_bullet(text), c), ignorenulls=True).over(by_page().rowsBetween(Window.unboundedPreceding, -1))
    rows = lines.filter(text.rlike(r"\S"))
    prompt = F.trim(F.regexp_replace(strip_bullet(text), r"\s+", " "))
    rows = rows.withColumns({"prompt_line": real(F.col("line_no")), "prompt": real(prompt), "bottom": F.coalesce(F.lead("y0").over(by_page()), F.lit(BOTTOM))})
    rows = rows.filter(is_empty_bullet(text)).withColumn("prompt", F.coalesce("prompt", F.lit(NO_PROMPT)))
    return rows.select(*PAGE, "line_no", "prompt_line", "prompt", F.col("y0").alias("top"), "bottom")


def bullet_parts(answers: DataFrame) -> DataFrame:
    """Numbers the bullets of one prompt: part k of n."""
    w = Window.partitionBy(*PAGE, "prompt_line")
    return answers.select(*PAGE, "line_no", "prompt_line", F.row_number().over(w.orderBy("line_no")).alias("part"), F.count("*").over(w).alias("parts"))


#: What a label's letters may be in a text, before look-alikes are folded.
LABEL_LETTERS = "A-Za-z" + "".join(LOOK_ALIKES)


def _folded(labels: Column) -> Column:
    """Labels in upper case, look-alikes folded. It is asked of labels only: folding a whole text costs more than finding them."""
    return F.translate(labels, ascii_lowercase + "".join(LOOK_ALIKES), ascii_uppercase + "".join(LOOK_ALIKES.values()))


def option_token(text: Column) -> Column:
    """Leading option label in upper case, look-alikes folded: one to four letters, a mark and a text; null if there is none."""
    return F.nullif(_folded(F.regexp_extract(text, rf"^\s*([{LABEL_LETTERS}]{{1,4}})\s*[.)]\s+\S", 1)), F.lit(""))


def label_system(token: Column) -> Column:
    """letter for A to H, roman for I to XII; no token is in both."""
    return F.when(token.isin(LETTERS), "letter").when(token.isin(ROMAN), "roman")


def label_ordinal(token: Column) -> Column:
    """Place of a label in its system, from 1; null if it is in none."""
    place = lambda labels: F.nullif(F.array_position(F.array(*map(F.lit, labels)), token).cast("int"), F.lit(0))
    return F.coalesce(place(LETTERS), place(ROMAN))


def marked_lines(lines: DataFrame) -> DataFrame:
    """All lines with the option run they belong to and the run whose stem they are: one pass of windows over each page.

    A run opens with a system's first label and goes on with the next one each time; a line without a
    label that stands close below the last label's line belongs to its option. A run's stem is the lines
    above it, up to a wide ``gap``, another run, or a question's start, which is the last. Adds token (null
    on wrapped lines), system, opt (number of the option), n (options of the run), first_line (of the run;
    null outside) and stem_of (first line of the run that the line introduces; null for others).
    """
    if "stem_of" in lines.columns:
        return lines  # marked already
    return _marked(_flagged(lines)).drop("seg", *FLAGS).select(*lines.columns, *CHOICE)


#: Columns that ``marked_lines`` adds, and what the windows need to know of a line's text, so that they needn't carry it.
CHOICE = ["token", "system", "opt", "n", "first_line", "stem_of"]
FLAGS = ["inline", "heading", "filled", "underscored", "starts_unit"]


def _flagged(lines: DataFrame) -> DataFrame:
    text = F.col("text")
    question = is_question_start(text)
    flags = [has_inline_options(text), question | text.rlike("^ *(?i:question)"), text.rlike(r"\S"), text.contains("_"), is_bulleted(text) | question]
    return lines.withColumn("token", option_token(text)).withColumns(dict(zip(FLAGS, flags)))


def _marked(rows: DataFrame, gap: float = 26.0) -> DataFrame:
    """``marked_lines`` of flagged lines, sorted by seg within each page."""
    order = by_page()
    before, through = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"system": label_system(F.col("token")), "ord": label_ordinal(F.col("token"))})
    below = F.col("y0") - F.last(F.when(F.col("token").isNotNull(), F.col("y1")), ignorenulls=True).over(before)
    apart = F.col("token").isNull() & ~F.coalesce(below.between(0.0, CONTINUED), F.lit(False))
    near = F.coalesce(F.col("y0") - F.lag("y1").over(order) <= gap, F.lit(False))
    rows = rows.withColumns({"apart": apart, "near": near}).withColumn("part", F.sum(F.col("apart").cast("int")).over(through))
    last = F.last(F.when(F.col("token").isNotNull(), F.struct("system", "ord", "part")), ignorenulls=True).over(before)
    rows = rows.withColumn("last", last)
    goes_on = F.coalesce((F.col("last.part") == F.col("part")) & (F.col("last.system") == F.col("system")) & (F.col("last.ord") + 1 == F.col("ord")), F.lit(False))
    opens = F.when(F.col("token").isNotNull(), ~goes_on).otherwise(F.col("apart"))
    rows = rows.withColumn("run", F.sum(opens.cast("int")).over(through)).drop("apart", "part", "last")
    run = piece("run")
    opt = F.count("token").over(run.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"opt": opt, "low": F.min("ord").over(run), "n": F.count("token").over(run), "system": F.first("system", ignorenulls=True).over(run), "top": F.min("line_no").over(run)})
    rows = rows.withColumn("first_line", F.when((F.col("n") >= 2) & (F.col("low") == 1), F.col("top")))
    rows = rows.withColumn("held", F.col("first_line").isNotNull() | F.col("inline")).drop("ord", "low", "top")
    rows = _islands(rows, ~F.col("near") | F.col("heading") | F.col("held") | F.lag("held").over(by_page("run")), "seg", "run")
    introduces = F.lead(F.when(F.col("near") & (F.col("first_line") == F.col("line_no")), F.col("line_no"))).over(by_page("run"))
    rows = rows.withColumn("introduces", introduces).drop("near", "run")
    return rows.withColumn("stem_of", F.when(~F.col("held"), F.max("introduces").over(piece("seg")))).drop("held", "introduces")


def option_lines(lines: DataFrame) -> DataFrame:
    """Lines of option runs; see ``marked_lines``."""
    return marked_lines(lines).filter("first_line is not null").drop("stem_of")


def stacked_options(lines: DataFrame) -> DataFrame:
    """Runs of options on lines of their own, two at least: first_line, last_line, n_options, system."""
    figures = [F.max("line_no").alias("last_line"), F.first("n").cast("int").alias("n_options"), F.first("system").alias("system")]
    return option_lines(lines).groupBy(*PAGE, "first_line").agg(*figures)


def _labels(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?:(?<=\s)|^)([{LABEL_LETTERS}]{{1,4}})[.)](?=\s)"), F.lit(1))


def inline_labels(text: Column) -> Column:
    """All labels on a line, in order."""
    return F.transform(_labels(text), _folded)


def has_inline_options(text: Column) -> Column:
    """Three labels or more, in sequence from a system's first. Labels are taken only from lines that hold a second one, B or II."""
    joined = F.concat(_folded(F.array_join(_labels(text), ",")), F.lit(","))
    runs = lambda system: joined.startswith(",".join(system[:3]) + ",") & F.lit(",".join(system) + ",").startswith(joined)
    likely = text.rlike(rf"\s(?:[Bb{''.join(k for k, v in LOOK_ALIKES.items() if v == 'B')}]|[Ii]{{2}})[.)]\s")
    return F.when(likely, runs(LETTERS) | runs(ROMAN)).when(text.isNotNull(), False)  # likely would be asked again in a last branch of its own


def inline_options(lines: DataFrame) -> DataFrame:
    """Three labels or more in sequence on one line."""
    return lines.filter(has_inline_options(F.col("text"))).select(*PAGE, "line_no", F.size(inline_labels(F.col("text"))).alias("n_options"))


def stems(lines: DataFrame) -> DataFrame:
    """Stem of each run of options: its first line, and its text with spaces collapsed."""
    parts = F.sort_array(F.collect_list(F.struct("y0", "x0", "line_no", "text")))
    rows = marked_lines(lines).filter("stem_of is not null").groupBy(*PAGE, "stem_of")
    out = rows.agg(F.min("line_no").alias("stem_line"), parts.alias("p"))
    text = F.array_join(F.transform("p", lambda s: s["text"]), " ")
    return out.select(*PAGE, F.col("stem_of").alias("first_line"), "stem_line", F.trim(F.regexp_replace(text, r"\s+", " ")).alias("stem"))


def with_room(rows: DataFrame, obstacles: DataFrame | None = None, gap: float = 10.0, indent: float = 30.0) -> DataFrame:
    """Lines with the prompt group they belong to and the room below it: one sweep down each page over the ``free`` lines.

    Free lines close below each other with about the same indent are one group. Its floor is the next group, the foot
    of the page or the nearest obstacle (x0, y0, x1) below it that reaches between its left edge and the margin.
    Adds unit_line (the group's first line), gx0, gy0, gx1, gy1 (its box), bottom and open: whether a
    written answer fits and the group has no underscores. Lines that aren't free are passed over.
    """
    return _with_room(rows.withColumn("underscored", F.contains("text", F.lit("_"))), obstacles, gap, indent).drop("underscored", "grp")


def _with_room(rows: DataFrame, obstacles: DataFrame | None, gap: float = 10.0, indent: float = 30.0, *along: str) -> DataFrame:
    """``with_room`` of rows with the flag underscored; keeps the group's number grp."""
    order, free = by_page(*along), F.col("free")
    above = F.last(F.when(free, F.struct("x0", "y1")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    near = (F.col("y0") - F.col("above.y1") < gap) & (F.abs(F.col("x0") - F.col("above.x0")) < indent)
    rows = rows.withColumn("above", above).withColumn("starts", free & ~F.coalesce(near, F.lit(False))).drop("above")
    following = F.expr("lead(if(starts, y0, null)) ignore nulls").over(order)
    rows = rows.withColumns({"grp": F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), "next": following}).drop("starts", *along)
    own = lambda f, c: f(F.when(free, c)).over(piece("grp"))
    first = own(F.min, F.struct("y0", "x0", "line_no"))["line_no"]
    rows = rows.withColumns({"unit_line": first, "gx0": own(F.min, F.col("x0")), "gy0": own(F.min, F.col("y0")), "gx1": own(F.max, F.col("x1")), "gy1": own(F.max, F.col("y1")), "ruled": own(F.max, F.col("underscored")), "bottom": F.coalesce("next", F.lit(BOTTOM))})
    if obstacles is not None:
        on_page = obstacles.groupBy(*PAGE).agg(F.collect_list(F.struct(F.col("x0").alias("ox0"), F.col("y0").alias("oy"), F.col("x1").alias("ox1"))).alias("ob"))
        met = F.filter("ob", lambda o: (o["oy"] >= F.col("gy1")) & (o["oy"] < F.col("bottom")) & (o["ox0"] < MARGIN) & (o["ox1"] > F.col("gx0")))
        rows = rows.join(grows(on_page), PAGE, "left").withColumn("bottom", F.coalesce(F.array_min(F.transform(met, lambda o: o["oy"])), "bottom")).drop("ob")
    return rows.withColumn("open", free & ~F.col("ruled") & (F.col("bottom") - F.col("gy1") >= ROOM)).drop("next", "ruled")


def open_responses(lines: DataFrame, obstacles: DataFrame | None = None) -> DataFrame:
    """Prompt groups, numbered or not, with room for an answer: line_no (the first line), n_lines, top and bottom of the room."""
    rows = with_room(lines.withColumn("free", F.col("text").rlike(r"\S")), obstacles).filter("open")
    out = rows.groupBy(*PAGE, "unit_line").agg(F.count("*").alias("n_lines"), F.first("gy1").alias("top"), F.first("bottom").alias("bottom"))
    return out.withColumnRenamed("unit_line", "line_no")


def ends_in_dash(text: Column, x1: Column, width: float = 612.0) -> Column:
    """A label of three characters or more, its bullet left out, that ends in a dash, with room to the right."""
    label = F.trim(F.regexp_replace(strip_bullet(text), f"[{ZERO_WIDTH}]", ""))
    # Only lines with a dash before the spaces at their end are stripped.
    likely, room = text.rlike(rf"[-\u2010-\u2015][\s{ZERO_WIDTH}\u0085\u2028\u2029]*$"), F.lit(width) - x1 >= ROOM
    return F.when(likely, label.rlike(rf"[{LABEL_DASHES}]\s*$") & (F.length(label) >= 3) & ~text.contains("_") & room).when(text.isNotNull(), False)


def trailing_dash(lines: DataFrame) -> DataFrame:
    return lines.filter(ends_in_dash(F.col("text"), F.col("x1"))).select(*PAGE, "line_no")


def tables(lines: DataFrame) -> DataFrame:
    """One table on each page, as its outer box."""
    return lines.select(*PAGE).distinct().select(*PAGE, F.lit(72.0).alias("bx0"), F.lit(300.0).alias("by0"), F.lit(540.0).alias("bx1"), F.lit(420.0).alias("by1"))


def outside(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines whose centre lies in no box of their page."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    b = boxes.withColumnsRenamed({"doc_id": "_d", "page": "_p"})
    return lines.join(b, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & x.between(F.col("bx0"), F.col("bx1")) & y.between(F.col("by0"), F.col("by1")), "left_anti")


def _dealt_outside(lines: DataFrame, boxes: DataFrame, parts: int) -> DataFrame:
    """``outside`` with pages dealt over ``parts`` tasks, which hold their pages' boxes and needn't sort the lines.

    The boxes come as a list to each page, not by an anti join: Spark would push that below the dealing and deal twice.
    """
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    on_page = boxes.repartition(parts, *PAGE).groupBy(*PAGE).agg(F.collect_list(F.struct("bx0", "by0", "bx1", "by1")).alias("_boxes"))
    held = F.exists("_boxes", lambda b: x.between(b["bx0"], b["bx1"]) & y.between(b["by0"], b["by1"]))
    rows = lines.repartition(parts, *PAGE).join(on_page.hint("shuffle_hash"), PAGE, "left")
    return rows.filter(~F.coalesce(held, F.lit(False))).select(lines.columns)


def by_buckets(cells: DataFrame, *axes: str, size: float = 64.0) -> DataFrame:
    """Cells once for each bucket of the page that they reach into along the axes; adds the buckets as _x or _y."""
    for a in axes:
        cells = cells.withColumn(f"_{a}", F.explode(F.sequence(F.floor(F.col(f"c{a}0") / size), F.floor(F.col(f"c{a}1") / size))))
    return cells


def cell_chars(chars: DataFrame, cells: DataFrame, size: float = 64.0) -> DataFrame:
    """Characters with the table cell that holds their centre: row, col and its rectangle.

    ``cells`` are rectangles of any size (doc_id, page, row, col, cx0, cy0, cx1, cy1), a merged one being one row;
    their right and lower edges are the next cell's. A character in two cells that overlap comes twice, one in
    none not at all. Both sides meet by bands of the page. A row may be a run of characters of equal width; it is cut
    at the cells' edges, so no row need stand for one character.
    """
    y, n = (F.col("y0") + F.col("y1")) / 2, F.length("ch")
    held = chars.withColumn("_y", F.floor(y / size)).join(by_buckets(cells, "y", size=size), [*PAGE, "_y"]).filter((y >= F.col("cy0")) & (y < F.col("cy1")))
    # How many of the run's centres lie left of an edge; all are at x0 if it has no width.
    width = F.nullif((F.col("x1") - F.col("x0")) / n, F.lit(0.0))
    before = lambda edge: F.coalesce(F.ceil((F.col(edge) - F.col("x0")) / width - 0.5), F.when(F.col("x0") < F.col(edge), n).otherwise(0))
    held = held.withColumns({a: F.least(F.greatest(before(edge), F.lit(0)), n).cast("int") for a, edge in (("_a", "cx0"), ("_b", "cx1"))}).filter("_b > _a")
    x = lambda at: F.col("x0") + F.coalesce(width, F.lit(0.0)) * F.col(at)
    cut = {"char_no": F.col("char_no") + F.col("_a"), "ch": F.substring("ch", F.col("_a") + 1, F.col("_b") - F.col("_a")), "x0": x("_a"), "x1": x("_b")}
    return held.withColumns(cut).drop("_y", "_a", "_b")


def cell_text(chars: DataFrame, cells: DataFrame) -> DataFrame:
    """Characters dealt to table cells by their centres, and each cell's text."""
    parts = F.sort_array(F.collect_list(F.struct("line_no", "char_no", "ch")))
    return cell_chars(chars, cells).groupBy(*PAGE, "row", "col").agg(F.array_join(F.transform(parts, lambda s: s["ch"]), "").alias("text"))


def scanned_pages(pages: DataFrame, images: DataFrame, lines: DataFrame, share: float = 0.8) -> DataFrame:
    """Pages that one image covers to ``share`` at least, or that have no character."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    full = images.join(pages, PAGE).groupBy(*PAGE).agg(F.bool_or(area >= share * F.col("width") * F.col("height")).alias("scanned"))
    drawn = lines.groupBy(*PAGE).agg((F.sum(F.length("text")) > 0).alias("drawn"))
    out = pages.join(full, PAGE, "left").join(drawn, PAGE, "left")
    return out.select(*PAGE, (F.coalesce("scanned", F.lit(False)) | ~F.coalesce("drawn", F.lit(False))).alias("scanned"))


def page_marks(lines: DataFrame, boxes: DataFrame | None = None, obstacles: DataFrame | None = None, formats: Sequence[str] = FORMATS, parts: int | None = None) -> DataFrame:
    """All lines outside table ``boxes`` with the detector that claims them: kind and unit_line (the unit's first line), null if none does.

    Options (runs and inline) and their stems go first; prompt groups with room below are open responses and claim
    every line inside their box; then empty bullets, labels that end in a dash, and the logical units that hold
    underscores, of the lines left. ``formats`` says which detectors run. It is one pass of windows over each page; a
    page's lines stay together, a document's don't. What the windows ask of the text is taken before lines meet the boxes, so
    neither carries the text unless it is wanted. With ``parts`` pages are dealt over so many tasks, whose memory then
    needn't grow with the input; else over Spark's usual number. Also returns the columns of ``marked_lines`` and ``with_room`` and blanks, the
    number of the line's underscore runs.
    """
    text = F.col("text")
    choice, written, ruling = "multiple_choice" in formats, "open_response" in formats, "inline_blanks" in formats
    rows = _flagged(lines).withColumns({"bullet": is_empty_bullet(text) & ("bullet_answer" in formats), "dash": ends_in_dash(text, F.col("x1")) & (written or ruling), "blanks": F.when(text.contains("_"), F.regexp_count("text", F.lit("_+"))).when(text.isNotNull(), 0)})
    if boxes is not None:
        rows = _dealt_outside(rows, boxes, parts) if parts else outside(rows, boxes)
    rows = _marked(rows if boxes is not None or parts is None else rows.repartition(parts, *PAGE))
    run, inline, filled = F.col("first_line").isNotNull() & choice, F.col("inline") & choice, F.col("filled")
    rows = rows.withColumn("taken", run | inline | (F.col("stem_of").isNotNull() & choice)).withColumn("free", filled & ~F.col("taken"))
    rows = _with_room(rows, obstacles, 10.0, 30.0, "seg").withColumn("open", F.col("open") & written)
    spaces = F.collect_list(F.when(F.col("open") & (F.col("line_no") == F.col("unit_line")), F.struct("gx0", "gy0", "gy1"))).over(Window.partitionBy(*PAGE))
    inside = F.exists("spaces", lambda o: (F.col("y0") >= o["gy0"] - 1) & (F.col("y1") <= o["gy1"] + 1) & (F.col("x0") >= o["gx0"] - 1))
    rows = rows.withColumn("spaces", spaces).withColumn("taken", F.col("taken") | inside).drop("spaces", "gy0")
    rows = rows.withColumn("bullet", F.col("bullet") & ~F.col("taken")).withColumn("dash", F.col("dash") & ~F.col("taken") & ~F.col("bullet") & filled)
    rows = rows.withColumn("free", filled & ~F.col("taken") & ~F.col("bullet") & ~F.col("dash"))
    order = by_page("grp")
    above = F.last(F.when(F.col("free"), F.col("y1")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.col("free") & F.coalesce(F.col("starts_unit") | (F.col("y0") - above > 14.0), F.lit(True))
    rows = rows.withColumn("begins", starts).withColumn("lu", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("begins", "grp")
    ruled = F.max(F.when(F.col("free"), F.col("underscored"))).over(piece("lu"))
    rows = rows.withColumns({"ruled": F.col("free") & ruled & ruling, "lu_line": F.min(F.when(F.col("free"), F.struct("y0", "x0", "line_no"))).over(piece("lu"))["line_no"]})
    kind = F.when(run, "multiple_choice").when(inline, "multiple_choice_inline").when(F.col("open"), "open_response").when(F.col("bullet"), "bullet").when(F.col("dash"), "trailing_dash").when(F.col("ruled"), "inline_blank")
    first = F.when(run, F.col("first_line")).when(F.col("open") & ~inline, F.col("unit_line")).when(F.col("ruled"), F.col("lu_line")).otherwise(F.col("line_no"))
    rows = rows.withColumns({"kind": kind, "unit_line": F.when(kind.isNotNull(), first)})
    return rows.select(*lines.columns, "blanks", "kind", "unit_line", "gx0", "gx1", "gy1", "bottom", *CHOICE)


def detected(lines: DataFrame, boxes: DataFrame | None = None, obstacles: DataFrame | None = None, formats: Sequence[str] = FORMATS, parts: int | None = None) -> DataFrame:
    """Lines that detectors claim, each in turn from what those before have left; see ``page_marks``."""
    rows = page_marks(lines, boxes, obstacles, formats, parts).filter("kind is not null")
    return rows.select(*lines.columns, "blanks", "kind", "unit_line", "gx0", "gx1", "gy1", "bottom")


def detect(lines: DataFrame, boxes: DataFrame | None = None, obstacles: DataFrame | None = None, formats: Sequence[str] = FORMATS) -> DataFrame:
    """doc_id, page, line_no, kind, unit_line of every line that a unit holds; see ``detected``."""
    return detected(lines, boxes, obstacles, formats).select(*PAGE, "line_no", "kind", "unit_line")


def numbered_units(found: DataFrame) -> DataFrame:
    """Document-wide numbers in order of page and first line, in one running pass over each document's detected lines (they come from one text)."""
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page", "unit_line"))
    return found.withColumn("unit_id", F.concat(F.lit("u"), rank.cast("string")))


def doc_summary(found: DataFrame) -> DataFrame:
    """Units by document and kind, with subtotals (a null stands for all)."""
    return found.filter("line_no = unit_line").rollup("doc_id", "kind").agg(F.count("*").alias("n"))


def page_text(lines: DataFrame) -> DataFrame:
    """Each document's text, its pages in order behind page marks."""
    parts = F.sort_array(F.collect_list(F.struct("line_no", "text")))
    pages = lines.groupBy(*PAGE).agg(F.array_join(F.transform(parts, lambda s: s["text"]), "\n").alias("t"))
    whole = F.sort_array(F.collect_list(F.struct("page", F.concat(F.lit("[page "), F.col("page").cast("string"), F.lit("]\n"), F.col("t")).alias("t"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(whole, lambda s: s["t"]), "\n").alias("text"))


def score_bands(found: DataFrame, bands: DataFrame) -> DataFrame:
    """Answer spaces (line_no, slot, y) against truth bands: correct, missed and surplus answer spaces in all."""
    hit = found.join(grows(bands), PAGE, "left").filter((F.col("y") >= F.col("b0")) & (F.col("y") < F.col("b1")))
    first = hit.groupBy(*PAGE, "line_no", "slot").agg(F.min("band").alias("band")).groupBy(*PAGE, "band").agg(F.count("*").alias("n"))
    rows = grows(bands).join(first, [*PAGE, "band"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.agg(F.sum(F.least("n", "expected")).alias("correct"), F.sum(F.greatest(F.col("expected") - F.col("n"), F.lit(0))).alias("missed"), F.sum(F.greatest(F.col("n") - F.col("expected"), F.lit(0))).alias("surplus"))


def json_object(text: Column) -> Column:
    """The first balanced {..} of a model's reply, thoughts and fences dropped; braces in strings don't count."""
    bare = F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    at = F.instr(bare, "{")

    def step(s: Column, ch: Column) -> Column:
        free = ~s["quoted"] & ~s["escaped"]
        depth = s["depth"] + F.when(free & (ch == "{"), 1).when(free & (ch == "}"), -1).otherwise(0)
        end = F.when(s["end"] > 0, s["end"]).when(free & (ch == "}") & (depth == 0), s["i"] + 1).otherwise(0)
        quoted = F.when(~s["escaped"] & (ch == '"'), ~s["quoted"]).otherwise(s["quoted"])
        return F.struct((s["i"] + 1).alias("i"), depth.alias("depth"), quoted.alias("quoted"), (~s["escaped"] & (ch == "\\")).alias("escaped"), end.alias("end"))

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("end"))
    size = F.aggregate(F.split(F.substr(bare, at), ""), zero, step)["end"]
    return F.when(at == 0, F.lit("")).otherwise(F.substr(bare, at, size))


def flat_answers(df: DataFrame, key: str = "doc_id", column: str = "reply") -> DataFrame:
    """key, slot, answer of a model's reply: flat, nested one level, or with composite keys.

    A key counts by the sN or uN at its end, else whole. Values that aren't texts are left out; of equal
    keys the last wins.
    """
    texts = lambda v: F.schema_of_variant(v) == "STRING"
    rows = df.select(key, F.posexplode(F.from_json(json_object(F.col(column)), "map<string,variant>")).alias("i", "k", "v"))
    flat = rows.filter(texts(F.col("v"))).select(key, "i", F.lit(0).alias("j"), "k", "v")
    nested = rows.filter(F.schema_of_variant("v").startswith("OBJECT")).select(key, "i", F.posexplode(F.col("v").cast("map<string,variant>")).alias("j", "k", "v")).filter(texts(F.col("v")))
    slot = F.coalesce(F.nullif(F.regexp_extract("k", r"([su]\d+)$", 1), F.lit("")), F.col("k"))
    both = flat.unionByName(nested.select(key, "i", "j", "k", "v")).select(key, "i", "j", slot.alias("slot"), F.col("v").cast("string").alias("answer"))
    return both.groupBy(key, "slot").agg(F.max_by("answer", F.struct("i", "j")).alias("answer"))


def snip_box(df: DataFrame, pad: float = 4.0) -> DataFrame:
    """Corners ordered, boxes under two points left out, padded and clipped to the page."""
    x0, x1, y0, y1 = F.least("ax", "bx"), F.greatest("ax", "bx"), F.least("ay", "by"), F.greatest("ay", "by")
    big = (x1 - x0 >= 2) & (y1 - y0 >= 2)
    zero = F.lit(0.0)
    return df.filter(big).select(*PAGE, "line_no", F.greatest(x0 - pad, zero).alias("x0"), F.greatest(y0 - pad, zero).alias("y0"), F.least(x1 + pad, F.lit(612.0)).alias("x1"), F.least(y1 + pad, F.lit(792.0)).alias("y1"))


def fix_axes(boxes: DataFrame, least: int = 2, share: float = 0.6) -> DataFrame:
    """Pages where most boxes stand upright were read with swapped axes: swap them back."""
    upright = (F.col("y1") - F.col("y0")) > (F.col("x1") - F.col("x0"))
    vote = boxes.groupBy(*PAGE).agg(F.count("*").alias("n"), F.count_if(upright).alias("up"))
    swap = (F.col("n") >= least) & (F.col("up") >= share * F.col("n"))
    out = boxes.join(vote, PAGE)
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a)
    return out.select(*PAGE, "line_no", pick("x0", "y0"), pick("y0", "x0"), pick("x1", "y1"), pick("y1", "x1"))
