"""Operators on odd lines, anchors and replies."""

from pyspark.sql import functions as F

from formlens.functions import core as c
from formlens.operators import anchors as n
from formlens.operators import layout as y
from formlens.operators import page_index as px
from formlens.plans import QUERIES
from formlens.sources.views import view
from tests.test_queries import SF, duck  # noqa: F401

def test_occurrences_in_whole_lines(spark, duck):  # noqa: F811
    got = {(r.doc_id, r.line_no): r.v for r in QUERIES["find_occurrences"](spark, SF).collect()}
    texts = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    at = lambda t, n: [i + 1 for i in range(len(t)) if t.startswith(n, i)]
    assert got == {(d, i): len(at(line.lower(), "aa")) for d, text in texts for i, line in enumerate(text.split("\n"))}
    odd = ["a" * 700, "xaa" * 5000 + "é", "b" * 63 + "aab", "a", "", "é" * 200 + "aa", None]
    df = spark.createDataFrame([(t, n) for t in odd for n in ("aa", "aab", "é", "a" * 130)], "t string, n string")
    for r in df.select("t", "n", c.occurrences(F.col("t"), F.col("n")).alias("v")).collect():
        assert r.v == at(r.t or "", r.n)


def test_anchors_take_occurrences_in_order(spark):
    lines = [(1, 0, i, t) for i, t in enumerate(["Name: ____ Name: ____", "", "Date of", "  birth – day", "Name: ____", "e.g. (this)"])] + [(2, 0, 7, "Name:")]
    asked = ["Name:", "name:", "NAME:", "Name:", "date  of birth", "e g this", "eg", "Birth - Day", None, "no such"]
    anchors = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(asked)] + [(2, 0, 0, "Name:"), (3, 0, 0, "Name:")], "doc_id long, page int, item_no int, anchor_text string")
    rows = px.resolve_anchors(anchors, spark.createDataFrame(lines, "doc_id long, page int, line_no int, text string")).collect()
    got = {(r.doc_id, r.item_no): r.line_no for r in rows}
    assert [got[1, i] for i in range(len(asked))] == [0, 0, 4, None, 2, 5, None, 3, None, None]
    assert got[2, 0] == 7 and got[3, 0] is None and len(rows) == len(asked) + 2
    assert all((r.dropped == "anchor not found") == (r.line_no is None) for r in rows)


def test_first_balanced_object(spark):
    cases = {
        'a {"s1": "x"} and {"s2": "y"}': '{"s1": "x"}', '<think>{"s9": 1}</think> {"s1": {"a": "}"}} {': '{"s1": {"a": "}"}}', '{"q": "\\"}{"} tail }': '{"q": "\\"}{"}',
        "none": "", "{ never closed": "", "": "", "é {}": "{}", None: None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert [r.v for r in df.select("i", y.json_object(F.col("t")).alias("v")).orderBy("i").collect()] == list(cases.values())
    two = spark.createDataFrame([(1, 'So {"s1": "x", "p0_u2": "y"}, not {"s3": "z"}')], "doc_id long, reply string")
    assert {(r.slot, r.answer) for r in y.flat_answers(two).collect()} == {("s1", "x"), ("u2", "y")}


def _page(spark, texts):
    rows = [(1, 0, i, t, 72.0, 40.0 + 14 * i, 300.0, 51.0 + 14 * i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")


def test_anchor_spans_and_boxes(spark):
    lines = _page(spark, ["Date of", "  birth – day", "", "e.g. (this) \u200bthat"])
    asked = [(1, 0, i, t) for i, t in enumerate(["date  of birth", "this that", "é", "thisthat"])]
    anchors = spark.createDataFrame(asked, "doc_id long, page int, item_no int, anchor_text string")
    rows = {r.item_no: r for r in px.anchor_boxes(px.resolve_anchors(anchors, lines), lines).collect()}
    span = lambda r: (r.line_no, r.first_char, r.last_line, r.last_char, r.x0, r.y0, r.x1, r.y1)
    assert span(rows[0]) == (0, 0, 1, 6, 72.0, 40.0, 72 + 5.0 * 7, 65.0)
    assert span(rows[1]) == (3, 6, 3, 16, 102.0, 82.0, 72 + 5.0 * 17, 93.0)
    assert rows[2].dropped == rows[3].dropped == "anchor not found" and rows[3].x0 is None


def test_bulleted_questions_are_prompts(spark):
    rows = y.bullet_answers(_page(spark, ["Chapter One", "● What is a  market?", "", "○", "■ ", "○ text", "○"])).collect()
    assert [(r.line_no, r.prompt_line, r.prompt) for r in sorted(rows)] == [(3, 1, "What is a market?"), (4, 1, "What is a market?"), (6, 5, "text")]
    assert [r.prompt for r in y.bullet_answers(_page(spark, ["○"])).collect()] == ["Fill in this answer."]


def test_labels_with_bullets_and_all_dashes(spark):
    texts = ["● Term -", "Term ‒", "Term ―", "Term ‑", "Term ‐", "Home files –\u200b", "- ", "● -", "a_b -", "Term -x", "definition of bob —  "]
    assert sorted(r.line_no for r in y.trailing_dash(_page(spark, texts)).collect()) == [0, 1, 2, 3, 4, 5, 10]


def test_items_of_a_reply(spark):
    item = '{"page": %d, "kind": "%s", "anchor_text": "%s", "blank_position": "%s"}'
    reply = '{"items": [%s]}' % ", ".join(item % x for x in [(1, "open", "Why?", "none"), (0, "inline", "Name:", "after"), (0, "choice", "A", "below"), (0, "inline", "B", "below"), (-1, "open", "C", "none"), (0, "open", " ", "none"), (0, "inline", "D", "before")])
    df = spark.createDataFrame([(1, reply), (2, f"Sure: ```json {reply} ```"), (3, "[]"), (4, "none"), (5, None), (6, '{"items": {}}')], "doc_id long, reply string")
    rows = [(r.doc_id, r.item_no, r.kind, r.blank_position, r.place) for r in n.anchor_items(df).collect()]
    one = [(0, "open", "none", 3), (1, "inline", "after", 1), (6, "inline", "before", 2)]
    assert sorted(rows) == [(d, *x) for d in (1, 2) for x in one]


def _drawn(spark, rows):
    """Lines of one page from (text, x0, y0, x1, y1)."""
    return spark.createDataFrame([(1, 0, i, t, *map(float, b)) for i, (t, *b) in enumerate(rows)], "doc_id long, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")


def test_detectors_claim_in_turn(spark):
    lines = _drawn(spark, [
        ("Explain the", 72, 40, 300, 50), ("causes -", 72, 53, 300, 63), ("note -", 320, 39.5, 400, 50),  # a group of two with room, and a line of another group inside its box
        ("Term -", 72, 100, 300, 110), ("Fill in ____ and", 72, 114, 300, 124), ("then ____ here", 72, 126, 300, 136), ("○", 72, 150, 80, 160),
        ("Next item", 120, 168, 300, 178), ("A. one", 72, 230, 300, 240), ("B. two", 72, 242, 300, 252), ("In the table ____", 100, 310, 300, 320), ("Last question", 72, 600, 300, 610),
    ])
    boxes = spark.createDataFrame([(1, 0, 90.0, 300.0, 500.0, 420.0)], "doc_id long, page int, bx0 double, by0 double, bx1 double, by1 double")
    kinds = lambda **more: {r.line_no: (r.kind, r.unit_line) for r in y.detect(lines, boxes, **more).collect()}
    assert kinds() == {0: ("open_response", 0), 1: ("open_response", 0), 3: ("trailing_dash", 3), 4: ("inline_blank", 4), 5: ("inline_blank", 4), 6: ("bullet", 6), 7: ("open_response", 7), 8: ("multiple_choice", 8), 9: ("multiple_choice", 8), 11: ("open_response", 11)}
    assert kinds(formats=["inline_blanks"]) == {1: ("trailing_dash", 1), 2: ("trailing_dash", 2), 3: ("trailing_dash", 3), 4: ("inline_blank", 4), 5: ("inline_blank", 4)}
    assert kinds(formats=["multiple_choice", "table"]) == {8: ("multiple_choice", 8), 9: ("multiple_choice", 8)}
    assert 10 in {r.line_no for r in y.detect(lines).collect()}
    numbers = {r.line_no: r.unit_id for r in y.numbered_units(y.detect(lines, boxes)).collect()}
    assert numbers == {0: "u1", 1: "u1", 3: "u2", 4: "u3", 5: "u3", 6: "u4", 7: "u5", 8: "u6", 9: "u6", 11: "u7"}


def test_obstacles_take_room(spark):
    lines = _drawn(spark, [("First", 72, 40, 200, 50), ("Second", 72, 200, 200, 210), ("Third", 400, 400, 450, 410)])
    at = lambda *boxes: {r.line_no: r.bottom for r in y.open_responses(lines, spark.createDataFrame([(1, 0, *map(float, b)) for b in boxes], "doc_id long, page int, x0 double, y0 double, x1 double")).collect()}
    assert at((0, 45, 612)) == {0: 200.0, 1: 400.0, 2: 732.0}  # above the group's foot: no floor
    assert at((100, 60, 150), (300, 100, 400)) == {1: 400.0, 2: 732.0}  # ten points are no room
    assert at((100, 120, 150), (0, 90, 70), (580, 90, 600), (72, 500, 390)) == {0: 120.0, 1: 400.0, 2: 732.0}  # beside the text or behind the margin: no floor


def test_one_id_names_one_blank(spark, duck):  # noqa: F811
    """cell_slots, table_slots, slot_numbers, overlays and llm_units share one numbering, and no detected line lies in a table."""
    rows = {name: QUERIES[name](spark, SF).collect() for name in ("cell_slots", "table_slots", "slot_numbers", "overlays", "llm_units", "detect_all")}
    ids = {(r.doc_id, f"s{r.first_slot + i}"): r.row is not None for r in rows["slot_numbers"] for i in range(r.n)}
    assert len(ids) == sum(r.n for r in rows["slot_numbers"])
    boxed = [(r.doc_id, r.key) for r in rows["overlays"] if r.key.startswith("s")]
    assert len(boxed) == len(set(boxed)) and set(boxed) == set(ids)
    asked = [(r.doc_id, s) for r in rows["llm_units"] for s in (r.slots or "").split(",") if s]
    assert set(asked) == {k for k, in_table in ids.items() if not in_table} and len(asked) == len(set(asked))
    assert all((r.doc_id, s) in set(asked) for r in rows["llm_units"] for s in (r.slots or "").split(",") if s and "{{" + s + "}}" in r.prompt)
    inside = {(r.doc_id, s) for name in ("cell_slots", "table_slots") for r in rows[name] for s in r.slots.split(",")}
    assert inside == {k for k, in_table in ids.items() if in_table} and len(inside) > 20
    held = {tuple(r) for r in duck_lines(spark) if 72 <= (r.x0 + r.x1) / 2 <= 540 and 300 <= (r.y0 + r.y1) / 2 <= 420}
    assert held and not {(r.doc_id, r.page, r.line_no) for r in rows["detect_all"]} & {t[:3] for t in held}


def duck_lines(spark):
    from formlens.sources import views

    return views.view(spark, SF, "lines").select("doc_id", "page", "line_no", "x0", "x1", "y0", "y1").collect()


def test_sketches_are_stored_and_merged(spark, tmp_path):
    from formlens.operators import sketches as k

    draw = F.pmod(F.xxhash64("id"), F.lit(100_000)) + 1
    calls = spark.range(60_000).select(F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 30 as int))").alias("ts"), F.lit(True).alias("ok"), F.when(F.col("id") % 3 == 0, "a").alias("purpose"), draw.alias("latency_ms"), (F.col("id") % 9000).cast("string").alias("ip"))
    for day, part in enumerate((calls.filter("day(ts) < 20"), calls.filter("day(ts) >= 20"))):
        k.daily_latency(part).write.parquet(str(tmp_path / f"latency/{day}"))
        k.daily_distinct(part, "ip").write.parquet(str(tmp_path / f"ips/{day}"))
    stored = spark.read.parquet(*(str(tmp_path / f"latency/{d}") for d in (0, 1)))
    for r in k.merged_latency(stored, "purpose").collect():
        own = [x.latency_ms for x in calls.filter(F.coalesce("purpose", F.lit("unknown")) == r.purpose).select("latency_ms").collect()]
        assert r.calls == len(own)
        for q, p in ((r.p50, 0.5), (r.p95, 0.95)):
            assert abs(sum(v <= q for v in own) / len(own) - p) <= k.RANK_ERROR
    n = k.merged_distinct(spark.read.parquet(*(str(tmp_path / f"ips/{d}") for d in (0, 1)))).first().n
    assert abs(n - 9000) <= 9000 * k.COUNT_ERROR and k.merged_distinct(stored.limit(0)).first().n == 0


def test_percentiles_by_narrowing(spark):
    from formlens.operators.sketches import exact_percentiles

    big = 2**63
    for values in ([5], [1, 2], [3] * 50 + [9], list(range(1000)), [-big, -7, 0, 4, big - 1], [10**12 + i * 7919 for i in range(300)], [None, 8, None]):
        df = spark.createDataFrame([(v,) for v in values], "v long")
        real = sorted(v for v in values if v is not None)
        want = [real[max(-(-int(p * 100) * len(real) // 100), 1) - 1] for p in (0.5, 0.95, 1.0)]
        assert list(exact_percentiles(df, "v", {"a": 0.5, "b": 0.95, "c": 1.0}, width=16).first()) == want
    assert list(exact_percentiles(spark.createDataFrame([], "v long"), "v", {"a": 0.5}).first()) == [None]


def test_runs_of_characters_are_cut_like_characters(spark):
    """line_text, cell_text and table_regions: rows stay near the lines' number, with the same lines and cells."""
    lines = spark.createDataFrame([(1, 0, 0, "ab\ncdЖ𝄞" * 30, 10.0, 20.0, 31.0), (1, 0, 1, "x_y", 70.0, 40.0, 51.0), (1, 0, 2, "", 0.0, 60.0, 71.0)], "doc_id long, page int, line_no int, text string, x0 double, y0 double, y1 double")
    cells = spark.createDataFrame([(1, 0, 0, c, 12.0 + 50 * c, 0.0, 62.0 + 50 * c, 45.0 - 10 * c) for c in range(4)] + [(1, 0, 1, 0, 0.0, 45.0, 900.0, 90.0)], "doc_id long, page int, row int, col int, cx0 double, cy0 double, cx1 double, cy1 double")
    one, many = y.glyphs(lines), y.glyphs(lines, run=64)
    assert (one.count(), many.count()) == (213, 5)
    for f in (y.line_text, lambda g: y.cell_text(g, cells), lambda g: n.table_regions(g, cells)):
        assert sorted(map(tuple, f(one).collect())) == sorted(map(tuple, f(many).collect()))
    assert {r.line_no: r.text for r in y.line_text(many).collect()} == {r.line_no: r.text for r in lines.collect() if r.text}


def test_units_are_detected_once(spark, monkeypatch):
    """Queries without unit ids don't number units, and those with several branches read stored rows: no window of detection runs twice."""
    windows = lambda name: str(QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan()).count("last(")
    once = windows("doc_structure")
    assert 0 < once == windows("slot_numbers") == windows("table_slots") == windows("detect_all") == windows("answer_centres")
    assert windows("llm_units") < once and windows("overlays") < once


def test_cells_and_pages_are_made_once(spark):
    """Header names come with the cells, and queries of detected units don't split the texts again for each use of the pages or bands."""
    plan = lambda name: str(QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan())
    splits = {name: plan(name).count("posexplode(split(") for name in ("detector_score", "doc_summary", "table_prompts")}
    assert splits == {"detector_score": 1, "doc_summary": 1, "table_prompts": 2}


def test_replies_are_read_once(spark):
    """No branch of overlays reads the replies again."""
    assert "from_json" not in str(QUERIES["overlays"](spark, SF)._jdf.queryExecution().optimizedPlan()).lower().replace("jsontostructs", "from_json")


def test_flags_of_a_line(spark):
    """Labels that share the space between them, look-alikes, and dashes before characters without width; texts are folded nowhere, labels are."""
    rows = [("A. B. C. x", True, "A", False), ("x a) b) c) -", True, None, True), ("I. II. III.", False, "I", False), ("i) ii) iii) \u2013 ", True, "I", True), ("А. Β. С. x", True, "A", False), ("A. C. B. x", False, "A", False), ("● ab -\u200b ", False, None, True), ("● a -\u200b", False, None, True), ("● -", False, None, False), ("ab - c", False, None, False), ("", False, None, False)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    lines = spark.createDataFrame(rows, "i int, text string, inline boolean, token string, dash boolean")
    t = F.col("text")
    out = lines.select("i", "text", y.has_inline_options(t).alias("inline"), y.option_token(t).alias("token"), y.ends_in_dash(t, F.lit(300.0)).alias("dash"))
    assert sorted(map(tuple, out.collect())) == rows
    assert "translate(text" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_anchors_shuffle_text_not_glyphs(spark):
    """Lines meet on their page as text; a page's letters are looked through only where an anchor has no exact occurrence."""
    lines = spark.createDataFrame([(1, 0, 0, "Na​me:\t x"), (1, 0, 1, None), (1, 0, 2, "e.g. (this)"), (2, 0, 0, "Na me")], "doc_id long, page int, line_no int, text string")
    asked = spark.createDataFrame([(1, 0, 0, "name: x"), (1, 0, 1, "eg this"), (2, 0, 0, "me"), (3, 0, 0, "me")], "doc_id long, page int, item_no int, anchor_text string")
    out = px.resolve_anchors(asked, lines)
    got = {(r.doc_id, r.item_no): tuple(r)[3:7] for r in out.collect()}
    assert got == {(1, 0): (0, 0, 0, 8), (1, 1): (2, 0, 2, 9), (2, 0): (0, 3, 0, 4), (3, 0): (None,) * 4}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    grouped = [row for row in plan.splitlines() if "Aggregate" in row]
    assert any("collect_list(struct(line_no" in row for row in grouped) and not any("split(" in row for row in grouped)


def test_pages_are_dealt_by_their_number(spark):
    """Detection deals pages over tasks by their number, so a task's memory doesn't grow with the input; the lines it takes are the same."""
    from formlens.plans import layout as plans

    x = view(spark, "/root/testdata/sf0.001", "lines")
    sheets = plans.page_list(x)
    boxes, obstacles = y.tables(sheets), plans.obstacles(sheets)
    dealt = y.detected(x, boxes, obstacles, parts=9)
    assert dealt.rdd.getNumPartitions() == 9
    assert sorted(map(str, dealt.collect())) == sorted(map(str, y.detected(x, boxes, obstacles).collect()))
    assert plans.page_parts(spark.range(5 * plans.PAGES_A_TASK + 1)) == 6


def test_lines_beyond_tables_stay_behind(spark):
    """Table cells are cut from the lines between the first table's top and the last one's foot; the others aren't shuffled."""
    from formlens.plans import layout as plans

    x = view(spark, "/root/testdata/sf0.001", "lines")
    sheets = plans.page_list(x)
    near, every = plans.cells(x, sheets), n.cell_lines(x, plans.rects(sheets))
    assert sorted(map(str, near.collect())) == sorted(map(str, every.collect())) and near.count()
    assert ">= 300.0" in near._jdf.queryExecution().optimizedPlan().toString()
    assert plans.cells(x.limit(0), plans.page_list(x.limit(0))).count() == 0


def test_pages_cells_and_units_are_not_broadcast(spark):
    """Tables with rows for each page or line meet by sort and merge: by the size of their stored files Spark would broadcast millions of cells."""
    from formlens.plans import layout as plans

    x = view(spark, "/root/testdata/sf0.001", "lines")
    sheets = plans.page_list(x)
    marks, units, inside, bullets = plans.kept(x)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) > 1 << 20
    bands = plans.stored(plans.bands(x), "bands")
    for df in (plans.cells(x, sheets), plans.found(x, sheets), y.score_bands(n.answer_centres(units), bands), n.overlays(marks, units, inside, bullets, plans.said(x)), n.model_units(marks, units, inside, bullets)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_answer_centres_hold_table_slots(spark, duck):  # noqa: F811
    """Blanks inside tables are answer spaces too: one for each run of each cell, counted through the line."""
    lines = spark.createDataFrame([(1, 0, 0, "ab__cd____", 10.0, 25.0, 60.0, 35.0), (1, 0, 1, "no blank", 10.0, 40.0, 50.0, 50.0), (1, 0, 2, "_", 10.0, 95.0, 15.0, 99.0)], "doc_id long, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([(1, 0, 0, 0, 0.0, 20.0, 27.5, 90.0), (1, 0, 0, 1, 27.5, 20.0, 200.0, 90.0)], "doc_id long, page int, row int, col int, cx0 double, cy0 double, cx1 double, cy1 double")
    found = lines.limit(0).selectExpr("*", "'' as kind", "line_no as unit_line", "1 as blanks")
    assert sorted(map(tuple, n.answer_centres(found, n.cell_lines(lines, boxes)).collect())) == [(1, 0, 0, 30.0, 1), (1, 0, 0, 30.0, 2), (1, 0, 0, 30.0, 3)]
    in_tables = {(r.doc_id, r.page, r.line_no): r.n for r in QUERIES["slot_numbers"](spark, SF).filter("row is not null").groupBy("doc_id", "page", "line_no").agg(F.sum("n").alias("n")).collect()}
    got = QUERIES["answer_centres"](spark, SF).groupBy("doc_id", "page", "line_no").agg(F.max("slot").alias("n"), F.count("*").alias("rows")).collect()
    slots = {(r.doc_id, r.page, r.line_no): r.n for r in got if r.n == r.rows}
    assert in_tables and all(slots.get(k) == v for k, v in in_tables.items())
