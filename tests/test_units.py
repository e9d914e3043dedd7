"""Literal cases: time, rounding, money, credits, webhooks, layout fixtures and odd inputs."""

import datetime as dt
import json

from pyspark.sql import functions as F

from formlens.functions import core as c
from formlens.operators import analytics as a
from formlens.operators import anchors as n
from formlens.operators import layout as y
from formlens.operators import ledger as l
from formlens.operators import metering as m
from formlens.sources import io


def ts(text):
    return dt.datetime.fromisoformat(text)


def test_heatmap_peaks_and_fractional_zone(spark):
    df = spark.createDataFrame([(ts("2024-01-01 10:45:00"),), (ts("2024-01-01 10:05:00"),), (ts("2024-01-07 23:30:00"),), (None,)], "ts timestamp")
    grid = {(r.dow, r.hour): r.n for r in a.heatmap(df).collect()}
    assert len(grid) == 168 and grid[0, 10] == 2 and grid[6, 23] == 1 and sum(grid.values()) == 3
    assert {(r.dow, r.hour): r.n for r in a.heatmap(df, 5.5).collect()}[0, 16] == 1
    assert tuple(a.peaks(df).first()) == (10, "10:00", "Mon")
    assert tuple(a.peaks(df.limit(0)).first()) == (None, "—", "—")


def test_unknown_cost_is_not_zero(spark):
    df = spark.createDataFrame([(ts("2024-01-01 00:00:00"), 0.5, 10, 5), (None, None, 100, 50)], "ts timestamp, cost_usd double, prompt_tokens long, output_tokens long")
    r = a.cost_total(df).first()
    assert (r.cost, r.uncosted_calls, r.tokens_total) == (0.5, 1, 165)


def test_live_money_only(spark):
    df = spark.createDataFrame([(ts("2024-01-30 00:00:00"), 500, True, "usd"), (ts("2024-01-30 01:00:00"), 900, False, "usd"), (None, 100, True, "gbp"), (ts("2024-01-30 00:00:00"), 1, None, "usd")], "ts timestamp, amount_cents long, livemode boolean, currency string")
    assert tuple(a.revenue_total(df).first()) == (600, 6.0, 2, 3.0)
    days = a.revenue_daily(df, "2024-01-30 23:59:59", 3).orderBy("day").collect()
    assert [r.revenue for r in days] == [0.0, 0.0, 5.0]


def test_reliability_percentiles(spark):
    calls = spark.createDataFrame([(True, 100 * i, "primary", "ocr", None) for i in range(1, 11)] + [(False, 5, "fallback", "", "APIError: boom")], "ok boolean, latency_ms long, provider string, purpose string, error string")
    calls = calls.withColumn("ts", F.lit(ts("2024-01-01 00:00:00")))
    assert tuple(a.latency(calls).first()) == (500, 1000)
    r = a.reliability(calls).first()
    assert (r.success_pct, r.fallback_pct) == (90.9, 9.1) and a.top_errors(calls).first().name == "APIError"
    assert tuple(a.latency(calls.limit(0)).first()) == (0, 0) and a.reliability(calls.limit(0)).first().success_pct == 0.0


def test_rates_and_credits(spark):
    raw = spark.createDataFrame([("a", "1", "3"), ("b", "x", "1"), (" ", "1", "1"), ("c", "-1", "1"), ("d", None, "2"), ("e", "NaN", "1")], "model string, rate_in string, rate_out string")
    assert {r.model: (r.rate_in, r.rate_out) for r in m.clean_rates(raw).collect()} == {"a": (1.0, 3.0), "d": (0.0, 2.0)}
    calls = spark.createDataFrame([(1, "a", "primary", 1_000_000, 1_000_000), (2, "zz", "primary", 5, 5)], "event_id long, model string, provider string, prompt_tokens long, output_tokens long")
    rates = spark.createDataFrame([("a", 1.0, 3.0)], "model string, rate_in double, rate_out double")
    assert {r.event_id: r.cost_usd for r in m.cost_calls(calls, rates).collect()} == {1: 4.0, 2: None}
    assert {r.event_id: r.cost_usd for r in m.cost_calls(calls, rates, True).collect()} == {1: 0.0, 2: 0.0}
    use = spark.createDataFrame([(1, ts("2024-01-01 01:00:00"), "u", False, 1000, 0), (2, ts("2024-01-01 02:00:00"), "u", None, 1500, 0), (3, ts("2024-01-02 00:00:00"), "u", False, 1, 0), (4, ts("2024-01-01 00:00:00"), " ", False, 9, 9), (5, ts("2024-01-01 00:00:00"), "p", True, 9, 9)], "event_id long, ts timestamp, user_key string, is_pro boolean, prompt_tokens long, output_tokens long")
    assert [(r.event_id, r.remaining, r.over) for r in m.credit_ledger(use, 2).orderBy("event_id").collect()] == [(1, 1.0, False), (2, 0.0, True), (3, 2.0, False)]


def test_rate_in_force_at_the_boundary(spark):
    history = spark.createDataFrame([("a", 1.0, 0.0, ts("2024-01-01 00:00:00")), ("a", 2.0, 0.0, ts("2024-01-10 00:00:00"))], "model string, rate_in double, rate_out double, effective_from timestamp")
    calls = spark.createDataFrame([(1, "a", ts("2023-12-31 00:00:00")), (2, "a", ts("2024-01-09 23:59:59")), (3, "a", ts("2024-01-10 00:00:00"))], "event_id long, model string, ts timestamp").selectExpr("*", "1000000L as prompt_tokens", "0L as output_tokens")
    assert {r.event_id: r.cost_usd for r in m.cost_calls_asof(calls, history).collect()} == {1: None, 2: 1.0, 3: 2.0}


def test_checkout_events(spark):
    ok = {"id": "evt_1", "type": "checkout.session.completed", "livemode": True, "data": {"object": {"amount_total": 900, "currency": "USD", "customer_details": {"email": "A@B.co"}}}}
    bare = {"id": "", "type": "checkout.session.completed", "data": {"object": {"customer_email": " X@y.z "}}}
    df = spark.createDataFrame([(json.dumps(ok),), (json.dumps(bare),), (json.dumps({"type": "invoice.paid"}),), ("{broken",), (None,)], "payload string")
    assert sorted(map(str, map(tuple, l.parse_checkout(df).collect()))) == sorted(map(str, [("evt_1", "a@b.co", 900, "usd", True), (None, "x@y.z", 0, "usd", False)]))


def test_upsert_keeps_absent_columns_and_patch_reports_matches(spark):
    df = spark.createDataFrame([("j", 1, "x", None), ("j", 2, None, "bad"), ("j", 3, "z", None)], "job string, ts int, style string, report string")
    assert tuple(l.upsert_columns(df, "job", ["ts"], ["style", "report"]).first()) == ("j", "z", "bad")
    base = spark.createDataFrame([("a", "1"), ("b", None)], "k string, v string")
    got = l.patch(base, spark.createDataFrame([("b", "2"), ("c", "3")], "k string, v string"), "k", ["v"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [("a", "1", False), ("b", "2", True)]


def test_worksheet_layout(spark):
    text = [("Cell Biology  Review Worksheet", 50), ("Name: ______________     Date: ______________", 80), ("1. The powerhouse of the cell is the ________________.", 110), ("definition of bob -", 140), ("single-eyed", 170), ("3. Explain why the sky appears blue:", 215), ("4. The capital of France is ______________.", 265)]
    lines = spark.createDataFrame([(1, 0, i, t, 72.0, float(b - 11), 300.0, float(b)) for i, (t, b) in enumerate(text)], "doc_id long, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")
    kinds = {r.line_no: r.kind for r in y.detect(lines).collect()}
    assert kinds == {1: "inline_blank", 2: "inline_blank", 3: "trailing_dash", 4: "open_response", 5: "open_response", 6: "inline_blank"}  # line 4 is no question, but has room: any prompt group counts
    runs = lines.filter("line_no = 1").select(c.underscore_runs(F.col("text")).alias("r")).first().r
    assert [(x.start, x.length) for x in runs] == [(6, 14), (31, 14)]
    assert lines.filter("line_no = 1").select(c.placeholder_text(F.col("text"), F.lit(4)).alias("t")).first().t == "Name: {{s4}} Date: {{s5}}"


def test_text_helpers(spark):
    df = spark.createDataFrame([("dQw4w9WgXcQ",), ("https://youtu.be/dQw4w9WgXcQ?t=1",), ("https://example.com",), (None,)], "u string")
    assert [r[0] for r in df.select(c.video_id(F.col("u"))).collect()] == ["dQw4w9WgXcQ", "dQw4w9WgXcQ", None, None]
    one = spark.range(1)
    assert one.select(c.occurrences(F.lit("aaaa"), F.lit("aa"))).first()[0] == [1, 2, 3] and one.select(c.occurrences(F.lit("abc"), F.lit(""))).first()[0] == []
    assert one.select(c.normalize_text(F.lit("  A–b​  “Q” "))).first()[0] == 'a-b "q"'
    assert [one.select(y.label_ordinal(F.lit(t))).first()[0] for t in ("A", "C", "IV", "Z")] == [1, 3, 4, None]


def sheet(spark, rows):
    """Lines of one page from (text, y0, y1)."""
    return spark.createDataFrame([(1, 0, i, t, 72.0, float(a), 300.0, float(b)) for i, (t, a, b) in enumerate(rows)], "doc_id long, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")


def test_folded_and_dropped_characters(spark):
    one = spark.range(1)
    for ch in c.DASHES:
        assert one.select(c.normalize_text(F.lit(f"a{ch}B"))).first()[0] == "a-b"
    for ch in c.SINGLE_QUOTES:
        assert one.select(c.normalize_text(F.lit(f"a{ch}"))).first()[0] == "a'"
    for ch in c.ZERO_WIDTH:
        assert one.select(c.normalize_text(F.lit(f"a{ch}b"))).first()[0] == "ab"
    for ch in c.BULLETS:
        assert one.select(c.is_empty_bullet(F.lit(f" {ch} \u200b")), c.strip_bullet(F.lit(f"{ch} x"))).first()[:] == (True, "x")
    assert one.select(c.is_bulleted(F.lit("◦ x"))).first()[0] is False
    for ch, latin in c.LOOK_ALIKES.items():
        assert one.select(y.option_token(F.lit(f" {ch} ) text"))).first()[0] == latin
    assert one.select(y.option_token(F.lit("iv. text"))).first()[0] == "IV" and one.select(y.option_token(F.lit("A."))).first()[0] is None


def test_options_wrap_and_have_stems(spark):
    lines = sheet(spark, [("Heading", 0, 10), ("3. What holds,", 40, 50), ("and why?", 53, 63), ("I. one", 70, 80), ("and more", 83, 93), ("II) two", 100, 110), ("iii. three", 115, 125), ("far below", 150, 160), ("B) stray", 170, 180), ("а. x", 200, 210), ("C. y", 215, 225), ("A. p", 300, 310), ("b. q", 312, 322)])
    assert sorted((r.first_line, r.last_line, r.n_options, r.system) for r in y.stacked_options(lines).collect()) == [(3, 6, 3, "roman"), (11, 12, 2, "letter")]
    assert [(r.first_line, r.stem_line, r.stem) for r in y.stems(lines).collect()] == [(3, 1, "3. What holds, and why?")]
    unit = n.choice_units(lines).filter("first_line = 3").first()
    assert (unit.options, unit.x0, unit.y0, unit.x1, unit.y1) == ("I. one and more | II) two | iii. three", 72.0, 70.0, 92.0, 125.0)
    kinds = {r.line_no: r.kind for r in y.detect(lines).collect()}
    assert {k for k, v in kinds.items() if v == "multiple_choice"} == {3, 4, 5, 6, 11, 12} and not {1, 2} & set(kinds)
    said = spark.createDataFrame([(1, 0, 3, "III only"), (1, 0, 11, "Bfoo")], "doc_id long, page int, first_line int, answer string")
    assert {r.first_line: r.label for r in n.chosen_option(n.choice_units(lines), said).collect()} == {3: "III", 11: "B"}
    inline = sheet(spark, [("i. a ii. b iii. c", 0, 1), ("A. a C. b B. c", 2, 3), ("A. a B. b", 4, 5), ("x A) 1 B) 2 C) 3", 6, 7)])
    assert {(r.line_no, r.n_options) for r in y.inline_options(inline).collect()} == {(0, 3), (3, 3)}


def test_blanks_beside_anchors(spark):
    rows = [("Name: ____ Date", 0, 4, "after"), ("Name: text", 0, 4, "after"), ("ends here", 0, 8, "after"), ("___ cat", 4, 6, "before"), ("word cat", 5, 7, "before"), ("Name:                ____", 0, 4, "after")]
    df = sheet(spark, [(t, 0, 10) for t, *_ in rows])
    where = spark.createDataFrame([(i, a, b, p) for i, (_, a, b, p) in enumerate(rows)], "line_no int, a0 int, a1 int, position string")
    got = {r.line_no: (r.sx0, r.sx1, r.underscores) for r in n.slots(df.join(where, "line_no")).collect()}
    assert got == {0: (102.0, 122.0, 4), 1: (100.0, 230.0, 0), 2: (120.0, 572.0, 0), 3: (72.0, 87.0, 3), 4: (72.0, 95.0, 0), 5: (100.0, 173.0, 0)}


def test_answers_overlays_and_table_prompts(spark):
    reply = '<think>{}</think>```json {"u1-s1": "a", "s1": "b", "u2": {"s3": "c", "s4": 5}, "k": [1], "note": "d"}```'
    df = spark.createDataFrame([(1, reply), (2, "none"), (3, None)], "doc_id long, reply string")
    assert sorted((r.slot, r.answer) for r in y.flat_answers(df).collect()) == [("note", "d"), ("s1", "b"), ("s3", "c")]
    raw = [("ink", [[1.0, 2.0]] * 2500, "#ABCDEF", 99.0, None, None, None), ("ink", [[1.0, 2.0]], "#abcdef", 1.0, None, None, None), ("ink", [[1.0, 2.0]] * 2, "blue", None, None, None, None), ("circle", None, None, None, [1.0] * 4, 2.0, "mono"), (None, None, None, None, [1.0] * 3, 2.0, "mono"), ("x", None, None, None, [1.0] * 4, None, "odd")]
    df = spark.createDataFrame([(1, 0, i, *r) for i, r in enumerate(raw)], "doc_id long, page int, line_no int, kind string, points array<array<double>>, color string, width double, bbox array<double>, size double, font string")
    got = {r.line_no: (r.kind, r.n_points, r.color, r.width, r.size, r.font) for r in n.clean_overlays(df, spark.createDataFrame([(1, 0)], "doc_id long, page int")).collect()}
    assert got == {0: ("ink", 2000, "#abcdef", 20.0, None, None), 2: ("ink", 2, "#1a1a1a", 2.0, None, None), 3: ("circle", None, None, None, 6.0, "mono"), 5: ("text", None, None, None, 11.0, "sans")}
    cells = [(1, 0, 0, 0, 0, None, "Name"), (1, 0, 0, 1, 0, None, ""), (1, 0, 1, 0, 1, 1, "x {{s1}}"), (1, 0, 1, 1, 0, None, "y"), (1, 1, 0, 0, 2, 2, "{{s2}} {{s3}}"), (1, 1, 1, 0, 0, None, "z")]
    df = spark.createDataFrame(cells, "doc_id long, page int, row int, col int, n int, first_slot int, text string")
    assert {r.page: r.prompt for r in n.table_prompts(df).collect()} == {0: 'TABLE:\n  [under "Name"] x {{s1}}\n  [under ""] y', 1: "TABLE:\n  [r0c0] {{s2}} {{s3}}\n  [r1c0] z"}
    assert {r.page: r.slots for r in n.table_slots(df).collect()} == {0: "s1", 1: "s2,s3"}
    one = spark.range(1)
    assert one.select(c.ocr_placeholders(F.lit("a ___ b ____"), F.array(*map(F.lit, ["s1", "s2", "s3"])))).first()[0] == "a {{s1}} b {{s2}} {{s3}}"
    assert one.select(c.ocr_placeholders(F.lit("a ___ b ____"), F.array(F.lit("s1")))).first()[0] == "a {{s1}} b "


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo".encode())
    (tmp_path / "b.md").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "c.png").write_bytes(b"\x89PNG")
    got = {r.name: r.text for r in io.read_text_files(spark, f"{tmp_path}/*").collect()}
    assert got == {"a.txt": "héllo", "b.md": "café", "c.png": "[unsupported file: c.png]"}
    (tmp_path / "rates.json").write_text(json.dumps({"models": {"m": {"in": 1, "out": 2.5}}}))
    assert [tuple(r) for r in io.read_rate_card(spark, str(tmp_path / "rates.json")).collect()] == [("m", 1.0, 2.5)]
    assert io.read_rate_card(spark, str(tmp_path / "none.json")).count() == 0
    df = spark.createDataFrame([(ts("2024-01-01 05:00:00"), "k1"), (ts("2024-01-02 05:00:00"), None)], "ts timestamp, k string")
    io.append_daily(df, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).filter("dt = '2024-01-02'").count() == 1
    assert io.append_new(df, str(tmp_path / "n"), "k") == 2 and io.append_new(df, str(tmp_path / "n"), "k") == 1
    (tmp_path / "g.json").write_text(json.dumps({"pages": [{"index": 1, "width": 1, "height": 2, "cells": [{"glyph": "g", "draw": [1, 2, 3, 4]}, {"glyph": "A", "draw": [0, 0, 1, 1]}]}]}))
    assert [(r.glyph, r.x1, r.descends) for r in io.read_geometry(spark, str(tmp_path / "g.json")).orderBy("glyph").collect()] == [("A", 1.0, False), ("g", 3.0, True)]
    units = spark.createDataFrame([(1, 0, 3, "bullet", "u1"), (1, 0, 1, "bullet", "u0")], "doc_id long, page int, line_no int, kind string, unit_id string")
    io.write_structure(units, str(tmp_path / "s"))
    assert [u.unit_id for u in spark.read.parquet(str(tmp_path / "s")).first().units] == ["u0", "u1"]
    files = spark.createDataFrame([("j", "b", "two"), ("j", "a", "one"), ("j", "c", " ")], "job string, name string, text string")
    assert io.context_blocks(files, "job").first().context == "### a\none\n\n### b\ntwo"


def test_the_rest_works_without_the_training_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['formlens.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'usage_heatmap' in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)


def test_unequal_and_merged_cells(spark):
    """A head over two columns, a wide and a narrow cell below, a character on an edge in the right cell, one outside in none."""
    lines = spark.createDataFrame([(1, 0, 0, "Head ___ x", 10.0, 5.0, 60.0, 15.0), (1, 0, 1, "ab__cd____", 10.0, 25.0, 60.0, 35.0), (1, 0, 2, "out", 10.0, 95.0, 25.0, 99.0), (1, 0, 3, None, 10.0, 25.0, 60.0, 35.0)], "doc_id long, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")
    cells = spark.createDataFrame([(1, 0, 0, 0, 0.0, 0.0, 200.0, 20.0), (1, 0, 1, 0, 0.0, 20.0, 27.5, 90.0), (1, 0, 1, 1, 27.5, 20.0, 200.0, 90.0)], "doc_id long, page int, row int, col int, cx0 double, cy0 double, cx1 double, cy1 double")
    got = {(r.row, r.col): (r.text, r.x0, r.n) for r in n.cell_lines(lines, cells).collect()}
    assert got == {(0, 0): ("Head ___ x", 10.0, 1), (1, 0): ("ab_", 10.0, 1), (1, 1): ("_cd____", 25.0, 2)}
    assert {(r.row, r.col): r.text for r in y.cell_text(y.glyphs(lines), cells).collect()} == {k: v[0] for k, v in got.items()}
    assert {(r.row, r.col): (r.top, r.bottom) for r in n.table_regions(y.glyphs(lines), cells).collect()} == {(1, 0): (35.0, 90.0), (1, 1): (35.0, 90.0)}
    assert n.cell_lines(lines, cells.limit(0)).count() == 0


def test_rates_of_a_long_history_are_carried(spark, monkeypatch):
    """Over 65,536 rates, models without calls, calls before the first rate, on a change of rates and without a model or time."""
    history = spark.range(70_000).selectExpr("concat('m', id % 7) as model", "timestamp'2024-01-01' + make_interval(0,0,0,0,0, id * 11, 0) as effective_from", "cast(id % 1000 as double) as rate_in", "cast(id % 13 as double) as rate_out")
    calls = spark.range(3000).selectExpr("id as event_id", "if(id % 50 = 0, null, concat('m', if(id % 3 = 0, 1, id % 9))) as model", "if(id % 61 = 0, null, timestamp'2023-12-25' + make_interval(0,0,0,0,0, id * 11 * 7 * 3, 0)) as ts", "10 as prompt_tokens", "cast(id as int) as output_tokens")
    rows = lambda: sorted(map(tuple, m.cost_calls_asof(calls, history).select("event_id", "model", "cost_usd").collect()))
    carried = rows()
    monkeypatch.setattr(m, "BROADCAST_RATES", 1 << 20)
    assert carried == rows() and len(carried) == 3000 and sum(r[2] is not None for r in carried) > 1000


def test_rate_card_flag(spark, tmp_path):
    for name, text, free in (("a", '{"_provider_primary_is_free": false, "models": {}}', False), ("b", '{"models": {}}', True), ("c", "{broken", True), ("d", "", True)):
        (tmp_path / name).write_text(text)
        assert io.primary_is_free(spark, str(tmp_path / name)) is free
    assert io.primary_is_free(spark, str(tmp_path / "none")) is True
