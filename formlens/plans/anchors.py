"""Anchor, table and answer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from formlens.functions import core as c
from formlens.operators import anchors as n
from formlens.operators import layout as y
from formlens.operators import metering as m
from formlens.plans.layout import EMPTY, FOUND, INLINE, LABEL, NUMBERED, QUESTION, REGISTRY, RUN, SAME, STACK, STEMS, STRIPPED, TABLE_CELLS, cells, found, images, kept, outer, page_list, rects
from formlens.plans.registry import query
from formlens.sources.io import context_blocks

pages = lambda x: x.select("doc_id", "page").distinct()
query("anchor_page_base", lambda x: n.page_base(x.filter("k = 3").select("doc_id", F.col("line_no").alias("item_no"), (F.col("page") + (F.col("doc_id") % 2).cast("int")).alias("page")), pages(x)), "lines",
      "WITH a AS (SELECT doc_id, line_no AS item_no, page + CAST(doc_id % 2 AS INT) AS page FROM lines WHERE k = 3), p AS (SELECT doc_id, count(DISTINCT page) AS n FROM lines GROUP BY doc_id), s AS (SELECT a.doc_id, min(page) >= 1 AND max(page) = max(n) AS s FROM a JOIN p ON p.doc_id = a.doc_id GROUP BY a.doc_id) SELECT a.doc_id, item_no, page - CAST(s AS INT) AS page FROM a JOIN s ON s.doc_id = a.doc_id")
beside = lambda x: x.filter(F.col("text").contains("_")).withColumns({"position": F.when(F.col("doc_id") % 2 == 0, "after").otherwise("before"), "a0": F.when(F.col("doc_id") % 2 == 0, 0).otherwise(F.greatest(F.length("text") - 8, F.lit(0))), "a1": F.when(F.col("doc_id") % 2 == 0, F.least(F.length("text"), F.lit(15)) - 1).otherwise(F.length("text") - 1)})
query("anchor_slots", lambda x: n.slots(beside(x)), "lines", """WITH s AS (SELECT doc_id, page, line_no, x0, text, doc_id % 2 = 0 AS aft, CASE WHEN doc_id % 2 = 0 THEN least(length(text), 15) - 1 ELSE greatest(length(text) - 8, 0) END AS a, regexp_extract_all(text, '_+') AS r, regexp_split_to_array(text, '_+') AS g FROM lines WHERE contains(text, '_')),
e AS (SELECT *, unnest(range(len(r))) AS k FROM s),
p AS (SELECT doc_id, page, line_no, aft, a, list_sum(list_transform(g[1:k + 1], lambda z: length(z))) + coalesce(list_sum(list_transform(r[1:k], lambda z: length(z))), 0) AS st, length(r[k + 1]) AS n FROM e),
f AS (SELECT doc_id, page, line_no, CASE WHEN any_value(aft) THEN min(st) FILTER (WHERE st > a) ELSE max(st) FILTER (WHERE st + n <= a) END AS st FROM p GROUP BY 1, 2, 3),
q AS (SELECT s.*, p.st, p.n, coalesce(CASE WHEN s.aft THEN 5 * (p.st - s.a - 1) ELSE 5 * (s.a - p.st - p.n) END <= 60, false) AS near, substr(text, s.a + 2) AS rest FROM s JOIN f ON f.doc_id = s.doc_id AND f.page = s.page AND f.line_no = s.line_no LEFT JOIN p ON p.doc_id = s.doc_id AND p.page = s.page AND p.line_no = s.line_no AND p.st = f.st),
m AS (SELECT *, x0 + 5.0 * (a + 1) + 3 AS b0, CASE WHEN trim(rest) = '' THEN 572.0 ELSE least(572.0, x0 + 5.0 * (a + 1 + length(rest) - length(ltrim(rest))) - 4) END AS lim FROM q)
SELECT doc_id, page, line_no, CASE WHEN aft THEN 'after' ELSE 'before' END AS position, CASE WHEN near THEN x0 + 5.0 * st WHEN aft THEN b0 ELSE greatest(x0, x0 + 5.0 * a - 130) END AS sx0,
  CASE WHEN near THEN x0 + 5.0 * (st + n) WHEN aft THEN CASE WHEN lim - b0 >= 8 THEN lim ELSE b0 + 130 END ELSE x0 + 5.0 * a - 2 END AS sx1, CAST(CASE WHEN near THEN n ELSE 0 END AS INT) AS underscores FROM m""")
query("anchor_regions", lambda x: n.regions(x.filter("k = 3 or k = 14"), x), "lines", "SELECT a.doc_id, a.page, a.line_no, a.y1 AS top, coalesce(min(l.y0), 732.0) AS bottom FROM lines a LEFT JOIN lines l ON l.doc_id = a.doc_id AND l.page = a.page AND l.y0 >= a.y1 AND trim(l.text) <> '' WHERE a.k IN (3, 14) GROUP BY a.doc_id, a.page, a.line_no, a.y1 HAVING coalesce(min(l.y0), 732.0) - a.y1 >= 25")
query("anchor_bullets", n.bullets_between, "lines", f"WITH q AS (SELECT doc_id, page, line_no, coalesce(lead(line_no) OVER (PARTITION BY doc_id, page ORDER BY line_no), 2147483647) AS until FROM lines WHERE {QUESTION}) SELECT q.doc_id, q.page, q.line_no, b.line_no AS bullet FROM q JOIN (SELECT * FROM lines WHERE {EMPTY}) b ON b.doc_id = q.doc_id AND b.page = q.page AND b.line_no > q.line_no AND b.line_no < q.until")
UNITS = f"""{STACK}, {INLINE}, {STEMS}, op AS (SELECT doc_id, page, st, sys, opt, min(line_no) AS line_no, string_agg(trim(text), ' ' ORDER BY rn) AS text FROM wl GROUP BY ALL),
lb AS (SELECT doc_id, page, st, min(x0) AS x0, min(y0) AS y0, max(y1) AS y1, max(x0 + 5.0 * coalesce(least(nullif(strpos(left(text, 8), '.'), 0), nullif(strpos(left(text, 8), ')'), 0)), least(length(text), 8))) AS x1 FROM wl WHERE token IS NOT NULL GROUP BY ALL),
mu AS (SELECT op.doc_id, op.page, min(op.line_no) AS first_line, count(*) AS n, op.sys AS system, any_value(lb.x0) AS x0, any_value(lb.y0) AS y0, any_value(lb.x1) AS x1, any_value(lb.y1) AS y1, string_agg(text, ' | ' ORDER BY opt) AS options FROM op JOIN lb ON lb.doc_id = op.doc_id AND lb.page = op.page AND lb.st = op.st GROUP BY op.doc_id, op.page, op.st, op.sys HAVING count(*) >= 2)"""
query("mc_units", n.choice_units, "lines", f"WITH {UNITS} SELECT mu.*, (SELECT trim(regexp_replace(string_agg(text, ' ' ORDER BY rn), '\\s+', ' ', 'g')) FROM sl WHERE sl.doc_id = mu.doc_id AND sl.page = mu.page AND sl.first_line = mu.first_line) AS stem FROM mu")
query("mc_suppress", lambda x: n.suppress(x.select("doc_id", "page", "line_no", ((F.col("y0") + F.col("y1")) / 2).alias("y")), n.choice_units(x)), "lines", f"WITH {UNITS} SELECT doc_id, page, line_no, (y0 + y1) / 2 AS y FROM lines l WHERE NOT EXISTS (SELECT 1 FROM mu WHERE mu.doc_id = l.doc_id AND mu.page = l.page AND (l.y0 + l.y1) / 2 BETWEEN mu.y0 AND mu.y1)")
REPLY = "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'B. text' WHEN 1 THEN ' (c)' WHEN 2 THEN 'Hmm' ELSE '42' END"
query("mc_answers", lambda x: n.chosen_option(n.choice_units(x), y.stacked_options(x).select("doc_id", "page", "first_line", F.expr(REPLY).alias("answer"))), "lines", f"WITH {STACK} SELECT doc_id, page, first_line, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN CASE WHEN system = 'letter' THEN 'B' END WHEN 1 THEN CASE WHEN system = 'letter' AND n_options >= 3 THEN 'C' END WHEN 2 THEN CASE WHEN system = 'letter' AND n_options >= 8 THEN 'H' END END AS label FROM so")
query("ocr_boxes", lambda x: x.select("doc_id", "page", "line_no", c.ocr_box(F.expr("array(line_no % 1000, line_no * 3 % 1000, line_no * 7 % 1000, line_no * 11 % 1000)"), 612.0, 792.0).alias("b")).select("doc_id", "page", "line_no", "b.*"), "lines",
      "SELECT doc_id, page, line_no, least(line_no % 1000, line_no * 7 % 1000) * 612.0::DOUBLE / 1000.0 AS x0, least(line_no * 3 % 1000, line_no * 11 % 1000) * 792.0::DOUBLE / 1000.0 AS y0, greatest(line_no % 1000, line_no * 7 % 1000) * 612.0::DOUBLE / 1000.0 AS x1, greatest(line_no * 3 % 1000, line_no * 11 % 1000) * 792.0::DOUBLE / 1000.0 AS y1 FROM lines")
query("ocr_prompts", lambda x: x.filter(F.col("text").contains("___")).select("doc_id", "line_no", c.ocr_placeholders(F.col("text"), F.transform(F.sequence(F.lit(1), F.size(F.split("text", "_{3,}")) - 1 + (F.col("doc_id") % 2).cast("int")), lambda i: F.concat(F.lit("s"), i.cast("string")))).alias("prompt")), "lines",
      "WITH s AS (SELECT doc_id, line_no, regexp_split_to_array(text, '_{3,}') AS g FROM lines WHERE contains(text, '___')) SELECT doc_id, line_no, array_to_string(list_transform(g, lambda p, i: CASE WHEN i = 1 THEN p ELSE '{{s' || CAST(i - 1 AS VARCHAR) || '}}' || p END), '') || CASE WHEN doc_id % 2 = 1 THEN ' {{s' || CAST(len(g) AS VARCHAR) || '}}' ELSE '' END AS prompt FROM s")
query("open_regions", lambda x: n.clamped_regions(x, images(x)), "lines", f"WITH q AS (SELECT *, lead(y0) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, line_no) AS nxt FROM lines WHERE {QUESTION}), b AS (SELECT doc_id, page, 100.0 AS bx0, 500.0 AS bx1, 300.0 AS oy FROM (SELECT DISTINCT doc_id, page FROM lines) WHERE page % 3 = 0) SELECT q.doc_id, q.page, line_no, y1 AS top, least(coalesce(any_value(nxt), 732.0), coalesce(min(oy), 732.0)) AS bottom FROM q LEFT JOIN b ON b.doc_id = q.doc_id AND b.page = q.page AND oy >= y1 AND bx0 < x1 AND bx1 > x0 GROUP BY q.doc_id, q.page, line_no, y1")
CELLS = f"""{FOUND}, {REGISTRY}, cp AS (SELECT *, trim(regexp_replace(array_to_string(list_transform(g, lambda p, i: CASE WHEN i = 1 THEN p ELSE '{{{{s' || CAST(first_slot + i - 2 AS VARCHAR) || '}}}}' || p END), ''), '\\s+', ' ', 'g')) AS t FROM rg WHERE z = 0),
fc AS (SELECT doc_id, page, r, c, sum(n) AS n, min(first_slot) FILTER (WHERE n > 0) AS first_slot, trim(regexp_replace(string_agg(t, ' ' ORDER BY line_no), '\\s+', ' ', 'g')) AS text FROM cp GROUP BY ALL)"""
IDS = "list_transform(range(CAST(first_slot AS BIGINT), CAST(first_slot + n AS BIGINT)), lambda i: 's' || CAST(i AS VARCHAR))"


def registry(x, rows):
    """``rows`` (slot_rows or slot_registry) of a document's cells and units, which share one list of pages."""
    sheets = page_list(x)
    return rows(cells(x, sheets), found(x, sheets))


filled = lambda x: n.filled_cells(registry(x, n.slot_rows))
query("table_prompts", lambda x: n.table_prompts(filled(x)), "lines", f"""WITH {CELLS}, hh AS (SELECT doc_id, page, coalesce(sum(n) FILTER (WHERE r = 0), 0) = 0 AS h FROM fc GROUP BY ALL)
SELECT b.doc_id, b.page, 'TABLE:' || chr(10) || string_agg(CASE WHEN hh.h THEN '  [under "' || coalesce(t.text, '') || '"] ' ELSE '  [r' || CAST(b.r AS VARCHAR) || 'c' || CAST(b.c AS VARCHAR) || '] ' END || b.text, chr(10) ORDER BY b.r, b.c) AS prompt
FROM fc b JOIN hh ON hh.doc_id = b.doc_id AND hh.page = b.page LEFT JOIN fc t ON t.doc_id = b.doc_id AND t.page = b.page AND t.c = b.c AND t.r = 0 WHERE b.text <> '' AND (b.r > 0 OR NOT hh.h) GROUP BY b.doc_id, b.page""")
query("table_regions", lambda x: n.table_regions(y.glyphs(x, run=RUN), rects(x)), "lines", f"""WITH {TABLE_CELLS}, us AS (SELECT doc_id, page, r, c, max(y1) AS u FROM cc GROUP BY ALL),
rt AS (SELECT tc.*, CAST(coalesce(u, cy0) AS DOUBLE) AS top FROM tc LEFT JOIN us ON us.doc_id = tc.doc_id AND us.page = tc.page AND us.r = tc.r AND us.c = tc.c) SELECT doc_id, page, r AS "row", c AS col, top, CAST(cy1 AS DOUBLE) AS bottom FROM rt WHERE cy1 - top >= 30""")
query("cell_slots", lambda x: n.cell_slots(filled(x)), "lines", f"WITH {CELLS} SELECT doc_id, page, r AS \"row\", c AS col, n, first_slot, text, array_to_string({IDS}, ',') AS slots FROM fc WHERE n > 0")
query("table_slots", lambda x: n.table_slots(filled(x)), "lines", f"WITH {CELLS} SELECT doc_id, page, array_to_string(flatten(list({IDS} ORDER BY r, c)), ',') AS slots FROM fc WHERE n > 0 GROUP BY doc_id, page")
query("slot_numbers", lambda x: registry(x, n.slot_registry).drop("after_table"), "lines", f'WITH {FOUND}, {REGISTRY} SELECT doc_id, page, r AS "row", c AS col, line_no, n, first_slot FROM rg WHERE n > 0')
ITEM = "CASE CAST(line_no % 4 AS INT) WHEN 0 THEN 'inline' WHEN 1 THEN 'bullet' ELSE 'open' END"
BESIDE = "CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'below' WHEN 1 THEN 'before' WHEN 2 THEN 'none' ELSE 'after' END"
listed = lambda x: x.filter("k = 3 or k = 4").groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "page", F.expr(ITEM).alias("kind"), F.left("text", F.lit(15)).alias("anchor_text"), F.expr(BESIDE).alias("blank_position")))), lambda s: s.dropFields("line_no")).alias("items"))
query("anchor_items", lambda x: n.anchor_items(listed(x).select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.to_json("items")).otherwise(F.concat(F.lit("<think>{}</think> Here: ```json "), F.to_json(F.struct("items")), F.lit(" ```"))).alias("reply"))), "lines", f"WITH a AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INT) AS item_no, page, {ITEM} AS kind, left(text, 15) AS anchor_text, {BESIDE} AS blank_position FROM lines WHERE k IN (3, 4)) SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, item_no) AS INT) AS place FROM a WHERE doc_id % 7 <> 0 AND kind <> 'bullet' AND blank_position <> 'below' AND trim(anchor_text) <> ''")
drawn = lambda x: x.select("doc_id", (F.col("page") - (F.col("line_no") % 13 == 0).cast("int")).alias("page"), "line_no", F.expr("CASE CAST(k % 3 AS INT) WHEN 0 THEN 'ink' WHEN 1 THEN 'circle' END").alias("kind"), F.transform(F.sequence(F.lit(1), F.when(F.col("line_no") % 17 == 0, 2500).otherwise(F.col("line_no") % 4 + 1)), lambda i: F.array(i.cast("double"), F.lit(1.0))).alias("points"), F.when(F.col("k") % 2 == 0, "#A0b1C2").otherwise("red").alias("color"), F.when(F.col("k") != 6, F.col("line_no") % 30).cast("double").alias("width"), F.transform(F.sequence(F.lit(1), F.when(F.col("k") == 7, 3).otherwise(4)), lambda i: i.cast("double")).alias("bbox"), F.when(F.col("k") != 5, F.col("line_no") % 60).cast("double").alias("size"), F.when(F.col("k") % 2 == 0, "mono").otherwise("comic").alias("font"))
query("overlay_clean", lambda x: n.clean_overlays(drawn(x), pages(x)), "lines", """SELECT doc_id, page - CAST(line_no % 13 = 0 AS INT) AS page, line_no, CASE k % 3 WHEN 0 THEN 'ink' WHEN 1 THEN 'circle' ELSE 'text' END AS kind, CASE WHEN k % 3 = 0 THEN CAST(CASE WHEN line_no % 17 = 0 THEN 2000 ELSE line_no % 4 + 1 END AS INT) END AS n_points,
CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN '#a0b1c2' ELSE '#1a1a1a' END END AS color, CASE WHEN k % 3 = 0 THEN CASE WHEN k = 6 THEN 2.0 ELSE least(greatest(line_no % 30, 0.5), 20.0) END END AS width,
CASE WHEN k % 3 <> 0 THEN CASE WHEN k = 5 THEN 11.0 ELSE least(greatest(line_no % 60, 6.0), 48.0) END END AS size, CASE WHEN k % 3 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'mono' ELSE 'sans' END END AS font
FROM lines WHERE page - CAST(line_no % 13 = 0 AS INT) >= 0 AND CASE WHEN k % 3 = 0 THEN line_no % 17 = 0 OR line_no % 4 + 1 >= 2 ELSE k <> 7 END""")
parts = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "line_no", c))), lambda s: s[c]), ",").alias(c)
query("doc_structure", lambda x: found(x).filter("line_no = unit_line").groupBy("doc_id").agg(F.count("*").alias("unit_count"), parts("kind")), "lines", f"WITH {FOUND} SELECT doc_id, count(*) AS unit_count, string_agg(kind, ',' ORDER BY page, line_no) AS kind FROM da WHERE line_no = unit_line GROUP BY doc_id")
TIDY = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
query("llm_units", lambda x: n.model_units(*kept(x)), "lines", f"""WITH {FOUND}, {NUMBERED}, {REGISTRY}, u AS (SELECT un.*, text, x0, y0 FROM un JOIN lines l ON {SAME('un', 'l')} AND l.line_no = un.line_no),
ip AS (SELECT u.doc_id, unit_id, u.y0, u.x0, u.line_no, n, first_slot, CASE WHEN n > 0 THEN {TIDY("array_to_string(list_transform(g, lambda p, i: CASE WHEN i = 1 THEN p ELSE '{{s' || CAST(first_slot + i - 2 AS VARCHAR) || '}}' || p END), '')")} ELSE u.text END AS t FROM u JOIN rg ON {SAME('u', 'rg')} AND rg.line_no = u.line_no AND rg.z = 1 WHERE kind = 'inline_blank'),
iq AS (SELECT doc_id, unit_id, string_agg(t, ' ' ORDER BY y0, x0, line_no) AS text, CAST(min(first_slot) FILTER (WHERE n > 0) AS BIGINT) AS f, CAST(sum(n) AS BIGINT) AS n FROM ip GROUP BY ALL),
op AS (SELECT doc_id, page, st, opt, min(line_no) AS line_no, max(token) AS label, string_agg(trim(text), ' ' ORDER BY rn) AS text FROM wl GROUP BY ALL),
rr AS (SELECT doc_id, page, min(line_no) AS first_line, string_agg(text, '  ' ORDER BY opt) AS texts, string_agg(label || ': ' || text, ' | ' ORDER BY opt) AS options FROM op GROUP BY doc_id, page, st HAVING count(*) >= 2),
sm AS (SELECT doc_id, page, first_line, {TIDY("string_agg(text, ' ' ORDER BY rn)")} AS stem FROM sl GROUP BY ALL)
SELECT doc_id, unit_id, 'inline_blank' AS kind, {TIDY(STRIPPED)} AS prompt, NULL AS answer_key, array_to_string(list_transform(range(f, f + n), lambda i: 's' || CAST(i AS VARCHAR)), ',') AS slots, NULL AS options FROM iq
UNION ALL SELECT u.doc_id, unit_id, kind, trim(coalesce(stem, '') || '  ' || texts), unit_id, NULL, options FROM u JOIN rr ON {SAME('u', 'rr')} AND rr.first_line = u.line_no LEFT JOIN sm ON {SAME('u', 'sm')} AND sm.first_line = u.line_no WHERE kind = 'multiple_choice' AND u.line_no = u.unit_line
UNION ALL SELECT doc_id, unit_id, kind, {TIDY("string_agg(text, ' ' ORDER BY y0, x0, line_no)")}, unit_id, NULL, NULL FROM u WHERE kind = 'open_response' GROUP BY doc_id, unit_id, kind
UNION ALL SELECT u.doc_id, unit_id, kind, prompt, unit_id, NULL, NULL FROM u JOIN bu ON {SAME('u', 'bu')} AND bu.line_no = u.line_no WHERE kind = 'bullet'
UNION ALL SELECT doc_id, unit_id, kind, CASE kind WHEN 'trailing_dash' THEN {TIDY(LABEL)} ELSE trim(text) END, unit_id, NULL, NULL FROM u WHERE kind IN ('trailing_dash', 'multiple_choice_inline')""")
query("context_blocks", lambda x: context_blocks(x.select("conv_id", F.concat(F.lpad(F.col("turn").cast("string"), 4, "0"), F.lit(" "), F.col("role")).alias("name"), "text"), "conv_id", 300), "conversations", "SELECT conv_id, string_agg('### ' || lpad(CAST(turn AS VARCHAR), 4, '0') || ' ' || role || chr(10) || CASE WHEN length(text) > 300 THEN rtrim(left(text, 300), ' ') || ' [truncated]' ELSE text END, chr(10) || chr(10) ORDER BY turn, role, text) AS context FROM conversations WHERE trim(text, ' ') <> '' GROUP BY conv_id")
query("rate_card_rows", lambda u: m.rate_card_from_json(u.select(F.when(F.col("user_id") % 10 == 0, F.lit("{broken")).otherwise(F.format_string('{"models":{"m%d":{"in":%d}}}', "user_id", F.col("user_id") % 7)).alias("value"))), "users", "SELECT 'm' || CAST(user_id AS VARCHAR) AS model, CAST(user_id % 7 AS DOUBLE) AS rate_in, 0.0::DOUBLE AS rate_out FROM users WHERE user_id % 10 <> 0")
query("rate_card_clean", lambda u: m.clean_rates(u.select(F.when(F.col("user_id") % 11 == 0, F.lit(" ")).otherwise(F.col("email")).alias("model"), F.expr("CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'x' WHEN 1 THEN '-1' WHEN 2 THEN NULL WHEN 3 THEN 'NaN' ELSE '2.5' END").alias("rate_in"), F.lit("1").alias("rate_out"))), "users", "SELECT email AS model, CASE CAST(user_id % 5 AS INT) WHEN 2 THEN 0.0::DOUBLE ELSE 2.5::DOUBLE END AS rate_in, 1.0::DOUBLE AS rate_out FROM users WHERE user_id % 11 <> 0 AND user_id % 5 IN (2, 4)")
