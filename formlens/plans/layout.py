"""Layout queries over the derived line tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from formlens.functions import core as c
from formlens.operators import anchors as n
from formlens.operators import layout as y
from formlens.operators import page_index as px
from formlens.plans.registry import query
from formlens.sources.io import PAGES, flatten_geometry, glyph_set, stored, template_markers

B = "[●○■▪◆◇•·]"
BULLETED = f"regexp_matches(text, '^\\s*{B}')"
STRIPPED = "regexp_replace(text, '^[\\s●○■▪◆◇•·\u200b\u200c\u200d]+', '')"
EMPTY = f"({BULLETED} AND {STRIPPED} = '')"
QUESTION = "regexp_matches(text, '^\\s*\\d+\\s*[.)]\\s')"
P = "PARTITION BY doc_id, page ORDER BY y0, x0, line_no"
FOLD = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[​‌‍﻿­]', '', 'g'), '[‐‑‒–—―−﹘﹣－·•]', '-', 'g'), '[‘’ʼ`´]', chr(39), 'g'), '[“”]', chr(34), 'g')"
NORMAL = f"lower(trim(regexp_replace({FOLD}, '\\s+', ' ', 'g')))"
LATIN = "translate(text, 'АВСЕНΑΒΕΗ', 'ABCEHABEH')"
TOKEN = f"nullif(upper(regexp_extract({LATIN}, '^\\s*([A-Za-z]{{1,4}})\\s*[.)]\\s+\\S', 1)), '')"
LET, ROM = "['A','B','C','D','E','F','G','H']", "['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII']"
RUN = 64  # characters of a line that stay in one row
fn = lambda name, f, sql, table="lines": query(name, lambda x: x.select("doc_id", "line_no", f(F.col("text")).alias("v")), table, f"SELECT doc_id, line_no, {sql} AS v FROM {table}")

query("doc_lines", lambda x: x.filter(F.trim("text") != "").select("doc_id", "line_no", "text"), "raw_lines", "SELECT doc_id, line_no, text FROM raw_lines WHERE trim(text) <> ''")
fn("bullet_strip", c.strip_bullet, STRIPPED)
fn("empty_bullets", c.is_empty_bullet, EMPTY)
fn("question_starts", c.is_question_start, QUESTION)
fn("text_normalize", c.normalize_text, NORMAL)
fn("text_alnum", c.alnum_only, "regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')")
fn("text_truncate", lambda t: c.truncate_text(t, 40), "CASE WHEN length(text) > 40 THEN rtrim(left(text, 40)) || ' [truncated]' ELSE text END", "raw_lines")
fn("option_tokens", y.option_token, TOKEN)
fn("label_ordinals", lambda t: y.label_ordinal(y.option_token(t)), f"CAST(nullif(coalesce(nullif(list_position({LET}, {TOKEN}), 0), list_position({ROM}, {TOKEN})), 0) AS INT)")
fn("find_occurrences", lambda t: F.size(c.occurrences(F.lower(t), F.lit("aa"))), "CAST(coalesce(list_sum(list_transform(regexp_extract_all(lower(text), 'a+'), lambda r: length(r) - 1)), 0) AS INT)", "raw_lines")
query("underscore_runs", lambda x: x.select("doc_id", "line_no", F.posexplode(c.underscore_runs(F.col("text"))).alias("k", "r")).select("doc_id", "line_no", "k", "r.start", "r.length"), "lines",
      """WITH s AS (SELECT doc_id, line_no, regexp_extract_all(text, '_+') AS r, regexp_split_to_array(text, '_+') AS g FROM lines WHERE contains(text, '_')),
e AS (SELECT doc_id, line_no, unnest(range(len(r))) AS k, r, g FROM s)
SELECT doc_id, line_no, CAST(k AS INT) AS k, CAST(list_sum(list_transform(g[1:k + 1], lambda z: length(z))) + coalesce(list_sum(list_transform(r[1:k], lambda z: length(z))), 0) AS INT) AS start, CAST(length(r[k + 1]) AS INT) AS length FROM e""")
query("inline_blanks", lambda x: x.filter(F.col("text").contains("_")).select("doc_id", "line_no", F.size(F.regexp_extract_all("text", F.lit("_+"), F.lit(0))).alias("n"), c.placeholder_text(F.col("text"), F.lit(1)).alias("t")), "lines",
      "WITH s AS (SELECT doc_id, line_no, regexp_split_to_array(text, '_+') AS g FROM lines WHERE contains(text, '_')) SELECT doc_id, line_no, CAST(len(g) - 1 AS INT) AS n, trim(regexp_replace(array_to_string(list_transform(g, lambda p, i: CASE WHEN i = 1 THEN p ELSE '{{s' || CAST(i - 1 AS VARCHAR) || '}}' || p END), ''), '\\s+', ' ', 'g')) AS t FROM s")
query("video_ids", lambda x: x.select("doc_id", "line_no", c.video_id(F.expr("CASE CAST(line_no % 5 AS INT) WHEN 0 THEN 'https://youtu.be/' || left(md5(text), 11) || '?t=1' WHEN 1 THEN 'https://www.youtube.com/watch?t=1&v=' || left(md5(text), 11) WHEN 2 THEN 'https://example.com/' || left(md5(text), 11) WHEN 3 THEN 'm.youtube.com/shorts/' || left(md5(text), 11) ELSE left(md5(text), 11) END")).alias("v")), "raw_lines", "SELECT doc_id, line_no, CASE WHEN line_no % 5 <> 2 THEN left(md5(text), 11) END AS v FROM raw_lines")
query("reading_order", y.reading_order, "lines", "SELECT doc_id, page, line_no, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY round_even(y0 / 3, 0) * 3, x0, line_no) AS INT) AS rank FROM lines")
query("logical_units", y.logical_units, "lines", f"WITH f AS (SELECT *, CASE WHEN coalesce({BULLETED} OR {QUESTION} OR y0 - lag(y1) OVER ({P}) > 14, true) THEN 1 ELSE 0 END AS s FROM lines) SELECT doc_id, page, line_no, sum(s) OVER ({P} ROWS UNBOUNDED PRECEDING) AS unit FROM f")
query("prompt_groups", y.prompt_groups, "lines", f"""WITH f AS (SELECT *, CASE WHEN coalesce(y0 - lag(y1) OVER ({P}) < 10 AND abs(x0 - lag(x0) OVER ({P})) < 30, false) THEN 0 ELSE 1 END AS s FROM lines),
g AS (SELECT *, sum(s) OVER ({P} ROWS UNBOUNDED PRECEDING) AS grp FROM f)
SELECT doc_id, page, grp, count(*) AS n_lines, min(line_no) AS first_line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, ' ' ORDER BY y0, x0, line_no) AS text FROM g GROUP BY doc_id, page, grp""")
query("group_bbox", y.group_bbox, "lines", "SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM lines GROUP BY ALL")
query("line_text", lambda x: y.line_text(y.glyphs(x, run=RUN)), "lines", f"SELECT doc_id, page, line_no, text, x0, x0 + 5.0 * length(text) AS x1 FROM lines WHERE text <> ''")
query("mc_label_boxes", lambda x: y.label_box(y.glyphs(x)), "lines", f"SELECT doc_id, page, line_no, x0, x0 + 5.0 * n AS x1 FROM (SELECT *, least(nullif(strpos(left(text, 8), '.'), 0), nullif(strpos(left(text, 8), ')'), 0)) AS n FROM lines) WHERE n IS NOT NULL")
ANSWERS = f"""bl AS (SELECT *, {EMPTY} AS e, row_number() OVER ({P}) AS rn FROM lines WHERE regexp_matches(text, '\\S')),
bp AS (SELECT x.doc_id, x.page, x.rn, max(z.rn) AS pr FROM bl x LEFT JOIN bl z ON z.doc_id = x.doc_id AND z.page = x.page AND z.rn < x.rn AND NOT z.e WHERE x.e GROUP BY ALL),
ba AS (SELECT x.doc_id, x.page, x.line_no, z.line_no AS prompt_line, coalesce(trim(regexp_replace(regexp_replace(z.text, '^[\\s●○■▪◆◇•·\u200b\u200c\u200d]+', ''), '\\s+', ' ', 'g')), 'Fill in this answer.') AS prompt, x.y0 AS top, coalesce(n.y0, 732.0) AS bottom
  FROM bp JOIN bl x ON x.doc_id = bp.doc_id AND x.page = bp.page AND x.rn = bp.rn LEFT JOIN bl z ON z.doc_id = bp.doc_id AND z.page = bp.page AND z.rn = bp.pr LEFT JOIN bl n ON n.doc_id = bp.doc_id AND n.page = bp.page AND n.rn = bp.rn + 1)"""
query("bullet_answers", y.bullet_answers, "lines", f"WITH {ANSWERS} SELECT * FROM ba")
query("bullet_parts", lambda x: y.bullet_parts(y.bullet_answers(x)), "lines", f"WITH {ANSWERS} SELECT doc_id, page, line_no, prompt_line, CAST(row_number() OVER (PARTITION BY doc_id, page, prompt_line ORDER BY line_no) AS INT) AS part, count(*) OVER (PARTITION BY doc_id, page, prompt_line) AS parts FROM ba")
# The walk down a page, line by line: the state is the open run (its first row), its system, labels so far, and the last label's bottom.
GO = f"coalesce(o.token = CASE w.sys WHEN 'letter' THEN {LET}[w.n + 1] WHEN 'roman' THEN {ROM}[w.n + 1] END, false)"
STAY = "(w.st IS NOT NULL AND o.token IS NULL AND o.y0 - w.ly BETWEEN 0 AND 6)"
STACK = f"""ol AS (SELECT *, row_number() OVER ({P}) AS rn, {TOKEN} AS token, {QUESTION} OR starts_with(lower(trim(text)), 'question') AS head FROM lines),
wk AS (SELECT doc_id, page, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS st, CAST(NULL AS VARCHAR) AS sys, 0 AS n, CAST(NULL AS DOUBLE) AS ly FROM ol WHERE rn = 1
  UNION ALL SELECT o.doc_id, o.page, o.rn, CASE WHEN {GO} OR {STAY} THEN w.st WHEN o.token IN ('A', 'I') THEN o.rn END,
    CASE WHEN {GO} OR {STAY} THEN w.sys WHEN o.token = 'A' THEN 'letter' WHEN o.token = 'I' THEN 'roman' END,
    CASE WHEN {GO} THEN w.n + 1 WHEN {STAY} THEN w.n WHEN o.token IN ('A', 'I') THEN 1 ELSE 0 END, CASE WHEN {STAY} THEN w.ly ELSE o.y1 END
  FROM wk w JOIN ol o ON o.doc_id = w.doc_id AND o.page = w.page AND o.rn = w.rn + 1),
wl AS (SELECT ol.*, wk.st, wk.sys, wk.n AS opt FROM wk JOIN ol ON ol.doc_id = wk.doc_id AND ol.page = wk.page AND ol.rn = wk.rn WHERE wk.st IS NOT NULL),
so AS (SELECT doc_id, page, min(line_no) AS first_line, max(line_no) AS last_line, CAST(max(opt) AS INT) AS n_options, sys AS system FROM wl GROUP BY doc_id, page, st, sys HAVING max(opt) >= 2)"""
LABELS = f"list_transform(regexp_extract_all(regexp_replace({LATIN}, '\\s', '  ', 'g'), '(?:^|\\s)([A-Za-z]{{1,4}})[.)]\\s', 1), lambda t: upper(t))"
INLINE = f"i0 AS (SELECT doc_id, page, line_no, {LABELS} AS l FROM lines), io AS (SELECT doc_id, page, line_no, CAST(len(l) AS INT) AS n_options FROM i0 WHERE len(l) >= 3 AND (l = {LET}[1:len(l)] OR l = {ROM}[1:len(l)]))"
# Lines above a run: none of those from there down to the run is held by options, followed by a wide gap or, but for itself, a heading.
STEMS = """hd AS (SELECT ol.*, lead(y0) OVER (PARTITION BY doc_id, page ORDER BY rn) - y1 AS room, EXISTS (SELECT 1 FROM so WHERE so.doc_id = ol.doc_id AND so.page = ol.page AND ol.line_no BETWEEN first_line AND last_line) OR EXISTS (SELECT 1 FROM io WHERE io.doc_id = ol.doc_id AND io.page = ol.page AND io.line_no = ol.line_no) AS held FROM ol),
sl AS (SELECT so.doc_id, so.page, so.first_line, k.line_no, k.text, k.rn FROM so JOIN ol f ON f.doc_id = so.doc_id AND f.page = so.page AND f.line_no = so.first_line JOIN hd k ON k.doc_id = so.doc_id AND k.page = so.page AND k.rn < f.rn
  LEFT JOIN hd j ON j.doc_id = so.doc_id AND j.page = so.page AND j.rn >= k.rn AND j.rn < f.rn AND (j.room > 26 OR j.held OR j.head AND j.rn > k.rn) WHERE j.rn IS NULL)"""
def rooms(free: str, obstacles: str = "") -> str:
    """Open groups (og) of the free lines: unit_line, box, floor."""
    nearest = f"least(nx, coalesce((SELECT min(oy) FROM ({obstacles}) ob WHERE ob.doc_id = gn.doc_id AND ob.page = gn.page AND gy1 <= oy AND oy < nx AND ox0 < 572 AND ox1 > gx0), nx))" if obstacles else "nx"
    return f"""fr AS ({free}),
fs AS (SELECT *, CASE WHEN coalesce(y0 - lag(y1) OVER ({P}) < 10 AND abs(x0 - lag(x0) OVER ({P})) < 30, false) THEN 0 ELSE 1 END AS s FROM fr),
fg AS (SELECT *, sum(s) OVER ({P} ROWS UNBOUNDED PRECEDING) AS grp FROM fs),
gg AS (SELECT doc_id, page, grp, count(*) AS n_lines, arg_min(line_no, (y0, x0, line_no)) AS unit_line, min(x0) AS gx0, max(x1) AS gx1, min(y0) AS gy0, max(y1) AS gy1, string_agg(text, ' ' ORDER BY y0, x0, line_no) AS gt FROM fg GROUP BY doc_id, page, grp),
gn AS (SELECT *, coalesce(lead(gy0) OVER (PARTITION BY doc_id, page ORDER BY grp), 732.0) AS nx FROM gg),
gb AS (SELECT gn.*, {nearest} AS bottom FROM gn), og AS (SELECT * FROM gb WHERE NOT contains(gt, '_') AND bottom - gy1 >= 25)"""


LABEL = "trim(regexp_replace(regexp_replace(text, '^[\\s●○■▪◆◇•·\u200b\u200c\u200d]+', ''), '[\u200b\u200c\u200d\ufeff\u00ad]', '', 'g'))"
DASH = f"td AS (SELECT doc_id, page, line_no FROM lines WHERE right(rtrim({LABEL}), 1) IN ('-', '‐', '‑', '‒', '–', '—', '―') AND length({LABEL}) >= 3 AND NOT contains(text, '_') AND 612 - x1 >= 25)"
query("mc_stacked", y.stacked_options, "lines", f"WITH {STACK} SELECT * FROM so")
query("mc_inline", y.inline_options, "lines", f"WITH {INLINE} SELECT * FROM io")
query("mc_stems", y.stems, "lines", f"WITH {STACK}, {INLINE}, {STEMS} SELECT doc_id, page, first_line, min(line_no) AS stem_line, trim(regexp_replace(string_agg(text, ' ' ORDER BY rn), '\\s+', ' ', 'g')) AS stem FROM sl GROUP BY doc_id, page, first_line")
OBSTACLES = "SELECT doc_id, page, 72.0 AS ox0, 540.0 AS ox1, 300.0 AS oy FROM (SELECT DISTINCT doc_id, page FROM lines) UNION ALL SELECT doc_id, page, 100.0, 500.0, 300.0 FROM (SELECT DISTINCT doc_id, page FROM lines) WHERE page % 3 = 0"
query("open_responses", y.open_responses, "lines", f"WITH {rooms('SELECT * FROM lines WHERE regexp_matches(text, $$\\S$$)')} SELECT doc_id, page, unit_line AS line_no, n_lines, gy1 AS top, bottom FROM og")
query("trailing_dash", y.trailing_dash, "lines", f"WITH {DASH} SELECT * FROM td")
INBOX = "(x0 + x1) / 2 BETWEEN 72 AND 540 AND (y0 + y1) / 2 BETWEEN 300 AND 420"
query("lines_outside", lambda x: y.outside(x, y.tables(x)).select("doc_id", "page", "line_no"), "lines", f"SELECT doc_id, page, line_no FROM lines WHERE NOT ({INBOX})")
# Rectangles of the tables, by (doc_id + page) % 3: equal cells, unequal ones, a head over all columns beside a cell over two rows.
EDGES = [("72,228,384,540", "300,360,420"), ("72,140,400,540", "300,330,420")]
GRIDS = [(m, r, c, xs[c], ys[r], xs[c + 1], ys[r + 1]) for m, (x, e) in enumerate(EDGES) for xs, ys in [(x.split(","), e.split(","))] for r in range(2) for c in range(3)]
GRIDS += [(2, 0, 0, 72, 300, 540, 340), (2, 1, 0, 72, 340, 160, 420), (2, 1, 1, 160, 340, 540, 380), (2, 2, 1, 160, 380, 540, 420)]
RECTS = ", ".join(f"named_struct('m', {m}, 'row', {r}, 'col', {c}, 'cx0', {x0}D, 'cy0', {y0}D, 'cx1', {x1}D, 'cy1', {y1}D)" for m, r, c, x0, y0, x1, y1 in GRIDS)
rects = lambda x: x.select("doc_id", "page").distinct().select("doc_id", "page", F.expr(f"inline(filter(array({RECTS}), t -> t.m = (doc_id + page) % 3))")).drop("m")
TABLE_CELLS = f"""tc AS (SELECT doc_id, page, r, c, cx0, cy0, cx1, cy1 FROM (SELECT DISTINCT doc_id, page FROM lines) JOIN (VALUES {', '.join(f"({', '.join(map(str, g))})" for g in GRIDS)}) t(m, r, c, cx0, cy0, cx1, cy1) ON m = (doc_id + page) % 3),
g0 AS (SELECT doc_id, page, line_no, y0, y1, x0, unnest(range(length(text))) AS i, text FROM lines WHERE text <> ''),
ch AS (SELECT doc_id, page, line_no, i, substr(text, i + 1, 1) AS ch, x0 + 5.0 * i + 2.5 AS x, (y0 + y1) / 2 AS y, y1 FROM g0),
cc AS (SELECT ch.*, r, c FROM ch JOIN tc ON tc.doc_id = ch.doc_id AND tc.page = ch.page AND x >= cx0 AND x < cx1 AND y >= cy0 AND y < cy1)"""
query("cell_text", lambda x: y.cell_text(y.glyphs(x, run=RUN), rects(x)), "lines", f"""WITH {TABLE_CELLS} SELECT doc_id, page, r AS "row", c AS col, string_agg(ch, '' ORDER BY line_no, i) AS text FROM cc GROUP BY ALL""")
images = lambda x: x.select("doc_id", "page").distinct().select("doc_id", "page", F.expr("inline(filter(array(named_struct('x0', 100D, 'y0', 300D, 'x1', 500D, 'y1', 320D, 'on', page % 3 = 0), named_struct('x0', 0D, 'y0', 0D, 'x1', 612D, 'y1', 792D, 'on', doc_id % 50 = 0)), b -> b.on))"))
sheets = lambda x: x.select("doc_id", "page").distinct().unionByName(x.filter("doc_id % 10 = 0").groupBy("doc_id").agg((F.max("page") + 1).alias("page"))).select("doc_id", "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
query("scanned_pages", lambda x: y.scanned_pages(sheets(x), images(x), x), "lines", "SELECT doc_id, page, doc_id % 50 = 0 OR sum(length(text)) = 0 AS scanned FROM lines GROUP BY doc_id, page UNION ALL SELECT doc_id, max(page) + 1, true FROM lines WHERE doc_id % 10 = 0 GROUP BY doc_id")
outer = lambda sql: sql.replace("FROM lines", "FROM lo").replace("JOIN lines", "JOIN lo")
SAME = lambda a, b: f"{b}.doc_id = {a}.doc_id AND {b}.page = {a}.page"
LESS = lambda a, *taken: " ".join(f"ANTI JOIN {t} USING (doc_id, page, line_no)" for t in taken)
# The lines outside tables, and what each detector in turn claims of those left.
FOUND = f"""lo AS (SELECT * FROM lines WHERE NOT ({INBOX})), {outer(f'{STACK}, {INLINE}, {STEMS}')},
mr AS (SELECT so.doc_id, so.page, lo.line_no, so.first_line FROM so JOIN lo ON {SAME('so', 'lo')} AND lo.line_no BETWEEN first_line AND last_line),
c0 AS (SELECT doc_id, page, line_no FROM mr UNION SELECT doc_id, page, line_no FROM io UNION SELECT doc_id, page, line_no FROM sl),
{rooms(f"SELECT lo.* FROM lo {LESS('lo', 'c0')} WHERE regexp_matches(text, $$\\S$$)", OBSTACLES)},
ol2 AS (SELECT fg.doc_id, fg.page, fg.line_no, og.unit_line, gx0, gx1, gy1, bottom FROM fg JOIN og ON {SAME('fg', 'og')} AND og.grp = fg.grp),
c1 AS (SELECT * FROM c0 UNION SELECT lo.doc_id, lo.page, lo.line_no FROM lo JOIN og ON {SAME('lo', 'og')} AND lo.y0 >= gy0 - 1 AND lo.y1 <= gy1 + 1 AND lo.x0 >= gx0 - 1),
{outer(ANSWERS)}, bu AS (SELECT * FROM ba {LESS('ba', 'c1')}),
{outer(DASH)}, dl AS (SELECT * FROM td {LESS('td', 'c1', 'bu')}),
rm AS (SELECT lo.* FROM lo {LESS('lo', 'c1', 'bu', 'dl')} WHERE regexp_matches(text, $$\\S$$)),
rs AS (SELECT *, CASE WHEN coalesce({BULLETED} OR {QUESTION} OR y0 - lag(y1) OVER ({P}) > 14, true) THEN 1 ELSE 0 END AS s FROM rm),
ru AS (SELECT *, sum(s) OVER ({P} ROWS UNBOUNDED PRECEDING) AS lu FROM rs),
il AS (SELECT ru.doc_id, ru.page, ru.line_no, g.unit_line FROM ru JOIN (SELECT doc_id, page, lu, arg_min(line_no, (y0, x0, line_no)) AS unit_line FROM ru GROUP BY ALL HAVING bool_or(contains(text, '_'))) g ON {SAME('ru', 'g')} AND g.lu = ru.lu),
da AS (SELECT doc_id, page, line_no, 'multiple_choice' AS kind, first_line AS unit_line FROM mr UNION ALL SELECT doc_id, page, line_no, 'multiple_choice_inline', line_no FROM io {LESS('io', 'mr')}
  UNION ALL SELECT doc_id, page, line_no, 'open_response', unit_line FROM ol2 UNION ALL SELECT doc_id, page, line_no, 'bullet', line_no FROM bu UNION ALL SELECT doc_id, page, line_no, 'trailing_dash', line_no FROM dl UNION ALL SELECT doc_id, page, line_no, 'inline_blank', unit_line FROM il)"""
NUMBERED = "un AS (SELECT *, 'u' || CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY page, unit_line) AS VARCHAR) AS unit_id FROM da)"
obstacles = lambda x: y.tables(x).select("doc_id", "page", F.col("bx0").alias("x0"), F.col("by0").alias("y0"), F.col("bx1").alias("x1")).unionByName(images(x).select("doc_id", "page", "x0", "y0", "x1"))
page_list = lambda x: stored(x.select("doc_id", "page").distinct(), "pages")  # noqa: E731  # each use would split all texts again
PAGES_A_TASK = 1 << 13


def page_parts(sheets):
    """Tasks to deal pages over: as many as keep one task's pages, and so its memory, to a fixed number."""
    return max(-(-sheets.count() // PAGES_A_TASK), int(sheets.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def found(x, sheets=None, **more):
    sheets = page_list(x) if sheets is None else sheets
    return y.detected(x, y.tables(sheets), obstacles(sheets), parts=page_parts(sheets), **more)


units = lambda x, **more: y.numbered_units(found(x, **more))
query("detect_all", lambda x: units(x).select("doc_id", "page", "line_no", "kind", "unit_line", "unit_id"), "lines", f"WITH {FOUND}, {NUMBERED} SELECT * FROM un")
query("detect_blanks", lambda x: units(x, formats=["inline_blanks"]).select("doc_id", "page", "line_no", "kind", "unit_line", "unit_id"), "lines", f"""WITH lo AS (SELECT * FROM lines WHERE NOT ({INBOX})), {outer(DASH)}, rm AS (SELECT lo.* FROM lo {LESS('lo', 'td')} WHERE regexp_matches(text, $$\\S$$)),
rs AS (SELECT *, CASE WHEN coalesce({BULLETED} OR {QUESTION} OR y0 - lag(y1) OVER ({P}) > 14, true) THEN 1 ELSE 0 END AS s FROM rm), ru AS (SELECT *, sum(s) OVER ({P} ROWS UNBOUNDED PRECEDING) AS lu FROM rs),
da AS (SELECT doc_id, page, line_no, 'trailing_dash' AS kind, line_no AS unit_line FROM td UNION ALL SELECT ru.doc_id, ru.page, ru.line_no, 'inline_blank', g.unit_line FROM ru JOIN (SELECT doc_id, page, lu, arg_min(line_no, (y0, x0, line_no)) AS unit_line FROM ru GROUP BY ALL HAVING bool_or(contains(text, '_'))) g ON {SAME('ru', 'g')} AND g.lu = ru.lu), {NUMBERED} SELECT * FROM un""")
query("doc_summary", lambda x: y.doc_summary(found(x)), "lines", f"WITH {FOUND} SELECT doc_id, kind, count(*) AS n FROM da WHERE line_no = unit_line GROUP BY ROLLUP (doc_id, kind)")
query("page_text", y.page_text, "lines", "WITH p AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY line_no) AS t FROM lines GROUP BY ALL) SELECT doc_id, string_agg('[page ' || CAST(page AS VARCHAR) || ']' || chr(10) || t, chr(10) ORDER BY page) AS text FROM p GROUP BY doc_id")
asked = lambda x: x.filter("k = 3").select("doc_id", "page", F.col("line_no").alias("item_no"), F.when(F.col("doc_id") % 20 == 0, "no such text at all").otherwise(F.left("text", F.lit(15))).alias("anchor_text"))
query("anchor_resolve", lambda x: px.anchor_boxes(px.resolve_anchors(asked(x), x), x), "lines", f"""WITH n AS (SELECT doc_id, page, line_no, x0, y0, y1, {NORMAL} AS hay FROM lines),
a AS (SELECT doc_id, page, line_no AS item_no, {NORMAL} AS needle FROM (SELECT doc_id, page, line_no, CASE WHEN doc_id % 20 = 0 THEN 'no such text at all' ELSE left(text, 15) END AS text FROM lines WHERE k = 3)),
h AS (SELECT a.doc_id, a.page, item_no, needle, min(line_no) FILTER (WHERE needle <> '' AND contains(hay, needle)) AS line_no FROM a LEFT JOIN n ON n.doc_id = a.doc_id AND n.page = a.page GROUP BY a.doc_id, a.page, item_no, needle)
SELECT h.doc_id, h.page, item_no, h.line_no, CAST(strpos(hay, needle) - 1 AS INT) AS first_char, h.line_no AS last_line, CAST(strpos(hay, needle) + length(needle) - 2 AS INT) AS last_char,
  n.x0 + 5.0 * (strpos(hay, needle) - 1) AS x0, n.y0, n.x0 + 5.0 * (strpos(hay, needle) - 1 + length(needle)) AS x1, n.y1, CASE WHEN h.line_no IS NULL THEN 'anchor not found' END AS dropped
FROM h LEFT JOIN n ON n.doc_id = h.doc_id AND n.page = h.page AND n.line_no = h.line_no""")
query("anchor_repeats", lambda x: px.resolve_anchors(x.filter("k between 3 and 7").select("doc_id", "page", F.col("line_no").alias("item_no"), F.lit(" ○").alias("anchor_text")), x), "lines", """WITH o AS (SELECT doc_id, page, line_no, i, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no, i) AS r FROM (SELECT doc_id, page, line_no, text, unnest(range(length(text))) AS i FROM lines WHERE contains(text, '○')) WHERE substr(text, i + 1, 1) = '○'),
a AS (SELECT doc_id, page, line_no AS item_no, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS r FROM lines WHERE k BETWEEN 3 AND 7)
SELECT a.doc_id, a.page, item_no, o.line_no, CAST(o.i AS INT) AS first_char, o.line_no AS last_line, CAST(o.i AS INT) AS last_char, CASE WHEN o.line_no IS NULL THEN 'anchor not found' END AS dropped FROM a LEFT JOIN o ON o.doc_id = a.doc_id AND o.page = a.page AND o.r = a.r""")
bands = lambda x: x.groupBy("doc_id", "page", F.floor(F.col("k") / 5).cast("int").alias("band")).agg(F.min("y0").alias("b0"), F.max("y1").alias("b1"), F.count_if(F.col("text").contains("_")).alias("expected"))
CENTRES = "ac AS (SELECT da.doc_id, da.page, da.line_no, (y0 + y1) / 2 AS y, unnest(range(CASE WHEN kind = 'inline_blank' THEN len(regexp_extract_all(text, '_+')) ELSE 1 END)) AS slot FROM da JOIN lines l ON l.doc_id = da.doc_id AND l.page = da.page AND l.line_no = da.line_no WHERE kind = 'inline_blank' OR da.line_no = unit_line AND kind NOT LIKE 'multiple_choice%')"



def all_centres(x):
    """Answer spaces of all units and of the tables' cells; a line without an underscore has no blank, so only the others meet the cells."""
    sheets = page_list(x)
    return n.answer_centres(found(x, sheets), cells(x.filter(F.col("text").contains("_")), sheets))


# Blanks of table cells: runs of what each cell holds of a line.
TABLE_CENTRES = f"""{TABLE_CELLS}, tb AS (SELECT doc_id, page, line_no, y, r, c, string_agg(ch, '' ORDER BY i) AS text FROM cc GROUP BY doc_id, page, line_no, y, r, c),
tn AS (SELECT doc_id, page, line_no, y, CAST(sum(len(regexp_extract_all(text, '_+'))) AS BIGINT) AS n FROM tb GROUP BY doc_id, page, line_no, y)"""
query("answer_centres", all_centres, "lines", f"WITH {FOUND}, {CENTRES}, {TABLE_CENTRES} SELECT doc_id, page, line_no, y, slot + 1 AS slot FROM ac UNION ALL SELECT doc_id, page, line_no, y, unnest(range(n)) + 1 AS slot FROM tn")
query("detector_score", lambda x: y.score_bands(n.answer_centres(found(x)), stored(bands(x), "bands")), "lines", f"""WITH {FOUND}, {CENTRES}, bd AS (SELECT doc_id, page, CAST(floor(k / 5) AS INT) AS band, min(y0) AS b0, max(y1) AS b1, count(*) FILTER (WHERE contains(text, '_')) AS expected FROM lines GROUP BY 1, 2, 3),
h AS (SELECT ac.doc_id, ac.page, ac.line_no, slot, min(band) AS band FROM ac JOIN bd ON bd.doc_id = ac.doc_id AND bd.page = ac.page AND y >= b0 AND y < b1 GROUP BY 1, 2, 3, 4),
c AS (SELECT doc_id, page, band, count(*) AS n FROM h GROUP BY ALL), r AS (SELECT bd.*, coalesce(n, 0) AS n FROM bd LEFT JOIN c ON c.doc_id = bd.doc_id AND c.page = bd.page AND c.band = bd.band)
SELECT sum(least(n, expected)) AS correct, sum(greatest(expected - n, 0)) AS missed, sum(greatest(n - expected, 0)) AS surplus FROM r""")
REPLY = "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN '{\"s1\":\"x' || CAST(doc_id AS STRING) || '\",\"p0_u2\":\"y\", \"s1\": \"last\"}' WHEN 1 THEN '```json {\"u1\": \"z\", \"note\": \"n\", \"u5\": {\"s2\": \"nest\", \"u1-s4\": \"comp\", \"s6\": 3}} ```' WHEN 2 THEN '<think>{\"s9\":\"no\"}</think> So: {\"s3\":\"w\", \"u6\": \"b) x\", \"u5\": \" (II)\", \"u7\": [1]} done' ELSE 'garbage' END"
SAID = {0: [("s1", "last"), ("u2", "y")], 1: [("u1", "z"), ("note", "n"), ("s2", "nest"), ("s4", "comp")], 2: [("s3", "w"), ("u6", "b) x"), ("u5", " (II)")]}
FLAT = " UNION ALL ".join(f"SELECT doc_id, '{slot}' AS slot, '{answer}' AS answer FROM dd WHERE doc_id % 4 = {i}" for i, said in SAID.items() for slot, answer in said)
replies = lambda x: x.select("doc_id").distinct().select("doc_id", F.expr(REPLY).alias("reply"))
query("json_extract", lambda x: replies(x).select("doc_id", F.get_json_object(y.json_object(F.col("reply")), "$.s3").alias("s3")), "raw_lines", "SELECT DISTINCT doc_id, CASE WHEN doc_id % 4 = 2 THEN 'w' END AS s3 FROM raw_lines")
query("answers_flat", lambda x: y.flat_answers(replies(x)), "raw_lines", f"WITH dd AS (SELECT DISTINCT doc_id FROM raw_lines) {FLAT}")
def cells(x, sheets):
    """Text of lines within table cells. Lines above or below all tables meet no cell, so they are left out before their text is made."""
    rows = rects(sheets)
    low, high = rows.agg(F.min("cy0"), F.max("cy1")).first()
    middle = (F.col("y0") + F.col("y1")) / 2
    return n.cell_lines(x.filter((middle >= F.lit(low)) & (middle < F.lit(high))), rows)


def kept(x):
    """Marked lines outside tables, numbered units, table cells and bullets: each computed and stored once, as the branches that follow read them many times."""
    sheets = page_list(x)
    marks = stored(y.page_marks(x, y.tables(sheets), obstacles(sheets), parts=page_parts(sheets)), "marks")
    return marks, stored(y.numbered_units(marks.filter("kind is not null").drop(*y.CHOICE)), "units"), stored(cells(x, sheets), "cells"), y.bullet_answers(marks)


# One registry of slots: runs of a page's cells, then those of its inline units.
REGISTRY = f"""{TABLE_CELLS},
cl AS (SELECT doc_id, page, r, c, line_no, string_agg(ch, '' ORDER BY i) AS text, min(x) - 2.5 AS x0, max(y1) AS y1 FROM cc GROUP BY ALL),
rl AS (SELECT doc_id, page, 0 AS z, r, c, line_no, text, x0, y1 FROM cl UNION ALL SELECT da.doc_id, da.page, 1, NULL, NULL, da.line_no, text, x0, y1 FROM da JOIN lines l ON {SAME('da', 'l')} AND l.line_no = da.line_no WHERE kind = 'inline_blank'),
rn AS (SELECT *, CAST(len(regexp_extract_all(text, '_+')) AS INT) AS n, regexp_extract_all(text, '_+') AS q, regexp_split_to_array(text, '_+') AS g FROM rl),
rg AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY page, z, r, c, line_no) - n + 1 AS BIGINT) AS first_slot FROM rn)"""


def said(x):
    """Answers of the replies, stored as two branches read them; replies are small beside the work of reading them, so they are dealt out by number, not by size."""
    n_parts = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(y.flat_answers(replies(x).repartition(n_parts, "doc_id")), "answers")


query("overlays", lambda x: n.overlays(*kept(x), said(x)), "lines", f"""WITH {FOUND}, {NUMBERED}, {REGISTRY}, u AS (SELECT un.*, text, x0, x1, y0, y1 FROM un JOIN lines l ON {SAME('un', 'l')} AND l.line_no = un.line_no),
dd AS (SELECT DISTINCT doc_id FROM lines), f AS ({FLAT}), ie AS (SELECT *, unnest(range(n)) AS k FROM rg WHERE n > 0),
ik AS (SELECT *, x0 + 5.0 * (list_sum(list_transform(g[1:k + 1], lambda z: length(z))) + coalesce(list_sum(list_transform(q[1:k], lambda z: length(z))), 0)) AS a, 5.0 * length(q[k + 1]) AS wd, 's' || CAST(first_slot + k AS VARCHAR) AS key FROM ie),
bx AS (SELECT doc_id, page, key, a AS x0, y1 - 13 AS y0, a + wd AS x1, y1 + 1 AS y1 FROM ik UNION ALL SELECT u.doc_id, u.page, unit_id, gx0 + 4, gy1 + 4, greatest(gx1, 572.0), bottom - 6 FROM u JOIN ol2 o ON {SAME('u', 'o')} AND o.line_no = u.line_no WHERE kind = 'open_response' AND u.line_no = u.unit_line
  UNION ALL SELECT doc_id, page, unit_id, x1 + 6, y0, 572.0, y1 FROM u WHERE kind = 'trailing_dash' UNION ALL SELECT u.doc_id, u.page, unit_id, x1 + 6, y0, 572.0, greatest(y1, bottom - 2) FROM u JOIN bu ON {SAME('u', 'bu')} AND bu.line_no = u.line_no WHERE kind = 'bullet'),
ci AS (SELECT so.doc_id, so.page, u.unit_id AS key, so.first_line, so.last_line, CASE WHEN list_contains(lab, tok) THEN tok WHEN list_contains(lab, left(tok, 1)) THEN left(tok, 1) END AS label FROM (SELECT *, CASE system WHEN 'roman' THEN {ROM}[1:n_options] ELSE {LET}[1:n_options] END AS lab FROM so) so
  JOIN u ON {SAME('so', 'u')} AND u.line_no = so.first_line AND u.kind = 'multiple_choice' JOIN (SELECT *, nullif(regexp_extract(upper(trim(answer)), '^\\(?([A-Z]+)', 1), '') AS tok FROM f) f ON f.doc_id = u.doc_id AND f.slot = u.unit_id)
SELECT bx.doc_id, page, 'text' AS kind, key, x0, y0, x1, y1, coalesce(answer, '') AS text FROM bx LEFT JOIN f ON f.doc_id = bx.doc_id AND f.slot = bx.key
UNION ALL SELECT ci.doc_id, ci.page, 'circle', key, wl.x0, wl.y0, wl.x0 + 5.0 * coalesce(least(nullif(strpos(left(wl.text, 8), '.'), 0), nullif(strpos(left(wl.text, 8), ')'), 0)), least(length(wl.text), 8)), wl.y1, '' FROM ci JOIN wl ON {SAME('ci', 'wl')} AND wl.line_no BETWEEN first_line AND last_line AND wl.token = ci.label""")
query("snip_boxes", lambda x: y.snip_box(x.select("doc_id", "page", "line_no", F.col("x1").alias("ax"), F.col("x0").alias("bx"), F.col("y0").alias("ay"), F.when(F.col("k") == 7, F.col("y0") + 1).otherwise(F.col("y1")).alias("by"))), "lines", "SELECT doc_id, page, line_no, greatest(x0 - 4, 0) AS x0, greatest(y0 - 4, 0) AS y0, least(x1 + 4, 612.0) AS x1, least(y1 + 4, 792.0) AS y1 FROM lines WHERE k <> 7")
query("ocr_axis_fix", lambda x: y.fix_axes(x.select("doc_id", "page", "line_no", *(F.when(F.col("doc_id") % 3 == 0, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("x0", "y0"), ("y0", "x0"), ("x1", "y1"), ("y1", "x1"))))), "lines", "WITH f AS (SELECT * FROM lines), v AS (SELECT doc_id, page, count(*) AS n FROM f GROUP BY ALL) SELECT f.doc_id, f.page, line_no, CASE WHEN f.doc_id % 3 = 0 AND n < 2 THEN y0 ELSE x0 END AS x0, CASE WHEN f.doc_id % 3 = 0 AND n < 2 THEN x0 ELSE y0 END AS y0, CASE WHEN f.doc_id % 3 = 0 AND n < 2 THEN y1 ELSE x1 END AS x1, CASE WHEN f.doc_id % 3 = 0 AND n < 2 THEN x1 ELSE y1 END AS y1 FROM f JOIN v ON v.doc_id = f.doc_id AND v.page = f.page")
pages_of = lambda x: x.filter("text <> ''").groupBy("doc_id", "page").agg(F.struct(F.col("page").alias("index"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.array(F.array(F.min("x0"), F.min("y0"), F.min("x0") + 5, F.min("y0") + 5)).alias("markers"), F.collect_list(F.struct(F.left("text", F.lit(1)).alias("glyph"), F.array("x0", "y0", "x1", "y1").alias("draw"))).alias("cells")).alias("p")).groupBy("doc_id").agg(F.to_json(F.struct(F.collect_list("p").alias("pages"))).alias("j"))
layouts = lambda x: pages_of(x).select("doc_id", F.from_json("j", PAGES).alias("j")).select("doc_id", "j.pages")
query("template_cells", lambda x: flatten_geometry(layouts(x), "doc_id"), "lines", "SELECT doc_id, page, left(text, 1) AS glyph, x0, y0, x1, y1, left(text, 1) IN ('g', 'j', 'p', 'q', 'y') AS descends FROM lines WHERE text <> ''")
query("template_glyphs", lambda x: glyph_set(flatten_geometry(layouts(x), "doc_id"), "doc_id"), "lines", "SELECT DISTINCT doc_id, left(text, 1) AS glyph FROM lines WHERE text <> ''")
query("template_marks", lambda x: template_markers(layouts(x), "doc_id"), "lines", "SELECT doc_id, page, 0 AS mark, min(x0) AS x0, min(y0) AS y0, min(x0) + 5 AS x1, min(y0) + 5 AS y1 FROM lines WHERE text <> '' GROUP BY doc_id, page")
query("active_formats", lambda x: x.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.when(F.col("line_no") % 7 == 0, F.element_at(F.split(F.lit("bullet_answer,bogus,table,open_response"), ","), (F.col("line_no") / 7 % 4).cast("int") + 1)))).alias("asked")).select("doc_id", F.array_join(c.active_formats(F.col("asked")), ",").alias("formats")), "raw_lines",
      "WITH q AS (SELECT doc_id, list_sort(list_distinct(list((['bullet_answer', 'bogus', 'table', 'open_response'])[CAST(line_no // 7 % 4 AS INT) + 1]))) AS f FROM raw_lines WHERE line_no % 7 = 0 GROUP BY doc_id), r AS (SELECT doc_id, list_filter(f, lambda x: x <> 'bogus') AS f FROM q) SELECT doc_id, CASE WHEN len(f) = 0 THEN 'inline_blanks,open_response,bullet_answer,table,multiple_choice' ELSE array_to_string(f, ',') END AS formats FROM r")
query("format_labels", lambda x: x.select("doc_id", "line_no", c.format_label(F.element_at(F.split(F.lit("inline_blanks,open_response,bullet_answer,table,multiple_choice,other"), ","), (F.col("line_no") % 6).cast("int") + 1)).alias("label")), "raw_lines",
      "SELECT doc_id, line_no, (['Fill-in-the-blank', 'Open response', 'Bullet list', 'Table / chart', 'Multiple choice', 'other'])[CAST(line_no % 6 AS INT) + 1] AS label FROM raw_lines")
