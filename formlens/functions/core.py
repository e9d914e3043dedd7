"""Column functions shared by the operators: rounding, time, text and account helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a style label reads when the text is typed.
TYPED = ["", "typed text", "none", "typed"]
#: List marks, and the characters that text matching folds or drops.
BULLETS = "●○■▪◆◇•·"
BLANKS = "\u200b\u200c\u200d"
DASHES = "‐‑‒–—―−﹘﹣－·•"
SINGLE_QUOTES, DOUBLE_QUOTES = "‘’ʼ`´", "“”"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff\u00ad"
#: Cyrillic and Greek letters that stand for a label's Latin ones.
LOOK_ALIKES = {"А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "Α": "A", "Β": "B", "Ε": "E", "Η": "H"}
#: Answer formats and what they are called.
FORMATS = {"inline_blanks": "Fill-in-the-blank", "open_response": "Open response", "bullet_answer": "Bullet list", "table": "Table / chart", "multiple_choice": "Multiple choice"}


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole, half-even to one decimal; 0 if there is no whole."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.bround(100.0 * part.cast("double") / whole.cast("double"), 1))


def shift(ts: Column, hours: float) -> Column:
    """Fixed offset in hours, which may be fractional."""
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(round(hours * 60))), F.lit(0))


def parse_ts(text: Column) -> Column:
    """ISO text with ``Z``, an offset or none (UTC); null if it isn't a time."""
    return F.try_to_timestamp(text)


def label_or(text: Column, default: str) -> Column:
    """Trimmed text, or the default for null and blank."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(default))


def is_handwriting(style: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(style, F.lit("")))).isin(TYPED)


def is_reported(feedback: Column) -> Column:
    return F.trim(F.coalesce(feedback, F.lit(""))) != ""


def _ua(ua: Column) -> Column:
    return F.lower(F.coalesce(ua, F.lit("")))


def browser(ua: Column) -> Column:
    u = _ua(ua)
    return (F.when(u.contains("edg/"), "Edge").when(u.contains("chrome") & ~u.contains("chromium"), "Chrome")
            .when(u.contains("safari") & ~u.contains("chrome"), "Safari").when(u.contains("firefox"), "Firefox").otherwise("Other"))


def os_name(ua: Column) -> Column:
    u = _ua(ua)
    return (F.when(u.contains("iphone") | u.contains("ipad"), "iOS").when(u.contains("android"), "Android")
            .when(u.contains("mac os") | u.contains("macintosh"), "macOS").when(u.contains("windows"), "Windows")
            .when(u.contains("linux"), "Linux").otherwise("Other"))


def device_kind(ua: Column) -> Column:
    u = _ua(ua)
    return F.when(u.contains("mobile") | u.contains("iphone") | u.contains("android"), "Mobile").otherwise("Desktop")


def error_class(error: Column) -> Column:
    return F.split_part(error, F.lit(":"), F.lit(1))


def error_text(error: Column) -> Column:
    """Error class and the first 200 characters of what it says."""
    kind = error_class(error)
    rest = F.trim(F.substr(error, F.length(kind) + 2))
    return F.when(rest == "", kind).otherwise(F.concat(kind, F.lit(": "), F.left(rest, F.lit(200))))


def short_ua(ua: Column) -> Column:
    """A user agent's first 200 characters; empty for null."""
    return F.left(F.coalesce(ua, F.lit("")), F.lit(200))


def valid_job_id(job: Column) -> Column:
    """1 to 64 characters of the URL-safe base64 alphabet."""
    return F.coalesce(job, F.lit("")).rlike(r"\A[A-Za-z0-9_-]{1,64}\z")


def format_label(ident: Column) -> Column:
    """What a format id is called; an unknown id stays."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv)), ident), ident)


def active_formats(asked: Column) -> Column:
    """Those of the asked formats that are known, in the order asked; all known ones if that leaves none."""
    known = F.array(*map(F.lit, FORMATS))
    kept = F.array_intersect(F.coalesce(asked, F.array().cast("array<string>")), known)
    return F.when(F.size(kept) == 0, known).otherwise(kept)


def token_live(expires: Column, as_of: Column) -> Column:
    """Whether a token still counts: an expiry that can't be read counts as valid."""
    return F.coalesce(parse_ts(expires) >= as_of, F.lit(True))


def ocr_box(box: Column, width: float, height: float, scale: float = 1000.0) -> Column:
    """Corners in thousandths of the page, in any order -> struct<x0,y0,x1,y1> in points."""
    side = lambda pick, i, size: pick(F.array(box[i], box[i + 2])) * size / scale
    return F.struct(side(F.array_min, 0, width).alias("x0"), side(F.array_min, 1, height).alias("y0"), side(F.array_max, 0, width).alias("x1"), side(F.array_max, 1, height).alias("y1"))


def ocr_placeholders(text: Column, slots: Column) -> Column:
    """Runs of three underscores or more replaced by the slots in turn; surplus slots follow at the end."""
    parts = F.split(text, "_{3,}")
    mark = lambda s: F.concat(F.lit("{{"), s, F.lit("}}"))
    filled = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.coalesce(mark(F.get(slots, i - 1)), F.lit("")), p)))
    surplus = F.transform(F.slice(slots, F.size(parts), F.greatest(F.size(slots) - F.size(parts) + 1, F.lit(0))), lambda s: F.concat(F.lit(" "), mark(s)))
    return F.concat(F.array_join(filled, ""), F.array_join(surplus, ""))


def account_hash(subject: Column) -> Column:
    return F.concat(F.lit("u"), F.left(F.sha2(subject, 256), F.lit(16)))


def strip_bullet(text: Column) -> Column:
    """Text after leading spaces, bullets and zero-width characters."""
    return F.regexp_replace(text, rf"^[\s{BULLETS}{BLANKS}]+", "")


def is_bulleted(text: Column) -> Column:
    return text.rlike(rf"^\s*[{BULLETS}]")


def is_empty_bullet(text: Column) -> Column:
    return is_bulleted(text) & (strip_bullet(text) == "")


def is_question_start(text: Column) -> Column:
    return text.rlike(r"^\s*\d+\s*[.)]\s")


def normalize_text(text: Column) -> Column:
    """Dashes and quotes folded, zero-width characters dropped, spaces collapsed, lower case."""
    folded = F.translate(text, DASHES + SINGLE_QUOTES + DOUBLE_QUOTES + ZERO_WIDTH, "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))
    return F.lower(F.trim(F.regexp_replace(folded, r"\s+", " ")))


def alnum_only(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def truncate_text(text: Column, limit: int, marker: str = " [truncated]") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.left(text, F.lit(limit))), F.lit(marker))).otherwise(text)


def clamp(value: Column, low: float, high: float, default: float) -> Column:
    """Value within bounds; the default where there is none (greatest and least skip nulls)."""
    return F.when(value.isNull(), F.lit(default)).otherwise(F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def video_id(url: Column) -> Column:
    """The 11-character id of a bare id, ``v=`` or path form; null otherwise."""
    found = [F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (r"^([A-Za-z0-9_-]{11})$", r"[?&]v=([A-Za-z0-9_-]{11})(?:[&#]|$)", r"^(?:https?://)?(?:www\.|m\.)?(?:youtu\.be|youtube\.com/(?:embed|shorts|live|v))/([A-Za-z0-9_-]{11})(?:[/?#&]|$)")]
    return F.coalesce(*found)


def occurrences(text: Column, needle: Column) -> Column:
    """All positions (from 1) of a needle, overlapping ones too; none for an empty needle."""
    n = F.length(needle)
    # Pieces that overlap by n - 1 characters, as a substring's cost grows with its place in the text.
    size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.length(text)))).cast("int")
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), size)
    pieces = F.transform(starts, lambda s: F.struct(s.alias("at"), F.substr(text, s, size + n - 1).alias("t")))
    held = F.filter(pieces, lambda p: F.contains(p["t"], needle))
    hits = lambda p: F.filter(F.sequence(F.lit(1), F.length(p["t"])), lambda i: F.substr(p["t"], i, n) == needle)
    found = F.flatten(F.transform(held, lambda p: F.transform(hits(p), lambda i: i + p["at"] - 1)))
    return F.when((n == 0) | (F.length(text) < n), F.array().cast("array<int>")).otherwise(found)


def underscore_runs(text: Column) -> Column:
    """array<struct<start:int,length:int>> of the underscore runs (start from 0)."""
    runs = F.regexp_extract_all(text, F.lit("_+"), F.lit(0))
    gaps = F.split(text, "_+")
    pairs = F.arrays_zip(runs.alias("run"), F.slice(gaps, 1, F.size(runs)).alias("gap"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out"))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["gap"]) + F.length(x["run"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["gap"])).alias("start"), F.length(x["run"]).alias("length")))).alias("out"),
    )
    return F.when(F.size(runs) == 0, F.array().cast("array<struct<start:int,length:int>>")).otherwise(F.aggregate(pairs, zero, step)["out"])


def placeholder_text(text: Column, first: Column) -> Column:
    """Text with its underscore runs numbered from ``first`` as {{sN}} and spaces collapsed."""
    parts = F.split(text, "_+")
    named = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("{{s"), (first + i - 1).cast("string"), F.lit("}}"), p)))
    return F.trim(F.regexp_replace(F.array_join(named, ""), r"\s+", " "))
