"""Column functions on texts, counts and names. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers' regular expressions see it.
WS = r"[\s\x{0b}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
WS_CHARS = " \t\n\x0b\x0c\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The names of things without one, and what a file name can't hold.
DEFAULT_FILE, DEFAULT_TITLE = "youtube-comments", "youtube-video"
UNSAFE = r'[<>:"/\\|?*\x00-\x1f]'
FILE_NAME_LENGTH, KEY_TEXT_LENGTH = 100, 60
DIVIDER = "-" * 40


def js_trim(x: Column) -> Column:
    return F.btrim(x, F.lit(WS_CHARS))


def normalize_ws(x: Column) -> Column:
    """Runs of white space become one space; trimmed."""
    return F.btrim(F.regexp_replace(F.translate(x, WS_CHARS, " " * len(WS_CHARS)), "  +", " "))


def strip_commas(x: Column) -> Column:
    return F.replace(x, F.lit(","), F.lit(""))


def first_int(x: Column) -> Column:
    """The first run of digits with commas as a number; 0 without one, null if it is too large."""
    digits = strip_commas(F.regexp_extract(x, r"(\d[\d,]*)", 1))
    return F.when(F.coalesce(digits, F.lit("")) == "", F.lit(0).cast("long")).otherwise(digits.try_cast("long"))


def compact_count(x: Column) -> Column:
    """1.2K, 4.5M, 2B or 1,234 as a number; 0 for what begins with no digit or dot, null where the
    number has dots only (not a number there)."""
    s = strip_commas(js_trim(x))
    digits = F.regexp_extract(s, r"^([\d.]+)", 1)
    number = F.regexp_extract(digits, r"^(\d*\.?\d*)", 1).try_cast("double")
    suffix = F.lower(F.regexp_extract(s, rf"^[\d.]+{WS}*([KkMmBb])", 1))
    scale = F.when(suffix == "k", 1e3).when(suffix == "m", 1e6).when(suffix == "b", 1e9).otherwise(1.0)
    return F.when(F.coalesce(digits, F.lit("")) == "", F.lit(0).cast("long")).otherwise(F.floor(number * scale + 0.5).cast("long"))


def slice_n(x: Column, n: int) -> Column:
    """The first n code points. (Browsers count UTF-16 units: texts past the basic plane differ.)"""
    return F.left(x, F.lit(n))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.floor(done / total * 100 + 0.5))).otherwise(0).cast("long")


def eta_label(seconds: Column) -> Column:
    short = F.concat(F.lit("~"), F.ceil(seconds).cast("string"), F.lit("s left"))
    long = F.concat(F.lit("~"), F.ceil(seconds / 60).cast("string"), F.lit("m left"))
    return F.when(seconds.isNull() | (seconds <= 0), "").when(seconds < 60, short).otherwise(long)


def sanitize_filename(title: Column) -> Column:
    safe = F.regexp_replace(title, UNSAFE, "")
    safe = F.regexp_replace(F.regexp_replace(safe, f"{WS}+", "-"), "-+", "-")
    return F.coalesce(F.nullif(slice_n(js_trim(safe), FILE_NAME_LENGTH), F.lit("")), F.lit(DEFAULT_FILE))


def export_name(title: Column, extension: str) -> Column:
    """The file name of an export; a missing or empty title gets the default."""
    title = F.coalesce(F.nullif(title, F.lit("")), F.lit(DEFAULT_FILE))
    return F.concat(sanitize_filename(title), F.lit(f"-comments.{extension}"))


def meta_line(likes: Column, replies: Column) -> Column:
    """The line above a comment; null where neither count is over 0."""
    both = F.concat(likes.cast("string"), F.lit(" likes (+ "), replies.cast("string"), F.lit(" replies)"))
    return (
        F.when((likes > 0) & (replies > 0), both)
        .when(likes > 0, F.concat(likes.cast("string"), F.lit(" likes")))
        .when(replies > 0, F.concat(F.lit("+ "), replies.cast("string"), F.lit(" replies")))
    )


def progress_text(status: Column, done: Column, total: Column) -> Column:
    counted = F.concat(thousands(done), F.lit(" / "), thousands(total), F.lit(" comments"))
    return F.coalesce(F.nullif(status, F.lit("")), F.when((done > 0) & (total > 0), counted))


def result_text(n: Column) -> Column:
    return F.concat(F.lit("Collected "), thousands(n), F.lit(" comment"), F.when(n == 1, "").otherwise("s"), F.lit(" successfully."))


def complete_text(n: Column) -> Column:
    return F.concat(F.lit("Export complete — "), thousands(n), F.lit(" comments"))
