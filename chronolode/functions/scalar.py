"""Column expressions with the semantics that the requests rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000

# File name endings whose line counts are not kept.
BINARY_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "tiff", "webp", "svg", "psd", "ai", "eps",
    "ttf", "otf", "woff", "woff2", "eot",
    "zip", "jar", "war", "ear", "tar", "gz", "bz2", "xz", "7z", "rar",
    "class", "pyc", "o", "obj", "exe", "dll", "so", "dylib", "lib",
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "mp3", "mp4", "wav", "ogg", "flac", "avi", "mov", "mkv",
    "db", "sqlite", "sqlite3", "bin", "dat", "proto",
]


def like_any_case(column: Column, pattern: str) -> Column:
    """LIKE with ``%`` and ``_``, case aside; a backslash is an ordinary character."""
    return column.ilike(pattern.replace("\\", "\\\\"))


def like_exact_case(column: Column, pattern: str) -> Column:
    return column.like(pattern.replace("\\", "\\\\"))


def ratio(part: Column, whole: Column) -> Column:
    """A double quotient; null where ``whole`` is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """``value`` scaled to 0..1 between ``low`` and ``high``; 1 where these are equal."""
    return F.when(low == high, 1.0).otherwise((value - low) / (high - low))


def extension(path: Column) -> Column:
    """From the last dot of the whole path on; ``(no ext)`` without one."""
    found = F.regexp_extract(path, r"([.][^.]*)$", 1)
    return F.when(found == "", "(no ext)").otherwise(found)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_binary_path(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[.]([^.]*)$", 1)).isin(BINARY_EXTENSIONS)


def whole_days(later_ms: Column, earlier_ms: Column) -> Column:
    """Days between two instants in milliseconds, cut towards zero."""
    return ((later_ms - earlier_ms - (later_ms - earlier_ms) % DAY_MS) / DAY_MS).cast("long")


def ticket_slug(first_line: Column) -> Column:
    """``ABC-12`` at the start of the trimmed line: two to four capitals, a dash, figures; else null."""
    return F.regexp_substr(F.btrim(first_line), F.lit("^[A-Z]{2,4}-[0-9]+"))


def line_count(text: Column) -> Column:
    """0 for empty text, else 1 and the number of line feeds; null for text that holds a NUL."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.instr(text, "\0") > 0, None).when(F.length(text) == 0, 0).otherwise(feeds + 1).cast("int")
