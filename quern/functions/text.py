"""Text helpers as SQL expressions: lines, slices, snippets, hashes, paths in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path patterns; alternation is leftmost-first, so .tsx is found as .ts.
PATH_PATTERNS = (
    r"[\w\-./]+\.(go|py|js|ts|tsx|jsx|java|rb|rs|c|cpp|h|hpp|sql|sh)",
    r"[\w\-]+/[\w\-./]+",
)


def content_hash(text: Column) -> Column:
    """SHA-256 of the bytes of a text, in hexadecimal."""
    return F.sha2(text, 256)


def lines_of(text: Column, keep_last_empty: bool = False) -> Column:
    """Lines of a text without their breaks (LF or CRLF); a final break opens no new line."""
    lines = F.split(F.regexp_replace(text, "\r(?=\n|$)", ""), "\n")
    if keep_last_empty:
        return lines
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def line_slice(text: Column, start: int = 0, end: int = 0) -> Column:
    """Lines ``start``..``end`` (from 1, inclusive, 0: open) of a text; null if start is past the end."""
    lines = lines_of(text)
    first = max(start, 1)
    stop = F.size(lines) if end <= 0 else F.least(F.lit(end), F.size(lines))
    piece = F.slice(lines, first, F.greatest(stop - first + 1, F.lit(0)))
    return F.when(F.size(lines) >= first, F.array_join(piece, "\n"))


def snippet_label(path: Column, start: Column, end: Column) -> Column:
    return F.format_string("[%s:%d-%d] (%d lines)", path, start, end, end - start + 1)


def truncate_snippet(text: Column, limit: int) -> Column:
    """Whole leading lines below ``limit`` characters and ``...``; a longer first line is cut.

    Empty lines before the first text are left out. Lengths are in characters, so none is split.
    """
    start = F.struct(F.lit("").alias("t"), F.lit(False).alias("full"))
    state = F.aggregate(
        F.split(text, "\n"),
        start,
        lambda a, x: F.when(a["full"] | (F.length(a["t"]) + F.length(x) + 1 > limit), F.struct(a["t"].alias("t"), F.lit(True).alias("full"))).otherwise(
            F.struct(F.when(a["t"] != "", F.concat(a["t"], F.lit("\n"), x)).otherwise(x).alias("t"), F.lit(False).alias("full"))
        ),
    )
    cut = F.when(state["t"] != "", F.concat(state["t"], F.lit("\n..."))).otherwise(F.concat(F.substring(text, 1, limit), F.lit("...")))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def extract_paths(text: Column) -> Column:
    """File paths mentioned in a text, each once, in order of the patterns and of appearance."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in PATH_PATTERNS]))


def contains_path(paths: Column, target: Column) -> Column:
    """Whether any path contains the target or is contained in it, without case."""
    low = F.lower(target)
    return F.exists(paths, lambda p: F.contains(F.lower(p), low) | F.contains(low, F.lower(p)))


def line_count(text: Column) -> Column:
    """Lines of a text; a final break opens no new one."""
    return F.when(text != "", F.size(lines_of(text))).otherwise(F.when(text == "", 0))


def bytes_label(n: Column) -> Column:
    """1536 -> ``1.5 KiB``, as an expression."""
    power = F.least(F.floor(F.log2(F.greatest(n, F.lit(1))) / 10 + F.lit(1e-12)), F.lit(6)).cast("int")
    unit = F.substring(F.lit("KMGTPE"), power, F.lit(1))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(F.format_string("%.1f", F.bround(n / F.pow(F.lit(1024.0), power), 1)), F.lit(" "), unit, F.lit("iB")))


#: Words for true and false.
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "on", "enabled"), ("false", "0", "no", "off", "disabled")


def to_bool(text: Column, default: bool = False) -> Column:
    """``parse_bool`` as an expression; null gives the default."""
    word = F.lower(F.trim(text))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).otherwise(default)


def format_bytes(n: int) -> str:
    """1536 -> ``1.5 KiB``."""
    if n < 1024:
        return f"{n} B"
    value, units = float(n), "KMGTPE"
    power = 0
    while value >= 1024 and power < len(units):
        value, power = value / 1024, power + 1
    return f"{value:.1f} {units[power - 1]}iB"


def parse_bool(text: str | None, default: bool = False) -> bool:
    """true/1/yes/on/enabled and false/0/no/off/disabled, else the default."""
    word = (text or "").strip().lower()
    return word in TRUE_WORDS if word in TRUE_WORDS + FALSE_WORDS else default
