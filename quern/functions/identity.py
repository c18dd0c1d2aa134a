"""Canonical forms of the identifiers that tables use to point at each other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_hash(col: Column) -> Column:
    """One spelling for all spellings of a content hash.

    Blanks around it, a scheme prefix (``sha256:``), ``0x``, the letter case and leading zeros do
    not change the number. Null and blank give null; text that is no hexadecimal number is only
    trimmed and lower-cased.
    """
    bare = F.regexp_replace(F.lower(F.regexp_replace(col, r"\s+", "")), r"^(?:[a-z][a-z0-9_-]*:|0x)", "")
    number = F.regexp_replace(bare, r"^0+(?=[0-9a-f]+$)", "")
    return F.when(number != "", number)


def canonical_path(col: Column, root: Column | None = None) -> Column:
    """The place a path leads to below its repository root.

    Backslashes are separators; empty and ``.`` segments vanish; ``..`` removes the segment
    before it; a leading ``root`` is cut. Null, empty and fully cancelled paths give null.
    """
    unix = F.replace(col, F.lit("\\"), F.lit("/"))
    if root is not None:
        base = F.concat(F.regexp_replace(F.replace(root, F.lit("\\"), F.lit("/")), "/+$", ""), F.lit("/"))
        unix = F.when(F.coalesce(F.startswith(unix, base), F.lit(False)), F.substr(unix, F.length(base) + 1)).otherwise(unix)
    parts = F.filter(F.split(unix, "/"), lambda x: (x != "") & (x != "."))
    stack = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    tidy = F.when(F.contains(unix, F.lit("..")), F.array_join(stack, "/")).otherwise(F.array_join(parts, "/"))
    return F.when(tidy != "", tidy)


def month_of(seconds: Column) -> Column:
    """``yyyy-MM`` of unix seconds (or milliseconds, told by their size); null gives ``unknown``."""
    return F.coalesce(F.date_format(F.timestamp_seconds(whole_seconds(seconds)), "yyyy-MM"), F.lit("unknown"))


def whole_seconds(col: Column) -> Column:
    """Unix seconds from seconds or milliseconds; values beyond 1e11 cannot be seconds of our era."""
    return F.when(F.abs(col) >= 100_000_000_000, F.floor(col / 1000)).otherwise(col).cast("bigint")
