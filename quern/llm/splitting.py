"""Splitting oversized items at natural boundaries (problem 2).

Method: dynamic programming over boundary positions. An item over its limits is cut between lines;
the cost of a plan is the sum of the penalties of its cuts (a cut before a top-level definition or
after a blank line is cheap, one inside a nested block dear) and of the squared deviations of the
pieces from the mean size, over all plans whose pieces keep both limits and share the asked number
of lines with their predecessor. Lines that alone exceed the byte limit are first cut inside, at
blanks or punctuation where they have any and never within a character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.runtime import broadcast_if_small, spread

_START = re.compile(
    r"\s*(?:#{1,6} |(?:export |pub |public |private |protected |static |async |final |abstract )*(?:func|def|class|fn|impl|struct|enum|trait|interface|type|function|module|namespace)\b|@\w|\[[\w.\-\" ]+\]\s*$|<\w)"
)
_CLOSE = re.compile(r"\s*(?:\}|\)|\]|end\b|</|fi\b|done\b|esac\b)[\s;,)}\]]*$")


def count_lines(content: Column) -> Column:
    """Lines of a text; a final line break opens no new line, empty and null text has none."""
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return F.when(F.coalesce(F.length(content), F.lit(0)) == 0, 0).otherwise(breaks + F.when(F.endswith(content, F.lit("\n")), 0).otherwise(1)).cast("int")


def cut_penalties(lines: list[str]) -> np.ndarray:
    """Penalty of a cut before each line (index 0..n); 0 is the best place, 1 the worst."""
    n = len(lines)
    depth = np.array([len(s) - len(s.lstrip()) if (s := x.expandtabs(4)).strip() else -1 for x in lines], np.int64)
    cost = np.empty(n + 1)
    cost[0] = cost[n] = 0
    for i in range(1, n):
        here, before = lines[i], lines[i - 1]
        if not here.strip():
            value = 0.35 if before.strip() else 0.3
        else:
            level = min(depth[i], 16) / 16
            if not before.strip():
                value = 0.05 + 0.3 * level
            elif _CLOSE.match(before) and depth[i - 1] <= depth[i]:
                value = 0.15 + 0.4 * level
            elif _START.match(here):
                value = 0.15 + 0.4 * level
            else:
                value = 0.6 + 0.4 * level
            if _CLOSE.match(here):
                value = 1.0
        cost[i] = value
    return cost


def split_line(data: bytes, limit: int) -> list[bytes]:
    """Parts of one line within ``limit`` bytes, cut after blanks or punctuation where possible.

    A character is never cut, unless the limit is smaller than the character itself.
    """
    parts, at = [], 0
    while len(data) - at > limit:
        end = limit
        while end > 0 and data[at + end] & 0xC0 == 0x80:
            end -= 1
        end = end or limit
        window = data[at : at + end]
        best = max(window.rfind(b" "), window.rfind(b"\t"))
        if best < end // 2:
            best = max(best, *(window.rfind(c) for c in (b";", b",", b"}", b")", b">", b".")))
        if best >= end // 2:
            end = best + 1
        parts.append(data[at : at + end])
        at += end
    return [*parts, data[at:]]


def plan_cuts(sizes: np.ndarray, penalties: np.ndarray, max_units: int | None, max_bytes: int | None, overlap: int, weight: float = 2.0) -> list[tuple[int, int]]:
    """(start, end) unit ranges of the cheapest plan; consecutive pieces share ``overlap`` units.

    Where a limit leaves no room for the whole overlap, a piece shares as many units as fit while
    it still advances by at least one.
    """
    n = len(sizes)
    prefix = np.concatenate(([0], np.cumsum(sizes)))
    total = int(prefix[-1])
    by_units = max(1.0, n / max_units) if max_units else 1.0
    by_bytes = max(1.0, total / max_bytes) if max_bytes else 1.0
    use_bytes = by_bytes > by_units
    measure = prefix.astype(float) if use_bytes else np.arange(n + 1, dtype=float)
    capacity = float((max_bytes if use_bytes else max_units) or measure[-1])
    shared = overlap * (measure[-1] / n)
    least = max(1, int(np.ceil((measure[-1] - shared) / max(capacity - shared, capacity / 4))))
    target = min(capacity, (measure[-1] + (least - 1) * shared) / least)

    def first_unit(cut: int) -> int:
        """Where a piece that continues after ``cut`` begins: the overlap reaches back from it."""
        start = max(0, cut - overlap)
        while start < cut and not fits(start, cut + 1):
            start += 1
        return start

    def fits(a: int, b: int) -> bool:
        return b - a == 1 or ((not max_units or b - a <= max_units) and (not max_bytes or prefix[b] - prefix[a] <= max_bytes))

    best = np.full(n + 1, np.inf)
    back = np.full(n + 1, -1, np.int64)
    best[0] = 0
    for cut in range(n):
        if not np.isfinite(best[cut]):
            continue
        start = first_unit(cut) if cut else 0
        high = n
        if max_units:
            high = min(high, start + max_units)
        if max_bytes:
            high = min(high, int(np.searchsorted(prefix, prefix[start] + max_bytes, "right")) - 1)
        high = max(high, cut + 1)
        ends = np.arange(cut + 1, high + 1)
        size = (measure[ends] - measure[start]) / target
        value = best[cut] + penalties[ends] + weight * (size - 1) ** 2 + 0.5
        better = value < best[ends]
        best[ends[better]] = value[better]
        back[ends[better]] = cut
    cuts, at = [], n
    while at > 0:
        cuts.append(int(at))
        at = int(back[at])
    cuts.reverse()
    pieces, before = [], 0
    for cut in cuts:
        pieces.append((first_unit(before) if before else 0, cut))
        before = cut
    return pieces


def split_text(content: str, max_lines: int | None, max_bytes: int | None, overlap: int) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of the pieces of a text, lines counted from 1 within it.

    Joining the pieces without their shared beginnings gives back the text. A text within its
    limits is one piece; an empty one gives none.
    """
    if not content:
        return []
    lines = content.split("\n")
    if lines[-1] == "":
        lines.pop()
        lines = [x + "\n" for x in lines]
    else:
        lines = [x + "\n" for x in lines[:-1]] + lines[-1:]
    raw = [x.encode("utf-8", "surrogatepass") for x in lines]
    units, number, inner = [], [], []
    for n, data in enumerate(raw):
        parts = split_line(data, max_bytes) if max_bytes and len(data) > max_bytes else [data]
        units += parts
        number += [n] * len(parts)
        inner += [0.0] + [0.4] * (len(parts) - 1)
    outer = cut_penalties(lines)
    penalties = np.array([outer[n] if not x else x for n, x in zip(number, inner, strict=True)] + [0.0])
    # between the lines of a text in one piece there is nothing to cut
    if (not max_lines or len(units) <= max_lines) and (not max_bytes or sum(map(len, units)) <= max_bytes):
        return [(1, len(lines), content)]
    sizes = np.array([len(u) for u in units])
    room = min(x for x in (max_lines, len(units)) if x)
    plan = plan_cuts(sizes, penalties, max_lines, max_bytes, min(overlap, max(0, room - 1)))
    return [(number[a] + 1, number[b - 1] + 1, b"".join(units[a:b]).decode("utf-8", "surrogatepass")) for a, b in plan]


def with_limits(chunks: DataFrame, limits: DataFrame, language: str = "language") -> DataFrame:
    """``chunks`` with ``max_lines``, ``max_bytes``, ``overlap`` of their language.

    Languages are compared without case and outer blanks; ``default`` serves those not listed and
    null. Null limits, and limits below one, are no limits; a null or negative overlap is none.
    """
    name = lambda c: F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))
    bound = lambda c: F.when(F.col(c) >= 1, F.col(c)).cast("int")
    told = limits.select(name(F.col("language")).alias("__language"), F.struct(bound("max_chunk_lines").alias("max_lines"), bound("max_chunk_bytes").alias("max_bytes"), F.greatest(F.coalesce("chunk_overlap", F.lit(0)), F.lit(0)).cast("int").alias("overlap")).alias("__limit"))
    told = told.filter("__language is not null").groupBy("__language").agg(F.max("__limit").alias("__limit"))  # a settings table: a row per language
    default = told.filter("__language = 'default'").agg(F.first("__limit").alias("__default"))
    joined = chunks.withColumn("__language", name(F.col(language))).join(broadcast_if_small(told), "__language", "left").crossJoin(F.broadcast(default))
    return joined.withColumn("__limit", F.coalesce("__limit", "__default")).select(*chunks.columns, "__limit.*")


def split_oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """``chunk_id, piece, pieces, start_line, end_line, content``: the pieces of every chunk that
    exceeds the limits of its language.

    ``chunks`` needs ``chunk_id, start_line, content, language``; start_line (null: 1) places the
    pieces in the file, the stored end_line is not used. Null and empty content exceeds nothing;
    rows without an id are left out.
    Equal chunks are split each. The limits are tested in the JVM, only oversized chunks reach
    Python; there is no shuffle, so no key can be hot.
    """
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    sized = with_limits(spread(chunks.select("chunk_id", F.coalesce("start_line", F.lit(1)).alias("start_line"), "content", "language")), limits)
    over = sized.filter("chunk_id is not null").filter((count_lines(F.col("content")) > F.col("max_lines")) | (F.octet_length("content") > F.col("max_bytes")))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = lambda x: None if pd.isna(x) else int(x)
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                pieces = split_text(r.content, whole(r.max_lines), whole(r.max_bytes), whole(r.overlap) or 0)
                rows += [(r.chunk_id, n, len(pieces), r.start_line + a - 1, r.start_line + b - 1, text) for n, (a, b, text) in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=["chunk_id", "piece", "pieces", "start_line", "end_line", "content"])

    return over.select("chunk_id", "start_line", "content", "max_lines", "max_bytes", "overlap").mapInPandas(split, f"chunk_id {kind}, piece int, pieces int, start_line int, end_line int, content string")
