"""Cutting texts into line windows, symbol regions and gaps; array operations without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions.languages import CHUNK_KINDS
from quern.functions.text import content_hash


def window_starts(count: Column, size: int, overlap: int) -> Column:
    """Zero-based starts of the windows of ``size`` lines over ``count`` lines; none for no lines."""
    stride = max(1, size - overlap)
    last = F.greatest(F.ceil((count - size) / F.lit(float(stride))).cast("int"), F.lit(0))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * stride))


def chunk_lines(texts: DataFrame, path: str, lines: str, size: int = 30, overlap: int = 15, least: int = 5) -> DataFrame:
    """``path, start_line, end_line, kind, content``: overlapping windows of an array of lines.

    Windows shorter than ``least`` lines are dropped, unless the text as a whole is that short.
    Null and empty arrays give no windows.
    """
    n = F.size(lines)
    windows = texts.select(F.col(path).alias("path"), F.col(lines).alias("__l"), n.alias("__n"), F.explode(window_starts(n, size, overlap)).alias("__s"))
    stop = F.least(F.col("__s") + size, F.col("__n"))
    cut = windows.select("path", (F.col("__s") + 1).cast("int").alias("start_line"), stop.cast("int").alias("end_line"), F.lit("fixed").alias("kind"), F.array_join(F.slice("__l", F.col("__s") + 1, stop - F.col("__s")), "\n").alias("content"), "__n")
    return cut.filter((F.col("end_line") - F.col("start_line") + 1 >= least) | (F.col("__n") < least)).drop("__n")


def chunk_fallback(texts: DataFrame, path: str, text: str, size: int = 50, overlap: int = 10) -> DataFrame:
    """``path, start_line, end_line, start_byte, end_byte, content_hash``: windows with byte offsets.

    Lines are split at ``\\n`` (a final break opens a line). A text of at most ``size`` lines is one
    chunk with the whole content and offsets 0. Offsets are prefix sums of the bytes between window
    starts, so their cost grows with the number of windows, not of lines. Null and empty texts have
    no chunks.
    """
    stride = max(1, size - overlap)
    lines = F.split(text, "\n")
    base = texts.filter(F.length(text) > 0).select(F.col(path).alias("path"), F.col(text).alias("__t"), lines.alias("__l"), F.size(lines).alias("__n"))
    base = base.withColumn("__w", window_starts(F.col("__n"), size, overlap))
    between = F.transform("__w", lambda s: (F.octet_length(F.array_join(F.slice("__l", s + 1, stride), "\n")) + 1).cast("bigint"))
    sums = F.aggregate(between, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    windows = base.withColumn("__o", sums).select("*", F.posexplode("__w").alias("__i", "__s"))
    stop = F.least(F.col("__s") + size, F.col("__n"))
    whole = F.col("__n") <= size
    cut = windows.select(
        "path",
        (F.col("__s") + 1).cast("int").alias("start_line"),
        stop.cast("int").alias("end_line"),
        whole.alias("__whole"),
        F.element_at("__o", F.col("__i") + 1).alias("__at"),
        F.when(whole, F.col("__t")).otherwise(F.array_join(F.slice("__l", F.col("__s") + 1, stop - F.col("__s")), "\n")).alias("__c"),
    )
    zero = F.lit(0).cast("bigint")
    return cut.select(
        "path",
        "start_line",
        "end_line",
        F.when(F.col("__whole"), zero).otherwise(F.col("__at")).alias("start_byte"),
        F.when(F.col("__whole"), zero).otherwise(F.col("__at") + F.octet_length("__c")).alias("end_byte"),
        content_hash(F.col("__c")).alias("content_hash"),
    )


def split_region(start: Column, end: Column, size: int, overlap: int) -> Column:
    """Windows ``(s, e)`` of a region: itself if it fits, else strided windows and the last ``overlap`` lines."""
    stride = max(1, size - overlap)
    n = end - start + 1
    last = F.greatest(F.ceil((n - size) / F.lit(float(stride))).cast("int"), F.lit(0))
    strided = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((start + i * stride).cast("int").alias("s"), F.least(start + i * stride + size - 1, end).cast("int").alias("e")))
    tail = F.array(F.struct((end - overlap + 1).cast("int").alias("s"), end.cast("int").alias("e")))
    return F.when(n <= size, F.array(F.struct(start.cast("int").alias("s"), end.cast("int").alias("e")))).otherwise(F.concat(strided, tail) if overlap > 0 else strided)


def symbol_regions(texts: DataFrame, symbols: DataFrame, path: str, count: str, least: int = 5) -> DataFrame:
    """``path, s, e, kind``: from each relevant symbol to the line before the next one of its file.

    One window per file over its symbols only. Regions of fewer than ``least`` lines, beyond the
    file or of kinds that do not delimit chunks are left to the gaps.
    """
    relevant = symbols.filter(F.col("kind").isin(*CHUNK_KINDS)).select(F.col(path).alias("__p"), "line", "kind")
    following = F.lead("line").over(W.partitionBy("__p").orderBy("line", "kind"))
    spans = relevant.withColumn("__next", following)
    counts = texts.select(F.col(path).alias("__p"), F.col(count).alias("__n"))
    joined = spans.join(counts, "__p").select(F.col("__p").alias("path"), F.greatest("line", F.lit(1)).alias("s"), F.least(F.coalesce(F.col("__next") - 1, F.col("__n")), F.col("__n")).alias("e"), "kind")
    return joined.filter(F.col("e") - F.col("s") + 1 >= least)


def uncovered_runs(texts: DataFrame, regions: DataFrame, path: str, count: str, least: int = 1) -> DataFrame:
    """``path, s, e``: maximal runs of lines of a file that no region covers, of at least ``least`` lines.

    Interval arithmetic on region ends (running maximum per file), not on single lines.
    """
    ordered = W.partitionBy("path").orderBy("s", "e")
    edges = regions.select("path", "s", "e").withColumn("__before", F.coalesce(F.max("e").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = edges.select("path", (F.col("__before") + 1).alias("s"), (F.col("s") - 1).alias("e"))
    ends = regions.groupBy("path").agg(F.max("e").alias("__last"))
    outer = texts.select(F.col(path).alias("path"), F.col(count).alias("__n")).join(ends, "path", "left").select("path", (F.coalesce("__last", F.lit(0)) + 1).alias("s"), F.col("__n").alias("e"))
    return inner.unionByName(outer).filter(F.col("e") - F.col("s") + 1 >= least).select("path", F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"))


def chunk_by_symbols(texts: DataFrame, symbols: DataFrame, path: str, lines: str, size: int = 30, overlap: int = 15, least: int = 5) -> DataFrame:
    """``path, start_line, end_line, kind, content``: symbol regions, large ones split, and the rest in windows."""
    sized = texts.select(F.col(path).alias("path"), F.col(lines).alias("__l"), F.size(lines).alias("__n"))
    regions = symbol_regions(sized.select("path", "__n"), symbols.withColumnRenamed(path, "path"), "path", "__n", least)
    inside = regions.select("path", "kind", F.explode(split_region(F.col("s"), F.col("e"), size, overlap)).alias("w")).select("path", F.col("w.s").alias("s"), F.col("w.e").alias("e"), "kind")
    runs = uncovered_runs(sized.select("path", "__n"), regions, "path", "__n")
    n = F.col("e") - F.col("s") + 1
    outside = runs.select("path", "s", "e", n.alias("__r"), F.explode(window_starts(n, size, overlap)).alias("__o")).select("path", (F.col("s") + F.col("__o")).cast("int").alias("s"), F.least(F.col("s") + F.col("__o") + size - 1, F.col("e")).cast("int").alias("e"), "__r")
    outside = outside.filter((F.col("e") - F.col("s") + 1 >= least) | (F.col("__r") < least)).select("path", "s", "e", F.lit("fixed").alias("kind"))
    cut = inside.unionByName(outside).join(sized, "path")
    return cut.select("path", F.col("s").alias("start_line"), F.col("e").alias("end_line"), "kind", F.array_join(F.slice("__l", F.col("s"), F.col("e") - F.col("s") + 1), "\n").alias("content"))
