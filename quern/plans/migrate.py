"""Copying a store into another one: resumable, and checked afterwards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import cut_lineage
from quern.sources.versioned import VersionedTable


@dataclass
class Migration:
    """Rows of the source, those the target had already, and those that were copied."""

    total: int
    skipped: int
    migrated: int


def migrate(source: DataFrame, target: VersionedTable, keys: list[str], dry_run: bool = False) -> Migration:
    """Append the rows of ``source`` whose key the target lacks, in one commit.

    Repeated keys of the source are one row; rows with a null key are left out. A run that fails
    has copied nothing, a repeated one copies what is still missing. ``dry_run`` only counts.
    """
    rows = source.na.drop(subset=keys).dropDuplicates(keys)
    there = target.read()
    missing = rows if there is None else rows.join(there.select(*keys).distinct(), keys, "left_anti")
    missing = cut_lineage(missing)
    total, fresh = rows.count(), missing.count()
    if fresh and not dry_run:
        target.append(missing)
    return Migration(total, total - fresh, fresh)


def differences(source: DataFrame, copy: DataFrame, keys: list[str], vector_col: str, first: int = 10, tolerance: float = 1e-4) -> DataFrame:
    """``keys, problem`` of the rows that were not copied as they are: ``missing``, ``dimensions`` or
    ``values`` (one of the ``first`` values is off by more than ``tolerance``)."""
    a = source.na.drop(subset=keys).dropDuplicates(keys).select(*keys, F.struct(F.col(vector_col).alias("v")).alias("__a"))
    b = copy.select(*keys, F.struct(F.col(vector_col).alias("v")).alias("__b"))
    joined = a.join(b, keys, "left")
    x, y = F.coalesce("__a.v", F.array().cast("array<double>")), F.coalesce("__b.v", F.array().cast("array<double>"))
    off = F.exists(F.zip_with(F.slice(x, 1, first), F.slice(y, 1, first), lambda p, q: ~(p.eqNullSafe(q) | F.coalesce(F.abs(p.cast("double") - q.cast("double")) <= tolerance, F.lit(False)))), lambda z: z)
    problem = F.when(F.col("__b").isNull(), "missing").when(F.size(x) != F.size(y), "dimensions").when(off, "values")
    return joined.select(*keys, problem.alias("problem")).filter("problem is not null")
