"""Referential integrity: rows whose reference has no target.

A reference may have several key columns, each of which may be null. References are split by
their null mask; every mask that the declared match semantics asks to check is anti-joined to
the distinct targets on exactly its non-null columns.

* ``simple``  a reference with any null column refers to nothing and is never an orphan;
* ``partial`` null columns match anything, the others must occur together in one target;
* ``full``    either all columns are null (no reference) or none: mixed references are orphans.

Only the key columns of the targets are read. Their ``distinct`` aggregates before the shuffle
and leaves them partitioned as the join needs, so each mask costs one shuffle per side. A key
that holds a large part of the references is on the left of an anti-join, which AQE splits.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "partial", "full")


def orphan_references(
    refs: DataFrame,
    targets: DataFrame,
    keys: list[str],
    target_keys: list[str] | None = None,
    match: str = "simple",
) -> DataFrame:
    """The rows of ``refs`` whose reference does not exist in ``targets``.

    ``refs`` keeps all its columns, repeated rows stay repeated, names may clash with those of
    ``targets``. An empty ``targets`` makes every checked reference an orphan; an empty ``refs``
    gives no rows. Null keys are handled as ``match`` declares.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    target_keys = target_keys or keys
    if len(keys) != len(target_keys) or not keys:
        raise ValueError("keys and target_keys must have the same, non-zero length")
    own = [f"__target_{i}" for i in range(len(keys))]
    targets = targets.select(*[F.col(t).alias(o) for t, o in zip(target_keys, own, strict=True)])
    found = []
    for mask in product((True, False), repeat=len(keys)):
        if not any(mask):
            continue
        part = refs.filter(_masked(keys, mask))
        if all(mask) or match == "partial":
            used = [(k, o) for k, o, m in zip(keys, own, mask, strict=True) if m]
            side = targets.select(*[o for _, o in used]).na.drop().distinct()
            condition = reduce(lambda a, b: a & b, [part[k] == side[o] for k, o in used])
            found.append(part.join(side, condition, "left_anti"))
        elif match == "full":
            found.append(part)
    return reduce(DataFrame.unionByName, found)


def _masked(keys: list[str], mask: tuple[bool, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() if m else F.col(k).isNull() for k, m in zip(keys, mask, strict=True)])


def orphan_report(orphans: DataFrame, table: str = "ref_table", period: str = "period") -> DataFrame:
    """How many orphans each table has in each period; map-side aggregated."""
    return orphans.groupBy(table, period).agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("ref_target").alias("distinct_targets"))
