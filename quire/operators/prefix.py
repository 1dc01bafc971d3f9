"""Running sums over groups of any size: no task holds a group, only a slice of its keys and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import stored


def sums_before(rows: DataFrame, group: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """group, order and, for each of values, its sum over the earlier rows of the group, 0 for the first.

    Rows are dealt by ranges of group and order, so that a large group spans many slices and
    small ones share one. A slice is summed within itself; the sums of earlier slices of the
    group, one row for each slice, are added. Only the columns named here are shuffled.
    group and order together tell rows apart; nulls in group are a group.
    """
    mine, names = [f"__g{i}" for i in range(len(group))], list(values)
    narrow = rows.select(*[F.col(g).alias(m) for g, m in zip(group, mine, strict=True)], *order, *[v.alias(n) for n, v in values.items()])
    sliced = stored(narrow.repartitionByRange(*mine, *order).withColumn("__slice", F.spark_partition_id()))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda w: {n: F.coalesce(F.sum(n).over(w), F.lit(0)) for n in names}
    totals = sliced.groupBy(*mine, "__slice").agg(*[F.sum(n).alias(n) for n in names])
    shifts = totals.withColumns(sums(upto(*mine).orderBy("__slice")))
    shifts = shifts.select(F.col("__slice").alias("__of"), *[F.col(m).alias(f"__of{m}") for m in mine], *[F.col(n).alias(f"__shift_{n}") for n in names])
    within = sliced.withColumns(sums(upto("__slice", *mine).orderBy(*order)))
    same = F.col("__slice") == F.col("__of")
    for m in mine:
        same = same & F.col(m).eqNullSafe(F.col(f"__of{m}"))
    shifted = within.join(shifts, same)
    return shifted.select(
        *[F.col(m).alias(g) for g, m in zip(group, mine, strict=True)], *order, *[(F.col(n) + F.col(f"__shift_{n}")).alias(n) for n in names]
    )


def with_sums_before(rows: DataFrame, group: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """rows, all columns, with those sums; what rows hold beside goes through one join by group and order."""
    keys = [*group, *order]
    found = sums_before(rows, group, order, values)
    found = found.select(*[F.col(k).alias(f"__of_{k}") for k in keys], *values)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return rows.join(found, same).drop(*[f"__of_{k}" for k in keys])
