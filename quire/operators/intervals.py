"""Points within intervals, joined by place: the work follows the points and what is found, not their product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of cells: cell i of level k holds the points from i * 2**k on, 2**k of them.
LEVELS = 40


def cells(first: Column, last: Column) -> Column:
    """array<struct<level, cell>>: the fewest cells that make up the integers from first to last, both from 0 on.

    At most two of a level: where the interval begins or ends within a cell of the next one.
    """
    cell = lambda k, i: F.struct(k.cast("int").alias("level"), i.alias("cell"))

    def step(s: Column, k: Column) -> Column:
        left, right = s["a"] % 2 == 1, s["b"] % 2 == 0
        inside = s["a"] <= s["b"]
        own = F.concat(
            s["out"], F.when(inside & left, F.array(cell(k, s["a"]))).otherwise(none),
            F.when(inside & right & ~(left & (s["a"] == s["b"])), F.array(cell(k, s["b"]))).otherwise(none),
        )
        a = F.shiftright(s["a"] + left.cast("long"), 1)
        b = F.shiftright(s["b"] - right.cast("long"), 1)
        return F.struct(a.alias("a"), F.when(s["b"] - right.cast("long") < 0, F.lit(-1).cast("long")).otherwise(b).alias("b"), own.alias("out"))

    none = F.expr("cast(array() as array<struct<level: int, cell: bigint>>)")
    start = F.struct(first.cast("long").alias("a"), last.cast("long").alias("b"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step, lambda s: s["out"])


def within(points: DataFrame, intervals: DataFrame, key: str, at: str, first: str, last: str) -> DataFrame:
    """points with the other columns of each interval of their key that holds them.

    An interval is taken apart into cells, a point looks up its cell of each level that the
    intervals of its key use, and they meet as equals: no range condition, and a key of many
    points and intervals is dealt out by cell. Null keys are equal; points and interval ends
    are integers from 0 on, others meet nothing.
    """
    kept = intervals.where((F.col(first) >= 0) & (F.col(first) <= F.col(last)))
    own = kept.withColumn("__cells", F.explode(cells(F.col(first), F.col(last)))).withColumnRenamed(key, "__key")
    own = own.select("*", "__cells.level", "__cells.cell").withColumnsRenamed({"level": "__level", "cell": "__cell"}).drop("__cells")
    used = own.groupBy("__key").agg(F.collect_set("__level").alias("__levels")).withColumnRenamed("__key", "__of")  # LEVELS a key at most
    asked = points.where(F.col(at) >= 0).join(used, F.col(key).eqNullSafe(F.col("__of"))).withColumn("__at", F.explode("__levels"))
    asked = asked.withColumn("__in", F.expr(f"shiftright(cast(`{at}` as bigint), __at)")).drop("__levels", "__of")
    met = (F.col(key).eqNullSafe(F.col("__key"))) & (F.col("__at") == F.col("__level")) & (F.col("__in") == F.col("__cell"))
    return asked.join(own, met).drop("__key", "__level", "__cell", "__at", "__in")
