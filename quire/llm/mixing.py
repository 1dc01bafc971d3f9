"""Mixing sources to target weights (DataFrame functions only).

Tokens are summed by source, targets are filled up by weight, and each document is
emitted floor(rate) times plus one more time if a hash of its id, its text and a seed
falls below the fraction of the rate. Reruns draw the same copies.

Defined results: null and empty texts have size 0; a null source is one source, ranked
last; a source without words has target 0 and rate 0; rows equal in doc_id and text share
the draw, rows with null or shared doc_ids but different texts do not; extra columns are
kept by mix() and ignored by plan_documents(), under whatever names; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, n_space_words

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_REPEATS = 2
SEED = 20250101
RANGES = 64
#: Shares that fair_share() tries at a time.
POINTS = 16


def source_sizes(docs: DataFrame) -> DataFrame:
    """of_source, source_size and rank, 0-based by code point with null last.

    Ranks are taken in ranges of sources and shifted by the number of sources in
    earlier ranges, so that no task holds all sources.
    """
    sizes = docs.groupBy(F.col("source").alias("of_source")).agg(
        F.sum(n_space_words(F.col("text"))).alias("source_size")
    )
    order = F.col("of_source").asc_nulls_last()
    ranged = cut(sizes.repartitionByRange(RANGES, order).withColumn("range", F.spark_partition_id()))
    before = ranged.groupBy("range").agg(F.count("*").alias("n")).select(
        F.col("range").alias("r"),
        F.coalesce(
            F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
    )  # at most RANGES rows
    within = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    return ranged.withColumn("within", within).join(F.broadcast(before), F.col("range") == F.col("r")).select(
        "of_source", "source_size", (F.col("within") + F.col("before")).alias("rank")
    )


def fair_share(limited: DataFrame, total: float) -> float:
    """What a unit of weight gets so that sum(min(weight * share, cap)) is total, over sources with a cap.

    Each round tries POINTS shares between two that are too small and too large, in one
    aggregation; it ends when no source reaches its cap between neighbours. Shares lie within
    a factor of 2**64, say, so a few rounds do for any number of sources.
    """
    ratio = F.col("cap") / F.col("weight")
    caps, weights, low, high = limited.agg(F.sum("cap"), F.sum("weight"), F.min(ratio), F.max(ratio)).head()
    if caps is None or total >= caps:
        return high or 0.0  # every source is full
    if total <= low * weights:
        return total / weights  # none is
    while True:
        points = [low * (high / low) ** (i / POINTS) for i in range(POINTS)] + [high]
        tried = limited.agg(*[
            F.struct(
                F.count(F.when(ratio <= p, 1)).alias("n"), F.coalesce(F.sum(F.when(ratio <= p, F.col("cap"))), F.lit(0.0)).alias("full"),
                F.coalesce(F.sum(F.when(ratio > p, F.col("weight"))), F.lit(0.0)).alias("open"),
            ) for p in points
        ]).head()
        at = max(i for i, x in enumerate(tried[:POINTS]) if i == 0 or x["full"] + points[i] * x["open"] <= total)
        if tried[at]["n"] == tried[at + 1]["n"] or (points[at], points[at + 1]) == (low, high):
            return (total - tried[at]["full"]) / tried[at]["open"]
        low, high = points[at], points[at + 1]


def fill(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sizes with target and rate: budget times all sizes, shared by weight, each up to max_repeats its size."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    limited = cut(sizes.select(
        "of_source", "source_size",
        F.get(cycle, (F.col("rank") % len(weights)).cast("int")).alias("weight"),
        (F.lit(float(max_repeats)) * F.col("source_size")).alias("cap"),
    ))
    total = budget * (limited.agg(F.sum("source_size")).head()[0] or 0)
    share = fair_share(limited.where("cap > 0"), total)
    target = F.least(F.col("weight") * F.lit(share), F.col("cap"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return limited.select("of_source", "source_size", target.alias("target"), rate.alias("rate"))


def draw(seed: int) -> Column:
    """A number from 0 to 1, less than 1, from the doc_id and the text of a row."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11) * F.lit(2.0**-53)


def with_copies(drawn: DataFrame, rates: DataFrame) -> DataFrame:
    """drawn, which has source and draw, with of_source, source_size, target, rate and copies."""
    rates = bounded(rates, F.coalesce(F.octet_length("of_source"), F.lit(0)) + 48)
    whole = F.floor("rate")
    copies = whole + (F.col("draw") < F.col("rate") - whole).cast("long")
    return drawn.join(rates, F.col("source").eqNullSafe(F.col("of_source"))).withColumn("copies", copies)


def plan_documents(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, copies."""
    rates = cut(fill(source_sizes(docs), weights, budget))
    sized = docs.select("doc_id", "source", n_space_words(F.col("text")).alias("size"), draw(seed).alias("draw"))
    return with_copies(sized, rates).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it."""
    rates = cut(fill(source_sizes(docs), weights, budget))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    each = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    copied = with_copies(docs.select(row, "source", draw(seed).alias("draw")), rates).where("copies > 0").select("row", each)
    return copied.select("row.*")
