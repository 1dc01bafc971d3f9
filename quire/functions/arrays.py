"""Values bound once, and running sums within an array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column], start: int) -> Column:
    """combine, which is associative and starts from start, of an array of integers up to and with each element.

    Results within blocks of BLOCK elements are combined with those of earlier blocks, so
    that an array of n elements costs n * BLOCK steps and not the square of n.
    """

    def folded(array: Column) -> Column:
        step = lambda s, x: F.concat(s, F.array(combine(F.element_at(s, -1), x.cast("long"))))
        return F.aggregate(array, F.array(F.lit(start).cast("long")), step)

    def whole(array: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(array) - 1) / BLOCK).cast("int"))
        blocks = F.transform(starts, lambda b: folded(F.slice(array, b * BLOCK + 1, F.lit(BLOCK))))
        return let(blocks, lambda own: F.flatten(F.zip_with(
            own, F.slice(folded(F.transform(own, lambda b: F.element_at(b, -1))), F.lit(1), F.size(own)),
            lambda b, before: F.transform(F.slice(b, F.lit(2), F.lit(BLOCK)), lambda x: combine(before, x)),
        )))

    none = F.expr("cast(array() as array<bigint>)")
    return let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(whole(v)))


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b, 0)


def running_max(values: Column) -> Column:
    """The largest up to and with each element; for numbers from 0 on."""
    return running(values, F.greatest, 0)
