"""Samples as arrays and events on a time line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def channel_difference(left: Column, right: Column) -> Column:
    """What differs between two channels: voices in the middle cancel out."""
    return F.zip_with(left, right, lambda a, b: a.cast("double") - b.cast("double"))


def gain(samples: Column, percent: int) -> Column:
    factor = min(200, max(50, percent)) / 100
    return F.transform(samples, lambda x: x.cast("double") * factor)


def fade_in(samples: Column, n: int) -> Column:
    """The first n samples rise from silence in a line."""
    return F.transform(samples, lambda x, i: x.cast("double") * F.least(F.lit(1.0), i / float(max(1, n))))


def fade_out(samples: Column, n: int) -> Column:
    return F.reverse(fade_in(F.reverse(samples), n))


def trim_samples(samples: Column, rate: int, start: float, end: float | None) -> Column:
    """The samples between two times in seconds; an end not after the start is no end."""
    first = int(start * rate)
    n = F.size(samples) if end is None or end <= start else F.lit(int(end * rate) - first)
    return F.slice(samples, F.lit(first + 1), F.greatest(n, F.lit(0)))


def normalize(samples: Column) -> Column:
    """0 to 255 as -1 to 1."""
    return F.transform(samples, lambda v: v.cast("double") / 127.5 - 1)


def luma(red: Column, green: Column, blue: Column) -> Column:
    return F.floor(0.299 * red + 0.587 * green + 0.114 * blue + 0.5).cast("int")


def trim(events: DataFrame, at: str, start: float, end: float | None) -> DataFrame:
    """The events whose seconds lie in [start, end), counted anew from start."""
    kept = events.where(F.col(at) >= start)
    if end is not None and end > start:
        kept = kept.where(F.col(at) < end)
    return kept.withColumn(at, F.col(at) - start)


def change_speed(events: DataFrame, at: str, speed: float) -> DataFrame:
    return events.withColumn(at, F.col(at) / speed)


def play_backwards(events: DataFrame, at: str, duration: float) -> DataFrame:
    return events.withColumn(at, F.lit(duration) - F.col(at))
