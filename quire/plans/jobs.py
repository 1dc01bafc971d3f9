"""Cancelling and watching the jobs of an operator."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[Callable[[], list[str]]]:
    """Tags the jobs started inside; calling what it gives, also from another thread, stops them."""
    spark.addTag(tag)
    try:
        yield lambda: spark.interruptTag(tag)
    finally:
        spark.removeTag(tag)


def progress(spark: SparkSession) -> list[dict]:
    """stage, done and total of the tasks of each stage that runs; empty when nothing does."""
    tracker = spark.sparkContext.statusTracker()
    found = (tracker.getStageInfo(i) for i in tracker.getActiveStageIds())
    return [{"stage": s.name, "done": s.numCompletedTasks, "total": s.numTasks} for s in found if s]
