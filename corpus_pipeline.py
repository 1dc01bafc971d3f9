"""The corpus pipeline: quality rules, near-copies, benchmark passages, secrets, mix.

Each stage takes (spark, docs, sf_dir) and returns documents; run() applies all of
them to the documents table. A stage judges everything its predecessor kept. SQL
cannot express the near-copies stage, so ORACLE_SQL is None and the tests compare
run() with a brute-force version.

Defined results of every stage: rows are judged one by one, by their own text; doc_ids
may be null or shared by different texts, which then live or fall apart from each other.
All columns are kept, also further ones under whatever names; an empty table gives an
empty one. The docstrings of the stages say what becomes of the other cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontam, mixing, quality, secrets, simhash
from quire.llm.common import scratch, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject.

    Null and empty texts have no words and go; a null source is a host of its own;
    repeated rows get equal verdicts.
    """
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-copies.

    It is that of the smallest doc_id; null comes last, then a hash of the text decides;
    of repeated rows one stays. Null and empty texts are copies of each other.
    """
    return simhash.keep_first(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item.

    Null and empty texts hold none and stay; repeated rows stay or go together; an empty
    benchmark drops nothing.
    """
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts and keeps every document.

    Null and empty texts stay as they are; repeated rows stay equal.
    """
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their target weights.

    Null and empty texts count as no words; a null source is one source, ranked last;
    repeated rows are drawn alike.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("secret_spans", secret_spans),
    ("mix_sources", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages leave. Each stage's own tables go as soon as its result is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            found = stage(spark, docs, sf_dir)
            docs = stored(found, kept=True)
    return STAGES[-1][1](spark, docs, sf_dir)
