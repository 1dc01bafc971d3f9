"""Ranked lexical search: items times documents as a blocked product of sparse matrices.

The left matrix holds how often a term occurs in an item, the right one the impact of a
term in a document, as 64-bit integers. Items go through in blocks of at most ITEM_TERMS
terms, so the driver and the tasks hold one block of the left matrix at a time. For each
block the documents' occurrences of the block's terms are counted in tasks and written;
from them come the number of documents, their terms and the documents that hold a term.
Tasks then turn batches of documents into blocks of the right matrix, sorted by term, and
compute an item's row by Gustavson's method: the rows of its terms, times their
multiplicity, are merged into one accumulator. An item's best documents of a block are
merged with those of the task's earlier blocks, and those of the tasks by two rankings.

Defined results: null and empty texts have no terms, are never found and do not count;
an item without terms has no rows; null item_ids are items like others, repeated item_ids
are items of their own, each with its ranks; a null doc_id comes after all others of equal
score; repeated documents each take a place; an empty table gives an empty result. Extra
columns are ignored, under whatever names. Doc_ids are integers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K = 20
#: Characters that are not in terms (the complement of ASCII letters and digits within ASCII).
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: Terms of the items of a block, counted for each item; an item with more is a block of its own.
ITEM_TERMS = 1_000_000
#: Documents of a block of the right matrix, at most.
BLOCK = 8192
#: Groups of tasks whose rows are ranked first.
GROUPS = 64
LAST = np.iinfo(np.int64).max


def terms(text: str | None) -> list[str]:
    if not text:
        return []
    return TERM.findall(text.lower() if text.isascii() else text.translate(LOWER))


class Items:
    """A block of the left matrix: row i has the terms columns[starts[i]:starts[i + 1]] with their multiplicities."""

    def __init__(self, ids: list, counts: list[Counter]):
        self.ids = ids
        self.number = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        self.starts = np.concatenate([[0], np.cumsum([len(c) for c in counts])])
        self.columns = np.array([self.number[t] for c in counts for t in c], np.int64)
        self.times = np.array([n for c in counts for n in c.values()], np.int64)


def item_blocks(items: DataFrame, most: int = ITEM_TERMS) -> Iterator[Items]:
    """The items in blocks; the driver reads partition by partition and holds one block."""
    ids, counts, size = [], [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        own = Counter(terms(r["text"]))
        if ids and size + len(own) > most:
            yield Items(ids, counts)
            ids, counts, size = [], [], 0
        if own:
            ids.append(r["item_id"])
            counts.append(own)
            size += len(own)
    if ids:
        yield Items(ids, counts)


def postings(docs: DataFrame, sent) -> DataFrame:
    """doc_id, n (its terms with repeats), terms (numbers of the block's terms in it) and tf of each document with a term; written."""

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            number = sent.value.number
            ids, sizes, lengths, columns, tf = [], [], [0], [], []
            for i, text in enumerate(batch.column("text")):
                words = terms(text.as_py())
                if not words:
                    continue
                own = Counter(map(number.get, words))
                own.pop(None, None)
                ids.append(i)
                sizes.append(len(words))
                lengths.append(lengths[-1] + len(own))
                columns += own
                tf += own.values()
            offsets = pa.array(lengths, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(columns, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32())),
                ],
                names=["doc_id", "n", "terms", "tf"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>"))


def weights(found: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """The weight of each term of the block, the number of documents and of all their terms."""

    def run(batches: Iterator):
        import pyarrow as pa

        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(df[used])], names=["term", "df"])

    n_docs, all_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    df = np.zeros(n_terms, np.int64)
    for r in found.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]  # one row for each term of the block
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64), n_docs, all_terms


def impacts(n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """What each occurring term adds to the score of its document, once for each time that an item has it."""
    m = 100 - 25 + (25 * n * n_docs) // max(all_terms, 1)
    return weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores above 0 with their ids, equal scores by id."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:
        own = scores[at]
        at = at[own >= np.partition(own, -k)[-k]]
    at = at[np.lexsort((ids[at], -scores[at]))[:k]]
    return scores[at], ids[at]


def _product(sent, weighed, n_docs: int, all_terms: int, k: int):
    def run(batches: Iterator):
        import pyarrow as pa

        items, weight, best = sent.value, weighed.value, {}
        for whole in batches:
            for offset in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(offset, BLOCK)
                ids = batch.column("doc_id").fill_null(LAST).to_numpy()
                sizes = batch.column("terms").value_lengths().to_numpy()
                doc, term = np.repeat(np.arange(len(ids)), sizes), batch.column("terms").flatten().to_numpy()
                tf = batch.column("tf").flatten().to_numpy().astype(np.int64)
                impact = impacts(batch.column("n").to_numpy(), doc, term, tf, weight, n_docs, all_terms)
                order = np.argsort(term, kind="stable")
                doc, impact = doc[order], impact[order]
                starts = np.searchsorted(term[order], np.arange(len(weight) + 1)).tolist()
                for i in range(len(items.ids)):
                    row = np.zeros(len(ids), np.int64)
                    for j in range(items.starts[i], items.starts[i + 1]):
                        t = items.columns[j]
                        a, b = starts[t], starts[t + 1]
                        if a < b:
                            row[doc[a:b]] += items.times[j] * impact[a:b]
                    scores, found = best_of(row, ids, k)
                    if len(scores):
                        if i in best:
                            scores, found = best_of(np.concatenate([best[i][0], scores]), np.concatenate([best[i][1], found]), k)
                        best[i] = scores, found
        for i, (scores, found) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * len(scores), pa.int32()), pa.array(found, mask=found == LAST), pa.array(scores)],
                names=["item", "doc_id", "score"],
            )

    return run


def ranked(parts: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item; first within groups of tasks, so that no item's rows all meet at once."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    parts = parts.withColumn("part", F.spark_partition_id() % GROUPS)
    first = parts.withColumn("rank", rank("item", "part")).where(F.col("rank") <= k)
    return first.withColumn("rank", rank("item")).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, most: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType
    blocks = []
    for block in item_blocks(items, most):
        sent = spark.sparkContext.broadcast(block)
        found = postings(docs, sent)
        weight, n_docs, all_terms = weights(found, len(block.number))
        weighed = spark.sparkContext.broadcast(weight)
        parts = found.mapInArrow(_product(sent, weighed, n_docs, all_terms, k), "item int, doc_id long, score long")
        best = stored(ranked(parts, k))
        weighed.unpersist()
        named = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind.simpleString()}")
        blocks.append(best.join(named, "item").select("item_id", "rank", "doc_id", "score"))
        sent.unpersist()
    if not blocks:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, blocks)
