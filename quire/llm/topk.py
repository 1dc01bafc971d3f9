"""Exact top-k search by inner product: vectors bucketed by length, pruned by local cosine thresholds.

Every partition sorts its vectors by length, the longest first, and packs them into
buckets of at most BUCKET, which are written once. Queries go to all partitions in rounds
of at most QUERY_BYTES, a round after the other, so neither side is ever held whole.

A task keeps the k best scores of each query and walks down its buckets. The k-th best
score, divided by the lengths of the query and of a bucket's longest vector, is that
bucket's local cosine threshold. Above one no vector of the bucket can enter. From COORD
on, the coordinate pruning applies: a unit vector whose cosine with the query reaches the
threshold lies within an interval in each coordinate, and the narrowest of the intervals
of the query's FOCUS largest coordinates, found by binary search in the bucket's sorted
coordinates, names the vectors to verify. Below COORD the length pruning applies: the
vectors of the bucket that are long enough are verified in one matrix product. Each task
first meets the HEAD longest vectors of all, which only bound the k-th best score from
below. The tasks' best rows are then ranked by query, in two steps.

All decisions are exact: bounds in floating point are widened by SLACK and only rule
vectors out; scores are integers; equal scores go to the smaller vec_id.

Defined results: vectors that are null or hold null or non-finite components take no part;
one with fewer components than the query counts as having zeros behind them, an empty one
scores 0. Rows that share the query's vec_id are its own and no candidates; a null vec_id
is never a query, and as a candidate comes after all others of equal score. Repeated query
rows are answered once, the smallest vector of a vec_id that has several; repeated
candidates each take a place. Fewer candidates than k give as many rows, an empty table
none. Extra columns are ignored, under whatever names. Scores must be below 2**63:
components below a million.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .balltree import inner_products, integers
from .common import stored

K = 5
EVERY = 50
SCALE = 256
#: Vectors of a bucket, and queries compared with it at once, at most.
BUCKET = 2048
QUERIES = 256
#: The longest vectors of all that give every task its first thresholds.
HEAD = 1024
#: Bytes of queries sent to all tasks at once.
QUERY_BYTES = 32 << 20
#: Local cosine thresholds from which intervals of coordinates are searched, and how many coordinates.
COORD = 0.7
FOCUS = 4
#: An interval pays if it leaves fewer vectors than this share of the bucket.
PAYS = 0.05
SLACK = 1e-9
#: Groups of tasks whose rows are ranked first.
GROUPS = 64
NONE = np.iinfo(np.int64).min
#: Stands for a null vec_id among candidates.
LAST = np.iinfo(np.int64).max


def lengths(points: np.ndarray) -> np.ndarray:
    return np.sqrt((points.astype(np.float64) ** 2).sum(axis=1))


def buckets(vectors: DataFrame) -> DataFrame:
    """(dims, vec_ids, points): the vectors (vec_id, v, length) of each partition in buckets of like length, written."""

    def run(batches: Iterator):
        import pyarrow as pa

        held: dict[int, tuple[list, list]] = {}

        def packed(dims: int):
            ids, rows = held.pop(dims)
            return pa.RecordBatch.from_arrays(
                [pa.array([dims], pa.int32()), pa.array([np.concatenate(ids).tobytes()]), pa.array([np.concatenate(rows).tobytes()])],
                names=["dims", "vec_ids", "points"],
            )

        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes)])
            flat = batch.column("v").flatten().to_numpy()
            ids = batch.column("vec_id").fill_null(LAST).to_numpy()
            for i, dims in enumerate(sizes.tolist()):
                own = held.setdefault(dims, ([], []))
                own[0].append(ids[i : i + 1])
                own[1].append(flat[starts[i] : starts[i + 1]])
                if len(own[0]) == BUCKET:
                    yield packed(dims)
        for dims in list(held):
            yield packed(dims)

    ordered = vectors.sortWithinPartitions(F.desc("length")).select("vec_id", "v")
    return stored(ordered.mapInArrow(run, "dims int, vec_ids binary, points binary"))


class Best:
    """The k best (score, vec_id) of each of the queries of one block, and a lower bound of the k-th best score."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), NONE), np.full((n, k), LAST)
        self.filled, self.least = np.zeros(n, np.int64), np.full(n, NONE)

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Takes in candidates: their query's row, vec_id and score."""
        used = np.unique(rows)
        old = np.repeat(used, self.filled[used])
        place = np.arange(len(old)) - np.repeat(np.cumsum(self.filled[used]) - self.filled[used], self.filled[used])
        all_rows = np.concatenate([old, rows])
        all_scores, all_ids = np.concatenate([self.scores[old, place], scores]), np.concatenate([self.ids[old, place], ids])
        order = np.lexsort((all_ids, -all_scores, all_rows))
        all_rows, all_scores, all_ids = all_rows[order], all_scores[order], all_ids[order]
        first = np.searchsorted(all_rows, used)
        rank = np.arange(len(all_rows)) - np.repeat(first, np.diff(np.append(first, len(all_rows))))
        keep = rank < self.k
        self.scores[all_rows[keep], rank[keep]], self.ids[all_rows[keep], rank[keep]] = all_scores[keep], all_ids[keep]
        self.filled[used] = np.bincount(np.searchsorted(used, all_rows[keep]), minlength=len(used))
        full = used[self.filled[used] == self.k]
        self.least[full] = np.maximum(self.least[full], self.scores[full, -1])


def kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest score of each row, or NONE if there are fewer."""
    return np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(scores), NONE)


class Bucket:
    """Vectors of one number of components, the longest first."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.ids, self.points, self.lengths = ids, points, lengths(points)
        order = np.argsort(-self.lengths, kind="stable")
        self.ids, self.points, self.lengths = ids[order], points[order], self.lengths[order]
        self.by_id = np.argsort(self.ids, kind="stable")
        self.sorted_ids = self.ids[self.by_id]
        self._sorted = None

    def coordinates(self) -> tuple[np.ndarray, np.ndarray]:
        """The vectors' order by each coordinate of their unit vectors, and those coordinates in that order."""
        if self._sorted is None:
            unit = self.points / np.maximum(self.lengths, 1e-300)[:, None]
            order = np.argsort(unit, axis=0)
            self._sorted = order, np.take_along_axis(unit, order, axis=0)
        return self._sorted

    def products(self, query_ids: np.ndarray, queries: np.ndarray, n: int) -> np.ndarray:
        """Scores of the first n vectors, NONE for a query's own rows."""
        dims = min(queries.shape[1], self.points.shape[1])
        scores = inner_products(queries[:, :dims], self.points[:n, :dims])
        low, high = np.searchsorted(self.sorted_ids, query_ids, "left"), np.searchsorted(self.sorted_ids, query_ids, "right")
        for i in np.flatnonzero(high > low):
            own = self.by_id[low[i] : high[i]]
            scores[i, own[own < n]] = NONE
        return scores


def search(bucket: Bucket, query_ids: np.ndarray, queries: np.ndarray, best: Best) -> None:
    """Offers best what the bucket holds for a block of queries."""
    size = lengths(queries)
    need, bounded = np.full(len(size), -np.inf), (best.least > NONE) & (size > 0)
    # The largest product that a vector can have with a query is the product of their lengths.
    need[bounded] = best.least[bounded] / size[bounded]
    long_enough = np.searchsorted(-bucket.lengths, -(need - SLACK * (1 + np.abs(need))), "right")
    long_enough[(size == 0) & (best.least > 0)] = 0
    longest = max(bucket.lengths[0], 1e-300)
    cosine = need / longest
    by_interval = (cosine >= COORD) & (long_enough > 0) & (queries.shape[1] == bucket.points.shape[1])
    for i in np.flatnonzero(by_interval):
        found = interval(bucket, queries[i] / size[i], min(float(cosine[i]), 1.0))
        if found is None:
            by_interval[i] = False
            continue
        found = found[found < long_enough[i]]
        found = found[bucket.ids[found] != query_ids[i]]
        scores = bucket.points[found] @ queries[i]
        keep = scores >= best.least[i]
        if keep.any():
            best.offer(np.full(keep.sum(), i), bucket.ids[found[keep]], scores[keep])
    rest = np.flatnonzero(~by_interval & (long_enough > 0))
    if len(rest):
        scores = bucket.products(query_ids[rest], queries[rest], int(long_enough[rest].max()))
        # The k-th best of this bucket alone also bounds the k-th best of all.
        best.least[rest] = np.maximum(best.least[rest], kth(scores, best.k))
        row, at = np.nonzero((scores >= best.least[rest][:, None]) & (scores > NONE))
        if len(row):
            best.offer(rest[row], bucket.ids[at], scores[row, at])


def interval(bucket: Bucket, unit: np.ndarray, cosine: float) -> np.ndarray | None:
    """The vectors of the narrowest interval of a coordinate that holds all with at least this cosine; None if it doesn't pay."""
    order, values = bucket.coordinates()
    spans = []
    for f in np.argsort(-np.abs(unit))[:FOCUS]:
        # Angles within acos(cosine) of the query's own angle with this axis.
        middle, reach = unit[f] * cosine, np.sqrt(max(0.0, 1 - cosine**2) * max(0.0, 1 - unit[f] ** 2)) + 1e-6
        low, high = -1.0 if unit[f] <= -cosine else middle - reach, 1.0 if unit[f] >= cosine else middle + reach
        spans.append((np.searchsorted(values[:, f], low - 1e-6), np.searchsorted(values[:, f], high + 1e-6, "right"), f))
    a, b, f = min(spans, key=lambda s: s[1] - s[0])
    return np.sort(order[a:b, f]) if b - a <= PAYS * len(order) else None


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best; both tables have vec_id (long) and v (array of long)."""
    spark = vectors.sparkSession
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    measured = vectors.withColumn("length", F.sqrt(squares))
    found = buckets(measured)
    head = measured.orderBy(F.desc("length"), "vec_id").limit(HEAD).select("vec_id", "v").collect()  # HEAD rows
    asked = stored(queries.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v")))
    rounds = []
    for ids, rows in _rounds(asked, query_bytes):
        sent = spark.sparkContext.broadcast((ids, rows, [(LAST if r["vec_id"] is None else r["vec_id"], r["v"]) for r in head]))
        parts = found.mapInArrow(_searcher(sent, k), "query_id long, vec_id long, score long")
        rounds.append(stored(ranked(parts, k)))
        sent.unpersist()
    if not rounds:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, rounds)


def ranked(parts: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; first within groups of tasks, so that no query's rows all meet at once."""
    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    parts = parts.withColumn("part", F.spark_partition_id() % GROUPS)
    first = parts.withColumn("rank", rank("query_id", "part")).where(F.col("rank") <= k)
    return first.withColumn("rank", rank("query_id")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rounds(asked: DataFrame, query_bytes: int):
    """The queries in lists of at most query_bytes (one query at least): never more of them on the driver."""
    ids, rows, size = [], [], 0
    for r in asked.toLocalIterator():
        if ids and size + 8 * len(r["v"]) > query_bytes:
            yield ids, rows
            ids, rows, size = [], [], 0
        ids.append(r["vec_id"])
        rows.append(np.array(r["v"], np.int64))
        size += 8 * len(r["v"])
    if ids:
        yield ids, rows


def _blocks(ids: list, rows: list, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Lists of vectors as blocks with one number of components each."""
    by_dims: dict[int, list[int]] = {}
    for i, v in enumerate(rows):
        by_dims.setdefault(len(v), []).append(i)
    parts = [(dims, own[j : j + most]) for dims, own in by_dims.items() for j in range(0, len(own), most)]
    return [(np.array([ids[i] for i in p], np.int64), np.array([rows[i] for i in p], np.int64).reshape(len(p), dims)) for dims, p in parts]


def _searcher(sent, k: int):
    def run(batches: Iterator):
        import pyarrow as pa

        state = []
        for batch in batches:
            for dims, ids, points in zip(*[batch.column(c).to_pylist() for c in ("dims", "vec_ids", "points")], strict=True):
                if not state:
                    query_ids, queries, head = sent.value
                    first = [Bucket(i, p) for i, p in _blocks([i for i, _ in head], [v for _, v in head], HEAD)]
                    for own, block in _blocks(query_ids, queries, QUERIES):
                        best = Best(len(own), k)
                        for b in first:
                            best.least = np.maximum(best.least, kth(b.products(own, block, len(b.ids)), k))
                        state.append((own, block, best))
                bucket = Bucket(np.frombuffer(ids, np.int64), np.frombuffer(points, np.int64).reshape(len(ids) // 8, dims))
                for own, block, best in state:
                    search(bucket, own, block, best)
        for own, _, best in state:
            row, place = np.nonzero(np.arange(k) < best.filled[:, None])
            vec_id = best.ids[row, place]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[row]), pa.array(vec_id, mask=vec_id == LAST), pa.array(best.scores[row, place])],
                names=["query_id", "vec_id", "score"],
            )

    return run


def nearest(table: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """The k best of each vector whose vec_id is divisible by every, among all rows but its own."""
    vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("v")).where("v IS NOT NULL")
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)
