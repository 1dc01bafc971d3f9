"""Centroid clustering (Lloyd's rounds over integers) filtered by ball trees.

Every partition packs its vectors into blocks of at most BLOCK and builds a metric tree of
each: a node keeps radius, count and the integer sum of its vectors, and splits at the
median of its widest component. The trees are written once. A round sends the centroids
to the trees. By the triangle inequality a centroid farther from the middle of a ball than
the nearest one plus twice the radius is nearest to no vector of it; a ball with one
centroid left is assigned whole, by its count and sum, the others are descended, and the
vectors of leaves that remain are compared exactly. Partitions return a count and a sum
for each centroid, so what reaches the driver is k vectors, and nothing else is shuffled.

All decisions are exact: floating-point bounds are widened by SLACK and only rule
centroids out; distances are integers, and ties go to the smaller centroid.

Defined results: null vectors, vectors with another number of components than dims and
those with null or non-finite components take no part and have no row. Null vec_ids are
allowed and rank last among the first centroids; repeated rows are clustered alike, also as
first centroids (equal centroids: the smaller number wins). Fewer vectors than k give as
many centroids; an empty table gives an empty result. Extra columns are ignored, under
whatever names. Squared distances must be below 2**63: components below a million.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

CENTROIDS = 40
ROUNDS = 5
DIMS = 64
SCALE = 256
SALT = 2
#: Vectors of a tree at most, and of a leaf.
BLOCK = 1024
LEAF = 16
SLACK = 1e-7


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component x, as double; null for a null vector or one with null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exactly: in doubles where every sum stays below 2**53, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def bounds(n: int, leaf: int = LEAF) -> list[np.ndarray]:
    """The borders of the nodes of each level, root first, of a tree over n ordered vectors."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max() > leaf:
        b = levels[-1]
        levels.append(np.append(np.stack([b[:-1], (b[:-1] + b[1:]) // 2], axis=1).ravel(), n))
    return levels


def build(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, sums, radii): the vectors' order in the tree, and sum and radius of every node, level by level."""
    order, levels = np.arange(len(points)), bounds(len(points))
    for upper, lower in zip(levels, levels[1:], strict=False):
        for i in range(len(upper) - 1):
            start, stop, middle = upper[i], upper[i + 1], lower[2 * i + 1]
            own = points[order[start:stop]]
            widest = own[:, np.argmax(own.max(axis=0) - own.min(axis=0))]
            order[start:stop] = order[start:stop][np.argpartition(widest, middle - start)]
    ordered, sums, radii = points[order], [], []
    for level in levels:
        total = np.add.reduceat(ordered, level[:-1], axis=0)
        count = np.diff(level)
        away = ordered - np.repeat(total / count[:, None], count, axis=0)
        sums.append(total)
        radii.append(np.sqrt(np.maximum.reduceat((away * away).sum(axis=1), level[:-1])))
    return order, np.concatenate(sums), np.concatenate(radii)


def assign(points: np.ndarray, sums: np.ndarray, radii: np.ndarray, centroids: np.ndarray):
    """Yields (start, stop, cluster, sum) of balls assigned whole and (places, clusters) of the vectors of other leaves."""
    levels = bounds(len(points))
    squares = (centroids * centroids).sum(axis=1)
    centres = centroids.astype(np.float64)
    nodes, near, first = np.array([0]), np.ones((1, len(centroids)), bool), 0
    for depth, level in enumerate(levels):
        counts = np.diff(level)
        middle = sums[first + nodes] / counts[nodes][:, None]
        far = (middle * middle).sum(axis=1)[:, None] - 2 * middle @ centres.T + squares
        far = np.where(near, np.sqrt(np.maximum(far, 0.0)), np.inf)
        reach = far.min(axis=1) + 2 * radii[first + nodes]
        near = far <= (reach * (1 + SLACK) + SLACK * (1 + np.sqrt(squares.max())))[:, None]
        whole = near.sum(axis=1) == 1
        for node, cluster in zip(nodes[whole], np.argmax(near[whole], axis=1), strict=True):
            yield level[node], level[node + 1], int(cluster), sums[first + node]
        nodes, near, first = nodes[~whole], near[~whole], first + len(counts)
        if depth < len(levels) - 1:
            nodes, near = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel(), np.repeat(near, 2, axis=0)
        if not len(nodes):
            return
    places = np.concatenate([np.arange(levels[-1][i], levels[-1][i + 1]) for i in nodes])
    near = np.repeat(near, np.diff(levels[-1])[nodes], axis=0)
    distances = squares - 2 * inner_products(points[places], centroids)  # but for the vector's own square
    yield places, np.argmin(np.where(near, distances, np.iinfo(np.int64).max), axis=1)


def trees(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """vec_ids, points, sums and radii of each block of vectors (vec_id, v), written."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator):
        import pyarrow as pa

        ids, rows = [], np.empty((0, dims), np.int64)

        def packed(last: bool):
            nonlocal ids, rows
            while len(rows) >= BLOCK or (last and len(rows)):
                order, sums, radii = build(rows[:BLOCK])
                points = rows[:BLOCK][order]
                own = pa.array([[ids[i].as_py() for i in order]], pa.list_(of))
                yield pa.RecordBatch.from_arrays(
                    [own, *[pa.array([x.tobytes()], pa.binary()) for x in (points, sums, radii)]],
                    names=["vec_ids", "points", "sums", "radii"],
                )
                ids, rows = ids[BLOCK:], rows[BLOCK:]

        for batch in batches:
            of = batch.column("vec_id").type
            ids += list(batch.column("vec_id"))
            rows = np.concatenate([rows, batch.column("v").flatten().to_numpy().reshape(-1, dims)])
            yield from packed(False)
        yield from packed(True)

    return stored(vectors.mapInArrow(run, f"vec_ids array<{kind}>, points binary, sums binary, radii binary"))


def _unpacked(batch, dims: int):
    for points, sums, radii in zip(*[batch.column(c) for c in ("points", "sums", "radii")], strict=True):
        yield (
            np.frombuffer(points.as_py(), np.int64).reshape(-1, dims), np.frombuffer(sums.as_py(), np.int64).reshape(-1, dims),
            np.frombuffer(radii.as_py(), np.float64),
        )


def moved(found: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floor of the mean of their vectors; those without any stay."""
    k, dims = centroids.shape

    def run(batches: Iterator):
        import pyarrow as pa

        counts, totals = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for points, sums, radii in _unpacked(batch, dims):
                for part in assign(points, sums, radii, centroids):
                    if len(part) == 4:
                        counts[part[2]] += part[1] - part[0]
                        totals[part[2]] += part[3]
                    else:
                        counts += np.bincount(part[1], minlength=k)
                        np.add.at(totals, part[1], points[part[0]])
        used = np.flatnonzero(counts)
        cells = [np.repeat(used, dims), np.tile(np.arange(dims), len(used)), totals[used].ravel(), np.repeat(counts[used], dims)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cells], names=["cluster", "i", "total", "n"])

    parts = found.mapInArrow(run, "cluster long, i long, total long, n long").groupBy("cluster", "i")
    after = centroids.copy()
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    for r in parts.agg(exact("total").alias("total"), exact("n").alias("n")).collect():  # k * dims rows at most
        after[r["cluster"], r["i"]] = int(r["total"]) // int(r["n"])
    return after


def first_centroids(vectors: DataFrame, k: int, dims: int) -> np.ndarray:
    """The k vectors whose salted vec_id has the smallest hash."""
    rank = F.sha2(F.concat(F.lit(f"{SALT}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(rank.alias("rank"), "v").orderBy(F.col("rank").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, dims)


def cluster(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector that takes part."""
    vectors = table.select("vec_id", integers(F.col("embedding")).alias("v")).where(F.size("v") == dims)
    centroids = first_centroids(vectors, k, dims)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return table.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    found = trees(vectors, dims)
    for _ in range(rounds):
        centroids = moved(found, centroids)

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for ids, (points, sums, radii) in zip(batch.column("vec_ids"), _unpacked(batch, dims), strict=True):
                clusters = np.empty(len(points), np.int32)
                for part in assign(points, sums, radii, centroids):
                    if len(part) == 4:
                        clusters[part[0] : part[1]] = part[2]
                    else:
                        clusters[part[0]] = part[1]
                away = points - centroids[clusters]
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(clusters), pa.array((away * away).sum(axis=1))], names=["vec_id", "cluster", "distance"]
                )

    assigned = stored(found.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"))
    sums = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # k rows at most
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(j, sums.get(j, 0), sum(sums.values()), digest(c)) for j, c in enumerate(centroids)]
    named = table.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
