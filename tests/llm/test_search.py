"""Clustering, exact top-k and lexical search against plain versions, on ordinary, tied and odd rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import balltree, lexical, topk

VECTORS = "vec_id long, embedding array<float>, label int"
INF, NAN = float("inf"), float("nan")


def vectors(spark, rows, parts=3):
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(parts)
    return frame.withColumns({c: F.lit("clash") for c in ("v", "length", "dims", "points", "cluster", "score", "rank", "query_id", "n")})


def floors(v, scale=256):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * float(np.float32(x))) for x in v]


def made(seed, n, dims, kind="normal"):
    """Vectors of few clusters, of many lengths, or with a third of equal ones."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)) * 0.3
    if kind == "clusters":
        v = rng.normal(size=(6, dims))[rng.integers(0, 6, n)] + 0.02 * v
    if kind == "lengths":
        v *= np.exp(rng.normal(size=(n, 1)) * 2)
    if kind == "hot":
        v[rng.random(n) < 0.4] = v[0]
    return [(int(i), [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]


# 11


def lloyd(rows, k, rounds, dims):
    kept = [(i, w) for i, v in rows if v is not None and len(v) == dims and (w := floors(v)) is not None]
    start = sorted(kept, key=lambda r: hashlib.sha256(f"2:{r[0]}".encode()).hexdigest())[:k]
    centroids = [list(w) for _, w in start]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda w: min(range(len(centroids)), key=lambda j: (apart(w, centroids[j]), j))
    for _ in range(rounds):
        groups = {}
        for _, w in kept:
            groups.setdefault(near(w), []).append(w)
        for j, own in groups.items():
            centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, j := near(w), apart(w, centroids[j])) for i, w in kept]
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, j, d in found)


@pytest.mark.parametrize("kind", ["normal", "clusters", "hot"])
def test_clusters_by_brute_force(spark, kind):
    rows = made(3, 500, 6, kind)
    found = balltree.cluster(vectors(spark, rows), 9, 5, 6)
    assert sorted(tuple(r) for r in found.collect()) == lloyd(rows, 9, 5, 6)


def test_balls_are_assigned_whole():
    """Tight groups need few exact comparisons: whole balls go to one centroid."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-400, 400, (4, 8))
    points = np.repeat(centres, 200, axis=0) + rng.integers(-3, 4, (800, 8))
    order, sums, radii = balltree.build(points)
    ordered, whole, clusters = points[order], 0, np.full(800, -1)
    for part in balltree.assign(ordered, sums, radii, centres):
        if len(part) == 4:
            assert (ordered[part[0] : part[1]].sum(axis=0) == part[3]).all()
            clusters[part[0] : part[1]] = part[2]
            whole += part[1] - part[0]
        else:
            clusters[part[0]] = part[1]
    exact = ((ordered[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    assert (clusters == exact).all() and whole == 800


def test_clusters_of_odd_rows(spark):
    rows = [
        (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [1.0]), (5, [1.0, 2.0, 3.0]), (6, [NAN, 1.0]), (7, [1.0, INF]),
        (8, [1.0, None]), (9, []), (10, [-0.001, 100000.0]), (11, [-3.0, 7.0]),
    ]
    found = balltree.cluster(vectors(spark, rows), 40, 5, 2).collect()
    assert sorted(tuple(r) for r in found) == lloyd(rows, 40, 5, 2)
    assert sorted(r.vec_id for r in found) == [1, 2, 2, 10, 11]
    with_null = balltree.cluster(vectors(spark, [*rows, (None, [0.5, 0.5])]), 2, 1, 2).collect()
    assert sorted(str(r.vec_id) for r in with_null) == ["1", "10", "11", "2", "2", "None"]
    assert balltree.cluster(vectors(spark, rows[3:4])).count() == 0


# 12


def scanned(rows, k, every):
    own = [(i, w) for i, v in rows if (w := floors(v)) is not None]
    asked = {}
    for i, w in own:
        if i is not None and i % every == 0:
            asked[i] = min(asked.get(i, w), w)
    result = []
    for q, a in asked.items():
        scores = [(-sum(x * y for x, y in zip(a, w, strict=False)), i is None, i or 0, i) for i, w in own if i != q]
        result += [(q, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return result


def same(found, expected):
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, expected))


@pytest.mark.parametrize("kind", ["normal", "clusters", "lengths", "hot"])
def test_top_k_by_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BUCKET", 64)
    monkeypatch.setattr(topk, "HEAD", 50)
    rows = made(7, 900, 5, kind)
    same(topk.nearest(vectors(spark, rows), 5, 9).collect(), scanned(rows, 5, 9))


def test_top_k_in_rounds(spark):
    rows = made(8, 120, 4)
    frame = vectors(spark, rows).select(F.col("vec_id"), balltree.integers(F.col("embedding")).alias("v"))
    found = topk.top_k(frame, frame.where("vec_id % 3 = 0"), 4, query_bytes=200).collect()
    same(found, scanned(rows, 4, 3))


def test_top_k_of_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (50, [0.0, 0.0]), (50, [0.0, 1.0]), (100, [-1.0, -1.0]), (100, [-1.0, -1.0]), (1, [3.0]), (2, []), (3, None),
        (4, [NAN, 1.0]), (5, [INF, 0.0]), (6, [None, 1.0]), (None, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0, 9.0]), (150, []), (200, None),
    ]
    same(topk.nearest(vectors(spark, rows, 4)).collect(), scanned(rows, 5, 50))
    same(topk.nearest(vectors(spark, rows[:2], 1)).collect(), [(0, 1, 50, 0), (50, 1, 0, 0)])
    assert topk.nearest(vectors(spark, rows[7:9], 1)).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_intervals_lose_nothing(monkeypatch, seed):
    """Every pruning on its own, whether it pays or not."""
    monkeypatch.setattr(topk, "PAYS", (0.0, 0.3, 1.0)[seed % 3])
    rng = np.random.default_rng(seed)
    n, dims = int(rng.integers(1, 300)), int(rng.integers(1, 7))
    points = rng.integers(-200, 200, (n, dims)) * rng.integers(0, 3, (n, 1))
    points = points[rng.integers(0, n, n)] if seed % 2 else points
    ids = rng.permutation(n)
    best = topk.Best(n, 5)
    for s in range(0, n, 32):
        topk.search(topk.Bucket(ids[s : s + 32], points[s : s + 32]), ids, points, best)
    for i in range(n):
        expected = sorted((-int(p @ points[i]), int(j)) for p, j in zip(points, ids, strict=True) if j != ids[i])[:5]
        assert [(-int(a), int(b)) for a, b in zip(best.scores[i], best.ids[i], strict=True)][: len(expected)] == expected


# 13


def ranking(docs, items, k):
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: pattern.findall((t or "").translate(lower))
    own = [(i, w) for i, t in docs if (w := words(t))]
    n, length = len(own), sum(len(w) for _, w in own)
    df = Counter(t for _, w in own for t in set(w))
    result = []
    for item, text in items:
        scores = []
        for i, w in own:
            m, tf = 100 - 25 + (25 * len(w) * n) // length, Counter(w)
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m))
                for t in words(text) if t in tf
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        result += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return result


def searched(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    d = d.withColumns({c: F.lit("clash") for c in ("n", "terms", "tf", "item", "item_id", "rank", "score", "part")})
    i = spark.createDataFrame(items, "item_id string, text string").withColumn("doc_id", F.lit("clash"))
    return lexical.search(d, i, **more).collect()


def texts(seed, n, words=40):
    rng = np.random.default_rng(seed)
    word = lambda: f"W{min(int(rng.zipf(1.3)), 400)}"
    return [" ".join(word() for _ in range(int(rng.integers(0, words)))) for _ in range(n)]


@pytest.mark.parametrize("most", [1_000_000, 30])
def test_search_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(lexical, "BLOCK", 50)
    docs = list(enumerate(texts(1, 400)))
    docs += [(1000 + i, docs[5][1]) for i in range(60)]  # ties beyond k
    items = [(f"i{i}", t) for i, t in enumerate(texts(2, 12))]
    same(searched(spark, docs, items, most=most), ranking(docs, items, 20))


def test_search_of_odd_rows(spark):
    long = "needle " * 40_000 + "hay " * 90_000
    docs = [
        (1, None), (2, ""), (3, " \n-"), (4, "Needle é É 5"), (4, "Needle é É 5"), (None, "needle"), (5, "NEEDLEİ x_y z"), (6, long), (7, "needle"), (7, "needle"),
    ]
    items = [("a", "needle needle É"), ("a", "x y-z"), (None, "5"), ("b", None), ("c", "?!"), ("d", "absent")]
    same(searched(spark, docs, items), ranking(docs, items, 20))
    assert searched(spark, docs, []) == [] and searched(spark, [], items) == []
