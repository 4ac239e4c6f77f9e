"""Exact search and vector near-duplicates against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridelta.llm import covertree, topk

SCHEMA = "vec_id long, embedding array<float>, label int, node string, query_id string"
ODD = [
    (900, None, 1),
    (901, [0.0] * 6, 1),
    (902, [float("nan")] * 6, 1),
    (903, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1),
    (None, [1.0] * 6, 1),
    (904, [1.0, 2.0], 1),
    (905, [2.0, 4.0], 1),
    (906, [], 1),
    (907, [1.0] * 6, None),
    (908, [float("inf")] * 6, 1),
]


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(0)
    points = draw.normal(size=(40, 6))[draw.integers(0, 40, 300)] + draw.normal(size=(300, 6)) * 0.15
    points[50:90] = points[50]
    return [(i, [float(np.float32(v)) for v in x], i % 3) for i, x in enumerate(points)] + ODD


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(5)


def finite(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def test_top_k(spark, rows, monkeypatch):
    monkeypatch.setattr(topk, "TILE_ROWS", 16)
    monkeypatch.setattr(topk, "TILE_QUERIES", 4)
    got = topk.top_k(table(spark, rows), F.col("vec_id") % 50 == 0, k=5).collect()
    good = [(i, [int(np.floor(256.0 * x)) for x in v]) for i, v, _ in rows if i is not None and finite(v)]
    want = set()
    for q, v in good:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
            want |= {(q, r, i, -s) for r, (s, i) in enumerate(scores[:5], 1)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    assert len(got) == len(want)


def test_large_components_are_exact():
    left, right = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [2.0**60, 0.0]])
    assert topk.product(left, right).tolist() == [[2**60 + 3, np.iinfo(np.int64).max]]


def test_top_k_of_nothing(spark):
    assert topk.top_k(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def brute(rows, cosine):
    n, links = len(rows), [0] * len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            (i, u, k), (j, v, m) = rows[a], rows[b]
            if None in (i, j, k, m) or k != m or not (finite(u) and finite(v)) or len(u) != len(v):
                continue
            if any(u) and any(v) and np.dot(u, v) / np.sqrt(np.dot(u, u)) / np.sqrt(np.dot(v, v)) >= cosine:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {rows[a][0]: (links[a], rows[find(a)][0]) for a in range(n)}


def test_cover_tree_components(spark, rows, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 40)
    got = covertree.near_duplicates(table(spark, rows)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows, 0.93)
    assert len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_far_cells_never_meet(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 20)
    monkeypatch.setattr(covertree, "DEALT", 50)
    draw = np.random.default_rng(5)
    points = draw.normal(size=(8, 16))[np.arange(400) % 8] + draw.normal(size=(400, 16)) * 0.05
    rows = [(i, [float(np.float32(v)) for v in x], i % 2) for i, x in enumerate(points)]
    rows += [(400 + i, [2.0 * v for v in x], k) for i, x, k in rows[:30]] + ODD
    vectors = table(spark, rows)
    got = covertree.near_duplicates(vectors).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows, 0.93)
    usable = vectors.where("vec_id < 430").groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    classes = usable.select(F.col("label").cast("long"), "embedding", "node", "copies")
    classes = classes.withColumn("class", F.xxhash64("label", "embedding")).withColumn("dim", F.size("embedding"))
    met = covertree.meetings(classes, 0.93).select("label", "block", "one", "two")
    blocks = {r.label: r.n for r in met.groupBy("label").agg(F.count_distinct("block").alias("n")).collect()}
    pairs = met.select("label", "one", "two").distinct().count()
    assert sum(blocks.values()) > 20 and pairs < 0.6 * sum(n * (n + 1) / 2 for n in blocks.values())


def test_cover_tree_of_nothing(spark):
    assert covertree.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("spread", [0.0, 0.01, 0.15, 1.0])
def test_dual_traversal(spread, monkeypatch):
    monkeypatch.setattr(covertree, "MOST_HELD", 50)
    draw = np.random.default_rng(1)
    x = draw.normal(size=(12, 8))[draw.integers(0, 12, 200)] + draw.normal(size=(200, 8)) * spread
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    copies = draw.integers(1, 4, len(x))
    order, nodes = covertree.build(x)
    for row in nodes:
        points = x[order[int(row[covertree.LOW]) : int(row[covertree.HIGH])]]
        assert np.sqrt(np.maximum(2 - 2 * points @ points[0], 0)).max() <= row[covertree.RADIUS] + 1e-6
    own = (x[order], nodes, copies[order])
    to_a, to_b, i, j = covertree.dual(own, own, 0.93)
    near = x[order] @ x[order].T >= 0.93
    assert (to_a == near @ copies[order]).all() and (to_b == copies[order] @ near).all()
    n = len(x)
    a, b = np.nonzero(near)
    assert (covertree._contracted(i, j + n, 2 * n) == covertree._contracted(a, b + n, 2 * n)).all()
