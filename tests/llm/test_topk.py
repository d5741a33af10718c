"""Exact top-k search against all inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from medialens.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=5, every=50):
    kept = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, (q, v) in enumerate(kept):
        if q is not None and q % every == 0:
            found = [(-sum(x * y for x, y in zip(v, w, strict=False)), i is None, i or 0) for b, (i, w) in enumerate(kept) if a != b]
            out += [(q, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()), key=repr)


def vectors(rng, n, size=16):
    """Clusters, opposite vectors, copies, and one vector that a third of all rows share."""
    centers = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    hot, rows = centers[0], []
    for i in range(n):
        c = rng.choice(centers)
        v = hot if rng.random() < 0.33 else [x + rng.gauss(0, 0.2) for x in c] if rng.random() < 0.8 else [-x for x in c]
        rows.append((i, [round(x, 2) for x in v]))
    return rows


@pytest.mark.parametrize(("n", "chunk"), [(3, 4096), (700, 4096), (1500, 60)])
def test_search_against_all_products(spark, monkeypatch, n, chunk):
    monkeypatch.setattr(topk, "CHUNK_ROWS", chunk)
    rows = vectors(random.Random(n), n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(topk.search(df)) == brute(rows)
    assert got(topk.search(df, k=2, every=7)) == brute(rows, 2, 7)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK_ROWS", 4)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (0, [-1.0, 3.0]), (50, None), (50, []), (100, [nan, 1.0]), (1, [inf, 1.0]), (2, [None, 1.0]), (None, [1.0, 0.5]), (None, [9.0, 9.0]), (3, [2.0]), (4, [1.0, 0.5]), (4, [1.0, 0.5]), (-50, [0.001, -0.001, 3.0]), (6, [1000.0, 2000.0, -30000.0]), (150, [30000.0, 30000.0, 30000.0])]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("id", "v", "table", "chunk", "bar", "a.b", "QUERY_ID")])
    assert got(topk.search(df)) == brute(rows)
    assert topk.search(df.limit(0)).count() == 0
    assert topk.search(df.filter("vec_id = 3")).count() == 0


def test_bounds_spare_candidates_and_stop():
    """On clusters most rows are never evaluated; the result is that of all products."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 32)) * 200
    rows = np.floor(np.repeat(centers, 100, 0) + rng.normal(size=(2000, 32)) * 10).astype(np.int64)
    pivots = topk.choose_pivots(rows.astype(np.float64))
    import pyarrow as pa

    chunk = topk.Chunk(pa.array(range(2000)), np.arange(2000), rows, topk._distances(rows.astype(np.float64), pivots))
    seen, plain = [], topk.scores
    try:
        topk.scores = lambda part, *a: (seen.append(len(part)), plain(part, *a))[1]
        for q in range(0, 2000, 50):
            want = sorted(((-int(rows[q] @ r), i) for i, r in enumerate(rows) if i != q))[:5]
            assert [(-s, i) for i, s in chunk.best(rows[q], chunk.table[q], q, 5, None)] == want
    finally:
        topk.scores = plain
    assert sum(seen) < 0.2 * 40 * 2000


def test_sums_beyond_exact_floats_are_exact():
    rows = np.array([[2**27, 1], [2**27, 2], [2**27 - 1, 2**27]], np.int64)
    assert topk.scores(rows, rows[1], False).tolist() == [2**54 + 2, 2**54 + 4, 2**54 - 2**27 + 2**28]
