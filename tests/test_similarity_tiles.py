"""The similarity matrix in tiles, against the full product."""

import numpy as np
import pytest

from medialens.operators import clusters


def vectors(n=260, copies=30, seed=5):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, 16))
    v[-copies:] = v[0]
    return v / np.linalg.norm(v, axis=1)[:, None]


def want_of(v, k, threshold):
    s = np.round(v @ v.T, 12)
    return {(f"{i:04d}", f"{j:04d}") for i in range(len(v)) for j in [j for j in sorted(range(len(v)), key=lambda j: (-s[i, j], j)) if j != i and s[i, j] >= threshold][: k if k > 0 else None]}


@pytest.mark.parametrize("k,block,tile", [(5, 40, 32_768), (5, 4096, 30), (0, 7, 50), (40, 64, 100)])
def test_tiles_find_the_nearest_of_each(spark, monkeypatch, k, block, tile):
    monkeypatch.setattr(clusters, "TILE", tile)
    monkeypatch.setattr(clusters, "PENDING", 100)
    v = vectors()
    df = spark.createDataFrame([(f"{i:04d}", [float(x) for x in row]) for i, row in enumerate(v)], "id string, v array<double>")
    got = [(r.src, r.dst) for r in clusters.knn_edges(df, k, 0.3, block).collect()]
    assert len(got) == len(set(got)) and set(got) == want_of(v, k, 0.3)


def test_a_vector_is_sent_once_for_each_tile_not_for_each_block():
    assert clusters.sets_of(600_000, 200) == clusters.sets_of(600_000, 4096) == 19
    assert clusters.sets_of(2_000, 200) == 10 and clusters.sets_of(0, 200) == 1
