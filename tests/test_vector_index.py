"""The index of centroids against the full product."""

import numpy as np
import pytest

from medialens.operators import clusters, vector_index


def units_of(spark, rows):
    return clusters.unit_vectors(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, v array<double>"), "id", "v")


def clustered(n, groups, size=24, seed=0, spread=0.12):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, size))
    return np.round(centers[rng.integers(groups, size=n)] / np.sqrt(size) + rng.normal(size=(n, size)) * spread, 4)


def edge_set(df):
    return {(r.src, r.dst): r.similarity for r in df.collect()}


@pytest.mark.parametrize("block", [40, 4096])
def test_recall_one_is_the_full_product(spark, block):
    rows = clustered(600, 12)
    rows[200:400] = rows[0]  # a third of all rows are one vector
    units = units_of(spark, [*rows, np.zeros(24)])
    want, got = edge_set(clusters.knn_edges(units, 5, 0.7)), edge_set(vector_index.knn_edges(units, 5, 0.7, recall=1.0, block=block))
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in want)


@pytest.mark.parametrize(("groups", "spread"), [(60, 0.12), (1, 1.0)])
def test_measured_recall_and_fewer_pairs(spark, groups, spread):
    """Also of vectors without any clusters, where the sample asks for more lists."""
    rows = clustered(4000, groups, seed=3, spread=spread)
    units = units_of(spark, rows).cache()
    index = vector_index.build(units, 10, 0.5, recall=0.95)
    want, got = edge_set(clusters.knn_edges(units, 10, 0.5)), edge_set(vector_index.knn_edges(units, 10, 0.5, index=index))
    assert len(want) > 1000 and len(want.keys() & got.keys()) >= 0.9 * len(want)
    assert all(abs(got[e] - want[e]) < 1e-9 for e in want.keys() & got.keys())
    if groups > 1:
        assert vector_index.compared_pairs(index, 0.5) < 0.1 * 4000**2


def test_candidates_grow_slower_than_the_square(spark):
    shares = []
    for n in (1000, 8000):
        units = units_of(spark, clustered(n, 60, seed=5, spread=0.2))
        shares.append(vector_index.compared_pairs(vector_index.build(units, 10, 0.6), 0.6) / n**2)
    assert shares[1] < 0.7 * shares[0] and shares[1] < 0.1, shares


def test_edges(spark):
    units = units_of(spark, [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    assert edge_set(vector_index.knn_edges(units, 3, 0.5)).keys() == {(0, 1), (1, 0)}
    assert vector_index.knn_edges(units.limit(0), 3, 0.5).count() == 0
    assert edge_set(vector_index.knn_edges(units.filter("id = 2"), 3, 0.5)) == {}
    with pytest.raises(ValueError, match="needs k"):
        vector_index.knn_edges(units, 0, 0.5)


def test_an_entry_asks_once_for_each_bundle_of_lists(spark):
    """Vectors without clusters look into most lists."""
    index = vector_index.build(units_of(spark, clustered(2000, 1, seed=7, spread=1.0)), 5, 0.3, recall=1.0)
    assert vector_index.compared_pairs(index, 0.3) > 20 * 2000
    assert vector_index._met(index, 0.3, 4096).filter("asks").count() <= 2000
    assert vector_index._met(index, 0.3, 100).filter("asks").count() <= 2000 * 2 * 10
