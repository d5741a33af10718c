"""Pairs are asked for where they are shown, and each pair is told once in each direction."""

from medialens.operators import near_duplicates as nd
from medialens.plans import views


def test_a_page_asks_for_its_own_pairs_only(spark, sf_dir, monkeypatch):
    asked = []
    monkeypatch.setattr(views, "hamming_pairs", lambda *args, **more: asked.append(more["delta"].count()) or nd.hamming_pairs(*args, **more))
    assert views.page(spark, sf_dir).count() == 24 and asked == [24]


def test_neighbours_of_unique_pairs_are_not_shuffled(spark):
    pairs = spark.createDataFrame([("a", "b", 1), ("c", "a", 2)], "anchor_id string, duplicate_id string, distance int")
    got = nd.neighbours(pairs, unique=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, nd.neighbours(pairs).collect())) == [("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("c", "a", 2)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
