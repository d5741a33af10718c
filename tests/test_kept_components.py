"""Components kept between batches, against the full computation."""

import random

from medialens.operators.graph import connected_components
from medialens.operators.kept_components import KeptComponents


def frame(spark, pairs, columns="a long, b long"):
    return spark.createDataFrame(list(pairs) or [], columns)


def labels_of(df):
    return {tuple(r) for r in df.collect()}


def test_batches_with_deletions_equal_the_full_computation(spark, tmp_path):
    rng = random.Random(4)
    kept, edges = KeptComponents(spark, f"file://{tmp_path}/c", buckets=8), set()
    for batch in range(4):
        new = {tuple(sorted(rng.sample(range(120), 2))) for _ in range(35)}
        lost = set(rng.sample(range(120), 12)) if batch else set()
        gone = set(rng.sample(sorted(edges), 8)) if batch else set()
        edges = {e for e in (edges | new) - gone if not lost & set(e)}
        kept.apply(frame(spark, [(b, a) for a, b in new] + list(new)[:5] + [(None, 3)]), frame(spark, [(x,) for x in lost], "node long"), frame(spark, [(b, a) for a, b in gone]))
        assert labels_of(kept.labels()) == labels_of(connected_components(frame(spark, edges)))
        assert {tuple(r) for r in kept.edges_of(kept.labels().select("component").distinct()).collect()} == edges


def test_only_touched_components_are_computed_and_read(spark, tmp_path, monkeypatch):
    kept = KeptComponents(spark, f"file://{tmp_path}/c", buckets=32)
    chains = [(100 * c + i, 100 * c + i + 1) for c in range(40) for i in range(5)]
    assert kept.apply(frame(spark, chains)) == 0
    seen, whole = [], KeptComponents.edges_of

    def watched(self, components):
        out = whole(self, components)
        buckets = self._buckets_of(components, "component")
        plan = self._read("edges", buckets)._jdf.queryExecution().executedPlan().toString()
        seen.append((out.count(), buckets, plan.split("PartitionFilters: [")[1].split("]")[0]))
        return out

    monkeypatch.setattr(KeptComponents, "edges_of", watched)
    assert kept.apply(frame(spark, [(5, 100)])) == 2  # joins two chains
    assert kept.apply(removed_nodes=frame(spark, [(3,), (99999,)], "node long")) == 1  # splits the joined one
    assert [n for n, *_ in seen] == [10, 11]
    assert all(len(buckets) <= 2 and "bucket" in pruned for _, buckets, pruned in seen)
    got = dict(labels_of(kept.labels()))
    assert (got[0], got[2], got[4], got[105], got[205], 3 in got) == (0, 0, 4, 4, 200, False)


def test_edges(spark, tmp_path):
    kept = KeptComponents(spark, f"file://{tmp_path}/c", "string")
    assert kept.labels().count() == 0 and kept.apply() == 0 and kept.labels().count() == 0
    kept.apply(spark.createDataFrame([("x", "y"), ("y", "x"), ("z", "z")], "a string, b string"))
    assert labels_of(kept.labels()) == {("x", "x"), ("y", "x"), ("z", "z")}
    (tmp_path / "c" / "edges" / "batch=99999999-lost").mkdir()  # a writer ended before its batch counted
    assert kept.apply(removed_edges=spark.createDataFrame([("y", "x")], "a string, b string")) == 1
    assert labels_of(kept.labels()) == {("z", "z")}
    assert labels_of(kept.labels(spark.createDataFrame([("z",), ("q",)], "node string"))) == {("z", "z")}
