"""Sketched thresholds, samples around them, and facets under each other's filters, against plain Python."""

import random
from collections import defaultdict

import pytest

from medialens.operators import quantiles, serving

SCORES = "key string, item long, p double, truth boolean"


def rows_of(n, seed=3):
    rng = random.Random(seed)
    return [("hot" if i % 3 else "small" if i % 30 else None, i, round(rng.random() ** 2, 4), rng.random() < 0.4) for i in range(n)]


def test_thresholds_are_within_the_rank_error_and_counts_are_exact(spark):
    rows = rows_of(20_000) + [("hot", -1, None, True), ("hot", -2, float("nan"), False), ("hot", -3, 0.5, None)]
    df = spark.createDataFrame(rows, SCORES).repartition(6)
    out = quantiles.sketched_sweep(df, "key", "p", "truth", 11, size=256).collect()
    assert {r.key for r in out} == {"hot", "small"}
    for key in ("hot", "small"):
        mine = [(p, t) for k, _, p, t in rows if k == key and p is not None and p == p]
        picked = sorted((r for r in out if r.key == key), key=lambda r: r.threshold)
        assert len(picked) == 11
        for i, r in enumerate(picked):
            rank = sum(p <= r.threshold for p, _ in mine) / len(mine)
            assert abs(rank - i / 10) < 0.03
            tp, fp = sum(t is True and p >= r.threshold for p, t in mine), sum(t is False and p >= r.threshold for p, t in mine)
            assert (r.tp, r.fp, r.tp + r.fn) == (tp, fp, sum(t is True for _, t in mine))


def test_merged_sketches_and_few_rows_are_exact(spark):
    df = spark.createDataFrame(rows_of(900), SCORES).filter("key IS NOT NULL")
    parts = quantiles.sketches(df.filter("item < 300"), "key", "p").unionByName(quantiles.sketches(df.filter("item >= 300"), "key", "p"))
    merged = {r.key: r.thresholds for r in quantiles.thresholds(quantiles.merged(parts, "key"), "key", 5).collect()}
    for key, got in merged.items():
        mine = sorted(p for k, _, p, _ in rows_of(900) if k == key)
        assert got == [mine[max(0, -(-i * len(mine) // 4) - 1)] for i in range(5)]


def test_samples(spark):
    rows = rows_of(600) + [("hot", -1, None, True), ("hot", -2, 0.3, None)]
    cuts = spark.createDataFrame([("hot", 0.3), ("other", 0.1)], "key string, threshold double")
    got = {(r.kind, r["rank"]): r.item for r in quantiles.samples(spark.createDataFrame(rows, SCORES), "key", "item", "p", "truth", cuts, 7).collect()}
    mine = [(i, p, t) for k, i, p, t in rows if k == "hot" and p is not None and t is not None]
    want = {"borderline": sorted(mine, key=lambda r: (abs(r[1] - 0.3), r[0])), "false_positive": sorted((r for r in mine if not r[2] and r[1] >= 0.3), key=lambda r: (-r[1], r[0])), "false_negative": sorted((r for r in mine if r[2] and r[1] < 0.3), key=lambda r: (r[1], r[0]))}
    assert got == {(kind, k + 1): r[0] for kind, rows in want.items() for k, r in enumerate(rows[:7])}


def plain_facets(rows, filters):
    have = defaultdict(set)
    for image, facet, value in rows:
        if None not in (image, facet, value):
            have[image].add((facet, value))
    filters = {f: set(v) for f, v in filters.items() if v}
    fits = lambda labels, but: all(any(g == f and x in v for g, x in labels) for f, v in filters.items() if f != but)
    out, whole = defaultdict(set), {i for i, labels in have.items() if fits(labels, None)}
    for image, labels in have.items():
        for facet, value in labels:
            if fits(labels, facet):
                out[facet, value].add(image)
                out[facet, None].add(image)
    return {k: len(v) for k, v in out.items()} | {(None, None): len(whole)}


@pytest.mark.parametrize("filters", [{}, {"scene": ["s1"]}, {"scene": ["s1", "s2"], "size": ["big"]}, {"scene": ["s1"], "size": [], "tag": ["t0"]}, {"scene": ["nothing"]}, {"unknown": ["x"]}, {"scene": ["s1"], "unknown": ["x"]}])
def test_facets_under_the_other_filters(spark, filters):
    rng = random.Random(9)
    rows = [(i, f, v) for i in range(200) for f, v in {("scene", f"s{rng.randrange(4)}"), ("scene", f"s{rng.randrange(4)}"), ("size", rng.choice(["big", "small"])), ("tag", f"t{rng.randrange(3)}")}]
    rows += rows[:20] + [(None, "scene", "s1"), (1, None, "s1"), (1, "scene", None)]
    got = {(r.facet, r.value): r.n for r in serving.filtered_facets(spark.createDataFrame(rows, "image_id long, facet string, value string"), filters).collect()}
    want = plain_facets(rows, filters)
    assert got == want or got == {k: v for k, v in want.items() if k != (None, None)} and want[None, None] == 0


def test_facets_of_nothing(spark):
    assert serving.filtered_facets(spark.createDataFrame([], "image_id long, facet string, value string"), {"a": ["b"]}).collect() in ([], [(None, None, 0)])
