"""Pairs of hashes in tiles, against the product of all with all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from medialens.operators import near_duplicates as nd
from medialens.operators.graph import connected_components


def hashes(spark, n=300, copies=40):
    r = np.random.default_rng(3)
    bits = r.integers(-(1 << 63), (1 << 63) - 1, n, np.int64)
    bits[: n // 3] = bits[0] ^ (1 << r.integers(0, 62, n // 3))  # near each other
    bits[-copies:] = -1
    rows = [(f"{i:04d}", int(b), int(i % 7) if i % 11 else None) for i, b in enumerate(bits)] + [("none", None, 1), ("0003", int(bits[3]), 3)]
    return spark.createDataFrame(rows, "image_id string, bits long, mtime long")


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 64)
    monkeypatch.setattr(nd, "TESTED", 500)
    monkeypatch.setattr(nd, "HANDED", 100)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("distance", [3, 22])
def test_tiles_find_every_pair_once(spark, small_blocks, distance):
    df = hashes(spark)
    want = rows(nd.hamming_pairs(df, distance))
    assert len(want) > 5000 and rows(nd.hamming_pairs(df, distance, small=0)) == want


def test_tiles_join_no_hashes_by_key(spark, small_blocks):
    plan = nd.hamming_pairs(hashes(spark), 18, small=0)._jdf.queryExecution().toString()
    assert "Join" not in plan and "FlatMapGroupsInArrow" in plan


def test_tiles_of_a_change(spark, small_blocks):
    df = hashes(spark)
    dirty = df.filter("image_id < '0110' OR image_id > '0270'").select("image_id")
    touched = {r.image_id for r in dirty.collect()}
    want = [p for p in rows(nd.hamming_pairs(df, 4)) if p[0] in touched or p[1] in touched]
    assert rows(nd.hamming_pairs(df, 4, dirty, small=0)) == want


def test_trees_of_tiles_connect_what_the_pairs_connect(spark, small_blocks):
    df = hashes(spark)
    of = lambda e: rows(connected_components(e, "anchor_id", "duplicate_id"))
    edges = nd.group_edges(df, 3, small=0)
    assert of(edges) == of(nd.hamming_pairs(df, 3)) and edges.count() < 1500 < nd.hamming_pairs(df, 3).count()
    assert nd.group_edges(df.limit(0), 3, small=-1).count() == 0 == nd.hamming_pairs(df.limit(0), 3, small=-1).count()


def test_images_without_an_id_link_nothing(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 3, 1), ("a", 2, 1), ("b", 6, 1)], "image_id string, bits long, mtime long")
    assert rows(nd.group_edges(df, 1, small=0)) == [("a", "b")] and rows(nd.hamming_pairs(df, 1, small=0)) == [("a", "b", 1)]


def test_a_table_of_thousands_meets_in_tiles(spark):
    """Row by row, the pairs of 50,000 hashes took one task a minute."""
    df = spark.range(5000).select(F.col("id").cast("string").alias("image_id"), F.xxhash64("id").alias("bits"), F.col("id").alias("mtime"))
    assert "NestedLoop" not in nd.hamming_pairs(df, 12)._jdf.queryExecution().toString()
    plan = nd.group_edges(df, 12)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "FlatMapGroupsInArrow" in plan
    assert rows(nd.hamming_pairs(df, 14)) == rows(nd.hamming_pairs(df, 14, small=5000))


def test_pairs_after_a_change_meet_their_images_once_a_side(spark):
    images = spark.createDataFrame([(c, b, 1) for c, b in zip("abcde", (0, 1, 3, 7, 1 << 40))], "image_id string, bits long, mtime long")
    old = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "gone", 1), (None, "a", 1), ("b", "c", 1)], "anchor_id string, duplicate_id string, distance int")
    found = nd.incremental_pairs(old, images, images.filter("image_id = 'c'"), 2)
    assert rows(found) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("c", "d", 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti, (anchor_id" not in plan and "LeftAnti, (duplicate_id" not in plan
