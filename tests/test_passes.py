"""Edges of composite views and passes; their rows are held against SQL with the other queries."""

import pytest
from pyspark.sql import functions as F

from medialens.functions.frames import SMALL
from medialens.operators import clusters, passes, serving

ASSIGNMENTS = "image_id string, label_key string, level string, display_name string, score double, source string, created_at bigint"


def test_a_page_without_labels_and_with_ties(spark):
    page = spark.createDataFrame([("a",), ("b",)], "image_id string")
    rows = [("a", "scene.food", "scene", "Food", None, "c", 1), ("a", "scene.document", "scene", "Doc", None, "c", 1), ("a", "attr.has_text", "attribute", "t", 1.0, "c", 1)] + [("a", f"object.o{k}", "object", f"o{k}", 0.5, "c", 1) for k in range(9)]
    out = {r.image_id: r for r in serving.enriched_page(page, spark.createDataFrame(rows, ASSIGNMENTS), spark.createDataFrame([("b", "z")], "anchor_id string, duplicate_id string")).collect()}
    assert (out["a"].scene_type, out["a"].has_text, out["a"].has_person, out["a"].is_duplicate) == ("document", True, False, False)
    assert [o.display_name for o in out["a"].objects] == ["o0", "o1", "o2", "o3"] and out["a"].clusters == []
    assert (out["b"].scene_type, out["b"].has_text, out["b"].is_duplicate, out["b"].objects) == (None, False, True, [])


def test_details_of_bare_and_unknown_images(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    images = spark.createDataFrame([("a", "/x/y.jpg", "active", None, None)], "image_id string, primary_path string, status string, gps_latitude double, gps_longitude double")
    pairs = spark.createDataFrame([("a", "b", 3), ("b", "a", 2), ("gone", "a", 1)], "anchor_id string, duplicate_id string, distance int")
    both = images.unionByName(images.withColumn("image_id", F.lit("b")))
    boxes = "image_id string, idx int, x_min double, y_min double, x_max double, y_max double, score double, raw_label string, detector string"
    regions = spark.createDataFrame([("a", 1, 0.0, 0.0, 1.0, 1.0, 0.5, None, "d")], boxes)
    labels = none("image_id string, idx int, level string, display_name string, label_key string, score double")
    out = serving.image_details(spark.createDataFrame([("a",), ("a",), ("nope",)], "image_id string"), both, none(ASSIGNMENTS), none("image_id string, caption string, model_name string"), pairs, regions, labels, none("image_id string, payload string")).collect()
    assert len(out) == 1
    (row,) = out
    assert (row.logical_name, row.scene, row.object_labels, row.cluster_labels, row.caption) == ("y.jpg", None, [], [], None)
    assert [(n.other_id, n.distance, n.role) for n in row.near_duplicates] == [("b", 2, "duplicate")]
    assert [(r.idx, r.raw_label, r.object_labels, round(r.priority, 6)) for r in row.regions] == [(1, "(raw)", [], 0.5)]


@pytest.mark.parametrize("small", [0, SMALL])
def test_details_broadcast_few_wanted_ids_and_nothing_else(spark, monkeypatch, small):
    monkeypatch.setattr(serving, "SMALL", small, raising=False)
    some = lambda rows, schema: spark.createDataFrame(rows, schema)
    images = some([(k, f"/x/{k}.jpg", "active", None, None) for k in "abc"], "image_id string, primary_path string, status string, gps_latitude double, gps_longitude double")
    labels = some([("a", "scene.food", "scene", "Food", 0.9, "c", 1), ("a", "attr.has_text", "attribute", "t", 1.0, "c", 1), ("a", "object.o", "object", "o", 0.5, "c", 1), ("a", "cluster.m", "cluster", "m", 0.4, "c", 1), ("c", "object.o", "object", "o", 0.5, "c", 1)], ASSIGNMENTS)
    captions = some([("a", "said", "blip"), ("c", "unsaid", "blip")], "image_id string, caption string, model_name string")
    pairs = some([("a", "b", 3), ("c", "b", 1)], "anchor_id string, duplicate_id string, distance int")
    regions = some([("a", 0, 0.0, 0.0, 1.0, 1.0, 0.5, None, "d")], "image_id string, idx int, x_min double, y_min double, x_max double, y_max double, score double, raw_label string, detector string")
    told = some([("a", 0, "object", "O", "object.o", 0.5), ("a", 0, "cluster", "C", "cluster.m", 0.4)], "image_id string, idx int, level string, display_name string, label_key string, score double")
    out = serving.image_details(some([("a",), ("b",)], "image_id string"), images, labels, captions, pairs, regions, told, some([("a", '{"gps":{"latitude":1,"longitude":2}}')], "image_id string, payload string"))
    a, b = sorted(out.collect(), key=lambda r: r.image_id)
    assert (a.gps_latitude, a.scene.scene_type, a.scene.has_text, a.caption, [x.display_name for x in a.object_labels + a.cluster_labels]) == (1.0, "food", True, "said", ["o", "m"])
    assert [(x.raw_label, x.object_labels[0].display_name, x.cluster_labels[0].display_name) for x in a.regions] == [("(raw)", "O", "C")] and [x.other_id for x in a.near_duplicates] == ["b"]
    assert (b.scene, b.caption, b.regions, [(x.other_id, x.distance) for x in b.near_duplicates]) == (None, None, [], [("c", 1), ("a", 3)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("== Initial Plan ==")[0].splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert all("LeftSemi" in line for line in joins) and bool(joins) == (small > 0)


def test_a_method_is_reset_without_the_others(spark):
    vectors = spark.createDataFrame([(f"i{k}#{j}", [1.0, k / 10, j / 50]) for k in range(3) for j in range(3)], "id string, v array<double>")
    units = clusters.unit_vectors(vectors, "id", "v")
    made = {m: passes.cluster_pass(units, m, t, "v1", 5, 0.9, 3, recall=1.0) for m, t in (("one", "image"), ("two", "region"))}
    tables = {t: made["one"][t].unionByName(made["two"][t]).cache() for t in made["one"]}
    assert {r.target_type for r in tables["assignments"].collect()} == {"image", "region"} and made["two"]["assignments"].filter("target_type = 'image'").count() == 3
    left = passes.without_method(tables, "one")
    for t in tables:
        assert left[t].columns == tables[t].columns
        assert sorted(left[t].collect(), key=str) == sorted(made["two"][t].select(*tables[t].columns).collect(), key=str), t


def test_too_few_vectors_make_no_clusters(spark):
    units = clusters.unit_vectors(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, v array<double>"), "id", "v")
    made = passes.cluster_pass(units, "m", "image", "v1")
    assert all(made[t].count() == 0 for t in made)
    assert all(t.count() == 0 for t in passes.cluster_pass(units.limit(0), "m", "region", "v1").values())


@pytest.mark.parametrize(("allowed", "want"), [((), {"a", "b"}), (("scene.food",), {"a"}), (("scene.nowhere",), set())])
def test_object_head_gate(spark, allowed, want):
    images = spark.createDataFrame([("a", [1.0]), ("b", [1.0]), ("c", [-9.0])], "image_id string, v array<double>")
    head = spark.createDataFrame([("object.x", [1.0], 0.0), ("object.unknown", [2.0], 0.0)], "label_key string, weights array<double>, bias double")
    scenes = spark.createDataFrame([("a", "scene.food", 0.9), ("a", "scene.people", 0.1), ("b", "scene.people", 0.5)], "image_id string, label_key string, score double")
    out = passes.object_head(images, head, scenes, spark.createDataFrame([("object.x",)], "label_key string"), allowed).collect()
    assert {r.target_id for r in out} == want and all(r.extra.startswith('{"head_rank":1,') for r in out)
