"""Operators on small hand-made inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from medialens.functions import geometry, hashing, metrics, text, vectors
from medialens.operators import clusters, evaluation, ingest, labeling, near_duplicates, regions, search, serving
from medialens.operators.graph import closure, connected_components
from medialens.sources import ground_truth, scan, snapshot
from medialens.streaming import arrivals


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_hashes(spark):
    assert one(spark, hashing.hamming(F.lit(0xA3F).cast("bigint"), F.lit(0xA0F).cast("bigint")), hashing.hamming_hex(F.lit("zz"), F.lit("0"))) == (2, 64)
    assert one(spark, hashing.hamming_hex(F.lit("ffffffffffffffff"), F.lit("0")))[0] == 64
    assert one(spark, hashing.hex64(hashing.from_hex64(F.lit("800000000000000f"))))[0] == "800000000000000f"
    df = spark.createDataFrame([(b"abc",), (None,)], "content binary")
    assert [r[0] for r in df.select(hashing.content_hash("content")).collect()] == ["44bc2cf5ad770999", None]
    assert one(spark, hashing.version_key(F.lit("m"), F.lit("h")), hashing.version_key(F.lit(""), F.lit("h"))) == ("m:h", "h")


def test_perceptual_hash_of_pixels(spark):
    rng = np.random.default_rng(0)
    image = rng.random(1024) * 255
    near = np.clip(image + rng.normal(0, 2, 1024), 0, 255)
    df = spark.createDataFrame([(image.tolist(),), (near.tolist(),), ([1.0],), (None,)], "p array<double>")
    a, b, bad, none = [r[0] for r in df.select(hashing.perceptual_hash("p")).collect()]
    assert bad is None and none is None and bin(int(a, 16)).count("1") == 32
    assert bin(int(a, 16) ^ int(b, 16)).count("1") <= 8


def test_texts(spark):
    assert one(spark, text.exif_datetime(F.lit("2024:01:31 10:20:30")), text.exif_datetime(F.lit("when"))) == ("2024-01-31T10:20:30", "when")
    assert one(spark, text.dms_to_degrees(F.lit(10.0), F.lit(30.0), F.lit(0.0), F.lit("s")))[0] == -10.5
    assert one(spark, text.camera_model(F.lit(" A "), F.lit("b")), text.camera_model(F.lit(None).cast("string"), F.lit(None).cast("string"))) == ("A b", None)
    assert one(spark, text.region_index(F.lit("x#7")), text.region_index(F.lit("x#y"))) == (7, 0)
    assert one(spark, text.is_true(F.lit(" YES ")), text.is_true(F.lit("2"))) == (True, False)


def test_metrics_and_vectors(spark):
    assert one(spark, metrics.logistic(F.lit(-800.0)), metrics.logistic(F.lit(800.0)), metrics.clamp01(F.lit(None).cast("double"))) == (0.0, 1.0, 0.0)
    assert one(spark, vectors.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))), vectors.l2_normalize(F.array(F.lit(0.0)))) == ([0.6, 0.8], None)
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 6.0])], "k string, v array<double>")
    assert {r.k: (r.m, r.n) for r in vectors.mean_by(df, ["k"], "v", "m").collect()} == {"a": ([2.0, 3.0], 2), "b": ([5.0, 6.0], 1)}


def test_graphs(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.component for r in connected_components(chain).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    tree = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None)], "n string, p string")
    assert {tuple(r) for r in closure(tree, "n", "p").collect()} == {("c", "b", 1), ("b", "a", 1), ("c", "a", 2)}


IMAGES = [("a", 0b0000, 5, 100, 100, 500), ("b", 0b0001, 5, 120, 90, 600), ("c", 0b0011, 9, 120, 90, 700), ("d", 1 << 62, 1, None, None, 1), ("e", None, 1, 1, 1, 1)]


def images(spark):
    return spark.createDataFrame(IMAGES, "image_id string, bits long, mtime long, width int, height int, size_bytes long")


@pytest.mark.parametrize("small,bands", [(50_000, 4), (0, 4), (0, 16)])
def test_hamming_pairs(spark, small, bands):
    got = {tuple(r) for r in near_duplicates.hamming_pairs(images(spark), 2 if bands == 4 else 1, small=small, bands=bands).collect()}
    want = {("a", "b", 1), ("c", "a", 2), ("c", "b", 1), ("a", "d", 1), ("b", "d", 2)}
    assert got == {w for w in want if w[2] <= (2 if bands == 4 else 1)}


def test_groups_and_changes(spark):
    pairs = near_duplicates.hamming_pairs(images(spark).filter("image_id <> 'd'"), 2)
    rows = {r.image_id: (r.group_id, r.is_canonical, r.distance) for r in near_duplicates.duplicate_groups(images(spark), pairs).collect()}
    assert rows == {"a": ("c", False, 2), "b": ("c", False, 1), "c": ("c", True, 0)}
    now = images(spark).filter("image_id <> 'b'").withColumn("bits", F.when(F.col("image_id") == "c", 1 << 62).otherwise(F.col("bits")))
    changed = near_duplicates.incremental_pairs(pairs, now, now.filter("image_id IN ('c', 'd')"), 2)
    assert {tuple(r) for r in changed.collect()} == {tuple(r) for r in near_duplicates.hamming_pairs(now, 2).collect()}
    assert near_duplicates.hamming_pairs(images(spark), 0).count() == near_duplicates.hamming_pairs(images(spark), 12).count()


def test_scene_gate(spark):
    protos = spark.createDataFrame([("laptop", [1.0, 0.0]), ("phone", [0.0, 1.0])], "label_key string, proto array<double>")
    allowed = labeling.allow_table(spark, protos, ["scene.food"], {"scene.screenshot": ["laptop"]})
    rows = spark.createDataFrame([("f", [2.0, 0.0], "scene.food"), ("s", [1.0, 0.0], "scene.screenshot"), ("o", [1.0, 0.0], "scene.other"), ("z", [0.0, 0.0], "scene.food")], "target_id string, v array<double>, scene_key string")
    got = {(r.target_id, r.label_key): round(r.margin, 6) for r in labeling.gate(labeling.ranked_labels(rows, protos, allowed), 0.3, 0.08).collect()}
    assert got == {("f", "laptop"): 1.0, ("s", "laptop"): 1.0}


@pytest.mark.parametrize("black,remap,want", [([], [("old", "new")], {"new"}), (["old"], [], set()), (["old"], [("old", "new")], set()), ([], [], {"old"})])
def test_blacklist_before_remap(spark, black, remap, want):
    rows = spark.createDataFrame([("r", "old", 1.0)], "target_id string, label_key string, similarity double")
    b = spark.createDataFrame([(x,) for x in black], "source_key string")
    m = spark.createDataFrame(remap, "source_key string, target_key string")
    assert {r.label_key for r in labeling.blacklist_and_remap(rows, b, m).collect()} == want


def test_rollup_counts_regions_once(spark):
    hits = spark.createDataFrame([("i", 0, "x", 0.9), ("i", 0, "x", 0.5), ("i", 1, "x", 0.1)], "image_id string, region_id int, label_key string, score double")
    assert labeling.rollup(hits, 0.3, 2).count() == 0
    assert [(r.score, r.n_regions) for r in labeling.rollup(hits, 0.3, 1).collect()] == [(0.9, 1)]


def test_propagation(spark):
    groups = spark.createDataFrame([("c", "c", True), ("c", "m", False)], "group_id string, image_id string, is_canonical boolean")
    rows = spark.createDataFrame([("c", "l", "a", 0.2, {"k": "v"}), ("c", "l", "b", 0.9, None), ("c", "l", "duplicate_propagated", 1.0, None), ("m", "own", "a", 1.0, None)], "image_id string, label_key string, source string, score double, extra map<string,string>")
    (r,) = labeling.propagate(rows, groups).collect()
    assert (r.image_id, r.label_key, r.score, json.loads(r.extra)) == ("m", "l", 0.9, {"duplicate_source_image_id": "c"})


def test_category_fallback_needs_both(spark):
    prompts = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "category string, proto array<double>")
    rows = spark.createDataFrame([("a", [1.0, 0.99]), ("b", [1.0, 0.0])], "image_id string, v array<double>")
    got = {r.image_id: r.category for r in labeling.coarse_category(rows, prompts, 0.9, 0.01).collect()}
    assert got == {"a": "other", "b": "x"}


def test_suppression_leaves_no_overlaps(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i % 5), int(i), *map(float, (x, y, x + w, y + h)), float(s)) for i, (x, y, w, h, s) in enumerate(rng.random((100, 5)) * [0.5, 0.5, 0.5, 0.5, 1])]
    df = spark.createDataFrame(rows, "image_id int, idx int, x_min double, y_min double, x_max double, y_max double, score double")
    kept = regions.non_max_suppression(df, 0.3)
    assert regions.iou_pairs(kept, 0.3).count() == 0
    assert regions.non_max_suppression(df, 0.0).count() == 100
    assert {r.image_id for r in kept.collect()} == set(range(5))
    ranked = regions.with_priority(df)
    assert regions.pruned(ranked, 1, 9.0, 9.0).count() == 5 and regions.pruned(ranked, 0).count() == 0


def test_pixel_boxes(spark):
    x0, y0, x1, y1 = geometry.pixel_box(tuple(F.lit(v) for v in (-0.1, 0.005, 0.5, 2.0)), F.lit(100), F.lit(100))
    assert one(spark, x0, y0, x1, y1) == (0, 0, 50, 100)


def test_clusters_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=4).tolist()) for i in range(60)] + [(99, [0.0] * 4)]
    units = clusters.unit_vectors(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    whole = {(r.src, r.dst) for r in clusters.knn_edges(units, 3, 0.5).collect()}
    assert whole == {(r.src, r.dst) for r in clusters.knn_edges(units, 3, 0.5, block=13).collect()}
    pairs = {(r.src, r.dst) for r in clusters.symmetric(clusters.knn_edges(units, 3, 0.5)).collect()}
    assert pairs == {(b, a) for a, b in pairs}
    members = clusters.clusters(units, clusters.knn_edges(units, 3, 0.5), 1)
    assert sorted(r.id for r in members.collect()) == list(range(60))
    centers = clusters.cluster_centers(members, units).filter("is_center").collect()
    assert len(centers) == members.select("cluster_id").distinct().count() and all(abs(r.distance) < 1e-9 for r in centers)


def test_sweep_against_counts(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(p), bool(t)) for p, t in zip(rng.integers(0, 20, 200) / 20, rng.random(200) < 0.4, strict=True)]
    sweep = evaluation.threshold_sweep(spark.createDataFrame(rows, "k string, p double, t boolean"), "k", "p", "t").collect()
    assert len(sweep) == len({p for _, p, _ in rows})
    for r in sweep:
        assert (r.tp, r.fp) == (sum(t and p >= r.threshold for _, p, t in rows), sum(not t and p >= r.threshold for _, p, t in rows))
        assert r.tp + r.fn == sum(t for *_, t in rows)
    picked = evaluation.threshold_sweep(spark.createDataFrame(rows, "k string, p double, t boolean"), "k", "p", "t", 7).collect()
    at = sorted({p for _, p, _ in rows})
    assert sorted(r.threshold for r in picked) == [at[i] for i in sorted({int(x) for x in np.linspace(0, len(at) - 1, 7)})]


def test_split_is_exact(spark):
    df = evaluation.split(spark.range(101), "id", 0.3, 1)
    assert df.filter("is_val").count() == 30 and df.count() == 101


def test_heads_learn(spark):
    rng = np.random.default_rng(5)
    rows = [([float(x), float(y)], int(x > 0)) for x, y in rng.normal(size=(200, 2))]
    df = spark.createDataFrame(rows, "v array<double>, label int")
    head = evaluation.head_weights(spark, evaluation.train_head(df, "v", "label"), ["no", "yes"])
    top = labeling.head_objects(df.withColumn("image_id", F.monotonically_increasing_id()), head).filter("rank = 1").count()
    assert head.count() == 2 and top > 0


def test_scan_merges_paths(spark):
    empty = spark.createDataFrame([], "image_id string, primary_path string, all_paths array<string>, size_bytes long, mtime double, status string, dirty boolean")
    first = ingest.merge_scan(empty, spark.createDataFrame([("/a", "h1", 1, 1.0), ("/b", "h1", 1, 1.0), ("/c", "h2", 2, 1.0)], "path string, image_id string, size_bytes long, mtime double")).withColumn("dirty", F.lit(False))
    again = spark.createDataFrame([("/b", "h1", 1, 1.0), ("/a", "h3", 5, 2.0)], "path string, image_id string, size_bytes long, mtime double")
    got = {r.image_id: (r.primary_path, r.all_paths, r.status, r.dirty) for r in ingest.merge_scan(first, again).collect()}
    assert got == {"h1": ("/b", ["/b"], "active", False), "h2": ("", [], "deleted", False), "h3": ("/a", ["/a"], "active", True)}
    revived = ingest.merge_scan(ingest.merge_scan(first, again), spark.createDataFrame([("/c", "h2", 2, 1.0)], "path string, image_id string, size_bytes long, mtime double"))
    assert {r.image_id: (r.status, r.dirty) for r in revived.collect()}["h2"] == ("active", True)


def test_resume():
    stages = ["scan", "hash", "embed", "scene"]
    assert ingest.stages_to_run(stages, "hash", None) == ["embed", "scene"]
    assert ingest.stages_to_run(stages, "embed", "img_002") == ["embed", "scene"]
    assert ingest.stages_to_run(stages, "gone", None) == stages == ingest.stages_to_run(stages, None, None)


def test_snapshots(spark, tmp_path):
    table = snapshot.SnapshotTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string, created int")
    table.upsert(rows((1, "a", 1), (2, "b", 1)), ["k"])
    table.upsert(rows((2, "B", 2), (3, "c", 2)), ["k"], ["created"])
    table.upsert(rows((2, "B", 2), (3, "c", 2)), ["k"], ["created"])
    assert sorted(map(tuple, table.read().collect())) == [(1, "a", 1), (2, "B", 1), (3, "c", 2)]
    out = snapshot.refresh(table.read(), rows((9, "n", 9)), ["created"], [(1,)])
    assert sorted(r.k for r in out.collect()) == [3, 9]
    assert sorted(r.v for r in snapshot.insert_missing(table.read(), rows((1, "x", 0), (4, "d", 0)), ["k"]).collect()) == ["B", "a", "c", "d"]


def test_file_sources(spark, tmp_path):
    for name in ("x.JPG", "sub/y.png", "z.txt"):
        (tmp_path / "pics" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "pics" / name).write_bytes(b"12345")
    rows = scan.scan_roots(spark, [str(tmp_path / "pics"), str(tmp_path / "missing")]).collect()
    assert sorted(r.path.rpartition("/")[2] for r in rows) == ["x.JPG", "y.png"] and {r.size_bytes for r in rows} == {5}
    assert scan.scan_roots(spark, [str(tmp_path / "missing")]).count() == 0
    paths = spark.createDataFrame([("a", '["/1","/2"]'), ("b", "broken")], "image_id string, all_paths string")
    assert {tuple(r) for r in scan.stored_paths(paths).collect()} == {("a", "/1"), ("a", "/2")} or {tuple(r)[::-1] for r in scan.stored_paths(paths).collect()} == {("/1", "a"), ("/2", "a")}
    (tmp_path / "gt.jsonl").write_text('{"image_id":"a","scene":["scene.food"],"attributes":{"attr.has_text":true}}\n\nbroken\n{"image_id":"b"}\n')
    (tmp_path / "gt.json").write_text('[\n {"image_id": "c",\n "objects": ["o"]}\n]')
    assert sorted(r.image_id for r in ground_truth.read_ground_truth(spark, str(tmp_path / "gt.jsonl")).collect()) == ["a", "b"]
    assert [(r.image_id, r.objects) for r in ground_truth.read_ground_truth(spark, str(tmp_path / "gt.json")).collect()] == [("c", ["o"])]


def test_listing_and_search(spark):
    imgs = spark.createDataFrame([(i,) for i in range(100)], "image_id long")
    labels = spark.createDataFrame([(i, k, float(i)) for i in range(100) for k in ("x", "y") if i % (2 if k == "x" else 3) == 0], "image_id long, label_key string, score double")
    both = serving.listing(imgs, labels, ["x", "y"])
    assert sorted(r.image_id for r in both.collect()) == list(range(0, 100, 6))
    assert [r.image_id for r in serving.page(both, 2, 5).collect()] == [30, 36, 42, 48, 54]
    assert serving.page(imgs, 0, 1000).count() == 64
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red"), (3, None)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in search.bm25(docs, "doc_id", "text", ["red", "fox"]).collect()}
    assert set(scores) == {1, 2} and scores[1] > scores[2] > 0


def test_streaming_ingest_equals_a_full_run(spark, tmp_path):
    rows = [(f"i{k:02d}", k * 3 % 16, float(k % 5), k) for k in range(24)]
    df = spark.createDataFrame(rows, "image_id string, bits long, mtime double, size_bytes long")
    landing, images_path, pairs_path = (str(tmp_path / x) for x in ("landing", "images", "pairs"))
    for part in (df.filter("size_bytes < 10"), df.filter("size_bytes >= 8")):
        part.coalesce(1).write.mode("append").parquet(landing)
        q = arrivals.ingest(spark, landing, images_path, pairs_path, str(tmp_path / "checkpoint"), 1)
        q.awaitTermination()
    got = {tuple(r) for r in snapshot.SnapshotTable(spark, pairs_path).read().collect()}
    assert got == {tuple(r) for r in near_duplicates.hamming_pairs(df, 1).collect()} and got


def test_windows_of_events(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.n, r.total) for r in arrivals.windowed_counts(rows).collect()) == [(1, 4.0), (2, 3.0)]


def test_models_are_loaded_once_and_errors_stay_apart(spark):
    from medialens.operators import hooks

    df = spark.createDataFrame([("a", 4.0), ("b", 0.0), ("c", None)], "image_id string, x double")
    out = hooks.apply_model(df, "image_id", "x", lambda: 2.0, lambda model, v: [1.0 / v * model], "array<double>", "test-model")
    got = {r.image_id: (r.result, r.status) for r in hooks.counted(out, errors=F.count_if(F.col("status") == "error")).collect()}
    assert got == {"a": ([0.5], "complete"), "b": (None, "error"), "c": (None, "error")}
    assert hooks.artifact_rows(out, "embedding", "m:1").filter("status = 'complete'").count() == 1


def test_tables_are_copied_and_pruned(spark, tmp_path):
    a = snapshot.create_empty(spark, str(tmp_path / "a"), "id string, n int")
    a.write(spark.createDataFrame([("x#0", 1), ("x#1", 2), ("xy#0", 3)], "id string, n int"))
    assert snapshot.create_empty(spark, str(tmp_path / "a"), "id string, n int").read().count() == 3
    b = snapshot.SnapshotTable(spark, str(tmp_path / "b"))
    snapshot.copy_table(a, b)
    left = snapshot.without_prefix(b.read(), spark.createDataFrame([("x",)], "image_id string"), "id")
    assert [r.id for r in left.collect()] == ["xy#0"]
    assert snapshot.without(b.read(), left, ["id"]).count() == 2
    with pytest.raises(FileNotFoundError):
        snapshot.copy_table(snapshot.SnapshotTable(spark, str(tmp_path / "none")), b)
