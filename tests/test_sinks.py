"""Sinks, heads, captions, queues, logs, checks of names, and graphs beyond one task."""

import json
import random

import pytest
from pyspark.sql import functions as F

from medialens import logs, settings
from medialens.functions import vectors
from medialens.operators.graph import connected_components
from medialens.sources import sinks
from medialens.streaming import queues


def test_results_are_only_added(spark, tmp_path):
    path = str(tmp_path / "r")
    for k in range(2):
        sinks.append_results(spark.createDataFrame([(k, "x")], "id long, v string"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1]


def test_annotations_go_on_where_they_ended(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = lambda n, v: spark.createDataFrame([(str(i), v) for i in range(n)], "image_id string, scene string")
    sinks.append_missing(rows(3, "old"), path)
    sinks.append_missing(rows(5, "new"), path)
    got = {r.image_id: r.scene for r in spark.read.json(path).collect()}
    assert got == {"0": "old", "1": "old", "2": "old", "3": "new", "4": "new"}


def test_vectors_and_heads(spark, tmp_path):
    sinks.write_vectors(spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "image_id string, embedding array<double>"), str(tmp_path / "v"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "v")).collect()] == [("a", [1.0, 2.0], 2)]
    head = spark.createDataFrame([("k", [1.0, 2.0], 0.5), ("l", [0.0, 1.0], 0.0)], sinks.HEAD)
    head.write.parquet(str(tmp_path / "h"))
    assert sinks.read_head(spark, str(tmp_path / "h")).count() == 2
    assert sinks.read_head(spark, str(tmp_path / "none")) is None
    head.union(spark.createDataFrame([("m", [1.0], 0.5)], sinks.HEAD)).write.parquet(str(tmp_path / "bad"))
    assert sinks.read_head(spark, str(tmp_path / "bad")) is None
    spark.range(2).write.parquet(str(tmp_path / "other"))
    assert sinks.read_head(spark, str(tmp_path / "other")) is None


def test_captions(spark, tmp_path):
    (tmp_path / "c" / "d").mkdir(parents=True)
    (tmp_path / "c" / "one.txt").write_text("\n a dog \n", encoding="utf-8")
    (tmp_path / "c" / "d" / "two.txt").write_text(" \n", encoding="utf-8")
    (tmp_path / "c" / "three.md").write_text("no")
    assert sorted(tuple(r) for r in sinks.read_captions(spark, str(tmp_path / "c")).collect()) == [("one", "a dog"), ("two", "")]


def test_stages_are_cleared_by_name(spark, tmp_path):
    for t in ("scenes", "embeddings"):
        spark.range(1).write.parquet(str(tmp_path / t))
    assert sinks.clear_stages(spark, str(tmp_path), ["scene_classification", "labels"]) == ["scenes"]
    assert (tmp_path / "embeddings").exists() and not (tmp_path / "scenes").exists()
    assert set(sinks.cleared(["all"])) >= {"artifacts", "label_assignments"}
    with pytest.raises(ValueError):
        sinks.cleared(["nothing"])


def test_messages_reach_their_task(spark, tmp_path):
    landing, seen = str(tmp_path / "landing"), {}
    images = spark.createDataFrame([("a",), ("b",)], "image_id string")
    queues.enqueue(images, landing)
    queues.enqueue(images.limit(1), landing, "process")
    handlers = {t: (lambda t: lambda df, _: seen.setdefault(t, []).extend(r.image_id for r in df.collect()))(t) for t in ("pre_process", "process")}
    for _ in range(2):  # the second run has nothing left to do
        queues.run_queues(spark, landing, handlers, str(tmp_path / "cp")).awaitTermination(120)
    assert {k: sorted(v) for k, v in seen.items()} == {"pre_process": ["a", "b"], "process": ["a"]}
    with pytest.raises(ValueError):
        queues.enqueue(images, landing, "other")


def test_logs_turn_over(tmp_path):
    path = tmp_path / "l" / "run.jsonl"
    log = logs.logger("medialens.test", str(path), max_bytes=400, backups=2)
    assert logs.logger("medialens.test", str(path), 400, 2) is log and len(log.handlers) == 1
    for i in range(20):
        log.info("step %s", i, extra={"images": i})
    assert json.loads(path.read_text().splitlines()[-1]) | {"time": 0} == {"time": 0, "level": "INFO", "name": "medialens.test", "message": "step 19", "images": 19}
    assert sorted(p.name for p in path.parent.iterdir()) == ["run.jsonl", "run.jsonl.1", "run.jsonl.2"]


def test_names_and_urls():
    assert settings.masked_url("postgresql://me:se:cret@h:1/d") == "postgresql://me:***@h:1/d"
    assert settings.masked_url("postgresql://h/d") == "postgresql://h/d"
    assert settings.checked_identifier("a_1") == "a_1"
    for bad in ("a-b", "", "a;b", "é"):
        with pytest.raises(ValueError):
            settings.checked_identifier(bad)
    with pytest.raises(FileNotFoundError):
        settings.checked_binary("no such program")
    assert settings.detector_backend(True, " OWLViT") == "owlvit"
    for args, error in (((False, "owlvit"), RuntimeError), ((True, "x"), ValueError)):
        with pytest.raises(error):
            settings.detector_backend(*args)
    assert settings.model_ids("b", None, "a", " b ") == ["a", "b"]


def test_synthetic_vectors(spark):
    rows = spark.createDataFrame([("x",), ("x",), ("My iPhone",)], "name string").select("name", vectors.synthetic(F.col("name"), 64, {"iphone": (0, 10)}).alias("v")).collect()
    assert rows[0].v == rows[1].v and len(rows[0].v) == 64
    assert all(abs(sum(x * x for x in r.v) - 1) < 1e-9 for r in rows)
    assert sum(rows[2].v[:10]) > sum(abs(x) for x in rows[2].v[10:20]) / 4


@pytest.mark.parametrize("kind", ["chain", "random", "hub"])
def test_components_beyond_one_task(spark, kind):
    rng = random.Random(kind)
    if kind == "chain":
        nodes = list(range(60))
        rng.shuffle(nodes)
        edges = list(zip(nodes, nodes[1:], strict=False))
    elif kind == "random":
        edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(500, 500), (7, 7)]
    else:
        edges = [(99 if i % 2 else 0, i) for i in range(1, 80)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    want = sorted((x, find(x)) for x in list(root))
    assert sorted(tuple(r) for r in connected_components(df).collect()) == want
    assert sorted(tuple(r) for r in connected_components(df, small=0).collect()) == want
