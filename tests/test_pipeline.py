"""Settings, stages, journal and manifest; the vocabulary."""

import pytest

from medialens import settings
from medialens.operators import taxonomy
from medialens.plans.stages import Journal, Stage, run_pipeline


def test_settings_leave_out_wrong_values(tmp_path):
    got = settings.parse({"clusters": {"k": "many", "threshold": 1, "enabled": False, "new": 3}, "objects": {"whitelist": ["a", 2]}, "nothing": 1})
    assert (got.clusters.k, got.clusters.threshold, got.clusters.enabled, got.objects.whitelist) == (20, 1.0, False, ("a",))
    (tmp_path / "s.json").write_text("broken")
    assert settings.load(str(tmp_path / "s.json")) == settings.Settings()
    assert settings.model_name(None, "big", {"big": "x"}, "d") == "x" and settings.model_name(None, None, {}, "d") == "d"
    with pytest.raises(KeyError):
        settings.model_name(None, "none", {}, "d")


def test_urls_and_folders():
    assert settings.checked_database_url(" postgresql+psycopg://user:pw@host:5432/db ").endswith("/db")
    for bad in ("", "host/db", "mysql://h/db", "postgresql://host", None):
        with pytest.raises(ValueError):
            settings.checked_database_url(bad)
    for bad in ("", "s3://x", "x.db"):
        with pytest.raises(ValueError):
            settings.checked_cache_root(bad)


def test_runs_resume_where_they_stopped(tmp_path):
    ran, wiped, fail = [], [], [True]

    def stage(name):
        def run(cursor, note):
            ran.append((name, cursor))
            if name == "b" and fail:
                note("img_002")
                fail.clear()
                raise RuntimeError
        return Stage(name, run)

    stages = [stage("a"), stage("b"), Stage("off", None, False), stage("c")]
    go = lambda s=settings.Settings(): run_pipeline(tmp_path, s, stages, lambda: wiped.append(1))
    with pytest.raises(RuntimeError):
        go()
    assert go() == ["b", "c"] and ran == [("a", None), ("b", None), ("b", "img_002"), ("c", None)]
    assert Journal(tmp_path).read() == (None, None) and len(wiped) == 1
    assert go() == ["a", "b", "c"] and len(wiped) == 1
    go(settings.parse({"clusters": {"k": 3}}))
    assert len(wiped) == 2


def test_vocabulary(spark):
    labels = taxonomy.seed_labels(spark)
    assert labels.count() == 97 and taxonomy.merge_labels(labels, labels).count() == 97
    assert taxonomy.require_labels(labels, labels.limit(3).select("label_key")).count() == 3
    with pytest.raises(KeyError):
        taxonomy.require_labels(labels, spark.createDataFrame([("nope",)], "label_key string"))
    for bad in (("scene.food", "x", "object", None), ("new", "x", "object", "gone")):
        with pytest.raises(ValueError):
            taxonomy.merge_labels(labels, spark.createDataFrame([bad], labels.schema))
    aliases = spark.createDataFrame([("object.food", "en", " dish "), ("object.food", "en", "  ")], "label_key string, language string, alias_text string")
    once = taxonomy.add_aliases(aliases.limit(0), aliases)
    assert [tuple(r) for r in taxonomy.add_aliases(once, aliases).collect()] == [("object.food", "en", "dish")]
