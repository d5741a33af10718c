"""Groups of equal hashes, settings and notes in any store, raw vectors, collections kept by hand."""

import pytest

from medialens import settings
from medialens.operators import clusters, near_duplicates, serving
from medialens.operators.graph import connected_components
from medialens.plans.stages import Journal, Manifest, Stage, run_pipeline


def test_equal_hashes_are_linked_once_and_connect_the_same_images(spark):
    rows = [(f"a{i:03d}", 5, i) for i in range(300)] + [("b", 7, 1), ("c", 1 << 40, 1), ("d", None, 1), ("e", (1 << 40) + 1, 2), ("f", -1, 3)]
    df = spark.createDataFrame(rows, "image_id string, bits long, mtime int")
    edges = near_duplicates.group_edges(df, 2)
    assert edges.count() == 299 + 3
    of = lambda e: {tuple(r) for r in connected_components(e, "anchor_id", "duplicate_id").collect()}
    assert of(edges) == of(near_duplicates.hamming_pairs(df, 2)) == of(near_duplicates.group_edges(df, 2, small=0))
    assert near_duplicates.group_edges(df.limit(0), 2).count() == 0


def test_settings_from_yaml(tmp_path):
    pytest.importorskip("yaml")
    plain, broken = tmp_path / "s.yaml", tmp_path / "b.yml"
    section, field = "cluster", None
    default = settings.Settings()
    section = next(n for n in vars(default) if vars(getattr(default, n)))
    field, value = next((k, v) for k, v in vars(getattr(default, section)).items() if isinstance(v, (int, float)) and not isinstance(v, bool))
    plain.write_text(f"{section}:\n  {field}: {value + 1}\n  unknown: 3\n")
    broken.write_text("a: [1,\n b")
    assert getattr(getattr(settings.load(str(plain)), section), field) == value + 1
    assert settings.load(str(broken)) == default


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_a_pipeline_goes_on_in_any_store(tmp_path, scheme):
    root, seen, fail = f"{scheme}{tmp_path}/new/run", [], [True]

    def second(cursor, note):
        seen.append(("second", cursor))
        note("img_2")
        if fail.pop() if fail else False:
            raise RuntimeError("lost")

    stages = [Stage("first", lambda cursor, note: seen.append(("first", cursor))), Stage("second", second)]
    wiped = []
    with pytest.raises(RuntimeError):
        run_pipeline(root, settings.Settings(), stages, lambda: wiped.append(1))
    assert Journal(root).read() == ("second", "img_2") and Manifest(root).matches(settings.Settings())
    assert run_pipeline(root, settings.Settings(), stages, lambda: wiped.append(1)) == ["second"]
    assert seen == [("first", None), ("second", None), ("second", "img_2")] and wiped == [1]
    assert Journal(root).read() == (None, None)


def test_raw_vectors_are_not_normalised(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, []), (4, [1.0, None]), (5, [0.0, 0.0])], "id int, v array<double>")
    assert {r.id: list(r.v) for r in clusters.raw_vectors(df, "id", "v").collect()} == {1: [3.0, 4.0], 5: [0.0, 0.0]}


def test_collections_by_hand(spark):
    rows = [("c", "a", "add", 1), ("c", "a", "remove", 2), ("c", "a", "add", 3), ("c", "a", "add", 3), ("c", "b", "add", 1), ("c", "b", "remove", 1), ("d", "a", "remove", 5), ("d", "b", "add", None), (None, "a", "add", 1), ("c", "z", "other", 9), ("d", "z", "add", 0)]
    members = serving.collection_members(spark.createDataFrame(rows, "collection_id string, image_id string, action string, at int"))
    assert sorted(tuple(r) for r in members.collect()) == [("c", "a"), ("d", "z")]
    assert sorted(tuple(r) for r in serving.collection_sizes(members).collect()) == [("c", 1), ("d", 1)]
