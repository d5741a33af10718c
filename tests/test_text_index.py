"""The index against scores of all documents."""

import random
import time

import pytest
from pyspark.sql import functions as F

from medialens.operators import search, text_index
from medialens.operators.text_index import TextIndex
from medialens.plans import search as plan


def texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.choice([3, 10, 40, 200])))) for i in range(n)]


def best(df, key, k):
    rows = [(r[key], r.score) for r in df.collect()]
    return sorted(((i, round(x, 8)) for i, x in rows), key=lambda r: (-r[1], r[0]))[:k]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(3000), "id long, text string").cache()


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    made = TextIndex(spark, f"file://{tmp_path_factory.mktemp('index')}", shards=16)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(text_index, "BLOCK_DOCS", 32)
        assert [made.add(docs.filter(f"id % 3 = {k}"), "id", "text") for k in range(3)] == [1000] * 3
    return made


@pytest.mark.parametrize("terms", [["w0"], ["w3", "w390"], ["w1", "w7", "w7", "w399"], ["w5", "nowhere"]])
def test_same_rows_as_scoring_all_documents(docs, index, terms):
    want = best(search.bm25(docs, "id", "text", terms), "id", 10)
    assert best(index.search(terms, 10), "key", 10) == want and len(want) > 0


def test_blocks_are_skipped(docs, index):
    _, held, scored = index._search(["w2", "w300"], 5)
    assert held.count() > 30 and scored.count() < held.count() / 2


def test_only_the_partitions_of_the_terms_are_read(index):
    read = index._of(["w2", "w300"])
    shards = {r.shard for r in read.select("shard").distinct().collect()}
    filters = read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert len(shards) == 2 and "shard" in filters and all(str(k) in filters for k in shards)


def test_added_documents_count_once_and_lost_batches_never(spark, tmp_path):
    made = TextIndex(spark, f"file://{tmp_path}/i", key_type="string")
    assert made.search(["a"], 5).count() == 0
    rows = spark.createDataFrame([("x", "a b"), ("y", None), ("x", "a a a"), (None, "a"), ("z", "A, a! c")], "id string, text string")
    assert made.add(rows, "id", "text") == 3 and made.add(rows, "id", "text") == 0 and made.add(rows.limit(0), "id", "text") == 0
    made.documents().select("key", "length", "block").write.parquet(f"file://{tmp_path}/i/documents/batch=000001-lost")
    assert {r.key: r.length for r in made.documents().collect()} == {"x": 3, "y": 0, "z": 3}
    assert [r.key for r in made.search(["a"], 5).collect()] == ["x", "z"]
    assert made.search([], 5).count() == made.search(["q"], 5).count() == made.search(["a"], 0).count() == 0
    assert made.add(spark.createDataFrame([("w", "a " * 50)], "id string, text string"), "id", "text") == 1
    assert [r.key for r in made.search(["a", "a"], 2).collect()] == ["w", "x"]


def test_a_search_of_a_ready_index_is_fast(spark, sf_dir):
    ready = plan.text_index(spark, sf_dir)
    ready.search(plan.TERMS, 20).collect()
    began = time.perf_counter()
    rows = ready.search(["license", "stupid"], 20).collect()
    print("seconds of a search:", round(time.perf_counter() - began, 2))
    assert len(rows) == 20


def test_postings_are_counted_where_their_block_is(spark, tmp_path):
    """Pairs of document and word were shuffled three times."""
    made = TextIndex(spark, f"file://{tmp_path}/i", key_type="string")
    placed = spark.createDataFrame([("b", "a b a", 3, 7), ("a", "b", 1, 7), ("c", "é 1", 2, 8), ("d", "", 0, 8)], "key string, words string, length int, block long")
    out = made._blocks(placed)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan
    assert sorted((r.block, r.term, r.docs, r.most, r.shortest, [tuple(p) for p in r.postings]) for r in out.collect()) == [
        (7, "a", 1, 2, 3, [("b", 2, 3)]),
        (7, "b", 2, 1, 1, [("a", 1, 1), ("b", 1, 3)]),
        (8, "1", 1, 1, 2, [("c", 1, 2)]),
        (8, "é", 1, 1, 2, [("c", 1, 2)]),
    ]


def test_blocks_are_bounded_by_words_too(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_WORDS", 2000, raising=False)
    made = TextIndex(spark, f"file://{tmp_path}/i")
    assert made.add(spark.range(200).select("id", F.repeat(F.lit("a "), 100).alias("text")), "id", "text") == 200
    words = [r.words for r in made.documents().groupBy("block").agg(F.sum("length").alias("words")).collect()]
    assert sum(words) == 20_000 and len(words) >= 5 and max(words) < 6000


def test_texts_are_grouped_only_where_a_key_stands_twice(spark, tmp_path):
    made = TextIndex(spark, f"file://{tmp_path}/i")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "key long, text string")
    assert "Aggregate" not in made._once(rows)._jdf.queryExecution().optimizedPlan().toString()
    again = rows.union(spark.createDataFrame([(2, "a b"), (3, "c"), (4, "d")], rows.schema))
    assert sorted(tuple(r) for r in made._once(again).collect()) == [(1, "a"), (2, "a b"), (3, None), (4, "d")]
