"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns: every operator has a defined result."""

import pytest

import corpus_pipeline
from medialens.llm import bpe, chat, decontamination, html, minhash, quality, sharding, substrings, toxicity, urls
from medialens.llm.queries import URL_RULES, tokenizer_path

LONG = " ".join(f"word{i} stands here. And more of it" for i in range(20_000))
TEXT = " ".join(f"plain{i} w{i} f{i} each{i} o{i}" for i in range(30))
ROWS = [(1, TEXT, "en", "s", 1), (1, TEXT, "en", "s", 1), (2, TEXT, None, None, None), (None, TEXT + " end", "en", "s", 1), (3, None, "en", "s", 0), (None, None, None, None, None), (4, "", "en", "s", 0), (5, " \n\t ", "en", "s", 3), (6, LONG, "en", "s", 9), (1, "another text under the same id", "en", "s", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["text_key", "node", "band", "hash", "sub", "class", "words", "lines", "removed", "score", "n_words", "slot", "__key", "__NODE", "places", "a.b", "kept", "n_sentences", "L_ID"]


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(20))), (1, None), (None, "")], "item_id long, text string")


def test_sharding(docs, none):
    rows = sharding.assign_shards(docs, "doc_id", ["x", "y"], 101).select("doc_id", "slot", "shard", "`a.b`").collect()
    assert len(rows) == len(ROWS) and all(r.shard in ("x", "y") for r in rows)
    assert len({(r.slot, r.shard) for r in rows if r.doc_id == 1}) == 1
    assert sharding.assign_shards(none, "doc_id", ["x"], 101).count() == 0


def test_quality(docs, none):
    rows = quality.quality_report(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    assert {(r.kept, r.n_words) for r in rows if r.doc_id == 1} == {(True, 150), (False, 6)}
    out = quality.apply_quality(docs)
    assert out.columns == docs.columns and out.count() == sum(r.kept for r in rows)
    assert quality.quality_report(none).count() == 0 and quality.apply_quality(none).count() == 0


def test_quality_counts_copies_once_and_footers_often(spark):
    body = lambda i: "\n".join(" ".join(f"l{i}x{k}y{j}" for j in range(9)) for k in range(8))
    copies = [(i, body(0), "s") for i in range(60)]
    footers = [(100 + i, body(i + 1) + "\nAll rights reserved", "s") for i in range(60)]
    rows = quality.quality_report(spark.createDataFrame(copies + footers, "doc_id long, text string, source string")).collect()
    assert all(r.kept for r in rows)
    assert all(r.n_frequent_lines == (r.doc_id >= 100) for r in rows)
    thin = [(200 + i, f"only {i}\n" + "\n".join(" ".join(f"w{k}x{j}" for j in range(20)) for k in range(3)), "t") for i in range(60)]
    assert not any(r.kept for r in quality.quality_report(spark.createDataFrame(thin, "doc_id long, text string, source string")).collect())


@pytest.mark.parametrize(("shared", "own", "n"), [(5, 1, 30), (10, 1, 40), (20, 1, 100), (20, 3, 60), (3, 1, 20)])
def test_quality_counts_every_document_of_a_template(spark, shared, own, n):
    template = [f"template line {k} of {shared}" for k in range(shared)]
    rows = [(i, "\n".join(template + [f"own line {k} of document {i}" for k in range(own)]), "s") for i in range(n)]
    rows += [(1000 + i, rows[0][1], "s") for i in range(30)]  # copies of the first count once
    holders = {}
    for _, text, _ in rows:
        for line in text.split("\n"):
            holders.setdefault(line, set()).add(text)
    want = {i: sum(len(holders[line]) > quality.MAX_DOCS_PER_HOST for line in text.split("\n")) for i, text, _ in rows}
    got = {r.doc_id: r.n_frequent_lines for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == want and set(want.values()) == {shared if n > quality.MAX_DOCS_PER_HOST else 0}


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://A.Example.NET/en/x?u=http://b.org/fr/"), (5, "HTTP://A.Example.NET/en/x?u=http://b.org/fr/"), (None, "x://net"), (6, "x://net/"), (7, "x://notnet/"), (8, "x://a.org/frx"), (9, "x://example.com/de/" + "a" * 50_000), (10, "x://..net./")]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, host int, digest int")
    got = urls.judge_urls(pages, urls.rules_table(spark, URL_RULES)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: (r.host, r.rule, r.verdict) for r in got}
    assert by[1] == by[2] == by[3] == by[4] == ("", None, "allow")
    assert by[5] == ("a.example.net", "example.net/en/", "allow")
    assert by[None] == ("net", None, "allow") and by[6][1:] == ("net/", "block") and by[7][1] is None and by[8][1] is None
    assert by[9][1:] == ("example.com/de/", "block") and by[10][1] is None
    assert urls.judge_urls(pages.limit(0), urls.rules_table(spark, URL_RULES)).count() == 0
    assert urls.judge_urls(pages, urls.rules_table(spark, URL_RULES).limit(0)).filter("verdict = 'allow'").count() == len(rows)
    prefix = urls.rules_table(spark, [("block", "org/f")])
    assert urls.judge_urls(pages, prefix).filter("rule = 'org/f'").count() == 1


def test_urls_meet_by_the_short_prefix_and_are_confirmed_by_the_digest(spark, monkeypatch):
    rows = [(i, f"x://h{i % 40}.example.net/p{i % 7}/en/x") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = urls.rules_table(spark, [*URL_RULES, *[("block", f"h{k}.example.net/p{k % 7}/") for k in range(0, 40, 3)]])
    want = {(r.page_id, r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()}
    joins = [line for line in _plans(spark, lambda: urls.judge_urls(pages, rules)) if "short" in line and "Join" in line]
    assert joins and not any("digest" in line.split("Inner")[0] for line in joins)
    monkeypatch.setattr(urls, "PREFIX_HEX", 1)  # sixteen different prefixes, so most expressions share one with a rule
    assert {(r.page_id, r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()} == want
    assert sum(rule is not None for _, rule, _ in want) > 100


def _plans(spark, made):
    """Lines of the physical plans that made() writes or returns."""
    from unittest import mock

    lines, plain = [], urls.written

    def seen(df, name):
        lines.extend(df._jdf.queryExecution().executedPlan().toString().splitlines())
        return plain(df, name)

    with mock.patch.object(urls, "written", seen):
        made()
    return lines


def test_urls_of_very_many_labels_and_slashes(spark):
    import time

    host, path = ".".join(["a"] * 200_000), "/b" * 200_000
    rows = [(1, f"x://{host}.example.com{path}"), (2, f"x://{host}.example.com/de{path}"), (3, f"x://example.com.{host}/de/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = urls.rules_table(spark, [*URL_RULES, ("block", "a.b.c.com/x/y/z"), ("block", "com/b/b/b/")])
    began = time.perf_counter()
    got = {r.page_id: r.rule for r in urls.judge_urls(pages, rules).collect()}
    assert got == {1: "com/b/b/b/", 2: "example.com/de/", 3: None}
    assert time.perf_counter() - began < 20


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, 0, "user", "hi"), (None, None, None, None), (3, 5, "assistant", "z" * 200_000), (3, -1, "tool", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, conversation int")
    got = {r.conv_id: r for r in chat.digests(*chat.format_chats(df)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, 2: 1, None: 1, 3: 2}
    assert got[3].loss_chars == 200_000 and got[1].loss_chars == 0
    assert chat.digests(*chat.format_chats(df.limit(0))).count() == 0


def test_chat_keys_of_very_long_conversations(spark):
    import hashlib

    rows = [(c, t, "user" if t % 2 else "assistant", f"turn {t} é" if t < n - 1 else f"end {c}") for c, n in ((1, 32_000), (2, 32_000), (3, 1)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.conversations_of(df).collect()}
    assert [len(got[c].prefixes) for c in (1, 2, 3)] == [32_000, 32_000, 1]
    assert got[1].prefixes[:-1] == got[2].prefixes[:-1] and got[1].conversation == got[1].prefixes[-1] != got[2].conversation
    key = ""
    for _, _, role, text in rows[:5]:
        key = hashlib.md5(f"{key}:{len(role)}:{role}:{text}".encode()).hexdigest()
    assert got[1].prefixes[4] == key
    assert got[1].size == sum(len(role) + len(text.encode()) for c, _, role, text in rows if c == 1)


def test_chat_packs_are_bounded_by_bytes(spark):
    rows = [(i, t, "user", "same" if t == 0 else f"{i} " * 2000) for i in range(40) for t in (0, 1)] + [(100 + i, 0, "user", "copy") for i in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conversations = chat.conversations_of(df)
    packs = chat.packs_of(conversations, max_bytes=30_000).collect()
    assert len(packs) > 8 and max(len(p.text) for p in packs) < 120_000
    assert sum(len(p.ends) for p in packs) == 41
    assert chat.digests(conversations, chat.packs_of(conversations, max_bytes=30_000)).count() == 90


def test_decontamination(docs, none, bench):
    assert decontamination.leaks(docs, bench).count() == 0
    assert decontamination.without_leaks(docs, bench).columns == docs.columns
    assert decontamination.without_leaks(docs, bench).count() == len(ROWS)
    assert decontamination.leaks(none, bench).count() == 0 and decontamination.leaks(docs, bench.limit(0)).count() == 0
    assert decontamination.without_leaks(docs, bench.limit(0)).count() == len(ROWS)
    own = docs.select("doc_id", "text").filter("doc_id = 2").withColumnRenamed("doc_id", "item_id")
    assert sorted((r.doc_id is None, r.doc_id, r.n_overlap) for r in decontamination.leaks(docs, own).collect() if r.doc_id) == [(False, 1, 150), (False, 1, 150), (False, 2, 150)]


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (6, None), (99, 1), (4, 0)], "doc_id long, toxic int")
    for lab in (labels, labels.limit(0)):
        rows = toxicity.score(docs, toxicity.train(docs, lab)).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_near_duplicates(docs, none):
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    assert {r.class_id for r in rows if r.doc_id == 2} == {None}
    assert sum(r.n_docs == 4 for r in rows) == 4
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    left = kept.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:5]) for r in left) == [(False, 1, "anoth"), (False, 3, ""), (False, 4, ""), (False, 5, " \n\t "), (False, 6, "word0"), (True, 0, ""), (True, 0, "plain")]
    assert minhash.near_duplicates(none).count() == 0 and minhash.drop_near_duplicates(none).count() == 0


def test_substrings(docs, none):
    out = substrings.dedup_substrings(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(ROWS)
    assert [r.text for r in rows if r.doc_id == 3] == [None]
    assert {r.text for r in rows if r.doc_id == 2} == {""} and {r.n_chars for r in rows if r.doc_id == 2} == {0}
    assert next(r for r in rows if r.doc_id is None and r.text).text == TEXT + " end"
    counted = substrings.dedup_substrings(docs, counts=True)
    assert sorted(counted.columns) == sorted(set(docs.columns) | {"n_removed"})
    assert substrings.dedup_substrings(none).count() == 0


def test_bpe(docs, none):
    rows = bpe.encode(docs, tokenizer_path()).collect()
    assert len(rows) == len(ROWS)
    assert all(r.n_tokens == len(r.ids) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert bpe.encode(none, tokenizer_path()).count() == 0


def test_html(spark):
    rows = [(1, None), (2, ""), (None, "<p>x"), (2, "<p>y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, html string, text int")
    assert sorted((r.page_id or 0, r.text, r.n_lines) for r in html.extract_pages(df).collect()) == [(0, "x", 1), (1, "", 0), (2, "", 0), (2, "y", 1)]
    assert html.extract_pages(df.limit(0)).count() == 0


def test_stages_keep_columns_and_survive(spark, docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_pipeline_leaves_no_copies_and_no_leaks(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) > 0
