"""Fill-in-middle against plain slices."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from medialens.llm import infill

ALPHABET = "ab \n\r\té́‍\U0001f600\U0001f468中<>PSM/ \x00﻿"


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
    return (n, "spm", a, b - a, s + p + m) if h4 % 100 < 20 else (n, "psm", a, b - a, p + s + m)


def test_forms_against_slices(spark):
    rng = random.Random(8)
    texts = [None, "", "<P>", "x<S>y", "<<S", "<", "a", "<<P<", "word " * 50_000, "\U0001f600" * 5000]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.choice([1, 2, 5, 40, 63, 64, 65, 128, 1000, 3000]))) for _ in range(250)]
    rows = [(k * 1000 + i, t) for k in range(2) for i, t in enumerate(texts)] + [(None, "a null id"), (None, None), (-5, "negative id")] + [(7, "again")] * 3
    out = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    order = lambda rows: sorted(rows, key=repr)
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()]
    assert order(got) == order((i, *brute(i, t)) for i, t in rows)
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = [(r.doc_id, r.output_sha256, r.restored_sha256) for r in infill.digests(out).collect()]
    assert order(digests) == order((i, sha(brute(i, t)[4]), sha(t or "")) for i, t in rows)


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 127, 128, 129, 256, 1000])
def test_ruler(monkeypatch, size):
    monkeypatch.setattr(infill, "PIECE", 2 * infill.BLOCK)
    rng, ruler = random.Random(size), infill.Ruler()
    text = "".join(rng.choice(ALPHABET) for _ in range(size))
    n, starts = ruler.measure(text)
    assert n == size and starts == list(range(0, size, infill.BLOCK))
    assert [ruler.place(text, starts, k) for k in range(0, size + 1, 3)] == list(range(0, size + 1, 3))
    assert ruler.place(text, starts, size) == size


def test_edges(spark):
    clashes = ["n", "form", "prefix", "MIDDLE", "suffix", "output", "whole", "__digest", "a.b", "prefix_chars"]
    df = spark.createDataFrame([(1, "some text"), (1, "some text"), (2, None)], "doc_id long, text string").select("*", *[F.lit(7).alias(c) for c in clashes])
    out = infill.fill_in_middle(df)
    assert out.count() == 3 and set(df.columns) <= set(out.columns)
    assert [tuple(r) for r in out.select("`a.b`", "__digest", "MIDDLE").distinct().collect()] == [(7, 7, 7)]
    assert infill.digests(infill.fill_in_middle(df.limit(0))).count() == 0
