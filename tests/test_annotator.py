"""The annotator's data source against a stub of the service."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from medialens.sources import annotator

FAST = {"retries": 2, "backoff": 0.01}


class Stub:
    """Answers each image; fails as often as `failing` says for it (by status code)."""

    def __init__(self):
        self.calls, self.failing, self.read = Counter(), {}, Counter()
        stub = self

        class Handler(BaseHTTPRequestHandler):
            def answer(self, code, body):
                self.send_response(code)
                self.end_headers()
                self.wfile.write(body.encode())

            def do_POST(self):
                row = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                stub.calls[row["image_id"]] += 1
                code, times = stub.failing.get(row["image_id"], (200, 0))
                if stub.calls[row["image_id"]] <= times:
                    self.answer(code, "no")
                else:
                    self.answer(200, json.dumps({"scene": "food", "of": row["path"]}) if row["image_id"] != "odd" else "no json")

            def do_GET(self):
                part, of = (int(x.split("=")[1]) for x in self.path.split("?")[1].split("&"))
                stub.read[part] += 1
                if part == 1 and stub.read[part] == 1:
                    return self.answer(503, "later")
                rows = [json.dumps({"image_id": i, "annotation": {"n": i}}) for i in range(20) if i % of == part]
                self.answer(200, "\n".join([*rows, "broken {", "[]", '{"annotation": 1}']))

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"


@pytest.fixture
def stub():
    made = Stub()
    yield made
    made.server.shutdown()


def requests(spark, n=12):
    rows = [(f"i{k}", f"/p/{k}") for k in range(n)]
    return spark.createDataFrame([*rows, rows[0], (None, "/none"), ("odd", "/odd")], "image_id string, path string").repartition(4)


def test_reads_all_parts_and_tries_again(spark, stub):
    spark.dataSource.register(annotator.AnnotatorSource)
    df = spark.read.format("annotator").option("url", stub.url).option("partitions", 3).option("backoff", 0.01).load()
    assert df.rdd.getNumPartitions() == 3
    assert sorted((int(r.image_id), json.loads(r.annotation)["n"], r.error) for r in df.collect()) == [(i, i, None) for i in range(20)]
    assert stub.read[1] > stub.read[0]


def test_failures_stay_apart_and_a_second_run_sends_only_them(spark, stub, tmp_path):
    stub.failing = {"i3": (503, 2), "i5": (500, 3), "i7": (400, 1)}
    folder = f"file://{tmp_path}/answers"
    first = {r.image_id: r for r in annotator.annotate(requests(spark), stub.url, folder, **FAST).collect()}
    assert set(first) == {f"i{k}" for k in range(12)} | {"odd"}
    assert {k for k, r in first.items() if r.error} == {"i5", "i7", "odd"}
    assert (stub.calls["i3"], stub.calls["i5"], stub.calls["i7"], stub.calls["i0"]) == (3, 3, 1, 1)
    assert json.loads(first["i3"].annotation) == {"of": "/p/3", "scene": "food"}
    before = Counter(stub.calls)
    second = {r.image_id: r for r in annotator.annotate(requests(spark), stub.url, folder, **FAST).collect()}
    assert {k for k in stub.calls if stub.calls[k] > before[k]} == {"i5", "i7", "odd"}
    assert {k for k, r in second.items() if r.error} == {"odd"}


def test_only_committed_answers_count(spark, stub, tmp_path):
    folder = f"file://{tmp_path}/answers"
    assert annotator.committed(spark, folder).count() == 0
    writer = annotator.AnnotationWriter({"url": stub.url, "folder": folder, **FAST})
    from pyspark.sql import Row

    lost = writer.write(iter([Row(image_id="x", path="/x")]))
    assert (lost.answered, lost.failed) == (1, 0) and annotator.committed(spark, folder).count() == 0
    writer.abort([lost, None])
    assert not list((tmp_path / "answers").glob("answers-*"))
    kept = writer.write(iter([Row(image_id="y", path="/y")]))
    writer.commit([kept, None])
    assert [r.image_id for r in annotator.committed(spark, folder).collect()] == ["y"]
    with pytest.raises(ValueError, match="appended"):
        annotator.AnnotatorSource({}).writer(None, True)
