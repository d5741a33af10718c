"""A remote annotator as a Spark data source: reads what it has annotated, and sends it what it shall annotate.

    spark.dataSource.register(AnnotatorSource)
    spark.read.format("annotator").option("url", url).option("partitions", 8).load()
    annotate(requests, url, folder)

The service answers GET {url}/annotations?part=k&of=n with one JSON object a line, and POST {url}/annotate (one JSON object: the row) with a JSON object. A
call that fails is made again after a fixed time, so many times; what still fails becomes a row with its error, and the others go on. Rows are sent by the tasks that hold
them. Each task writes its answers to a file of its own in the shared folder and returns that file's name as its commit message; answers count once the driver has
committed all of them, and those of an aborted or lost run are never read.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

RETRIES, BACKOFF_SECONDS, TIMEOUT_SECONDS = 3, 2.0, 60.0
SCHEMA = "image_id string, annotation string, error string"


def call(url: str, body: dict | None, options: dict) -> str:
    """The answer to one request; the last error if all tries fail. Answers that say the request itself is wrong (4xx but 408 and 429) are not tried again."""
    tries = int(options.get("retries", RETRIES)) + 1
    for k in range(tries):
        try:
            request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=float(options.get("timeout", TIMEOUT_SECONDS))) as answer:
                return answer.read().decode("utf-8")
        except (urllib.error.URLError, OSError) as e:
            code = getattr(e, "code", 500)
            if k + 1 == tries or 400 <= code < 500 and code not in (408, 429):
                raise
            time.sleep(float(options.get("backoff", BACKOFF_SECONDS)))
    raise AssertionError("unreachable")


@dataclass
class Part(InputPartition):
    k: int
    of: int

    def __init__(self, k: int, of: int):
        super().__init__(k)
        self.k, self.of = k, of


@dataclass
class Answers(WriterCommitMessage):
    """What one task has written."""

    file: str
    answered: int
    failed: int


def _rows(lines: Iterator[str]) -> Iterator[tuple]:
    for line in lines:
        try:
            row = json.loads(line)
        except ValueError:
            continue
        if isinstance(row, dict) and row.get("image_id") is not None:
            annotation = row.get("annotation")
            yield str(row["image_id"]), annotation if annotation is None or isinstance(annotation, str) else json.dumps(annotation, sort_keys=True), row.get("error")


class AnnotationReader(DataSourceReader):
    """One partition for each part of the service's annotations; lines that are no annotation are left out."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Part]:
        n = int(self.options.get("partitions", 1))
        return [Part(k, n) for k in range(n)]

    def read(self, partition: Part) -> Iterator[tuple]:
        return _rows(call(f"{self.options['url']}/annotations?part={partition.k}&of={partition.of}", None, self.options).splitlines())


class AnnotationWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.options = dict(options)

    def _folder(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.options["folder"])

    def write(self, rows: Iterator[Row]) -> Answers:
        store, folder = self._folder()
        store.create_dir(folder)
        file, answered, failed = f"answers-{uuid.uuid4().hex}.jsonl", 0, 0
        with store.open_output_stream(f"{folder}/{file}") as out:
            for row in rows:
                line = {"image_id": row["image_id"]}
                try:
                    line["annotation"] = json.loads(call(f"{self.options['url']}/annotate", row.asDict(recursive=True), self.options))
                    answered += 1
                except (OSError, ValueError) as e:
                    line["error"] = f"{type(e).__name__}: {e}"[:500]
                    failed += 1
                out.write(json.dumps(line).encode() + b"\n")
        return Answers(file, answered, failed)

    def commit(self, messages: list[Answers | None]) -> None:
        store, folder = self._folder()
        store.create_dir(folder)
        done = {"files": [m.file for m in messages if m], "answered": sum(m.answered for m in messages if m), "failed": sum(m.failed for m in messages if m)}
        name = f"{folder}/commit-{time.time_ns():020d}"
        with store.open_output_stream(f"{name}.tmp") as out:
            out.write(json.dumps(done).encode())
        store.move(f"{name}.tmp", f"{name}.json")

    def abort(self, messages: list[Answers | None]) -> None:
        store, folder = self._folder()
        for m in messages:
            if m:
                store.delete_file(f"{folder}/{m.file}")


class AnnotatorSource(DataSource):
    """Options: url; for reading `partitions`; for writing `folder` (a URI that driver and executors share); retries, backoff and timeout in seconds."""

    @classmethod
    def name(cls) -> str:
        return "annotator"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AnnotationReader:
        return AnnotationReader(self.options)

    def writer(self, schema, overwrite: bool) -> AnnotationWriter:
        if overwrite:
            raise ValueError("answers are only appended")
        return AnnotationWriter(self.options)


def committed(spark, folder: str) -> DataFrame:
    """image_id, annotation, error of all answers that count: of an image the newest without an error, else its newest error. An empty or missing folder has none."""
    store, path = pafs.FileSystem.from_uri(folder)
    found = store.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    commits = sorted(f.path for f in found if f.base_name.startswith("commit-") and f.base_name.endswith(".json"))
    files = [(f, k) for k, c in enumerate(commits) for f in json.loads(store.open_input_stream(c).read())["files"]]
    if not files:
        return spark.createDataFrame([], SCHEMA)
    order = spark.createDataFrame(files, "file string, run int")
    lines = spark.read.schema("image_id string, annotation string, error string").json([f"{folder.rstrip('/')}/{f}" for f, _ in files])
    named = lines.select("image_id", "annotation", "error", F.regexp_extract(F.input_file_name(), "[^/]+$", 0).alias("file")).filter("image_id IS NOT NULL")
    newest = F.max_by(F.struct("annotation", "error"), F.struct(F.col("error").isNull(), "run", "annotation"))
    return named.join(F.broadcast(order), "file").groupBy("image_id").agg(newest.alias("a")).select("image_id", "a.*")


def annotate(requests: DataFrame, url: str, folder: str, **options) -> DataFrame:
    """Sends those rows of requests (image_id and what else the service needs) that have no answer yet, and returns all answers that count.

    A second run sends what failed or was lost in the first; of repeated ids one row is sent, null ids are left out.
    """
    spark = requests.sparkSession
    spark.dataSource.register(AnnotatorSource)
    answered = committed(spark, folder).filter("error IS NULL").select("image_id")
    waiting = requests.filter("image_id IS NOT NULL").dropDuplicates(["image_id"]).join(answered, "image_id", "left_anti")
    writer = waiting.write.format("annotator").mode("append").option("url", url).option("folder", folder)
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.save()
    return committed(spark, folder)
