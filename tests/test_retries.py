"""Retries, dead letters, duplicates and restarts of the stateful stream."""

from datetime import datetime, timedelta

import pytest

from medialens.streaming import retries

START = datetime(2024, 5, 1)


def at(hours):
    return START + timedelta(hours=hours)


#: Files of messages: id, image, hours, payload (which tries fail, "always", or "crash").
FILES = [
    [("a", "i1", 0, ""), ("b", "i1", 1, "1"), ("c", "i2", 1, "always"), ("a", "i1", 0.5, "always"), (None, "i2", 1, "")],
    [("b", "i1", 2, ""), ("d", "i3", 30, "1,2"), ("e", None, 30, "")],
    [("f", "i1", 100, ""), ("late", "i9", 1, ""), ("a", "i1", 0, "")],
    [("a", "i1", 120, "again"), ("g", "i2", 200, "")],
    [("h", "i2", 300, "")],
    [("i", "i2", 400, "")],
]
WANT = {
    ("a", "i1", 1, "done", None), ("b", "i1", 2, "done", None), ("c", "i2", 3, "dead", "no"), ("d", "i3", 3, "done", None), ("e", None, 1, "done", None), ("f", "i1", 1, "done", None),
    ("g", "i2", 1, "done", None), ("h", "i2", 1, "done", None), ("i", "i2", 1, "done", None),
}


def handler(image, payload, attempt):
    if payload == "again":
        return None
    return "no" if payload == "always" or str(attempt) in (payload or "").split(",") else None


def write(spark, folder, rows):
    spark.createDataFrame([(m, i, at(h), p) for m, i, h, p in rows], retries.MESSAGE).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def go(spark, folder, work=handler):
    stream = spark.readStream.schema(retries.MESSAGE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    retries.run(stream, work, f"{folder}/out", f"{folder}/checkpoint", attempts=3, backoff="1 hour", lateness="24 hours").awaitTermination()


def result(spark, folder):
    return sorted(((r.message_id, r.image_id, r.attempts, r.outcome, r.error) for r in retries.read_outcomes(spark, f"{folder}/out").collect()), key=str)


def test_retries_dead_letters_duplicates_and_restarts(spark, tmp_path):
    for rows in FILES:
        write(spark, f"{tmp_path}/a", rows)
        go(spark, f"{tmp_path}/a")
    # an id that the watermark has let the state forget counts again
    want = sorted([*WANT, ("a", "i1", 1, "done", None)], key=str)
    assert result(spark, f"{tmp_path}/a") == want
    assert [r.message_id for r in spark.read.parquet(f"{tmp_path}/a/out/outcome=dead").collect()] == ["c"]


def test_a_query_that_dies_in_a_batch_gives_the_same_table(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    mark = tmp_path / "died"

    def dying(image, payload, attempt):
        if payload == "1,2" and attempt == 1 and not mark.exists():
            mark.touch()
            raise SystemExit("the worker is gone")
        return handler(image, payload, attempt)

    folder = f"{tmp_path}/b"
    for rows in FILES:
        write(spark, folder, rows)
        try:
            go(spark, folder, dying)
        except StreamingQueryException:
            go(spark, folder, dying)
    assert mark.exists()
    assert result(spark, folder) == sorted([*WANT, ("a", "i1", 1, "done", None)], key=str)


def test_errors_of_the_handler_are_kept_and_old_state_goes(spark):
    def broken(image, payload, attempt):
        raise ValueError("bad pixel")

    class State:
        exists, hasTimedOut, kept, due = False, False, None, None

        def getCurrentWatermarkMs(self):
            return self.now

        def update(self, value):
            self.exists, self.kept = True, value

        @property
        def get(self):
            return self.kept

        def setTimeoutTimestamp(self, ms):
            self.due = ms

        def remove(self):
            self.exists = False

    import pandas as pd

    worker, state = retries.Worker(broken, 2, 1000), State()
    state.now = 0
    frame = pd.DataFrame({"message_id": ["m"], "image_id": ["x"], "sent_at": [pd.Timestamp(5, unit="ms")], "payload": ["p"]})
    assert list(worker(("x",), iter([frame]), state)) == [] and state.exists and state.due == 6
    state.hasTimedOut, state.now = True, 2000
    (out,) = worker(("x",), iter([]), state)
    assert out.iloc[0].tolist()[4:] == [2, "dead", "ValueError: bad pixel"] and not state.exists


def test_one_call_works_on_all_images_of_a_group(spark):
    """Each image apart, with one message id in all; a call for each image took most of the time."""
    import pandas as pd

    class State:
        exists = hasTimedOut = False

        def getCurrentWatermarkMs(self):
            return 0

        def update(self, value):
            self.kept = value

        def setTimeoutTimestamp(self, ms):
            self.due = ms

    state = State()
    frame = pd.DataFrame({"message_id": ["m"] * 4, "image_id": ["x", "y", None, "y"], "sent_at": [pd.Timestamp(n, unit="ms") for n in (5, 7, 3, 9)], "payload": ["", "", "", ""]})
    (out,) = retries.Worker(handler, 3, 1000)((0,), iter([frame[:1], frame[1:]]), state)
    assert dict(zip(out["image_id"], out["sent_at"], strict=True)) == {i: pd.Timestamp(ms, unit="ms") for i, ms in ((None, 3), ("x", 5), ("y", 7))} and len(out) == 3
    assert state.due == 4


@pytest.mark.parametrize("rows", [[], [(None, "i", 0, "")]])
def test_nothing_to_do(spark, tmp_path, rows):
    spark.createDataFrame([(m, i, at(h), p) for m, i, h, p in rows], retries.MESSAGE).write.parquet(f"{tmp_path}/in")
    go(spark, str(tmp_path))
    assert spark.read.schema(retries.OUTCOME).option("ignoreMissingFiles", "true").parquet(f"{tmp_path}/out").count() == 0
