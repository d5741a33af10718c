"""Messages worked on with retries: state of each image, a dead-letter table, duplicates told apart within a watermark.

Messages of one image meet in its state, in order of time. States of images are held together in groups by hash, as a call for each image costs
more than its few messages. What fails waits there and is tried again when event time has passed its due time; after the
last try it goes to the dead letters. The ids that an image has seen are forgotten once they are older than the watermark, as a message of that age is
late whatever its id. Outcomes are appended to Parquet files by the exactly-once sink, so a restarted query gives the same table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MESSAGE = "message_id string, image_id string, sent_at timestamp, payload string"
OUTCOME = f"{MESSAGE}, attempts int, outcome string, error string"

#: Groups that the images are dealt into, for the life of a checkpoint, and outcomes handed on at once.
GROUPS, HANDED = 512, 10_000

#: Works on (image_id, payload, attempt); returns what went wrong, or None.
Handler = Callable[[str | None, str | None, int], str | None]


class Worker:
    """What happens to the messages of a group of images in a batch, or when event time reaches the first due time of its state."""

    def __init__(self, handler: Handler, attempts: int, backoff_ms: int):
        self.handler, self.attempts, self.backoff_ms = handler, attempts, backoff_ms

    def _try(self, image, message: dict, now: int, waiting: list[dict], out: list[tuple]) -> None:
        message["attempts"] += 1
        try:
            error = self.handler(image, message["payload"], message["attempts"])
        except Exception as e:  # noqa: BLE001  one message must not stop the others
            error = f"{type(e).__name__}: {e}"
        if error is not None and message["attempts"] < self.attempts:
            waiting.append(message | {"due": max(now, message["at"]) + self.backoff_ms})
        else:
            out.append(self._row(image, message, "done" if error is None else "dead", error))

    def _row(self, image, message: dict, outcome: str, error: str | None) -> tuple:
        return message["id"], image, message["us"], message["payload"], message["attempts"], outcome, error

    def _image(self, image, seen: dict, before: list[dict], new: list[tuple], now: int, out: list[tuple]) -> tuple[dict, list[dict]]:
        """What an image has seen and what waits, after the tries that are due and the new messages (time, id, payload)."""
        waiting = []
        for message in sorted(before, key=lambda m: (m["due"], m["id"])):
            if message["due"] > now:
                waiting.append(message)
            else:
                self._try(image, message, now, waiting, out)
        for us, name, payload in sorted(new, key=lambda r: (r[0], r[1], r[2] is not None, r[2])):
            sent = us // 1000
            message = {"id": name, "at": sent, "us": us, "payload": payload, "attempts": 0}
            if sent < now:
                out.append(self._row(image, message, "late", None))
            elif name not in seen:
                seen[name] = sent
                self._try(image, message, now, waiting, out)
        return {k: v for k, v in seen.items() if v >= now}, waiting

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = {image: (seen, waiting) for image, seen, waiting in json.loads(state.get[0])} if state.exists else {}
        now, new, after, out = max(state.getCurrentWatermarkMs(), 0), {}, [], []
        if not state.hasTimedOut:
            for frame in frames:
                at = frame["sent_at"].astype("datetime64[us]").astype("int64").tolist()
                for image, *message in zip(frame["image_id"].tolist(), at, frame["message_id"].tolist(), frame["payload"].tolist(), strict=True):
                    new.setdefault(image, []).append(message)
        for image in kept | new:
            seen, waiting = self._image(image, *kept.get(image, ({}, [])), new.get(image, ()), now, out)
            if seen or waiting:
                after.append((image, seen, waiting))
        if after:
            state.update((json.dumps(after),))
            state.setTimeoutTimestamp(max(now + 1, min(t for _, seen, waiting in after for t in (*(m["due"] for m in waiting), *(v + 1 for v in seen.values())))))
        elif state.exists:
            state.remove()
        for i in range(0, len(out), HANDED):
            rows = pd.DataFrame(out[i : i + HANDED], columns=[x.split()[0] for x in OUTCOME.split(", ")])
            yield rows.assign(sent_at=pd.to_datetime(rows["sent_at"], unit="us"))


def outcomes(messages: DataFrame, handler: Handler, attempts: int = 3, backoff: str = "1 hour", lateness: str = "1 day", groups: int = GROUPS) -> DataFrame:
    """OUTCOME rows of a stream of messages (MESSAGE): done, or dead (after so many tries). Messages older than the watermark of the batch before are dropped by Spark;
    one that the watermark passes in its own batch is late and not worked on.

    Of messages with one id and image the first counts (by time, then payload). Ids and times must not be null; such rows are left out. Messages with a null image are those of one image. A
    try comes due `backoff` after the last one in event time, so a stream without new messages makes none; its last failures then wait in the state.
    """
    pause = int(pd.Timedelta(backoff) / pd.Timedelta(milliseconds=1))
    rows = messages.filter("message_id IS NOT NULL AND sent_at IS NOT NULL").withWatermark("sent_at", lateness)
    worker = Worker(handler, attempts, pause)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("image_id"), F.lit(groups)).cast("int"))
    return dealt.groupBy("part").applyInPandasWithState(worker, OUTCOME, "kept string", "append", GroupStateTimeout.EventTimeTimeout)


def run(messages: DataFrame, handler: Handler, folder: str, checkpoint: str, **options):
    """Starts a query that appends outcomes below the folder, a partition for each outcome (`outcome=dead` has the dead letters); stops when all is read."""
    writer = outcomes(messages, handler, **options).writeStream.format("parquet").partitionBy("outcome").outputMode("append")
    return writer.option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_outcomes(spark, folder: str) -> DataFrame:
    """What run() has written, files of unfinished batches left out."""
    return spark.read.schema(OUTCOME).parquet(folder).select(*[F.col(x.split()[0]) for x in OUTCOME.split(", ")])
