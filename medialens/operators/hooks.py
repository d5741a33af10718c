"""Places for models and decoders: functions of the caller over Arrow-batched rows, with errors kept apart.

The engine ships no model. An encoder (of images, texts or captions), a decoder, a detector or a remote annotator is
a pair of functions: one that loads it, once in a worker, and one that takes a value and gives a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOADED: dict[str, Any] = {}


def apply_model(df: DataFrame, key: str, value: str, load: Callable[[], Any], call: Callable[[Any, Any], Any], result_type: str, name: str) -> DataFrame:
    """key, result, status (`complete` or `error`), error_message of each row.

    The model is loaded once in a worker under `name`. A row that fails, or whose value is null, is an error row and
    the others go on. Columns that are not needed are not sent.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _LOADED:
            _LOADED[name] = load()
        model = _LOADED[name]
        for batch in batches:
            out = []
            for k, v, missing in zip(batch["k"], batch["v"], batch["missing"], strict=True):
                try:
                    if missing:
                        raise ValueError("no value")
                    out.append((k, call(model, v), "complete", None))
                except Exception as e:  # noqa: BLE001  one bad row must not end the batch
                    out.append((k, None, "error", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "result", "status", "error_message"])

    return df.select(F.col(key).alias("k"), F.col(value).alias("v"), F.col(value).isNull().alias("missing")).mapInPandas(run, f"{key} {kind}, result {result_type}, status string, error_message string")


def counted(df: DataFrame, name: str = "progress", **metrics) -> DataFrame:
    """df with metrics (name -> column) that are gathered while it runs; a query listener or Observation reads them."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()])


def artifact_rows(results: DataFrame, artifact_type: str, version_key: str) -> DataFrame:
    """Rows of the artifact table from apply_model(): image_id, artifact_type, version_key, status, error_message, checksum."""
    return results.select("image_id", F.lit(artifact_type).alias("artifact_type"), F.lit(version_key).alias("version_key"), "status", "error_message", F.sha2(F.to_json(F.struct("result")), 256).alias("checksum"))
