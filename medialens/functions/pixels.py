"""Resampling of decoded images inside Arrow batches: a separable windowed sinc, and the grey values in front of the perceptual hash.

An image is a row of numbers with its width, height and channels (1 or 3, values interleaved). Rows of one size are resampled together: both passes are products with
one matrix of weights for each axis, which has a few numbers in each row whatever the size. Files are decoded by the caller's hook.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialens.functions.frames import ship

#: Half the width of the window, in samples of the coarser side.
LOBES = 3
#: Shares of red, green and blue in a grey value, in thousandths.
GREY = (299, 587, 114)
#: Pixels that are resampled together.
CELLS = 4_000_000
#: Images that are handed on at once; a batch of Spark's may hold ten thousand.
SLICE = 256


@lru_cache(maxsize=4096)
def weights(source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of `target` samples: the first of the source samples that it takes, and their weights (sum 1, zeros at the end)."""
    scale = source / target
    reach = LOBES * max(scale, 1.0)
    centers = (np.arange(target) + 0.5) * scale
    first = np.maximum((centers - reach + 0.5).astype(int), 0)
    last = np.minimum((centers + reach + 0.5).astype(int), source)
    taken = first[:, None] + np.arange(int((last - first).max()))[None, :]
    x = (taken + 0.5 - centers[:, None]) / max(scale, 1.0)
    w = np.where((taken < last[:, None]) & (np.abs(x) < LOBES), np.sinc(x) * np.sinc(x / LOBES), 0.0)
    return first, w / w.sum(1, keepdims=True)


def _along(pixels: np.ndarray, source: int, target: int) -> np.ndarray:
    """pixels (..., source) resampled to (..., target) and rounded to bytes, as images hold them between the passes."""
    first, w = weights(source, target)
    out = np.empty((*pixels.shape[:-1], target))
    for t in range(target):
        some = pixels[..., first[t] : first[t] + w.shape[1]]
        out[..., t] = some @ w[t, : some.shape[-1]]
    return np.clip(np.floor(out + 0.5), 0, 255)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Images (n, rows, columns) resampled to (n, height, width), columns first."""
    across = _along(pixels, pixels.shape[2], width) if pixels.shape[2] != width else pixels
    return _along(across.swapaxes(1, 2), pixels.shape[1], height).swapaxes(1, 2) if pixels.shape[1] != height else across


def grey(pixels: np.ndarray) -> np.ndarray:
    """Grey values of (n, rows, columns, 3)."""
    return np.floor((pixels @ np.array(GREY, np.float64)) / 1000 + 0.5)


def _resample(batches: Iterator[pa.RecordBatch], width: int, height: int) -> Iterator[pa.RecordBatch]:
    """Of (keys..., width, height, channels, pixels): keys and the resampled grey values, null where the numbers do not fit the size."""
    for batch in (some.slice(at, SLICE) for some in batches for at in range(0, some.num_rows, SLICE)):
        wide, high, deep = (np.asarray(batch[c].fill_null(0)) for c in ("width", "height", "channels"))
        column = batch["pixels"]
        offsets, values = np.asarray(column.offsets), column.values
        sizes = np.diff(offsets)
        sound = column.is_valid().to_numpy(zero_copy_only=False) & (wide > 0) & (high > 0) & np.isin(deep, (1, 3)) & (wide.astype(np.int64) * high * deep == sizes)
        out = [None] * len(column)
        shapes = np.stack([wide, high, deep], axis=1)
        for shape in np.unique(shapes[sound], axis=0):
            mine = np.flatnonzero(sound & (shapes == shape).all(1))
            w, h, d = (int(x) for x in shape)
            for at in range(0, len(mine), max(1, CELLS // (w * h * d))):
                some = mine[at : at + max(1, CELLS // (w * h * d))]
                numbers = np.stack([np.asarray(values.slice(offsets[i], sizes[i]).cast(pa.float64())) for i in some])
                numbers = np.nan_to_num(numbers).reshape(len(some), h, w, d)
                plain = numbers[..., 0] if d == 1 else grey(numbers)
                for i, small in zip(some, resized(plain, width, height), strict=True):
                    out[i] = small.ravel().tolist()
        keys = [n for n in batch.schema.names if n not in ("width", "height", "channels", "pixels")]
        yield pa.RecordBatch.from_arrays([*[batch[n] for n in keys], pa.array(out, pa.list_(pa.float64()))], names=[*keys, "grey"])


def grey_thumbnails(images: DataFrame, key: str, width: int = 32, height: int = 32, pixels: str = "pixels") -> DataFrame:
    """key, grey (width x height numbers, row by row) of images with width, height, channels and pixels.

    Null where pixels are null or their number is not width x height x channels, or channels are neither 1 nor 3. A null or broken number counts as 0. Repeated
    rows give a row each.
    """
    spark = images.sparkSession
    ship(spark)
    plain = images.select(F.col(key).alias("key"), *[F.col(c).cast("int").alias(c) for c in ("width", "height", "channels")], F.col(pixels).alias("pixels"))
    kind = plain.schema["key"].dataType.simpleString()
    done = plain.mapInArrow(partial(_resample, width=width, height=height), f"key {kind}, grey array<double>")
    return done.withColumnRenamed("key", key)
