"""Content and perceptual hashes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from medialens.functions.vectors import bound


def median64(values: Column) -> Column:
    """Median of 64 numbers: the mean of the middle two."""
    return bound(F.sort_array(values), lambda s: (F.get(s, F.lit(31)) + F.get(s, F.lit(32))) / 2)


def perceptual_bits(values: Column) -> Column:
    """64 bits, one for each value above the median, the first value in the highest bit, as a signed long."""

    def against(m: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > m, F.lit(1)).otherwise(F.lit(0)).cast("bigint")))

    return bound(median64(values), against)


def hex64(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def from_hex64(text: Column) -> Column:
    """Bits of 1 to 16 hex digits; null for anything else."""
    return F.when(text.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(text, 16, -10).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hamming_hex(a: Column, b: Column) -> Column:
    """Hamming distance of hex hashes; 64 if either can't be read."""
    return F.coalesce(hamming(from_hex64(a), from_hex64(b)), F.lit(64))


def prefix_bucket(bits: Column, width: int = 16) -> Column:
    """The first bits of a 64-bit hash, as a number: images of one bucket are looked at together."""
    return F.shiftrightunsigned(bits, 64 - width).cast("int")


@F.pandas_udf(StringType())
def content_hash(content: pd.Series) -> pd.Series:
    """XXH64 (seed 0) of binary content as 16 hex digits; the built-in xxhash64 has another seed."""
    import xxhash

    return content.map(lambda b: None if b is None else xxhash.xxh64_hexdigest(bytes(b)))


@F.pandas_udf(StringType())
def perceptual_hash(pixels: pd.Series) -> pd.Series:
    """Perceptual hash of 32 x 32 grey images (1,024 numbers, row by row): low frequencies of the cosine transform
    against their median. Decoding and scaling of image files are hooks of the caller."""
    import numpy as np

    k = np.arange(32)
    basis = (np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64) * np.sqrt(np.where(k == 0, 1 / 32, 2 / 32))[:, None])[:8]
    whole = pixels.map(lambda p: p is not None and len(p) == 1024).to_numpy(bool)
    out = np.full(len(pixels), None, object)
    if whole.any():
        grey = np.stack([np.asarray(p, float) for p in pixels[whole]]).reshape(-1, 32, 32)
        low = (basis @ grey @ basis.T).reshape(-1, 64)
        packed = np.packbits(low > np.median(low, axis=1)[:, None], axis=1)
        out[whole] = [row.tobytes().hex() for row in packed]
    return pd.Series(out, index=pixels.index)


def params_hash(params_json: Column) -> Column:
    """SHA-256 of canonical JSON (sorted keys, no spaces), which the caller provides."""
    return F.sha2(params_json, 256)


def version_key(model: Column, params: Column) -> Column:
    """`model:hash`, or the hash alone without a model."""
    return F.concat_ws(":", F.when(F.length(F.coalesce(model, F.lit(""))) > 0, model), params)
