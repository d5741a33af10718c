"""Expressions over boxes with corners in [0, 1]."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x_min", "y_min", "x_max", "y_max"))


def area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for boxes that do not meet or are empty."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = w * h
    signed = lambda x: F.greatest(F.lit(0.0), (x[2] - x[0]) * (x[3] - x[1]))
    union = signed(a) + signed(b) - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(F.lit(0.0))


@F.arrow_udf(DoubleType())
def power(x: pa.Array, y: pa.Array) -> pa.Array:
    """x to the power of y by the C library, as databases have it. Spark's own pow() is off by a last bit for one value of ten, which orders and cuts
    near-equal priorities otherwise."""
    return pc.power(x, y)


def priority(b: Box, score: Column, gamma: float = 0.3, center_penalty: float = 0.6) -> Column:
    """Score, weighted by area and by nearness to the image's center."""
    dx, dy = (b[0] + b[2]) / 2 - 0.5, (b[1] + b[3]) / 2 - 0.5
    near = F.greatest(F.lit(0.0), 1.0 - center_penalty * F.sqrt(dx * dx + dy * dy))
    return score * power(F.greatest(F.lit(1e-6), area(b)).cast("double"), F.lit(float(gamma))) * near


def fallback_box(mx: float, my: float) -> Box:
    """The box of a region made from a caption."""
    return F.lit(mx), F.lit(my), F.lit(max(mx, 1 - mx)), F.lit(max(my, 1 - my))


def pixel_box(b: Box, width: Column, height: Column) -> Box:
    """Corners in pixels, rounded half to even and kept inside the image."""
    put = lambda x, n: F.greatest(F.lit(0), F.least(n.cast("int"), F.bround(x * n, 0).cast("int")))
    return put(b[0], width), put(b[1], height), put(b[2], width), put(b[3], height)


def normalized(b: Box, width: Column, height: Column) -> Box:
    """Detector corners in pixels to [0, 1], clamped."""
    put = lambda x, n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / n))
    return put(b[0], width), put(b[1], height), put(b[2], width), put(b[3], height)
