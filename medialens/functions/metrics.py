"""Score and metric expressions."""

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def logistic(x: Column) -> Column:
    """1 / (1 + e^-x) without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))


def ratio(n: Column, d: Column) -> Column:
    """n / d, 0 where d is 0."""
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2.0 * tp, 2 * tp + fp + fn)


def softmax_over(x: Column, *keys: str) -> Column:
    w = Window.partitionBy(*keys)
    e = F.exp(x - F.max(x).over(w))
    return e / F.sum(e).over(w)


def route(confidence: Column, auto: float = 0.8, suggest: float = 0.5) -> Column:
    """What happens with a prediction: taken, offered, or left to people."""
    return F.when(confidence >= auto, "auto").when(confidence >= suggest, "suggest").otherwise("manual")


def top_mean(xs: Column, k: int = 3) -> Column:
    """Mean of the k largest elements of an array."""
    top = F.slice(F.sort_array(xs, asc=False), 1, k)
    return F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.size(top)
