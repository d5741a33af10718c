"""Thresholds from mergeable quantile sketches, and the samples around them.

A sketch of a key's scores has a fixed size whatever their number, and sketches of parts (days, batches) merge. Thresholds are quantiles of the sketch, so
no window runs over all distinct scores; what each threshold accepts is counted exactly, in one more pass. The rank of a picked threshold is off by a share of at most
about 2.3 / k^0.9 of the rows (99 % of the time); up to k rows the sketch is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialens.functions.frames import small_side
from medialens.functions.metrics import f1, ratio
from medialens.operators.graph import stored

#: Size of a sketch: ranks are off by 0.0013 or less.
SKETCH = 4096


def sketches(scores: DataFrame, key: str, p: str, size: int = SKETCH) -> DataFrame:
    """key, sketch of its scores; null keys, null scores and those that are no numbers do not count."""
    return scores.filter(F.col(key).isNotNull() & F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double"))).groupBy(key).agg(F.kll_sketch_agg_double(F.col(p).cast("double"), F.lit(size)).alias("sketch"))


def merged(parts: DataFrame, key: str) -> DataFrame:
    """key, sketch of all its parts."""
    return parts.groupBy(key).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def thresholds(sketched: DataFrame, key: str, count: int) -> DataFrame:
    """key, thresholds: its scores at `count` even ranks from the lowest to the highest, ascending, without repeats."""
    at = [F.kll_sketch_get_quantile_double("sketch", F.lit(k / max(1, count - 1))) for k in range(count)]
    return sketched.select(key, F.array_sort(F.array_distinct(F.array(*at))).alias("thresholds"))


def sketched_sweep(scores: DataFrame, key: str, p: str, truth: str, count: int = 200, size: int = SKETCH, sketched: DataFrame | None = None) -> DataFrame:
    """key, threshold, tp, fp, fn, precision, recall, f1 at thresholds of a sketch (of these scores, or one that is given), counted exactly.

    Rows are summed by the interval of thresholds that they lie in, so a hot key shuffles count + 1 rows a task. A row with a null truth counts as neither; rows with a null
    score, or of a key that the given sketch lacks, do not count.
    """
    # stored, as a sketch draws lots and would give other thresholds the next time
    picked = stored(thresholds(sketches(scores, key, p, size) if sketched is None else sketched, key, count))
    rows = scores.filter(F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double"))).join(small_side(picked), key)
    place = F.size(F.filter("thresholds", lambda t: t <= F.col(p).cast("double")))
    counts = rows.groupBy(key, place.alias("place")).agg(F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    grid = picked.select(key, F.posexplode("thresholds").alias("i", "threshold")).select(key, (F.col("i") + 1).alias("place"), "threshold")
    none = counts.filter("place = 0").select(key, "place", F.lit(None).cast("double").alias("threshold"))
    whole = grid.unionByName(none).join(counts, [key, "place"], "left").na.fill(0, ["pos", "neg"])
    down = Window.partitionBy(key).orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    sums = whole.select(key, "place", "threshold", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(Window.partitionBy(key)).alias("all"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("all") - F.col("tp")
    return sums.filter("place > 0").select(key, "threshold", "tp", "fp", fn.alias("fn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1"))


def _first(rows: DataFrame, key: str, order: list[Column], n: int, kind: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n).withColumn("kind", F.lit(kind))


def samples(scores: DataFrame, key: str, item: str, p: str, truth: str, cuts: DataFrame, n: int = 20) -> DataFrame:
    """key, kind, rank, item, p, truth: of each key the n rows nearest to its threshold (`borderline`), the n negatives with the highest scores at or above it
    (`false_positive`) and the n positives with the lowest scores below it (`false_negative`); ties by item.

    cuts: key, threshold. Each task passes on n rows of a key and kind at most. Rows with a null score or truth do not count.
    """
    rows = scores.filter(F.col(p).isNotNull() & F.col(truth).isNotNull()).select(key, item, p, truth).join(small_side(cuts.select(key, "threshold")), key)
    score, cut = F.col(p), F.col("threshold")
    parts = [
        _first(rows, key, [F.abs(score - cut), F.col(item)], n, "borderline"),
        _first(rows.filter(~F.col(truth) & (score >= cut)), key, [score.desc(), F.col(item)], n, "false_positive"),
        _first(rows.filter(F.col(truth) & (score < cut)), key, [score.asc(), F.col(item)], n, "false_negative"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(key, "kind", "rank", item, p, truth)
