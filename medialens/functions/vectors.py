"""Vector expressions over array columns, accumulated in double."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row: an expression that lambdas repeat would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """The unit vector; null for a zero or null vector, which callers filter out."""
    return bound(v, lambda w: bound(norm(w), lambda n: F.when(n > 0, F.transform(w, lambda x: x / n))))


def cosine(a: Column, b: Column) -> Column:
    return bound(norm(a) * norm(b), lambda d: F.when(d > 0, dot(a, b) / d))


def half_shift(similarity: Column) -> Column:
    """A cosine moved from [-1, 1] to [0, 1]."""
    return (similarity + 1) / 2


def sum_by(df: DataFrame, keys: list[str], vec: str, out: str) -> DataFrame:
    """keys, out (element-wise sum) and n. Elements are summed with partial aggregation by (keys, index), so a hot key
    never gathers its vectors in one task."""
    parts = df.select(*keys, F.posexplode(vec).alias("__i", "__x")).groupBy(*keys, "__i").agg(F.sum("__x").alias("__x"), F.count(F.lit(1)).alias("__n"))
    packed = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__i", "__x"))).alias("__v"), F.max("__n").alias("n"))
    return packed.select(*keys, F.transform("__v", lambda s: s["__x"]).alias(out), "n")


def mean_by(df: DataFrame, keys: list[str], vec: str, out: str) -> DataFrame:
    summed = sum_by(df, keys, vec, out)
    return summed.withColumn(out, F.transform(out, lambda x: x / F.col("n")))


def synthetic(name: Column, size: int, bumps: dict[str, tuple[int, int]] | None = None) -> Column:
    """A unit vector that only the name decides, for tests without a model: normal numbers from its hashes, with 2 added
    to the elements [from, to) of each keyword of bumps that the name holds."""
    unit = lambda i, k: (F.shiftrightunsigned(F.xxhash64(name, i, F.lit(k)), 11).cast("double") + 1) * F.lit(2.0**-53)
    raised = lambda i: sum((F.when(F.contains(F.lower(name), F.lit(word)) & (i >= a) & (i < b), 2.0).otherwise(0.0) for word, (a, b) in (bumps or {}).items()), F.lit(0.0))
    return l2_normalize(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.sqrt(-2 * F.log(unit(i, 1))) * F.cos(2 * F.pi() * unit(i, 2)) + raised(i)))


def linear_head(v: Column, weights: Column, bias: Column) -> Column:
    return dot(v, weights) + bias
