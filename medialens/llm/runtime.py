"""Shared helpers: clash-free names, the shared checkpoint folder, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialens.operators.graph import shared_folder

#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACE = " \t\n\x0b\x0c\r"
#: The same as a character class of a Java regular expression.
SPACE_CLASS = r"[ \t-\r]"

#: Largest side that is ever broadcast by hint, in rows; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        candidate = f"__{name}"
        while candidate.lower() in taken:
            candidate += "_"
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder, which outlives executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def within_rows(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `limit` rows; stops counting one row beyond it."""
    return df.limit(limit + 1).count() <= limit


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_medialens_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="medialens-")) / "medialens_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "medialens").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(target))
    context._medialens_shipped = True


def release_memory() -> None:
    """Gives free memory of a Python worker back to the machine; workers live on after their task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not on this platform
        pass


def _tidy(function):
    def run(batches):
        try:
            yield from function(batches)
        finally:
            release_memory()

    return run


def map_pandas(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInPandas with this package importable on the executors."""
    ship(df.sparkSession)
    return df.mapInPandas(_tidy(function), schema)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with this package importable on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(_tidy(function), schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again; deleted when the application ends. Texts take much less disk by zstd."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/medialens-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow_rows(df: DataFrame, function, added: str = "") -> DataFrame:
    """mapInArrow over whole rows: function gets and returns batches of all columns, in order, with the `added` ones
    (name and type) after them. Columns travel under plain names, so any name is safe."""
    plain = df.select(*[col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    fields = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields)]
    extra = [x.strip() for x in added.split(",") if x.strip()]
    done = map_arrow(plain, function, ", ".join([*fields, *extra]))
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)], *[F.col(x.split()[0]) for x in extra])
