"""Exact top-k search by inner product with pivot-table elimination.

The distances of every vector to many pivots stand in a table. By the triangle inequality their differences bound the distance of a
query and a candidate from below (the largest one counts), and with it their inner product from above, as
2 <q, x> = |q|^2 + |x|^2 - |q - x|^2. Candidates are evaluated in the order of that bound until no bound reaches the k-th score.

The table is range-partitioned by nearest pivot and distance into chunks. A query meets its own chunk first, which gives it a
score to beat, and then those chunks whose ranges of distances can hold a better one: the chunk's rows are held by a task, the queries
stream past them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialens.llm.runtime import col, map_arrow, written

TOP = 5
#: Queries are the rows whose id is divisible by this.
EVERY = 50
SCALE = 256
#: Pivots are chosen from a sample of so many rows (those with the smallest hashes), each the farthest from those before.
PIVOTS, SAMPLE_ROWS = 32, 2048
#: A chunk has about so many rows; a task holds one chunk.
CHUNK_ROWS = 4096
#: Bounds give way by this share of the lengths that they come from, for rounding.
SLACK = 1e-6
LIMIT = 2**31 - 1
NO_ID = np.iinfo(np.int64).max


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Up to `count` different rows of the sample, each the farthest from those chosen before."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _matrix(column: pa.Array, size: int, kind=np.int64) -> np.ndarray:
    """Rows of a list column, filled up with zeros to `size`."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), size), kind)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), kind))


def _distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((rows - p) ** 2).sum(1)) for p in points], axis=1)


def scores(rows: np.ndarray, query: np.ndarray, exact_floats: bool) -> np.ndarray:
    """Inner products as integers; by floats where these hold every sum exactly."""
    return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64) if exact_floats else rows @ query


class Chunk:
    """The rows of a chunk: ids (nulls marked), places, vectors, lengths and the pivot table."""

    def __init__(self, ids: pa.Array, places: np.ndarray, rows: np.ndarray, table: np.ndarray):
        self.missing = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(NO_ID).to_numpy()
        self.places, self.rows, self.table = places, rows, table
        self.squares = (rows.astype(np.float64) ** 2).sum(1)
        self.reach = table.max(1, initial=0) if table.size else np.zeros(len(rows))

    def best(self, query: np.ndarray, table: np.ndarray, own: int | None, k: int, bar: int | None) -> list[tuple[int, int]]:
        """(place in the chunk, score) of the k best rows but the one at place `own`, of those that reach `bar`; best first, ties to the smaller id."""
        square = float((query.astype(np.float64) ** 2).sum())
        apart = np.abs(self.table - table).max(1) - SLACK * (self.reach + table.max())
        above = (square + self.squares - np.maximum(apart, 0) ** 2) / 2 + SLACK * (square + self.squares) + 1
        if own is not None:
            above[self.places == own] = -np.inf
        open_rows = np.flatnonzero(above >= (-np.inf if bar is None else bar))
        open_rows = open_rows[above[open_rows] > -np.inf]
        order = open_rows[np.argsort(-above[open_rows], kind="stable")]
        exact = square * self.squares.max(initial=0) < 2.0**104  # by Cauchy and Schwarz no sum passes 2^52
        rows, found, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, 4 * k
        while at < len(order) and not (len(found) == k and above[order[at]] < found[-1]):
            some = order[at : at + step]
            rows, found = np.concatenate([rows, some]), np.concatenate([found, scores(self.rows[some], query, exact)])
            first = np.lexsort((self.ids[rows], self.missing[rows], -found))[:k]
            rows, found = rows[first], found[first]
            at, step = at + step, 2 * step
        return list(zip(rows.tolist(), found.tolist(), strict=True))


class _Table:
    """Computes the pivot table of batches."""

    def __init__(self, pivots: np.ndarray, size: int):
        self.pivots, self.size = pivots, size

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = _distances(_matrix(batch["v"], self.size, np.float64), self.pivots)
            near = table.argmin(1) if len(table) else np.empty(0, np.int64)
            arrays = [batch["id"], batch["v"], _lists(table, pa.float64()), pa.array(near, pa.int32()), pa.array(table[np.arange(len(table)), near])]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "v", "table", "near", "ring"])


class _Home:
    """Gives each query the k-th best score within its own partition, which becomes a chunk; null for other rows, or if there are fewer."""

    def __init__(self, size: int, k: int, every: int):
        self.size, self.k, self.every = size, k, every

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        ids, v = whole["id"].combine_chunks(), whole["v"].combine_chunks()
        chunk = Chunk(ids, np.arange(len(ids)), _matrix(v, self.size), _matrix(whole["table"].combine_chunks(), len(whole["table"][0]), np.float64))
        bars = np.zeros(len(ids), np.int64)
        known = np.zeros(len(ids), bool)
        for i in np.flatnonzero(~chunk.missing & (chunk.ids % self.every == 0)):
            got = chunk.best(chunk.rows[i], chunk.table[i], i, self.k, None)
            if len(got) == self.k:
                bars[i], known[i] = got[-1][1], True
        out = whole.select(["id", "v", "table", "chunk"])
        out = out.append_column("place", pa.array(np.arange(len(ids)), pa.int64())).append_column("bar", pa.array(bars, mask=~known))
        yield from out.to_batches(max_chunksize=10_000)


class _Pass:
    """Holds the rows of one chunk after another and gives the best of each for the queries that come after them."""

    def __init__(self, size: int, pivots: int, k: int):
        self.size, self.pivots, self.k = size, pivots, k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, chunk = None, [], None
        for batch in batches:
            chunks, kinds = batch["chunk"].to_numpy(), batch["asks"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(chunks) != 0) | (np.diff(kinds.astype(np.int8)) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(chunks)], strict=True):
                part = batch.slice(low, high - low)
                if not part.num_rows:
                    continue
                if chunks[low] != at:
                    at, held, chunk = chunks[low], [], None
                if not kinds[low]:
                    held.append(part)
                    continue
                if chunk is None:
                    rows = pa.Table.from_batches(held).combine_chunks() if held else None
                    chunk = rows and Chunk(rows["id"].combine_chunks(), rows["place"].to_numpy(), self._vectors(rows["v"].combine_chunks()), self._table(rows["table"].combine_chunks()))
                    held = []
                if chunk is not None:
                    yield self._answers(part, chunk, int(at))

    def _vectors(self, column) -> np.ndarray:
        return _matrix(column, self.size)

    def _table(self, column) -> np.ndarray:
        return _matrix(column, self.pivots, np.float64)

    def _answers(self, asked: pa.RecordBatch, chunk: Chunk, at: int) -> pa.RecordBatch:
        vectors, tables = self._vectors(asked["v"]), self._table(asked["table"])
        out = ([], [], [], [], [])
        for i, (query, home, place, bar) in enumerate(zip(*(asked[c].to_pylist() for c in ("id", "home", "place", "bar")), strict=True)):
            for row, score in chunk.best(vectors[i], tables[i], place if home == at else None, self.k, bar):
                for values, value in zip(out, (home, place, query, None if chunk.missing[row] else int(chunk.ids[row]), score), strict=True):
                    values.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(x, pa.int64()) for x in out[1:]]], names=["home", "place", "query_id", "vec_id", "score"])


def search(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = TOP, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query, ties to the smaller id.

    Components are floor(256 * x). Vectors that are null or hold a null, a component that is not finite or does not fit into 32 bits then, take no part.
    Shorter vectors count as filled up with zeros. A query is a row: repeated rows each ask and each are candidates,
    but for the row itself. A null id is a candidate only, after all others in a tie. Other columns are left out; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    floors = F.transform(col(vector), lambda x: F.floor(x.cast("double") * SCALE))
    sound = F.forall(col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * SCALE < LIMIT))
    rows = embeddings.filter(col(vector).isNotNull() & sound).select(col(vec_id).cast("long").alias("id"), floors.alias("v"))
    total, size = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    sample = [r.v for r in rows.orderBy(F.xxhash64("id", "v"), "id", "v").limit(SAMPLE_ROWS).collect()]
    size = max(size or 0, 1)
    filled = np.array([v + [0] * (size - len(v)) for v in sample] or [[0] * size], np.float64)
    pivots = choose_pivots(filled)
    table = map_arrow(rows, _Table(pivots, size), "id long, v array<bigint>, table array<double>, near int, ring double")
    keys = ["near", "ring", F.xxhash64("id", "v"), "id"]
    chunked = table.repartitionByRange(max(1, -(-total // CHUNK_ROWS)), *keys).select("id", "v", "table", F.spark_partition_id().alias("chunk"))
    held = written(map_arrow(chunked, _Home(size, k, every), "id long, v array<bigint>, table array<double>, chunk int, place long, bar long"), "pivots")

    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    ranges = [f(F.element_at("table", i + 1)) for f in (F.min, F.max) for i in range(len(pivots))]
    stats = held.groupBy("chunk").agg(F.array(*ranges[: len(pivots)]).alias("lows"), F.array(*ranges[len(pivots) :]).alias("highs"), F.max(square(F.col("v"))).alias("most"))
    chunks = (held.agg(F.max("chunk")).first()[0] or 0) + 1
    asking = held.filter(F.col("id") % every == 0).withColumnRenamed("chunk", "home").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    below = F.zip_with("table", F.arrays_zip("lows", "highs"), lambda d, r: F.greatest(r["lows"] - d, d - r["highs"], F.lit(0.0)) - SLACK * (d + r["highs"]))
    apart = F.greatest(F.array_max(below), F.lit(0.0))
    lengths = square(F.col("v")) + F.col("most")
    reach = (lengths - apart * apart) / 2 + SLACK * lengths + 1
    pairs = asking.join(stats, "chunk").filter(F.col("bar").isNull() | (reach >= F.col("bar"))).select("chunk", F.lit(True).alias("asks"), "id", "v", "table", "home", "place", "bar")
    both = held.select("chunk", F.lit(False).alias("asks"), "id", "v", "table", F.col("chunk").alias("home"), "place", "bar").unionByName(pairs)
    met = both.repartition(max(chunks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "chunk").sortWithinPartitions("chunk", "asks")
    found = map_arrow(met, _Pass(size, len(pivots), k), "home int, place long, query_id long, vec_id long, score long")
    best = Window.partitionBy("home", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
