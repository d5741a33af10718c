"""Resampling and perceptual hashes against plain loops."""

import math
import random

import pyarrow as pa
import pytest

from medialens.functions import pixels
from medialens.functions.hashing import perceptual_hash


def window(x):
    return 0.0 if abs(x) >= 3 else 1.0 if x == 0 else 3 * math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x) ** 2


def line(values, target):
    scale = len(values) / target
    reach, out = 3 * max(scale, 1.0), []
    for t in range(target):
        center = (t + 0.5) * scale
        taken = range(max(0, int(center - reach + 0.5)), min(len(values), int(center + reach + 0.5)))
        w = [window((k + 0.5 - center) / max(scale, 1.0)) for k in taken]
        out.append(min(255, max(0, math.floor(sum(a * values[k] for a, k in zip(w, taken, strict=True)) / sum(w) + 0.5))))
    return out


def plain(rows, width, height):
    across = [line(r, width) if len(r) != width else r for r in rows]
    columns = [line(c, height) if len(c) != height else list(c) for c in zip(*across, strict=True)]
    return [list(r) for r in zip(*columns, strict=True)]


def hashed(grey):
    c = [[math.sqrt((1 if u == 0 else 2) / 32) * math.cos(math.pi * (2 * k + 1) * u / 64) for k in range(32)] for u in range(8)]
    low = [sum(c[u][i] * grey[i][j] * c[v][j] for i in range(32) for j in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(low)
    bits = "".join(str(int(x > (middle[31] + middle[32]) / 2)) for x in low)
    return f"{int(bits, 2):016x}"


def image(rng, width, height, channels):
    return [rng.randrange(256) if rng.random() < 0.3 else (x * 7 + y * 3 + 40 * c) % 256 for y in range(height) for x in range(width) for c in range(channels)]


SIZES = [(32, 32, 1), (1, 1, 1), (5, 90, 1), (200, 33, 1), (64, 48, 3), (31, 31, 3), (100, 7, 3), (64, 48, 3)]


def test_hashes_equal_a_plain_loop_on_images_of_any_size(spark):
    rng = random.Random(2)
    rows = [(i, w, h, d, image(rng, w, h, d)) for i, (w, h, d) in enumerate(SIZES)]
    df = spark.createDataFrame(rows, "id int, width int, height int, channels int, pixels array<int>")
    got = {r.id: (r.grey, r.phash) for r in pixels.grey_thumbnails(df, "id").select("id", "grey", perceptual_hash("grey").alias("phash")).collect()}
    for i, w, h, d, numbers in rows:
        grey = [[numbers[(y * w + x)] if d == 1 else math.floor((299 * numbers[3 * (y * w + x)] + 587 * numbers[3 * (y * w + x) + 1] + 114 * numbers[3 * (y * w + x) + 2]) / 1000 + 0.5) for x in range(w)] for y in range(h)]
        small = plain(grey, 32, 32)
        assert [int(x) for x in got[i][0]] == [x for r in small for x in r], (w, h, d)
        if w > 1:
            assert got[i][1] == hashed(small), (w, h, d)


def test_other_sizes_and_edges(spark):
    rows = [(1, 2, 2, 1, [0, 255, 255, 0]), (1, 2, 2, 1, [0, 255, 255, 0]), (2, 2, 2, 1, [1, 2, 3]), (3, 2, 2, 2, [1] * 8), (4, None, 2, 1, [1, 2]), (5, 2, 1, 1, None), (6, 2, 1, 1, [None, 9]), (None, 1, 1, 1, [7])]
    df = spark.createDataFrame(rows, "id int, width int, height int, channels int, pixels array<int>")
    got = [(r.id, r.grey) for r in pixels.grey_thumbnails(df, "id", 2, 1).collect()]
    assert sum(i == 1 for i, _ in got) == 2 and len({tuple(g) for i, g in got if i == 1}) == 1
    assert {i for i, g in got if g is None} == {2, 3, 4, 5} and dict(got)[6] == [0, 9] and dict(got)[None] == [7, 7]
    assert pixels.grey_thumbnails(df.limit(0), "id").count() == 0


@pytest.mark.parametrize(("source", "target"), [(1, 32), (32, 32), (1000, 7), (33, 32), (7, 1000)])
def test_weights_sum_to_one(source, target):
    first, w = pixels.weights(source, target)
    assert len(first) == target and abs(w.sum(1) - 1).max() < 1e-12


def test_a_large_batch_is_handed_on_in_slices():
    n = 1000
    batch = pa.RecordBatch.from_pydict({"key": list(range(n)), "width": [2] * n, "height": [2] * n, "channels": [1] * n, "pixels": [[k % 256] * 4 for k in range(n)]})
    made = list(pixels._resample(iter([batch]), 2, 2))
    assert max(b.num_rows for b in made) <= 256 and [k for b in made for k in b["key"].to_pylist()] == list(range(n))
    assert [g[0] for b in made for g in b["grey"].to_pylist()] == [k % 256 for k in range(n)]
