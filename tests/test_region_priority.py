"""Priorities to the last bit, so that near-equal regions rank and stay as a database has them."""

import duckdb
import math

from medialens.operators import regions


def test_priorities_are_those_of_the_c_library_to_the_last_bit(spark):
    rows = [(k // 4, k % 4, (k % 11) / 20, (k % 9) / 20, min(1.0, (k % 11) / 20 + 0.1 + (k % 50 + 1) / 100), min(1.0, (k % 9) / 20 + 0.1 + (k % 37) / 100), (k % 100) / 100) for k in range(4000)]
    df = spark.createDataFrame(rows, "image_id long, idx int, x_min double, y_min double, x_max double, y_max double, score double")
    got = {(r.image_id, r.idx): (r.priority, r.rank) for r in regions.with_priority(df).collect()}
    con = duckdb.connect()
    power = {a: con.execute("SELECT pow(?::DOUBLE, 0.3)", [a]).fetchone()[0] for a in {max(1e-6, max(0.0, x1 - x0) * max(0.0, y1 - y0)) for _, _, x0, y0, x1, y1, _ in rows}}
    want = {}
    for i, n, x0, y0, x1, y1, s in rows:
        dx, dy = (x0 + x1) / 2 - 0.5, (y0 + y1) / 2 - 0.5
        want[i, n] = s * power[max(1e-6, max(0.0, x1 - x0) * max(0.0, y1 - y0))] * max(0.0, 1.0 - 0.6 * math.sqrt(dx * dx + dy * dy))
    assert {k: p for k, (p, _) in got.items()} == want
    assert all(r == sum((want[i, m], -m) > (want[i, n], -n) for m in range(4)) for (i, n), (_, r) in got.items())
