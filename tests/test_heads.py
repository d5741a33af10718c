"""Multi-label heads against a local solve."""

import numpy as np

from medialens.operators import evaluation, heads


def data(n=1500, size=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    true = rng.normal(size=(3, size)) * 1.5
    y = (rng.random((n, 3)) < 1 / (1 + np.exp(-(x @ true.T - 0.5)))).astype(int)
    y[:, 2] = 0  # a label that no row has
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, [float(a) for a in v], [bool(b) for b in h]) for i, (v, h) in enumerate(zip(x, y, strict=True))], "id long, v array<double>, hot array<boolean>").repartition(5)


def loss(w, x, y, ridge):
    z = np.hstack([x, np.ones((len(x), 1))]) @ w.T
    return (np.logaddexp(0, z) - y * z).sum() / len(x) + ridge / 2 * (w[:, :-1] ** 2).sum()


def local(x, y, ridge):
    """Newton's steps, label by label."""
    big, out = np.hstack([x, np.ones((len(x), 1))]), []
    held = np.diag([ridge] * x.shape[1] + [0.0])
    for k in range(y.shape[1]):
        w = np.zeros(big.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-big @ w))
            step = np.linalg.solve(big.T @ (big * (p * (1 - p))[:, None]) / len(x) + held + 1e-9 * np.eye(len(w)), big.T @ (p - y[:, k]) / len(x) + held @ w)
            w = w - step / max(1.0, np.abs(step).max() / 5)
        out.append(w)
    return np.array(out)


def test_loss_within_a_hundredth_of_a_local_solve(spark):
    x, y = data()
    made = heads.train(frame(spark, x, y[:, :2]), ["a", "b"], validation=0, ridge=1e-2)
    assert loss(made.weights, x, y[:, :2], 1e-2) <= 1.01 * loss(local(x, y[:, :2], 1e-2), x, y[:, :2], 1e-2)
    assert all(b[0] <= a[0] + 1e-12 for a, b in zip(made.losses, made.losses[1:], strict=False))


def test_validation_part_stops_and_keeps_the_best_step(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 40))
    y = rng.integers(0, 2, size=(120, 2))  # nothing to learn, so more steps only fit noise
    made = heads.train(frame(spark, x, y), ["a", "b"], ridge=1e-6, patience=2)
    others = [v for _, v in made.losses]
    assert made.step == int(np.argmin(others)) and len(others) - 1 - made.step <= 2 < len(others)


def test_probabilities_and_pairs(spark):
    x, y = data(300)
    df = frame(spark, x, y)
    made = heads.train(df, ["a", "b", "none"])
    table = heads.head_table(spark, made)
    truth = spark.createDataFrame([(i, k, bool(y[i, j])) for i in range(0, 300, 2) for j, k in enumerate(["a", "b"])] + [(1, "a", None)], "id long, label_key string, truth boolean")
    rows = heads.scored_pairs(df, table, truth, "id", "v").collect()
    big = np.hstack([x, np.ones((300, 1))])
    assert len(rows) == 300 and all(abs(r.p - 1 / (1 + np.exp(-big[r.id] @ made.weights["ab".index(r.label_key)]))) < 1e-9 for r in rows)
    assert sum((r.p > 0.5) == r.truth for r in rows) > 0.75 * len(rows)
    sweep = evaluation.threshold_sweep(spark.createDataFrame(rows), "label_key", "p", "truth").collect()
    assert {r.label_key for r in sweep} == {"a", "b"}


def test_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [True]), (2, None, [True]), (3, [1.0, None], [False]), (4, [0.0, 1.0], None), (5, [0.0, 1.0], [False])], "id long, v array<double>, hot array<boolean>")
    assert heads.train(df.limit(0), ["a"]).weights.tolist() == [[0.0]]
    made = heads.train(df, ["a"], validation=0)
    assert made.weights.shape == (1, 3) and made.weights[0, 0] > made.weights[0, 1]
