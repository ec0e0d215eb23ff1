import numpy as np
import pytest
from pyspark.sql import functions as F

from penprint.operators import fit
from penprint.operators import scaled_fit as sf


def simulated(n=4000, d=6, k=3, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.uniform(0.5, 3, d) + rng.normal(size=d) * 5
    w, v = rng.normal(size=(k, d)), rng.normal(size=(k, d)) * 0.25
    b, c = rng.normal(size=k) * 10, rng.normal(size=k)
    v_bias = c - x.mean(axis=0) @ v.T
    sigma = np.exp((x @ v.T + v_bias) / 2)
    return x, x @ w.T + b + sigma * rng.normal(size=(n, k)), (w, b, v, v_bias)


def likeliest(x, y):
    """The same head on one machine: means and variances in turns, each until it stands still."""
    x = np.hstack([x, np.ones((len(x), 1))])
    means, spreads = [], []
    for j in range(y.shape[1]):
        w, v = np.linalg.lstsq(x, y[:, j], rcond=None)[0], np.zeros(x.shape[1])
        v[-1] = np.log(((y[:, j] - x @ w) ** 2).mean())
        for _ in range(400):
            weight = np.exp(-x @ v)
            w = np.linalg.solve((x * weight[:, None]).T @ x, x.T @ (weight * y[:, j]))
            r = (y[:, j] - x @ w) ** 2
            for _ in range(3):
                z = r * np.exp(-x @ v)
                v = v + 0.5 * np.linalg.solve((x * z[:, None]).T @ x / 2 + 1e-9 * np.eye(len(v)), x.T @ (z - 1) / 1)
        means.append(w)
        spreads.append(v)
    return np.array(means), np.array(spreads)


@pytest.fixture(scope="module")
def frame(spark):
    x, y, _ = simulated()
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, features array<double>, target array<double>").repartition(5)


def test_head_against_numpy(frame):
    x, y, truth = simulated()
    head = sf.fit_scaled_gaussian(frame)
    means, spreads = likeliest(x, y)
    assert np.allclose(head.weights, means[:, :-1], atol=1e-4) and np.allclose(head.bias, means[:, -1], atol=1e-3)
    assert np.allclose(head.log_weights, spreads[:, :-1], atol=1e-4) and np.allclose(head.log_bias, spreads[:, -1], atol=1e-3)
    assert np.abs(head.weights - truth[0]).max() < 0.1 and np.abs(head.log_weights - truth[2]).max() < 0.1


def test_loss_falls_and_beats_a_constant_deviation(frame):
    head = sf.fit_scaled_gaussian(frame)
    assert len(head.losses) > 3 and all(b < a for a, b in zip(head.losses, head.losses[1:]))
    rows = sf.apply_scaled_gaussian(frame, head)
    per_row = rows.select(F.explode(F.arrays_zip("target", "mu", "sigma")).alias("z"))
    loss = F.avg(0.5 * F.pow((F.col("z.target") - F.col("z.mu")) / F.col("z.sigma"), 2) + F.log("z.sigma"))
    scaled = per_row.agg(loss).first()[0]
    assert abs(scaled - head.losses[-1]) < 1e-6
    constant = fit.apply_linear_gaussian(frame, fit.fit_linear_gaussian(frame)).select(F.explode(F.arrays_zip("target", "mu", "sigma")).alias("z"))
    assert scaled < constant.agg(loss).first()[0] - 0.05


def test_constant_columns_single_rows_and_table(spark):
    rows = [(i, [1.0, float(i % 5)], [2.0 * (i % 5) + (-1) ** i * (1 + i % 5), 7.0]) for i in range(200)]
    frame = spark.createDataFrame(rows, "id int, features array<double>, target array<double>").withColumn("line", F.lit(1))
    head = sf.fit_scaled_gaussian(frame)
    got = sf.apply_scaled_gaussian(frame, head).orderBy("id").collect()
    assert all(np.isfinite(r.mu).all() and np.isfinite(r.sigma).all() for r in got)
    assert got[4].sigma[0] > 2 * got[0].sigma[0] and abs(got[0].mu[1] - 7) < 1e-6
    table = sf.head_rows(frame, head).orderBy("dim").collect()
    assert [r.dim for r in table] == [0, 1] and np.allclose(table[0].weights, head.weights[0])
