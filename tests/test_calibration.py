import numpy as np

from pyspark.sql import functions as F

from tessera.operators import calibration


def test_weights_are_those_of_plain_descent(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 2)), 1)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.5, -0.7] + 0.3)))).astype(int)
    rows = [(float(a), None if a == 0 else float(b), int(t)) for (a, b), t in zip(x, y, strict=True)] + [(1.0, 1.0, None), (900.0, 0.0, 1)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    m = np.array([[1, a, b or 0.0] for a, b, t in rows if t is not None])
    t, w = np.array([r[2] for r in rows if r[2] is not None]), np.zeros(3)
    for _ in range(25):
        w -= 0.1 / len(t) * (m.T @ (1 / (1 + np.exp(-np.clip(m @ w, -35, 35))) - t))
    for most in (10**6, 1):
        found = {r.name: r.weight for r in calibration.fit_logistic(df, ["a", "b"], "y", 25, most_cells=most).collect()}
        assert np.allclose([found["intercept"], found["a"], found["b"]], w, atol=1e-9)
    assert calibration.fit_logistic(df.limit(0), ["a", "b"], "y").count() == 0


def test_intervals_are_as_wide_as_a_bootstrap(spark):
    rng = np.random.default_rng(5)
    values = (rng.random(3000) < 0.3).astype(float)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, v double")
    row = calibration.bootstrap_mean(df, F.col("v"), F.col("id").cast("string"), 4000).first()
    means = np.array([rng.choice(values, len(values)).mean() for _ in range(4000)])
    low, high = np.quantile(means, [0.025, 0.975])
    assert abs((row.high - row.low) / (high - low) - 1) < 0.06 and abs(row.high + row.low - low - high) < 0.004
    w = df.select(F.sequence(F.lit(1), F.lit(1)).alias("b"), "id").select(F.explode("b").alias("b"), "id").select(calibration.draws(F.col("id").cast("string")).alias("w"))
    mean, spread = w.agg(F.avg("w"), F.variance("w")).first()
    assert abs(mean - 1) < 0.06 and abs(spread - 1) < 0.1
