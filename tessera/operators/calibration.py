"""Logistic calibration of scores by gradient descent, and resampled intervals of means."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import stored

#: Where scores are cut before they become probabilities, and the descent's steps and rate.
CLIP, ITERATIONS, RATE = 35.0, 1000, 0.1


def probability(score: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), score))))


def _linear(features: list[str], weights: dict[str, float]) -> Column:
    score = F.lit(weights["intercept"])
    for name in features:
        score = score + F.lit(weights[name]) * F.col(name)
    return score


def fit_logistic(rows: DataFrame, features: list[str], label: str, iterations: int = ITERATIONS, rate: float = RATE, most_cells: int = 200_000) -> DataFrame:
    """``name, weight`` of each feature and of ``intercept``, by batch gradient descent from zeros.

    Equal rows are one cell with a number, which is all that a gradient needs; null features are 0, and rows without a
    label do not count. Up to ``most_cells`` cells take all steps in one task; beyond that a step is one aggregate over
    the stored cells, and nothing but its sums reaches the driver. No rows, no result.
    """
    cells = rows.where(F.col(label).isNotNull()).select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features), F.col(label).cast("double").alias("label"))
    cells = stored(cells.groupBy(*features, "label").agg(F.count("*").alias("n")), "calibration-cells")
    size, total = cells.agg(F.count("*"), F.sum("n")).first()
    schema = "name string, weight double"
    if not size:
        return cells.sparkSession.createDataFrame([], schema)
    if size <= most_cells:

        def descend(held: pd.DataFrame) -> pd.DataFrame:
            x = np.column_stack([np.ones(len(held)), *(held[c] for c in features)])
            n, y, w = held["n"].to_numpy(np.float64), held["label"].to_numpy(), np.zeros(len(features) + 1)
            for _ in range(iterations):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -CLIP, CLIP)))
                w = w - rate / total * (x.T @ (n * (p - y)))
            return pd.DataFrame({"name": ["intercept", *features], "weight": w})

        return cells.groupBy().applyInPandas(descend, schema)
    weights = dict.fromkeys(["intercept", *features], 0.0)
    for _ in range(iterations):
        error = F.col("n") * (probability(_linear(features, weights)) - F.col("label"))
        sums = cells.agg(F.sum(error).alias("intercept"), *(F.sum(error * F.col(c)).alias(c) for c in features)).first()
        weights = {c: w - rate / total * sums[c] for c, w in weights.items()}
    return cells.sparkSession.createDataFrame(list(weights.items()), schema)


#: Probabilities that a count of mean 1 is at most 0, 1, 2, ...
POISSON = tuple(float(np.exp(-1) * sum(1 / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(j + 1))) for j in range(10))
#: Groups of rows that are resampled together, by a hash of the row.
GROUPS_HEX = 3


def draws(key: Column) -> Column:
    """How often resample ``b`` takes what ``key`` names: a count of mean and variance 1, by inverting a hash."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", key, "b")), 1, 8), 16, 10).cast("double") / 2.0**32
    return sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))


def bootstrap_mean(rows: DataFrame, value: Column, key: Column, resamples: int, confidence: float = 0.95, grouped: bool = True) -> DataFrame:
    """One row ``low, high``: percentile bounds of the mean of ``value`` over resamples of the rows that ``key`` tells apart.

    With ``grouped``, rows are summed in 4,096 groups by a hash of the key before the resamples are dealt, so their cost does
    not grow with the rows; with less rows than that few share a group. Otherwise the keys are few and drawn whole.
    """
    unit = F.substring(F.md5(key), 1, GROUPS_HEX) if grouped else key
    sums = stored(rows.select(unit.alias("unit"), value.alias("value")).where("unit is not null").groupBy("unit").agg(F.sum("value").alias("total"), F.count("value").alias("n")), "resampled")
    w = draws(F.col("unit"))
    means = sums.select("*", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b")).groupBy("b").agg((F.sum(F.col("total") * w) / F.sum(F.col("n") * w)).alias("mean"))
    tail = (1 - confidence) / 2
    low, high = max(0, int(np.floor(tail * resamples))) + 1, min(resamples, int(np.ceil((1 - tail) * resamples)))
    ranked = means.withColumn("r", F.row_number().over(Window.orderBy("mean", "b")))
    at = lambda r: F.round(F.max(F.when(F.col("r") == r, F.col("mean"))), 6)
    return ranked.agg(at(low).alias("low"), at(high).alias("high"))
