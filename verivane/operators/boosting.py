"""Walk-forward boosted trees: one model for each series and cutoff, fitted in parallel, applied only to what comes after the cutoff.

A plan table has a row for each model: a series, how many of its pairs the model knows (the cutoff), and up to which pair it forecasts. The pairs
of a series form one feature matrix, shared by all its models; plan rows are dealt over FOLDS groups a series, and the matrix goes to each group
once, not once a model. Pair i has the features of day t and the target of day t + 1, so that all targets before a cutoff
are known on the day of the first features after it. A group is bounded by the days of a series.

Trees are small histograms: features are cut at quantiles of the rows that the model knows, missing values have a bin of their own below all
others, each level of a tree is split for all its nodes at once by the gain in squared error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verivane.operators.backtest import MIN_TRAIN, series
from verivane.schema import FEATURE_COLUMNS

EVERY = 60  #: pairs between two fits of a series
FOLDS = 8  #: groups of a series' models that are fitted side by side


@dataclass(frozen=True)
class Settings:
    rounds: int = 100
    step: float = 0.05
    depth: int = 5
    leaf: int = 20  #: rows in a leaf at least
    bins: int = 64
    columns: float = 0.9  #: share of features that a tree may use
    rows: float = 0.8  #: share of rows that trees learn from, drawn anew every `again` trees
    again: int = 5
    seed: int = 42


def edges_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """The inner borders of each feature's bins: quantiles of the values that are there."""
    out = []
    for column in x.T:
        seen = column[~np.isnan(column)]
        out.append(np.unique(np.quantile(seen, np.linspace(0, 1, bins)[1:-1], method="lower")) if len(seen) else np.empty(0))
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """0 for a missing value, else 1 and the number of borders below the value."""
    columns = [np.where(np.isnan(c), 0, 1 + np.searchsorted(e, c, "left")) for c, e in zip(x.T, edges, strict=True)]
    return np.stack(columns, 1).astype(np.int64).reshape(len(x), len(edges))


def grow(b: np.ndarray, r: np.ndarray, allowed: np.ndarray, s: Settings) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """A tree on bins b and residuals r: for each level, the feature and last bin to the left of each node; and the leaves' means."""
    n, f = b.shape
    width = s.bins + 1
    cells, weights = b + np.arange(f) * width, np.repeat(r, f)
    node, levels = np.zeros(n, np.int64), []
    for depth in range(s.depth):
        nodes = 1 << depth
        cell, shape = (cells + node[:, None] * (f * width)).ravel(), (nodes, f, width)
        count = np.bincount(cell, minlength=nodes * f * width).reshape(shape).cumsum(2, dtype=np.float64)
        total = np.bincount(cell, weights, minlength=nodes * f * width).reshape(shape).cumsum(2)
        size, sums = count[:, :, -1:], total[:, :, -1:]
        right = size - count
        fits = (count >= s.leaf) & (right >= s.leaf) & allowed[None, :, None]
        if not fits.any():
            break
        gain = np.full(shape, -1.0)
        n_left, n_right, left = count[fits], right[fits], total[fits]
        whole, every = np.broadcast_to(sums, shape)[fits], np.broadcast_to(size, shape)[fits]
        gain[fits] = left**2 / n_left + (whole - left) ** 2 / n_right - whole**2 / every
        best = gain.reshape(nodes, -1).argmax(1)
        feature, cut = best // width, best % width
        cut = np.where(gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-12, cut, width)  # else all rows go left
        levels.append((feature, cut))
        node = node * 2 + (b[np.arange(n), feature[node]] > cut[node])
    leaves = 1 << len(levels)
    count = np.bincount(node, minlength=leaves)
    return levels, np.bincount(node, r, minlength=leaves) / np.maximum(count, 1)


def leaf_of(b: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    node = np.zeros(len(b), np.int64)
    for feature, cut in levels:
        node = node * 2 + (b[np.arange(len(b)), feature[node]] > cut[node])
    return node


def fit_predict(x: np.ndarray, y: np.ndarray, ahead: np.ndarray, s: Settings, cutoff: int) -> np.ndarray:
    """Forecasts for the rows `ahead` by trees fitted on x and y alone."""
    edges = edges_of(x, s.bins)
    b, a = binned(x, edges), binned(ahead, edges)
    draw = np.random.default_rng([s.seed, cutoff])
    start = y.mean()
    now, out = np.full(len(y), start), np.full(len(ahead), start)
    some = np.arange(len(y))
    few = max(1, round(s.columns * x.shape[1]))
    for k in range(s.rounds):
        if k % s.again == 0 and s.rows < 1:
            some = draw.permutation(len(y))[: max(1, round(s.rows * len(y)))]
        allowed = np.zeros(x.shape[1], bool)
        allowed[draw.permutation(x.shape[1])[:few]] = True
        levels, means = grow(b[some], (y - now)[some], allowed, s)
        now = now + s.step * means[leaf_of(b, levels)]
        out = out + s.step * means[leaf_of(a, levels)]
    return out


def plan(training: DataFrame, min_train: int = MIN_TRAIN, every: int = EVERY, folds: int = FOLDS) -> DataFrame:
    """city, fold, cutoff, until: the model that knows the first `cutoff` pairs forecasts those up to `until`."""
    sizes = training.groupBy("city").agg(F.count("*").cast("int").alias("n")).where(F.col("n") > min_train)
    cuts = sizes.select("city", "n", F.posexplode(F.sequence(F.lit(min_train), F.col("n") - 1, F.lit(every))).alias("k", "cutoff"))
    return cuts.select("city", (F.col("k") % folds).alias("fold"), "cutoff", F.least("n", F.col("cutoff") + every).alias("until"))


FORECASTS = "city string, forecast_date date, cutoff int, predicted_pm2_5 double, actual_pm2_5 double"


def walkforward_trees(training: DataFrame, min_train: int = MIN_TRAIN, every: int = EVERY, folds: int = FOLDS, settings: Settings | None = None) -> DataFrame:
    """city, forecast_date, cutoff (pairs that the model knew), predicted_pm2_5, actual_pm2_5 of each pair after the first `min_train` of its series.

    training: features and target of backtest.training_set(). A series of `min_train` pairs or fewer gives no rows; features may be null, targets are not."""
    s = settings or Settings()
    models = plan(training, min_train, every, folds)
    matrix = training.select(
        "city", F.row_number().over(series()).alias("n"), "target_date", F.col("target").cast("double").alias("target"),
        F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in FEATURE_COLUMNS]).alias("x"),
    )
    groups = models.groupBy("city", "fold").agg(F.max("until").alias("last"))
    dealt = matrix.join(groups, "city").where(F.col("n") <= F.col("last"))

    def fit(key: tuple, rows: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        x, y = np.stack(rows["x"]) if len(rows) else np.empty((0, 0)), rows["target"].to_numpy()
        out = []
        for cutoff, until in sorted(zip(todo["cutoff"], todo["until"], strict=True)):
            ahead = rows.iloc[cutoff:until]
            predicted = fit_predict(x[:cutoff], y[:cutoff], x[cutoff:until], s, int(cutoff))
            out.append(pd.DataFrame({"city": key[0], "forecast_date": ahead["target_date"], "cutoff": cutoff, "predicted_pm2_5": predicted, "actual_pm2_5": ahead["target"]}))
        return pd.concat(out)

    # Few bytes, much work: a fixed number of partitions, which adaptive planning leaves as it is.
    tasks = int(training.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    apart = lambda df: df.repartition(tasks, "city", "fold").groupBy("city", "fold")
    return apart(dealt).cogroup(apart(models.toDF(*models.columns))).applyInPandas(fit, FORECASTS)
