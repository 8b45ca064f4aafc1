"""Alignment of features with the next day's target, and walk-forward backtests by running sums and recursions.

No training set is copied: what a forecast may know is a frame that ends one row before it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from verivane.schema import FEATURE_COLUMNS

MIN_TRAIN = 30


def series() -> WindowSpec:
    return Window.partitionBy("city").orderBy("as_of")


def before() -> WindowSpec:
    """All rows before this one."""
    return series().rowsBetween(Window.unboundedPreceding, -1)



def aligned(features: DataFrame, observations: DataFrame, horizon: int = 1) -> DataFrame:
    """Features of day t with the target of day t + horizon."""
    target = observations.select("city", F.date_sub("as_of", horizon).alias("as_of"), F.col("as_of").alias("target_date"), F.col("pm2_5").alias("target"))
    return features.join(target, ["city", "as_of"])


def training_set(features: DataFrame, observations: DataFrame, horizon: int = 1) -> DataFrame:
    """Pairs with a lag and a target; other features may be null."""
    return aligned(features, observations, horizon).where("pm2_5_lag_1 is not null and target is not null")


def alignment_violations(pairs: DataFrame, horizon: int = 1) -> DataFrame:
    return pairs.where(F.datediff("target_date", "as_of") != horizon).select("city", "as_of", "target_date")


def naive_backtest(training: DataFrame, min_train: int = MIN_TRAIN) -> DataFrame:
    """Yesterday's value for tomorrow, after the first pairs of each series."""
    rows = training.withColumn("n", F.row_number().over(series())).where(F.col("n") > min_train)
    return rows.select("city", F.col("target_date").alias("forecast_date"), F.col("pm2_5_lag_1").alias("predicted_pm2_5"), F.col("target").alias("actual_pm2_5"))


def walkforward_ols(observations: DataFrame, min_train: int = MIN_TRAIN) -> DataFrame:
    """A line through all earlier (today, tomorrow) pairs of the series, evaluated at today."""
    today = observations.select("city", "as_of", F.col("pm2_5").alias("x"))
    tomorrow = observations.select("city", F.date_sub("as_of", 1).alias("as_of"), F.col("pm2_5").alias("y"))
    pairs = today.join(tomorrow, ["city", "as_of"]).where("x is not null and y is not null")
    fitted = pairs.select("city", "as_of", "x", "y", F.row_number().over(series()).alias("n"), F.regr_slope("y", "x").over(before()).alias("slope"), F.regr_intercept("y", "x").over(before()).alias("intercept"))
    return fitted.where(F.col("n") > min_train).select("city", F.date_add("as_of", 1).alias("forecast_date"), (F.col("intercept") + F.col("slope") * F.col("x")).alias("predicted_pm2_5"), F.col("y").alias("actual_pm2_5"))


#: Weights of the last error in a level: 1 + theta of an ARIMA(0,1,1) for theta from -0.95 to 0.95.
WEIGHTS = [k / 20 for k in range(1, 40)]
RECURSIONS = "city string, as_of date, n int, y double, last double, ar double, ma double, weight double"


def recursions(observations: DataFrame, weights: list[float] = WEIGHTS) -> DataFrame:
    """What the rows before each reading say of it, in one ordered pass over a series: `last`, the last value; `ar`, AR(1) on first differences with
    least squares so far, null where no difference has varied; `ma`, ARIMA(0,1,1), a bank of levels (one a weight) that each error corrects, of
    which the one with the least squared errors so far counts (ties: the weight nearest 1, then the smaller; its value is in `weight`). Null readings are left out; the first row of a
    series has its own value as last and ma."""
    bank = np.array(sorted(weights, key=lambda w: (abs(w - 1), w)))

    def carry(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("as_of", kind="stable")
        y = g["y"].to_numpy(np.float64)
        last = np.r_[y[:1], y[:-1]]
        d = y - last
        d1 = np.r_[0.0, d[:-1]]
        ahead = lambda v: np.r_[0.0, np.cumsum(v)[:-1]]  # noqa: E731  # sums of the rows before
        top, bottom = ahead(d * d1), ahead(d1 * d1)
        ar = np.where(bottom > 0, last + np.divide(top, bottom, out=np.zeros_like(top), where=bottom > 0) * d1, np.nan)
        ma, weight = np.empty_like(y), np.empty_like(y)
        level, squares = np.full(len(bank), y[0]), np.zeros(len(bank))
        for i, value in enumerate(y):
            best = int(squares.argmin())
            ma[i], weight[i] = level[best], bank[best]
            error = value - level
            level = level + bank * error
            squares = squares + error * error
        return pd.DataFrame({"city": g["city"], "as_of": g["as_of"], "n": np.arange(1, len(y) + 1), "y": y, "last": last, "ar": ar, "ma": ma, "weight": weight})

    rows = observations.where("pm2_5 is not null").select("city", "as_of", F.col("pm2_5").alias("y"))
    return rows.groupBy("city").applyInPandas(carry, RECURSIONS).withColumn("ar", F.when(~F.isnan("ar"), F.col("ar")))


def walkforward_ar1(observations: DataFrame, min_train: int = MIN_TRAIN) -> DataFrame:
    """A ladder: AR(1) on first differences; where that can't be fitted, ARIMA(0,1,1); at last the last value."""
    predicted = F.coalesce("ar", "ma", "last").alias("predicted_pm2_5")
    return recursions(observations).where(F.col("n") > min_train).select("city", F.col("as_of").alias("forecast_date"), predicted, F.col("y").alias("actual_pm2_5"))


def walkforward_ma1(observations: DataFrame, min_train: int = MIN_TRAIN) -> DataFrame:
    """ARIMA(0,1,1), fitted anew before each row."""
    rows = recursions(observations).where(F.col("n") > min_train)
    return rows.select("city", F.col("as_of").alias("forecast_date"), F.col("ma").alias("predicted_pm2_5"), F.col("y").alias("actual_pm2_5"), "weight")


ALPHA = 0.3


def smoothed(y: Column, alpha: float = ALPHA) -> Column:
    """The exponentially smoothed level of the rows before this one. What lies further back than the frame weighs less than 1e-18."""
    rows = math.ceil(math.log(1e-18) / math.log(1 - alpha))
    seen = F.collect_list(y).over(series().rowsBetween(-rows, -1))
    return F.aggregate(seen, F.get(seen, F.lit(0)), lambda level, v: alpha * v + (1 - alpha) * level)


def walkforward_ses(observations: DataFrame, alpha: float = ALPHA, min_train: int = MIN_TRAIN) -> DataFrame:
    """Simple exponential smoothing of the readings that are there."""
    rows = observations.where("pm2_5 is not null").select("city", "as_of", F.col("pm2_5").alias("y"))
    rows = rows.select("*", F.row_number().over(series()).alias("n"), smoothed(F.col("y"), alpha).alias("level"))
    return rows.where(F.col("n") > min_train).select("city", F.col("as_of").alias("forecast_date"), F.coalesce("level", "y").alias("predicted_pm2_5"), F.col("y").alias("actual_pm2_5"))


STEPS = 1024  #: small systems solved at once


def walkforward_ridge(training: DataFrame, penalty: float = 1.0, min_train: int = MIN_TRAIN) -> DataFrame:
    """Ridge regression on all features, refitted before each row: running sums of products, one small system a row, solved many at a time."""

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("as_of")
        x = np.nan_to_num(g[FEATURE_COLUMNS].to_numpy(np.float64))
        x, y = np.c_[x, np.ones(len(x))], g["target"].to_numpy(np.float64)
        xx, xy = penalty * np.eye(x.shape[1]), np.zeros(x.shape[1])
        out = np.full(len(y), np.nan)
        for at in range(0, len(y), STEPS):  # all steps of a stretch at once
            part, target = x[at : at + STEPS], y[at : at + STEPS]
            products, sums = np.cumsum(part[:, :, None] * part[:, None, :], axis=0), np.cumsum(part * target[:, None], axis=0)
            before_xx = xx + np.concatenate([np.zeros((1, *xx.shape)), products[:-1]])
            before_xy = xy + np.concatenate([np.zeros((1, len(xy))), sums[:-1]])
            out[at : at + STEPS] = (part * np.linalg.solve(before_xx, before_xy[:, :, None])[:, :, 0]).sum(1)
            xx, xy = xx + products[-1], xy + sums[-1]
        return pd.DataFrame({"city": g["city"], "forecast_date": g["target_date"], "predicted_pm2_5": out, "actual_pm2_5": y})[min_train:]

    rows = training.select("city", "as_of", "target_date", "target", *[F.col(c).cast("double").alias(c) for c in FEATURE_COLUMNS])
    return rows.groupBy("city").applyInPandas(fit, "city string, forecast_date date, predicted_pm2_5 double, actual_pm2_5 double")


# ---- results ---------------------------------------------------------------------------------------


def metrics(results: DataFrame, *keys: str | Column) -> DataFrame:
    """Samples, MAE and RMSE by keys."""
    e = F.abs(F.col("actual_pm2_5") - F.col("predicted_pm2_5"))
    return results.groupBy(*keys).agg(F.count(e).alias("samples"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def paired(ledger: DataFrame, first: str, second: str) -> DataFrame:
    """Both models' errors side by side, where both are scored."""
    e = F.abs(F.col("actual_pm2_5") - F.col("predicted_pm2_5"))
    wide = ledger.groupBy("city", "forecast_date").pivot("model", [first, second]).agg(F.max(e))
    return wide.where(F.col(first).isNotNull() & F.col(second).isNotNull())


def summary(naive: DataFrame, model: DataFrame) -> DataFrame:
    """One row a series: samples, dates, both models' errors, improvement in percent, winner."""
    keys = ["city", "forecast_date"]
    common = naive.select(*keys, "actual_pm2_5", F.col("predicted_pm2_5").alias("naive")).join(model.select(*keys, F.col("predicted_pm2_5").alias("model")), keys)
    errors = {n: F.abs(F.col("actual_pm2_5") - F.col(n)) for n in ("naive", "model")}
    sides = [x for n, e in errors.items() for x in (F.avg(e).alias(f"{n}_mae"), F.sqrt(F.avg(e * e)).alias(f"{n}_rmse"))]
    out = common.groupBy("city").agg(F.count(errors["naive"]).alias("samples"), F.min("forecast_date").alias("start_date"), F.max("forecast_date").alias("end_date"), *sides)
    return out.select(
        "*",
        (F.try_divide(F.col("naive_mae") - F.col("model_mae"), F.col("naive_mae")) * 100).alias("improvement_percent"),
        F.when(F.col("model_mae") < F.col("naive_mae"), "model").otherwise("naive").alias("winner"),
    )


def long_form(naive: DataFrame, model: DataFrame) -> DataFrame:
    """One row a date with two predictions becomes two records."""
    keys = ["city", "forecast_date"]
    wide = naive.select(*keys, "actual_pm2_5", F.col("predicted_pm2_5").alias("naive_baseline")).join(model.select(*keys, F.col("predicted_pm2_5").alias("ols")), keys)
    return wide.unpivot([*keys, "actual_pm2_5"], ["naive_baseline", "ols"], "model", "predicted_pm2_5")


def head_tail(results: DataFrame, n: int = 5) -> DataFrame:
    """The first and last n rows of each series."""
    w = Window.partitionBy("city")
    ranked = results.select("*", F.row_number().over(w.orderBy("forecast_date")).alias("head"), F.row_number().over(w.orderBy(F.desc("forecast_date"))).alias("tail"))
    return ranked.where((F.col("head") <= n) | (F.col("tail") <= n)).drop("head", "tail")
