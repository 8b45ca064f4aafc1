"""Read-side queries of the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verivane.functions import absolute_error, accuracy_percent, badge, band, day, percent_change, status
from verivane.operators.ledger import latest

#: Known models and what they are.
MODELS = {"persistence": "Tomorrow is as today", "rolling_7": "Mean of the last seven rows"}


def for_city(df: DataFrame, city: str | None) -> DataFrame:
    """One city, or all without a name."""
    return df.where(F.col("city") == city) if city else df


def check_model(model: str | None) -> None:
    if model and model not in MODELS:
        raise ValueError(f"unknown model {model!r}; known: {', '.join(MODELS)}")


def latest_forecast(ledger: DataFrame, model: str | None = None) -> DataFrame:
    check_model(model)
    rows = ledger.where(F.col("model") == model) if model else ledger
    return latest(rows, ["city", "model"], "forecast_date").withColumn("status", status())


def prediction_log(ledger: DataFrame, model: str | None = None, limit: int | None = None, scored_only: bool = False) -> DataFrame:
    """Newest first; an empty model name is no filter; scored_only: those whose actual is known."""
    rows = ledger
    if model:
        rows = rows.where(F.col("model") == model)
    if scored_only:
        rows = rows.where("actual_pm2_5 is not null")
    rows = rows.withColumn("error", absolute_error())
    rows = rows.orderBy(F.desc("forecast_date"), "model", "city")
    return rows.limit(limit) if limit else rows


def evaluation(ledger: DataFrame, today: str, days: int = 30) -> DataFrame:
    """By city and model: scored and pending rows of the window, MAE, RMSE; without scored rows these are null."""
    e = absolute_error()
    return (
        ledger.where(F.col("forecast_date") >= F.date_sub(day(today), days))
        .groupBy("city", "model")
        .agg(F.count(e).alias("scored"), F.count_if(e.isNull()).alias("pending"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    )


def leaderboard(performance: DataFrame) -> DataFrame:
    """Each model's newest metrics, best first, models without metrics last."""
    described = F.coalesce(F.create_map(*[F.lit(x) for kv in MODELS.items() for x in kv])[F.col("model")], F.lit(""))
    return latest(performance, ["model"], "score_date").withColumn("description", described).orderBy(F.asc_nulls_last("mae"), "model")


def history(observations: DataFrame, n: int = 30) -> DataFrame:
    """The latest n rows of each city, oldest first, with month and day as a label."""
    w = Window.partitionBy("city").orderBy(F.desc("as_of"))
    rows = observations.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
    return rows.withColumn("label", F.date_format("as_of", "MM-dd")).orderBy("city", "as_of")


def accuracy_summary(ledger: DataFrame) -> DataFrame:
    """By model, of scored rows: share within 5, mean accuracy."""
    e = absolute_error()
    return (
        ledger.where(e.isNotNull())
        .groupBy("model")
        .agg(F.count("*").alias("scored"), (F.avg(F.when(e <= 5, 1.0).otherwise(0.0)) * 100).alias("within_5_percent"), F.avg(accuracy_percent(F.col("actual_pm2_5"), e)).alias("accuracy_percent"))
    )


def rolling_accuracy(ledger: DataFrame, n: int = 30) -> DataFrame:
    """MAE and mean accuracy over the last n scored rows of each city and model."""
    e = absolute_error()
    w = Window.partitionBy("city", "model").orderBy("forecast_date").rowsBetween(1 - n, 0)
    scored = ledger.where(e.isNotNull()).select("city", "model", "forecast_date", e.alias("e"), accuracy_percent(F.col("actual_pm2_5"), e).alias("a"))
    return scored.select("city", "model", "forecast_date", F.avg("e").over(w).alias("rolling_mae"), F.avg("a").over(w).alias("rolling_accuracy"))


def bands(observations: DataFrame) -> DataFrame:
    return observations.select("city", "as_of", "pm2_5", band(F.col("pm2_5")).alias("band"))


def badges(ledger: DataFrame) -> DataFrame:
    e = absolute_error()
    return ledger.select("city", "forecast_date", "model", badge(e).alias("badge"), accuracy_percent(F.col("actual_pm2_5"), e).alias("accuracy"))


def forecast_change(ledger: DataFrame, observations: DataFrame) -> DataFrame:
    """Each city's and model's latest forecast against the latest observation."""
    last = latest(observations, ["city"], "as_of").select("city", F.col("pm2_5").alias("latest_pm2_5"))
    f = latest(ledger, ["city", "model"], "forecast_date").join(last, "city", "left")
    return f.select("city", "model", "forecast_date", "predicted_pm2_5", "latest_pm2_5", percent_change(F.col("predicted_pm2_5"), F.col("latest_pm2_5")).alias("change_percent"))
