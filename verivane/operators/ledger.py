"""The forecast ledger: upserts, publishing, scoring when the actual arrives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verivane.functions import absolute_error, day
from verivane.schema import FEATURE_COLUMNS


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; ranks are cut before and after the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], keep: list[str] | None = None, order: str | None = None) -> DataFrame:
    """stored with each incoming row in place of the one of its key.

    Without `keep` all columns are replaced, null by null too. Columns in `keep` hold on to the stored value where
    the key is there already. Several incoming rows of a key: the last by `order` counts.
    """
    if order:
        incoming = latest(incoming, keys, order).drop(order)
    if not keep:
        return stored.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)
    new = incoming.select(*[F.col(c).alias(f"_new_{c}") for c in incoming.columns])
    on = reduce(lambda a, b: a & b, [stored[k] == new[f"_new_{k}"] for k in keys])
    both = stored.withColumn("_stored", F.lit(True)).join(new.withColumn("_incoming", F.lit(True)), on, "full")

    def column(c: str):
        if c in keys:
            return F.coalesce(c, f"_new_{c}")
        if c not in incoming.columns:
            return F.col(c)
        if c in keep:
            return F.when(F.col("_stored"), F.col(c)).otherwise(F.col(f"_new_{c}"))
        return F.when(F.col("_incoming"), F.col(f"_new_{c}")).otherwise(F.col(c))

    return both.select(*[column(c).alias(c) for c in stored.columns])


# ---- forecasts -------------------------------------------------------------------------------------


def persistence(observations: DataFrame, name: str = "persistence") -> DataFrame:
    """Tomorrow is as today: a forecast for the day after each row."""
    return observations.select("city", F.date_add("as_of", 1).alias("forecast_date"), F.lit(name).alias("model"), F.col("pm2_5").alias("predicted_pm2_5"))


def with_actuals(forecasts: DataFrame, observations: DataFrame, before: str | None = None) -> DataFrame:
    """Adds actual_pm2_5, the observation on the forecast's day; only of days before `before`."""
    seen = observations.select("city", F.col("as_of").alias("forecast_date"), F.col("pm2_5").alias("actual_pm2_5"))
    if before:
        seen = seen.where(F.col("forecast_date") < day(before))
    return forecasts.join(seen, ["city", "forecast_date"], "left")


def publishable(observations: DataFrame, features: DataFrame, model: DataFrame, model_name: str) -> DataFrame:
    """What to publish from the latest rows: the baseline always; the model's forecast (city, predicted_pm2_5) only where
    the latest features are of the latest observation's day and none of them is null."""
    last = latest(observations, ["city"], "as_of").select("city", "as_of", "pm2_5")
    f = latest(features, ["city"], "as_of")
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in FEATURE_COLUMNS])
    ready = f.where(whole).select("city", "as_of").join(last.select("city", "as_of"), ["city", "as_of"])
    judged = ready.join(model, "city").select("city", F.date_add("as_of", 1).alias("forecast_date"), F.lit(model_name).alias("model"), "predicted_pm2_5")
    return persistence(last).unionByName(judged)


# ---- scoring ---------------------------------------------------------------------------------------


def score_pending(ledger: DataFrame, observations: DataFrame) -> DataFrame:
    """The ledger with pending actuals filled in where an observation has arrived; `newly` marks those."""
    seen = observations.where(F.col("pm2_5").isNotNull()).select("city", F.col("as_of").alias("forecast_date"), F.col("pm2_5").alias("_seen"))
    joined = ledger.join(seen, ["city", "forecast_date"], "left")
    newly = F.col("actual_pm2_5").isNull() & F.col("_seen").isNotNull()
    return joined.withColumn("newly", newly).withColumn("actual_pm2_5", F.coalesce("actual_pm2_5", "_seen")).drop("_seen")


def with_scores(ledger: DataFrame, settled: DataFrame) -> DataFrame:
    """The ledger with the actuals of settled forecasts (city, forecast_date, model, actual_pm2_5) where it has none."""
    keys = ["city", "forecast_date", "model"]
    joined = ledger.join(settled.where("actual_pm2_5 is not null").select(*keys, F.col("actual_pm2_5").alias("_seen")), keys, "left")
    return joined.withColumn("actual_pm2_5", F.coalesce("actual_pm2_5", "_seen")).drop("_seen")


def newly_scored(ledger: DataFrame, observations: DataFrame) -> DataFrame:
    return score_pending(ledger, observations).where("newly").drop("newly")


def score_day(ledger: DataFrame, observations: DataFrame, date: str) -> DataFrame:
    """Only the rows of one forecast date."""
    return newly_scored(ledger.where(F.col("forecast_date") == day(date)), observations)


def daily_metrics(scored: DataFrame) -> DataFrame:
    """score_date, model, mae, rmse, sample_size; rows without a prediction count for none of them."""
    e = absolute_error()
    return (
        scored.groupBy(F.col("forecast_date").alias("score_date"), "model")
        .agg(F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(e).alias("sample_size"))
    )
