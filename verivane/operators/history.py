"""As-of reads of append-only logs: what stood in the ledger at a moment, and whether a forecast was published before its outcome.

A log has a row for each version of a key, with the time it was written (created_at). A version holds from then until the next of its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verivane.operators.ledger import latest

FORECAST = ["city", "forecast_date", "model"]


def versions(log: DataFrame, keys: list[str], at: str = "created_at") -> DataFrame:
    """The log with valid_from and valid_to (null: still valid). Of several rows of a key and time the greatest counts; rows without a time don't."""
    rest = [c for c in log.columns if c not in (*keys, at)]
    once = log.where(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, at, "_r.*")
    return once.select(*log.columns, F.col(at).alias("valid_from"), F.lead(at).over(Window.partitionBy(*keys).orderBy(at)).alias("valid_to"))


def as_of(log: DataFrame, moment: Column, keys: list[str], at: str = "created_at") -> DataFrame:
    """The version of each key that was valid at a moment; only rows up to it are shuffled."""
    return latest(log.where(F.col(at) <= moment), keys, at)


def as_of_join(events: DataFrame, log: DataFrame, keys: list[str], when: str, at: str = "created_at") -> DataFrame:
    """Each event with the columns of the version of its key that was valid just before its time `when`; null where none was.

    Events and versions are merged in one ordered pass by key: one shuffle, and no row meets more than its own."""
    own, rest = ([c for c in df.columns if c not in keys] for df in (log, events))
    a = events.select(*keys, F.col(when).alias("_t"), F.lit(0).alias("_kind"), F.struct(*rest).alias("_e"))
    b = log.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.struct(*own).alias("_v"))
    before = Window.partitionBy(*keys).orderBy("_t", "_kind", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(before))
    return both.where("_kind = 0").select(*keys, *[F.col(f"_e.{c}").alias(c) for c in rest], *[F.col(f"_v.{c}").alias(c) for c in own])


def arrivals(observations: DataFrame, at: str = "created_at") -> DataFrame:
    """city, forecast_date, arrived_at, actual_pm2_5: when the first reading of each day came in, and what it was."""
    seen = observations.where(F.col("pm2_5").isNotNull() & F.col(at).isNotNull())
    return seen.groupBy("city", F.col("as_of").alias("forecast_date")).agg(F.min(at).alias("arrived_at"), F.min_by("pm2_5", F.struct(at, "pm2_5")).alias("actual_pm2_5"))


def late_publications(forecasts: DataFrame, observations: DataFrame) -> DataFrame:
    """Gate: the versions of forecasts that were written when their outcome was already there."""
    there = arrivals(observations)
    return forecasts.join(there, ["city", "forecast_date"]).where(F.col("created_at") >= F.col("arrived_at"))


def published_before_outcome(forecasts: DataFrame, observations: DataFrame) -> DataFrame:
    """For each forecast whose outcome has come in, the version that stood just before; predicted_pm2_5 and created_at are null where
    there was none yet."""
    due = forecasts.select(*FORECAST).distinct().join(arrivals(observations), ["city", "forecast_date"])
    return as_of_join(due, forecasts.select(*FORECAST, "predicted_pm2_5", "created_at"), FORECAST, "arrived_at")
