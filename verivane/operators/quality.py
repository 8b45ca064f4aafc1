"""Data-quality gates, each a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verivane.functions import day, same
from verivane.operators.features import features as recompute
from verivane.operators.ledger import latest
from verivane.schema import FEATURE_COLUMNS, KEYS


def null_counts(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Nulls in each column, in one pass."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])


def row_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("city").agg(F.count("*").alias("rows"))


def duplicate_keys(df: DataFrame, table: str) -> DataFrame:
    keys = KEYS[table]
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def leakage_report(stored: DataFrame, observations: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Every stored feature that differs from what the observations give: column, stored and expected value.

    Rows of features without an observation are reported with column `missing in observations`."""
    values = lambda df: df.select("city", "as_of", *[F.col(c).cast("double").alias(c) for c in FEATURE_COLUMNS])
    a = values(stored).alias("a")
    b = values(recompute(observations)).withColumn("there", F.lit(True)).alias("b")
    joined = a.join(b, ["city", "as_of"], "left")
    checks = [F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").alias("stored"), F.col(f"b.{c}").alias("expected"), same(F.col(f"a.{c}"), F.col(f"b.{c}"), tolerance).alias("same")) for c in FEATURE_COLUMNS]
    gone = F.array(F.struct(F.lit("missing in observations").alias("column"), F.lit(None).cast("double").alias("stored"), F.lit(None).cast("double").alias("expected"), F.lit(False).alias("same")))
    rows = joined.select("city", "as_of", F.inline(F.when(F.col("b.there"), F.array(*checks)).otherwise(gone)))
    return rows.where("not same").drop("same")


def latest_nulls(features: DataFrame) -> DataFrame:
    """The columns that are null in each city's latest row."""
    names = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in FEATURE_COLUMNS]))
    return latest(features, ["city"], "as_of").select("city", "as_of", F.array_join(names, ",").alias("null_columns"), F.size(names).cast("long").alias("n_null"))


def orphan_predictions(ledger: DataFrame, features: DataFrame, model: str) -> DataFrame:
    """The model's forecasts without features of the day before."""
    days = features.select("city", F.date_add("as_of", 1).alias("forecast_date"))
    return ledger.where(F.col("model") == model).join(days, ["city", "forecast_date"], "left_anti")


def score_mismatches(ledger: DataFrame, observations: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    seen = observations.select("city", F.col("as_of").alias("forecast_date"), "pm2_5")
    return ledger.join(seen, ["city", "forecast_date"]).where(F.abs(F.col("actual_pm2_5") - F.col("pm2_5")) > tolerance)


def missing_models(ledger: DataFrame, required: list[str]) -> DataFrame:
    wanted = ledger.sparkSession.createDataFrame([(m,) for m in required], "model string")
    return wanted.join(ledger.select("model").distinct(), "model", "left_anti")


def forecast_diagnostics(ledger: DataFrame, observations: DataFrame, model: str) -> DataFrame:
    """Each city's latest forecast of the model: there or not, stale or not; staleness does not block."""
    last = observations.groupBy("city").agg(F.max("as_of").alias("latest_observation"))
    newest = ledger.where(F.col("model") == model).groupBy("city").agg(F.max("forecast_date").alias("latest_forecast"))
    both = last.join(newest, "city", "left")
    stale = F.coalesce(F.col("latest_forecast") < F.col("latest_observation"), F.lit(False))
    return both.select("*", F.col("latest_forecast").isNotNull().alias("found"), stale.alias("stale"), F.col("latest_forecast").isNull().alias("blocking"))


def readiness_report(observations: DataFrame, features: DataFrame, ledger: DataFrame, models: list[str], today: str) -> DataFrame:
    """city, check, passed: freshness, features up to date and whole, forecasts there, whole and for the next day."""
    obs = observations.groupBy("city").agg(F.max("as_of").alias("latest"))
    feat = latest_nulls(features).select("city", F.col("as_of").alias("features_at"), "n_null")
    tomorrow = F.date_add("latest", 1)
    at = [x for i, m in enumerate(models) for x in (
        F.max(F.when(F.col("model") == m, F.col("forecast_date"))).alias(f"last{i}"),
        F.bool_or((F.col("model") == m) & (F.col("forecast_date") == tomorrow) & F.col("predicted_pm2_5").isNotNull()).alias(f"there{i}"),
    )]
    all_rows = obs.join(feat, "city", "left").join(ledger.join(obs, "city").groupBy("city").agg(*at), "city", "left")
    checks = {
        "observations fresh": F.datediff(day(today), "latest") <= 1,
        "features match observations": F.col("features_at") == F.col("latest"),
        "latest features whole": F.col("n_null") == 0,
    }
    for i, m in enumerate(models):
        checks[f"{m} forecast exists"] = F.col(f"there{i}")
        checks[f"{m} forecast is for the next day"] = F.col(f"last{i}") == tomorrow
    return all_rows.select("city", F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in checks.items()])))


def readiness_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("city").agg(F.bool_and("passed").alias("ready"), F.count_if("passed").alias("n_passed"), F.count("*").alias("n_checks"))


def prediction_summary(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("model").agg(F.count("*").alias("rows"), F.min("forecast_date").alias("first_date"), F.max("forecast_date").alias("last_date"))


def none_of(*reports: DataFrame) -> bool:
    """Gate: whether all reports are empty."""
    return reduce(lambda ok, r: ok and r.isEmpty(), reports, True)
