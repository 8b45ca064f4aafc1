"""Registered queries of the forecasting ledger; their SQL twins are in ledger_sql."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verivane import streaming
from verivane.functions import day, local_day, settled
from verivane.operators import backtest, features, history, ingest, ledger, long_series, models, quality, serve
from verivane.plans.ledger_sql import ORACLE_SQL
from verivane.schema import FEATURE_COLUMNS, LAGS, MEASURES, ROLLS
from verivane.sources import digests, payloads, tables
from verivane.sources.constants import AS_OF, OPEN_FROM, SHIFT, TODAY
from verivane.sources.fixtures import Inputs, readings_of
from verivane.sources.shared import land, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(Inputs(spark, sf_dir)))
    return f


def rounded(df: DataFrame) -> DataFrame:
    """Doubles settled to four places, for comparison between engines."""
    out: dict[str, Column] = {c: settled(F.col(c)) for c, t in df.dtypes if t == "double"}
    return df.withColumns(out) if out else df


# ---- sources and ingest ------------------------------------------------------------------------------


@query
def payload_unzip(x: Inputs) -> DataFrame:
    rows = payloads.hourly_readings(payloads.parse_payloads(x.payload_lines))
    return rows.select("city", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.to_date("ts").alias("as_of"), "pm2_5", "pm10")


@query
def payload_weather(x: Inputs) -> DataFrame:
    return payloads.daily_weather(payloads.parse_payloads(x.weather_lines))


@query
def describe_tables(x: Inputs) -> DataFrame:
    return tables.describe({"observations": x.observations, "features": x.features, "predictions": x.ledger, "model_performance": x.performance})


@query
def daily_observations(x: Inputs) -> DataFrame:
    shifted = x.weather.withColumn("as_of", F.date_add("as_of", SHIFT))
    return ingest.with_weather(ingest.daily_means(x.readings), shifted, ["as_of"])


@query
def source_quality(x: Inputs) -> DataFrame:
    return ingest.source_gate(x.readings, x.weather)


@query
def missing_hours(x: Inputs) -> DataFrame:
    return ingest.missing_hours(x.readings)


@query
def ingest_range(x: Inputs) -> DataFrame:
    # Some cities are a day behind, one is up to date.
    return ingest.next_range(x.observations.where("as_of < date'2001-07-30' or city = '1-URGENT'"), TODAY)


@query
def date_range(x: Inputs) -> DataFrame:
    return ingest.date_range(x.observations)


@query
def staleness(x: Inputs) -> DataFrame:
    return ingest.staleness(x.observations, TODAY)


@query
def row_counts(x: Inputs) -> DataFrame:
    return quality.row_counts(x.observations)


@query
def local_day_counts(x: Inputs) -> DataFrame:
    return x.readings.groupBy(local_day(F.col("ts")).alias("local_date")).agg(F.count("*").alias("readings"))


# ---- features ----------------------------------------------------------------------------------------


@query
def lag_features(x: Inputs) -> DataFrame:
    return features.lag_features(x.observations)


@query
def rolling_features(x: Inputs) -> DataFrame:
    return features.rolling_features(x.observations)


@query
def calendar_features(x: Inputs) -> DataFrame:
    return x.observations.select("city", "as_of", *[c.alias(n) for n, c in features.calendar_columns().items()])


@query
def features_full(x: Inputs) -> DataFrame:
    return x.features


QUERIES["features"] = QUERIES.pop("features_full")


def corrected(x: Inputs) -> tuple[DataFrame, DataFrame]:
    """Stored features of observations that were corrected later (the 17th of a quarter's first month) or came later (the 3rd), and these days."""
    late = (F.month("as_of") % 3 == 1) & (F.dayofmonth("as_of") == 3)
    wrong = (F.month("as_of") % 3 == 1) & (F.dayofmonth("as_of") == 17)
    first = x.observations.where(~late).withColumn("pm2_5", F.when(wrong, 0.0).otherwise(F.col("pm2_5")))
    return features.features(first), x.observations.where(late | wrong).select("city", "as_of")


@query
def reached_rows(x: Inputs) -> DataFrame:
    return features.reached(x.observations, corrected(x)[1])


@query
def incremental_features(x: Inputs) -> DataFrame:
    stored, changed = corrected(x)
    return ledger.upsert(stored, features.changed_features(x.observations, changed), ["city", "as_of"])


def stored(x: Inputs) -> str:
    """A folder of stored tables: observations, of which some come and some are corrected after the features were computed, and features brought up to date."""
    root = f"{shared_folder(x.spark)}/stored-{uuid.uuid4().hex}"
    changed = corrected(x)[1]
    late = x.observations.join(changed, ["city", "as_of"])
    first = x.observations.join(late.where("day(as_of) = 3").select("city", "as_of"), ["city", "as_of"], "left_anti")
    tables.merge(first.withColumn("pm2_5", F.when(F.dayofmonth("as_of") == 17, 0.0).otherwise(F.col("pm2_5"))), root, "observations")
    tables.refresh_features(x.spark, root, first.select("city", "as_of"))
    again = x.observations.where(F.dayofmonth("as_of").isin(3, 17))
    tables.merge(again, root, "observations")
    tables.refresh_features(x.spark, root, again.select("city", "as_of"))
    return root


@query
def stored_features(x: Inputs) -> DataFrame:
    return tables.read(x.spark, stored(x), "features").drop("created_at")


@query
def leakage_report_stored(x: Inputs) -> DataFrame:
    root = stored(x)
    return quality.leakage_report(tables.read(x.spark, root, "features"), tables.read(x.spark, root, "observations"))


@query
def leakage_report_since(x: Inputs) -> DataFrame:
    # Features of the years from 1996 on are stored wrongly after a clean check; only their parts are recomputed.
    root = stored(x)
    before = digests.mark(x.spark, root)
    wrong = tables.read(x.spark, root, "features", since="1996-01-01").where("day(as_of) = 15").withColumn("pm2_5_lag_1", F.lit(0.0))
    tables.merge(wrong, root, "features")
    return digests.leakage_since(x.spark, root, before)


@query
def stored_window(x: Inputs) -> DataFrame:
    return tables.read(x.spark, stored(x), "observations", since="1995-11-20", until="1996-02-10").drop("created_at")


@query
def stored_digests(x: Inputs) -> DataFrame:
    """Rows and dates of the stored features' parts by year, as the version has them; none differs from its files."""
    root = stored(x)
    now = tables.state(x.spark, root, "features")
    about = x.spark.createDataFrame([(now.of(p)[1], a["rows"], a["first"], a["last"]) for p, a in now.parts.items()], "year int, rows long, first string, last string")
    wrong = digests.verify(x.spark, root, "features").agg(F.count("*").alias("differing"))
    return about.groupBy("year").agg(F.sum("rows").alias("rows"), F.min("first").cast("date").alias("first_date"), F.max("last").cast("date").alias("last_date")).join(wrong)


@query
def features_long_series(x: Inputs) -> DataFrame:
    return long_series.long_features(x.observations)


@query
def date_gaps(x: Inputs) -> DataFrame:
    return features.date_gaps(x.observations)


@query
def latest_features(x: Inputs) -> DataFrame:
    return ledger.latest(x.features, ["city"], "as_of")


# ---- ledger ------------------------------------------------------------------------------------------


@query
def persistence_forecast(x: Inputs) -> DataFrame:
    return ledger.persistence(x.observations)


@query
def upsert_observations(x: Inputs) -> DataFrame:
    stored = x.observations.where("as_of < date'2000-06-01'")
    first = x.observations.where("as_of >= date'2000-01-01'").withColumns({"pm2_5": F.col("pm2_5") + 1, "batch_seq": F.lit(1)})
    again = x.observations.where("as_of >= date'2001-01-01'").withColumns({"pm2_5": F.col("pm2_5") + 2, "batch_seq": F.lit(2)})
    return ledger.upsert(stored, first.unionByName(again), ["city", "as_of"], order="batch_seq")


@query
def upsert_features(x: Inputs) -> DataFrame:
    stored = x.features.where("as_of < date'2000-06-01'").withColumn("pm2_5_lag_1", F.lit(-1.0))
    return ledger.upsert(stored, x.features.where("as_of >= date'2000-01-01'"), ["city", "as_of"])


@query
def upsert_forecasts(x: Inputs) -> DataFrame:
    stored = x.ledger.where("forecast_date < date'2001-06-01'")
    fresh = x.ledger.where("forecast_date >= date'2001-05-01' and model = 'persistence'").withColumns({"predicted_pm2_5": F.col("predicted_pm2_5") * 2, "actual_pm2_5": F.lit(None).cast("double")})
    return ledger.upsert(stored, fresh, ["city", "forecast_date", "model"], keep=["actual_pm2_5"])


@query
def upsert_backtest(x: Inputs) -> DataFrame:
    return ledger.upsert(x.ledger, x.naive.withColumn("model", F.lit("persistence")), ["city", "forecast_date", "model"])


@query
def upsert_performance(x: Inputs) -> DataFrame:
    scored = x.ledger.where("actual_pm2_5 is not null")
    total = backtest.metrics(scored, "model").join(scored.groupBy("model").agg(F.max("forecast_date").alias("score_date")), "model").withColumnRenamed("samples", "sample_size")
    return ledger.upsert(x.performance, total.select("score_date", "model", "mae", "rmse", "sample_size"), ["score_date", "model"])


@query
def publishable_forecasts(x: Inputs) -> DataFrame:
    model = ledger.latest(x.features, ["city"], "as_of").select("city", F.col("pm2_5_roll_7").alias("predicted_pm2_5"))
    return ledger.publishable(x.observations, x.features, model, "rolling_7")


@query
def score_pending(x: Inputs) -> DataFrame:
    return ledger.score_pending(x.ledger, x.observations)


@query
def score_returning(x: Inputs) -> DataFrame:
    return ledger.newly_scored(x.ledger, x.observations)


@query
def score_yesterday(x: Inputs) -> DataFrame:
    return ledger.score_day(x.ledger, x.observations, "2001-07-30")


@query
def score_daily_metrics(x: Inputs) -> DataFrame:
    return ledger.daily_metrics(ledger.newly_scored(x.ledger, x.observations))


# ---- backtests ---------------------------------------------------------------------------------------


@query
def training_set(x: Inputs) -> DataFrame:
    return x.training


@query
def training_set_h3(x: Inputs) -> DataFrame:
    return backtest.training_set(x.features, x.observations, horizon=3).select("city", "as_of", "target_date", "target", "pm2_5_lag_1")


@query
def alignment_violations(x: Inputs) -> DataFrame:
    # A pair in twenty is a day late.
    pairs = x.training.withColumn("target_date", F.when(F.dayofmonth("as_of") == 20, F.date_add("target_date", 1)).otherwise(F.col("target_date")))
    return backtest.alignment_violations(pairs)


@query
def naive_backtest(x: Inputs) -> DataFrame:
    return x.naive


@query
def naive_backtest_metrics(x: Inputs) -> DataFrame:
    return backtest.metrics(x.naive, "city")


@query
def walkforward_ols(x: Inputs) -> DataFrame:
    return x.ols


@query
def walkforward_ols_long_series(x: Inputs) -> DataFrame:
    return long_series.long_walkforward_ols(x.observations)


@query
def walkforward_ar1(x: Inputs) -> DataFrame:
    return backtest.walkforward_ar1(x.observations)


@query
def walkforward_ma1(x: Inputs) -> DataFrame:
    return backtest.walkforward_ma1(x.observations)


@query
def walkforward_ses(x: Inputs) -> DataFrame:
    return backtest.walkforward_ses(x.observations)


@query
def walkforward_ridge(x: Inputs) -> DataFrame:
    return backtest.walkforward_ridge(x.training)


@query
def model_metrics(x: Inputs) -> DataFrame:
    return backtest.metrics(x.ledger, "model")


@query
def paired_errors(x: Inputs) -> DataFrame:
    return backtest.paired(x.ledger, "persistence", "rolling_7")


@query
def backtest_summary(x: Inputs) -> DataFrame:
    return backtest.summary(x.naive, x.ols)


@query
def backtest_long(x: Inputs) -> DataFrame:
    return backtest.long_form(x.naive, x.ols)


@query
def backtest_head_tail(x: Inputs) -> DataFrame:
    return backtest.head_tail(x.naive)


# ---- models ------------------------------------------------------------------------------------------


@query
def training_matrix(x: Inputs) -> DataFrame:
    return models.missing_share(x.training)


@query
def walkforward_gbt(x: Inputs) -> DataFrame:
    return x.trees


@query
def walkforward_gbt_summary(x: Inputs) -> DataFrame:
    return backtest.summary(x.naive, x.trees)


@query
def gbt_forecast(x: Inputs) -> DataFrame:
    return models.forecast(models.fit(x.training), x.features)


# ---- serving -----------------------------------------------------------------------------------------


@query
def latest_forecast(x: Inputs) -> DataFrame:
    return serve.latest_forecast(x.ledger)


@query
def prediction_log(x: Inputs) -> DataFrame:
    return serve.prediction_log(x.ledger, limit=200)


@query
def prediction_log_scored(x: Inputs) -> DataFrame:
    return serve.prediction_log(x.ledger, "rolling_7", scored_only=True)


@query
def evaluation_30d(x: Inputs) -> DataFrame:
    return serve.evaluation(x.ledger, TODAY)


@query
def leaderboard(x: Inputs) -> DataFrame:
    return serve.leaderboard(x.performance)


@query
def history_30(x: Inputs) -> DataFrame:
    return serve.history(x.observations)


@query
def accuracy_summary(x: Inputs) -> DataFrame:
    return serve.accuracy_summary(x.ledger)


@query
def rolling_accuracy(x: Inputs) -> DataFrame:
    return serve.rolling_accuracy(x.ledger)


@query
def rolling_accuracy_long_series(x: Inputs) -> DataFrame:
    return long_series.long_rolling_accuracy(x.ledger)


@query
def concentration_bands(x: Inputs) -> DataFrame:
    return serve.bands(x.observations)


@query
def prediction_badges(x: Inputs) -> DataFrame:
    return serve.badges(x.ledger)


@query
def forecast_change(x: Inputs) -> DataFrame:
    return serve.forecast_change(x.ledger, x.observations)


# ---- quality -----------------------------------------------------------------------------------------


@query
def observation_nulls(x: Inputs) -> DataFrame:
    return quality.null_counts(x.observations, MEASURES, "city")


@query
def feature_nulls(x: Inputs) -> DataFrame:
    return quality.null_counts(x.features, [*LAGS, *ROLLS], "city")


@query
def duplicate_keys(x: Inputs) -> DataFrame:
    # Leap days come twice.
    return quality.duplicate_keys(x.observations.unionByName(x.observations.where("day(as_of) = 29 and month(as_of) = 2")), "observations")


@query
def leakage_report(x: Inputs) -> DataFrame:
    return quality.leakage_report(x.features, x.observations)


def dirty_features(x: Inputs) -> DataFrame:
    """A lag filled in, a mean lost, a weekday moved, a row without an observation."""
    f = x.features.withColumns({
        "pm2_5_lag_1": F.when(F.dayofmonth("as_of") == 15, 0.0).otherwise(F.col("pm2_5_lag_1")),
        "pm2_5_roll_7": F.when(F.dayofmonth("as_of") != 10, F.col("pm2_5_roll_7")),
        "day_of_week": F.when(F.dayofmonth("as_of") == 5, 0).otherwise(F.col("day_of_week")),
    })
    return f.unionByName(x.features.where("as_of = date'1995-03-01'").withColumn("as_of", day("1990-01-01")))


@query
def leakage_report_dirty(x: Inputs) -> DataFrame:
    return quality.leakage_report(dirty_features(x), x.observations)


@query
def latest_feature_nulls(x: Inputs) -> DataFrame:
    return quality.latest_nulls(x.features)


@query
def orphan_predictions(x: Inputs) -> DataFrame:
    return quality.orphan_predictions(x.ledger, x.features.where("day(as_of) <> 11"), "persistence")


@query
def score_mismatches(x: Inputs) -> DataFrame:
    moved = F.when(F.dayofmonth("forecast_date") == 20, F.col("actual_pm2_5") + 0.5).otherwise(F.col("actual_pm2_5"))
    return quality.score_mismatches(x.ledger.withColumn("actual_pm2_5", moved), x.observations)


@query
def missing_models(x: Inputs) -> DataFrame:
    return quality.missing_models(x.ledger, ["persistence", "rolling_7", "gbt"])


@query
def forecast_diagnostics(x: Inputs) -> DataFrame:
    return quality.forecast_diagnostics(x.ledger.where("forecast_date < date'2001-07-30' or city like '1%'"), x.observations, "rolling_7")


@query
def readiness_report(x: Inputs) -> DataFrame:
    return quality.readiness_report(x.observations, x.features, x.ledger, ["persistence", "rolling_7"], TODAY)


@query
def readiness_summary(x: Inputs) -> DataFrame:
    return quality.readiness_summary(quality.readiness_report(x.observations, x.features, x.ledger, ["persistence", "rolling_7"], TODAY))


@query
def prediction_summary(x: Inputs) -> DataFrame:
    return quality.prediction_summary(x.ledger)


# ---- as-of reads ---------------------------------------------------------------------------------------


def times_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t.startswith("timestamp")})


@query
def forecast_versions(x: Inputs) -> DataFrame:
    return times_as_text(history.versions(x.forecast_log, history.FORECAST))


@query
def ledger_as_of(x: Inputs) -> DataFrame:
    return times_as_text(history.as_of(x.forecast_log, F.lit(AS_OF).cast("timestamp_ntz"), history.FORECAST))


@query
def late_publications(x: Inputs) -> DataFrame:
    return times_as_text(history.late_publications(x.forecast_log, x.observation_log))


@query
def published_before_outcome(x: Inputs) -> DataFrame:
    return times_as_text(history.published_before_outcome(x.forecast_log, x.observation_log))


def served(x: Inputs) -> DataFrame:
    """The ledger as it is read: the newest version of each forecast with the time it was written, and actuals."""
    newest = ledger.latest(x.forecast_log, history.FORECAST, "created_at")
    return ledger.with_actuals(newest, x.observations, before=OPEN_FROM)


@query
def prediction_log_created(x: Inputs) -> DataFrame:
    return times_as_text(serve.prediction_log(served(x), limit=200))


@query
def latest_forecast_created(x: Inputs) -> DataFrame:
    return times_as_text(serve.latest_forecast(served(x)))


# ---- streams -----------------------------------------------------------------------------------------


@query
def stream_daily_mean(x: Inputs) -> DataFrame:
    events = x.table("events")
    stream = x.spark.readStream.schema(events.schema).parquet(f"{x.sf_dir}/events.parque[t]")  # as a pattern, it may be a file or a folder
    return streaming.stream_daily_means(readings_of(stream), f"{shared_folder(x.spark)}/stream-{uuid.uuid4().hex}")


def arriving(x: Inputs, rows: DataFrame, by: Column, root: str, name: str, files: int) -> DataFrame:
    """rows as a stream of files in the order of `by`, one a batch."""
    land(rows, by, f"{root}/{name}", files)
    return x.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/{name}")


@query
def stream_score(x: Inputs) -> DataFrame:
    root = f"{shared_folder(x.spark)}/stream-{uuid.uuid4().hex}"
    forecasts = arriving(x, x.ledger, F.col("forecast_date"), root, "forecasts", 4)
    seen = arriving(x, x.observations.select("city", "as_of", "pm2_5"), F.col("as_of"), root, "observations", 4)
    return ledger.with_scores(x.ledger, streaming.stream_scores(forecasts, seen, root))


@query
def stream_features(x: Inputs) -> DataFrame:
    # Days arrive up to a week out of order.
    root = f"{shared_folder(x.spark)}/stream-{uuid.uuid4().hex}"
    mixed = F.date_add("as_of", F.pmod(F.xxhash64("city", "as_of"), F.lit(8)).cast("int"))
    return streaming.stream_features(arriving(x, x.observations, mixed, root, "observations", 4), root).drop("version", "late")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each series' latest days with the persistence forecast and the last 30 days' evaluation."""
    x = Inputs(spark, sf_dir)
    last = ledger.latest(x.features, ["city"], "as_of")
    forecast = ledger.persistence(ledger.latest(x.observations, ["city"], "as_of")).drop("model")
    judged = serve.evaluation(x.ledger.where("model = 'persistence'"), TODAY).drop("model")
    return rounded(last.select("city", "as_of", *FEATURE_COLUMNS).join(forecast, "city").join(judged, "city", "left"))
