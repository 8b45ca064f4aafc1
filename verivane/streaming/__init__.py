"""Streams: daily means that late readings correct, scoring as observations arrive, features kept up to date."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verivane.operators.features import ROWS, calendar_columns
from verivane.operators.ledger import latest, upsert
from verivane.schema import FEATURE_COLUMNS, LAGS, MEASURES, ROLLS, WEATHER
from verivane.sources.tables import read_snapshot, update


def _drain(stream: DataFrame, each, checkpoint: str, mode: str) -> None:
    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_daily_means(readings: DataFrame, root: str, lateness: str = "2 days") -> DataFrame:
    """Runs until the input is used up. Each batch upserts the days it changed, in the parts that hold them; a day stays open for late readings for as
    long as the watermark allows. A batch that is run again writes the same rows: the upsert is idempotent."""
    spark = readings.sparkSession
    days = readings.withWatermark("ts", lateness).groupBy("city", F.window("ts", "1 day")).agg(F.avg("pm2_5").alias("pm2_5"), F.avg("pm10").alias("pm10"), F.count("*").alias("hours"))
    days = days.select("city", F.to_date("window.start").alias("as_of"), "pm2_5", "pm10", "hours")

    def each(batch: DataFrame, _: int) -> None:
        update(batch, root, "daily", days.schema, lambda stored: upsert(stored, batch, ["city", "as_of"]))

    _drain(days, each, f"{root}/_checkpoint-daily", "update")
    return read_snapshot(spark, root, "daily", days.schema)


# ---- scoring -----------------------------------------------------------------------------------------

SCORED = "city string, forecast_date date, model string, predicted_pm2_5 double, actual_pm2_5 double"


def stream_scores(forecasts: DataFrame, observations: DataFrame, root: str, lateness: str = "30 days") -> DataFrame:
    """Runs until both streams are used up; returns the pending forecasts settled so far, a row each.

    Forecasts wait for their outcome, and outcomes for forecasts, in the state of a stream-stream join keyed by city and day: no stored
    ledger is read again. A day's state goes when the watermark, the earlier of both streams' latest day less `lateness`, passes it; forecasts that
    are then without an outcome are returned with null, so that a later batch can still score them (ledger.score_pending). Rows
    that come later than that are left to it, too. Of several forecasts of one key, or readings of one day, the first counts: a forecast is not changed once its outcome
    may be known. Null readings are no outcomes. The file sink writes each batch once, also when it runs again after a crash."""
    spark = observations.sparkSession
    due = forecasts.where("actual_pm2_5 is null").select("city", "forecast_date", "model", "predicted_pm2_5", F.col("forecast_date").cast("timestamp").alias("due"))
    due = due.withWatermark("due", lateness).dropDuplicatesWithinWatermark(["city", "due", "model"])
    seen = observations.where("pm2_5 is not null").select(F.col("city").alias("_city"), F.col("as_of").cast("timestamp").alias("seen"), F.col("pm2_5").alias("actual_pm2_5"))
    seen = seen.withWatermark("seen", lateness).dropDuplicatesWithinWatermark(["_city", "seen"])
    settled = due.join(seen, (F.col("city") == F.col("_city")) & (F.col("due") == F.col("seen")), "left_outer")
    return _appended(spark, settled.select("city", "forecast_date", "model", "predicted_pm2_5", "actual_pm2_5"), root, "scores", SCORED)


def _appended(spark: SparkSession, rows: DataFrame, root: str, name: str, schema: str) -> DataFrame:
    """What a stream has written so far to a folder of Parquet files, each batch once."""
    path = f"{root}/{name}"
    rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", f"{root}/_checkpoint-{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(path)


# ---- features ----------------------------------------------------------------------------------------

RING = "version long, gone long, days array<int>, cells array<double>"
KEPT = f"city string, as_of date, version long, late boolean, {', '.join(f'{c} double' for c in [*LAGS, *ROLLS, *WEATHER])}"


def ring_features(days: np.ndarray, cells: np.ndarray, gone: int) -> dict[str, np.ndarray]:
    """Lag and rolling features of consecutive rows of a series, before which `gone` others lie; days rise, cells are rows x measures with NaN for null."""
    value = dict(zip(MEASURES, cells.T, strict=True))
    adjacent = np.r_[False, np.diff(days) == 1]
    out = {name: np.where(adjacent, np.r_[np.nan, value[source][:-1]], np.nan) for name, source in LAGS.items()}
    for name, (source, n) in ROLLS.items():
        frame = np.lib.stride_tricks.sliding_window_view(np.r_[np.full(n - 1, np.nan), value[source]], n)
        there = (~np.isnan(frame)).sum(1)
        mean = np.divide(np.nansum(frame, axis=1), there, out=np.full(len(days), np.nan), where=there > 0)
        out[name] = np.where(gone + np.arange(1, len(days) + 1) >= n, mean, np.nan)
    return out | {c: value[c] for c in WEATHER}


def stream_features(observations: DataFrame, root: str, lateness: int = 10) -> DataFrame:
    """Keeps the features of daily observations up to date as they arrive, in any order within `lateness` days of a series' latest; runs until the
    input is used up and returns city, as_of, version, late and the model's columns, the newest version of each day.

    The state of a series is a ring: the days that a late reading may still change, and the ROWS before them that their features reach back to;
    how many rows have left it is counted, for the warm-up of the means. A reading that comes in, or corrects its day, gives new versions of its own row and of those after
    it, from the ring alone. What comes too late to be placed is returned as a row with late = true and null features: these days, and what they
    reach, are for features.changed_features() to compute. The sink only appends; a batch that is run again after a crash is written once."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        warnings.filterwarnings("ignore", "The behavior of DataFrame concatenation", FutureWarning)  # Spark's own, for each batch of states
        version, gone, days, cells = state.get if state.exists else (0, 0, [], [])
        days, cells = np.array(days, np.int64), np.array(cells, np.float64).reshape(-1, len(MEASURES))
        came = pd.concat(list(batches), ignore_index=True).drop_duplicates("day", keep="last").sort_values("day")
        new, values = came["day"].to_numpy(np.int64), came[MEASURES].to_numpy(np.float64)
        # Placed where what its features reach back to is in the ring.
        late = (new <= days[ROWS - 1]) if gone and len(days) >= ROWS else np.zeros(len(new), bool)
        old = ~np.isin(days, new[~late])
        days, cells = np.r_[days[old], new[~late]], np.r_[cells[old], values[~late]]
        order = np.argsort(days, kind="stable")
        days, cells = days[order], cells[order]
        out = [pd.DataFrame({"day": new[late], "late": True})]
        if not late.all():
            first = int(np.searchsorted(days, new[~late][0]))
            made = ring_features(days, cells, gone)
            out.append(pd.DataFrame({"day": days[first:], "late": False} | {c: v[first:] for c, v in made.items()}))
            drop = max(0, int(np.searchsorted(days, days[-1] - lateness)) - ROWS)
            gone, days, cells = gone + drop, days[drop:], cells[drop:]
        state.update((version + 1, gone, days.tolist(), cells.ravel().tolist()))
        rows = pd.concat(out, ignore_index=True).reindex(columns=["day", "late", *LAGS, *ROLLS, *WEATHER])
        as_of = pd.to_datetime(rows["day"], unit="D").dt.date
        yield rows.drop(columns="day").assign(city=key[0], as_of=as_of, version=version + 1)[[f.split()[0] for f in KEPT.split(", ")]]

    daily = observations.select("city", F.unix_date("as_of").alias("day"), *MEASURES)
    versions = daily.groupBy("city").applyInPandasWithState(keep, KEPT, RING, "append", GroupStateTimeout.NoTimeout)
    null = {c: F.when(~F.isnan(c), F.col(c)) for c in [*LAGS, *ROLLS, *WEATHER]}  # pandas has no other null for a number
    rows = latest(_appended(observations.sparkSession, versions, root, "features", KEPT).withColumns(null), ["city", "as_of"], "version")
    calendar = {c: F.when(~F.col("late"), e) for c, e in calendar_columns().items()}
    return rows.withColumns(calendar).select("city", "as_of", "version", "late", *FEATURE_COLUMNS)
