"""Table schemas, keys and the one list of model columns."""

from __future__ import annotations

from pyspark.sql import types as T

MEASURES = ["pm2_5", "pm10", "temperature_2m_mean", "wind_speed_10m_max", "precipitation_sum"]
#: Source column of each lag.
LAGS = {
    "pm2_5_lag_1": "pm2_5",
    "pm10_lag_1": "pm10",
    "temperature_lag_1": "temperature_2m_mean",
    "wind_speed_lag_1": "wind_speed_10m_max",
    "precipitation_lag_1": "precipitation_sum",
}
#: Source column and number of rows of each rolling mean.
ROLLS = {"pm2_5_roll_7": ("pm2_5", 7), "pm2_5_roll_30": ("pm2_5", 30), "pm10_roll_7": ("pm10", 7), "pm10_roll_30": ("pm10", 30)}
CALENDAR = ["day_of_week", "month", "is_weekend"]
WEATHER = ["temperature_2m_mean", "wind_speed_10m_max", "precipitation_sum"]
#: The model's inputs, in the order that every fitted model expects.
FEATURE_COLUMNS = [*LAGS, *ROLLS, *CALENDAR, *WEATHER]


def _table(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


_double = lambda names: [(n, T.DoubleType(), True) for n in names]
_created = ("created_at", T.TimestampType(), True)

TABLES = {
    "observations": _table(("city", T.StringType(), False), ("as_of", T.DateType(), False), *_double(MEASURES), _created),
    "features": _table(
        ("city", T.StringType(), False),
        ("as_of", T.DateType(), False),
        *_double([*LAGS, *ROLLS]),
        ("day_of_week", T.IntegerType(), True),
        ("month", T.IntegerType(), True),
        ("is_weekend", T.BooleanType(), True),
        *_double(WEATHER),
        _created,
    ),
    "predictions": _table(("city", T.StringType(), False), ("forecast_date", T.DateType(), False), *_double(["predicted_pm2_5", "actual_pm2_5"]), ("model", T.StringType(), True), _created),
    "model_performance": _table(("score_date", T.DateType(), False), ("model", T.StringType(), False), *_double(["mae", "rmse"]), ("sample_size", T.IntegerType(), True), _created),
}
KEYS = {
    "observations": ["city", "as_of"],
    "features": ["city", "as_of"],
    "predictions": ["city", "forecast_date", "model"],
    "model_performance": ["score_date", "model"],
}

HOURLY = T.StructType([T.StructField("time", T.ArrayType(T.StringType())), T.StructField("pm2_5", T.ArrayType(T.DoubleType())), T.StructField("pm10", T.ArrayType(T.DoubleType()))])
DAILY = T.StructType([T.StructField("time", T.ArrayType(T.StringType())), *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in WEATHER)])
#: Landed payloads: parallel arrays, one object a series.
PAYLOAD = T.StructType([T.StructField("city", T.StringType()), T.StructField("hourly", HOURLY), T.StructField("daily", DAILY)])
