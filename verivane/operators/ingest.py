"""Readings and weather to daily observations; incremental ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verivane.functions import day
from verivane.schema import WEATHER


def daily_means(readings: DataFrame) -> DataFrame:
    """The mean of each UTC day, nulls ignored; a day of nulls stays, with null."""
    return readings.groupBy("city", F.to_date("ts").alias("as_of")).agg(F.avg("pm2_5").alias("pm2_5"), F.avg("pm10").alias("pm10"))


def with_weather(daily: DataFrame, weather: DataFrame, keys: list[str]) -> DataFrame:
    """Days without weather have null there, weather without a day goes."""
    return daily.join(weather.select(*keys, *WEATHER), keys, "left")


def missing_hours(readings: DataFrame) -> DataFrame:
    return readings.groupBy("city").agg(F.count("*").alias("hours"), F.count_if(F.col("pm2_5").isNull()).alias("missing"))


def source_gate(readings: DataFrame, weather: DataFrame, hours: int = 15_000, days: int = 700) -> DataFrame:
    """One row: hours, missing hours, weather days, and whether both suffice."""
    a = readings.agg(F.count("*").alias("hours"), F.count_if(F.col("pm2_5").isNull()).alias("missing_hours")).withColumn("one", F.lit(1))
    b = weather.agg(F.count("*").alias("weather_days")).withColumn("one", F.lit(1))
    return a.join(b, "one").drop("one").withColumn("go", (F.col("hours") > hours) & (F.col("weather_days") > days))


def next_range(observations: DataFrame, today: str, initial: str = "2023-08-01") -> DataFrame:
    """Each city's dates still to fetch: from the day after its latest to yesterday; none where that is empty."""
    start = F.coalesce(F.date_add(F.max("as_of"), 1), day(initial))
    return observations.groupBy("city").agg(start.alias("start_date")).withColumn("end_date", F.date_sub(day(today), 1)).where("start_date <= end_date")


def date_range(observations: DataFrame) -> DataFrame:
    return observations.groupBy("city").agg(F.min("as_of").alias("first_date"), F.max("as_of").alias("last_date"))


def staleness(observations: DataFrame, today: str) -> DataFrame:
    return observations.groupBy("city").agg(F.max("as_of").alias("latest_observation")).withColumn("stale_days", F.datediff(day(today), "latest_observation").cast("long"))
