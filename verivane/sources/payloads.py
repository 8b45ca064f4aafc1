"""Landed JSON payloads: parallel arrays become rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verivane.schema import DAILY, HOURLY, PAYLOAD, WEATHER


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed files, one JSON object a line; the schema is fixed, nothing is inferred."""
    return spark.read.schema(PAYLOAD).json(path)


def parse_payloads(lines: DataFrame, column: str = "payload") -> DataFrame:
    """The same for JSON in a column."""
    return lines.select(F.from_json(column, PAYLOAD).alias("p")).select("p.*")


def hourly_readings(payloads: DataFrame) -> DataFrame:
    """city, ts, pm2_5, pm10: arrays zipped by place; a shorter array counts as null at its end."""
    rows = payloads.select("city", F.inline(F.arrays_zip(*[F.col(f"hourly.{f.name}") for f in HOURLY])))
    return rows.select("city", F.to_timestamp("time").alias("ts"), "pm2_5", "pm10")


def daily_weather(payloads: DataFrame) -> DataFrame:
    """city, as_of and the weather columns; of a repeated date the first place counts."""
    rows = payloads.select("city", F.posexplode(F.arrays_zip(*[F.col(f"daily.{f.name}") for f in DAILY])).alias("place", "r"))
    first = rows.groupBy("city", F.to_date("r.time").alias("as_of")).agg(F.min_by("r", "place").alias("r"))
    return first.select("city", "as_of", *[F.col(f"r.{c}").alias(c) for c in WEATHER])
