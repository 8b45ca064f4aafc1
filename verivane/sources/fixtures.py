"""Series derived from the given star-schema tables: long daily histories, readings, payloads, a forecast ledger."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verivane.operators import backtest, boosting, features, ledger
from verivane.schema import WEATHER
from verivane.sources.constants import OPEN_FROM


PIECE = 5000


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def weather(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.to_date("l_shipdate").alias("as_of")).agg(F.avg("l_quantity").alias(WEATHER[0]), F.max(F.col("l_discount") * 100).alias(WEATHER[1]), F.sum("l_tax").alias(WEATHER[2]))

    @cached_property
    def observations(self) -> DataFrame:
        daily = self.table("orders").groupBy(F.col("o_orderpriority").alias("city"), F.to_date("o_orderdate").alias("as_of")).agg(
            (F.avg(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))) / 1000).alias("pm2_5"), (F.max("o_totalprice") / 1000).alias("pm10")
        )
        return daily.join(self.weather, "as_of", "left").select("city", "as_of", "pm2_5", "pm10", *WEATHER)

    @cached_property
    def features(self) -> DataFrame:
        return features.features(self.observations)

    @cached_property
    def readings(self) -> DataFrame:
        return readings_of(self.table("events"))

    @cached_property
    def payload_lines(self) -> DataFrame:
        """JSON of parallel arrays for each city and UTC day, in pieces of about PIECE readings, as several fetches land them."""
        r = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"), "pm2_5", "pm10")
        rows = self.readings.withColumn("d", F.to_date("ts"))
        sizes = rows.groupBy("city", "d").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
        days = rows.join(sizes, ["city", "d"]).groupBy("city", "d", F.pmod(F.xxhash64("ts", "pm2_5", "pm10"), "pieces").alias("piece")).agg(F.sort_array(F.collect_list(r)).alias("r"))
        hourly = F.struct(*[F.col(f"r.{c}").alias(c) for c in ("time", "pm2_5", "pm10")])
        return days.select(F.to_json(F.struct("city", hourly.alias("hourly"))).alias("payload"))

    @cached_property
    def weather_lines(self) -> DataFrame:
        """The same for weather, one object a year."""
        r = F.struct(F.col("as_of").cast("string").alias("time"), *WEATHER)
        years = self.weather.groupBy(F.year("as_of").alias("y")).agg(F.sort_array(F.collect_list(r)).alias("r"))
        daily = F.struct(*[F.col(f"r.{c}").alias(c) for c in ("time", *WEATHER)])
        return years.select(F.to_json(F.struct(F.lit("all").alias("city"), daily.alias("daily"))).alias("payload"))

    @cached_property
    def forecasts(self) -> DataFrame:
        rolling = self.features.select("city", F.date_add("as_of", 1).alias("forecast_date"), F.lit("rolling_7").alias("model"), F.col("pm2_5_roll_7").alias("predicted_pm2_5"))
        return ledger.persistence(self.observations).unionByName(rolling)

    @cached_property
    def forecast_log(self) -> DataFrame:
        """Versions of the forecasts: written up to three days from the day before theirs on, some written again 20 hours later."""
        hours = (F.dayofmonth("forecast_date") * 7 + F.month("forecast_date") * 5) % 72
        first = self.forecasts.withColumn("created_at", F.date_sub("forecast_date", 1).cast("timestamp_ntz") + F.make_dt_interval(hours=hours))
        again = first.where(F.dayofmonth("forecast_date") % 3 == 0)
        return first.unionByName(again.withColumns({"created_at": F.col("created_at") + F.expr("interval 20 hours"), "predicted_pm2_5": F.col("predicted_pm2_5") + 1}))

    @cached_property
    def observation_log(self) -> DataFrame:
        """Observations as they came in, two hours after their day; on the first of a month once more, corrected, a day later."""
        first = self.observations.select("city", "as_of", "pm2_5", (F.date_add("as_of", 1).cast("timestamp_ntz") + F.expr("interval 2 hours")).alias("created_at"))
        again = first.where(F.dayofmonth("as_of") == 1)
        return first.unionByName(again.withColumns({"pm2_5": F.col("pm2_5") + 5, "created_at": F.col("created_at") + F.expr("interval 1 day")}))

    @cached_property
    def ledger(self) -> DataFrame:
        return ledger.with_actuals(self.forecasts, self.observations, before=OPEN_FROM)

    @cached_property
    def performance(self) -> DataFrame:
        return ledger.daily_metrics(self.ledger.where("actual_pm2_5 is not null"))

    @cached_property
    def training(self) -> DataFrame:
        return backtest.training_set(self.features, self.observations)

    @cached_property
    def naive(self) -> DataFrame:
        return backtest.naive_backtest(self.training)

    @cached_property
    def trees(self) -> DataFrame:
        return boosting.walkforward_trees(self.training)

    @cached_property
    def ols(self) -> DataFrame:
        return backtest.walkforward_ols(self.observations)


def readings_of(events: DataFrame) -> DataFrame:
    """city, ts, pm2_5, pm10 of the events table, batch or stream."""
    return events.select(
        F.col("event_type").alias("city"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("user_id") % 7 != 0, F.col("value")).alias("pm2_5"), F.get_json_object("props", "$.k").cast("double").alias("pm10"),
    )
