"""Boosted-tree forecasts with MLlib: training matrix, fit, persistence, distributed application."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verivane.operators.ledger import latest
from verivane.schema import FEATURE_COLUMNS

INPUTS = [*FEATURE_COLUMNS, *(f"{c}_missing" for c in FEATURE_COLUMNS)]


def matrix(rows: DataFrame) -> DataFrame:
    """Features as doubles without nulls (trees reject NaN): 0 and an indicator stand for a missing value."""
    return rows.withColumns(
        {f"{c}_missing": F.col(c).isNull().cast("double") for c in FEATURE_COLUMNS} | {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURE_COLUMNS}
    )


def fit(training: DataFrame, rounds: int = 100, depth: int = 5, step: float = 0.05, seed: int = 42) -> PipelineModel:
    if len(FEATURE_COLUMNS) != 15:
        raise ValueError(f"the model takes 15 features, not {len(FEATURE_COLUMNS)}")
    trees = GBTRegressor(labelCol="target", featuresCol="features", maxDepth=depth, stepSize=step, featureSubsetStrategy="0.9", subsamplingRate=0.8, maxIter=rounds, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=INPUTS, outputCol="features"), trees]).fit(matrix(training))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(spark, path: str) -> PipelineModel | None:
    """None where nothing is stored: the caller goes on with the baseline alone."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return PipelineModel.load(path) if found else None


def forecast(model: PipelineModel | None, features: DataFrame, name: str = "gbt") -> DataFrame | None:
    """The model's forecast for the day after each series' latest features; None without a model."""
    if model is None:
        return None
    last = latest(features, ["city"], "as_of")
    return model.transform(matrix(last)).select("city", F.date_add("as_of", 1).alias("forecast_date"), F.lit(name).alias("model"), F.col("prediction").alias("predicted_pm2_5"))


def missing_share(training: DataFrame) -> DataFrame:
    """One row: rows of the matrix, missing values in it, sum of each indicator."""
    m = matrix(training)
    total = reduce(lambda a, b: a + b, [F.col(f"{c}_missing") for c in FEATURE_COLUMNS])
    return m.agg(F.count("*").alias("rows"), F.sum(total).cast("long").alias("missing"), *[F.sum(f"{c}_missing").cast("long").alias(f"{c}_missing") for c in FEATURE_COLUMNS])
