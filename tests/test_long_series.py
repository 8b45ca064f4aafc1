"""Windows over blocks of long series: the same rows as windows over whole series, and no task with a whole one."""

import pytest
from pyspark.sql import functions as F

from tests.test_ledger import OBS
from tests.test_streaming import made, same_features
from verivane.operators import backtest, features, long_series, serve


def data(spark):
    """A long series with gaps, a shorter one, one of four rows and one of a single row; some values are null."""
    rows = made(300, 1, gaps=(0, 20, 21, 60, *range(100, 190))) + made(100, 2, "b") + made(4, 3, "c") + made(1, 4, "d")
    return spark.createDataFrame(rows, OBS).withColumn("pm2_5", F.when(F.dayofmonth("as_of") % 11 != 3, F.col("pm2_5")))


def same(a, b, *keys):
    assert a.columns == b.columns
    x, y = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (a, b))
    assert x.keys() == y.keys() and len(x) == b.count()
    for k, r in x.items():
        for c in a.columns:
            assert r[c] == y[k][c] or r[c] == pytest.approx(y[k][c], abs=1e-9), (k, c)


@pytest.mark.parametrize("days, rows", [(256, 256), (7, 64), (31, 8), (1, 1)])
def test_same_as_whole_series(spark, monkeypatch, days, rows):
    monkeypatch.setattr(long_series, "DAYS", days)
    monkeypatch.setattr(long_series, "ROWS", rows)
    obs = data(spark)
    same_features(long_series.long_features(obs), features.features(obs))
    same(long_series.long_walkforward_ols(obs), backtest.walkforward_ols(obs), "city", "forecast_date")
    log = obs.select("city", F.col("as_of").alias("forecast_date"), F.explode(F.array(F.lit("m"), F.lit("n"))).alias("model"), F.col("pm10").alias("predicted_pm2_5"), F.col("pm2_5").alias("actual_pm2_5"))
    same(long_series.long_rolling_accuracy(log), serve.rolling_accuracy(log), "city", "model", "forecast_date")


def test_no_block_holds_more_than_its_rows_and_copies(spark, monkeypatch):
    monkeypatch.setattr(long_series, "DAYS", 16)
    monkeypatch.setattr(long_series, "ROWS", 40)
    rows, _ = long_series.in_blocks(data(spark), ["city"], "as_of", 29)
    sizes = rows.groupBy("city", "_block").agg(F.count("*").alias("n"), F.count_if("_copy").alias("copies")).collect()
    assert max(r["n"] for r in sizes) <= 40 + 29 and max(r["copies"] for r in sizes) <= 29 and len(sizes) > 7
    assert rows.where("not _copy").count() == data(spark).count()


def test_empty(spark):
    none = spark.createDataFrame([], OBS)
    assert long_series.long_features(none).collect() == [] and long_series.long_walkforward_ols(none).collect() == []


def test_a_line_through_values_far_from_zero(spark):
    """Sums of squares of large values would lose the digits that the line is made of."""
    far = data(spark).withColumn("pm2_5", F.col("pm2_5") + 1e7)
    got = {(r[0], r[1]): r[2] for r in long_series.long_walkforward_ols(far).collect()}
    want = {(r[0], r[1]): r[2] + 1e7 for r in backtest.walkforward_ols(data(spark)).collect()}
    assert got.keys() == want.keys() and len(want) > 50
    assert all(got[k] == pytest.approx(v, abs=1e-4) for k, v in want.items() if v is not None)


def test_constant_series(spark):
    flat = data(spark).withColumn("pm2_5", F.lit(5.0))
    assert [r[2] for r in long_series.long_walkforward_ols(flat).collect()] == [r[2] for r in backtest.walkforward_ols(flat).collect()]
