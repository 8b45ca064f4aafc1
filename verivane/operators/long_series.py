"""Windows over few, long series, none of which is one task's.

A series is cut into blocks of DAYS days. What comes before a row is then two sums: over the blocks before its own, from a table with a row a block, and over the
rows before it in its own. Row numbers are such sums; by them a series is cut again, into blocks of ROWS rows, each with a copy of the last rows before it as
far as frames reach back, so that every frame lies in one block.

A task holds blocks: DAYS rows at most (a series has a row a day at most), or ROWS and the copies; only the table of blocks is ordered by series, a DAYS-th
of it. All rows pass two shuffles where a window over whole series has one, so that this pays where series are few and long. Keys and dates are
not null, as in stored tables. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from verivane.functions import absolute_error, accuracy_percent
from verivane.operators import backtest, features
from verivane.schema import FEATURE_COLUMNS

DAYS, ROWS = 256, 256


def before(rows: DataFrame, keys: list[str], date: str, sums: dict[str, Column]) -> DataFrame:
    """rows, and by name the sums of columns (nulls skipped) over the rows before each in its series; 0 where there are none."""
    own, total = {n: f"_own_{n}" for n in sums}, {n: f"_total_{n}" for n in sums}
    block = F.floor(F.datediff(F.col(date), F.lit("1970-01-01").cast("date")) / DAYS)
    placed = rows.withColumns({own[n]: c for n, c in sums.items()} | {"_block": block})
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_block").orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy(*keys, "_block").agg(*[F.sum(own[n]).alias(total[n]) for n in sums])
    offsets = blocks.select(*keys, "_block", *[F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(t) for t in total.values()])
    # Rows meet their block's offsets where the window needs them: one shuffle for both.
    joined = placed.join(offsets, [*keys, "_block"])
    return joined.select(*rows.columns, *[(F.col(total[n]) + F.coalesce(F.sum(own[n]).over(inside), F.lit(0))).alias(n) for n in sums])


def in_blocks(rows: DataFrame, keys: list[str], date: str, reach: int) -> tuple[DataFrame, WindowSpec]:
    """rows with _row (how many come before it in its series), _block and _copy (whether it is a copy for a later block), and the window of a block:
    frames of up to `reach` rows before the current one are whole for all rows but copies."""
    numbered = before(rows, keys, date, {"_row": F.lit(1)})
    home = F.floor(F.col("_row") / ROWS)
    spread = numbered.withColumn("_block", F.explode(F.sequence(home, F.floor((F.col("_row") + reach) / ROWS))))
    return spread.withColumn("_copy", F.col("_block") > home), Window.partitionBy(*keys, "_block").orderBy(date)


def long_features(observations: DataFrame) -> DataFrame:
    """The same as features.features()."""
    rows, block = in_blocks(observations, ["city"], "as_of", features.ROWS)
    made = features.lag_columns(block) | features.rolling_columns(line=block, row=F.col("_row") + 1) | features.calendar_columns()
    return rows.withColumns(made).where(~F.col("_copy")).select("city", "as_of", *FEATURE_COLUMNS)


def long_rolling_accuracy(ledger: DataFrame, n: int = 30) -> DataFrame:
    """The same as serve.rolling_accuracy()."""
    e = absolute_error()
    scored = ledger.where(e.isNotNull()).select("city", "model", "forecast_date", e.alias("e"), accuracy_percent(F.col("actual_pm2_5"), e).alias("a"))
    rows, block = in_blocks(scored, ["city", "model"], "forecast_date", n - 1)
    frame = block.rowsBetween(1 - n, 0)
    means = rows.select("city", "model", "forecast_date", "_copy", F.avg("e").over(frame).alias("rolling_mae"), F.avg("a").over(frame).alias("rolling_accuracy"))
    return means.where(~F.col("_copy")).drop("_copy")


def long_walkforward_ols(observations: DataFrame, min_train: int = backtest.MIN_TRAIN) -> DataFrame:
    """The same as backtest.walkforward_ols(), from sums of what comes before. Values are taken from the series' mean, which
    moves no line, so that the sums lose no digits."""
    today = observations.select("city", "as_of", F.col("pm2_5").alias("x"))
    tomorrow = observations.select("city", F.date_sub("as_of", 1).alias("as_of"), F.col("pm2_5").alias("y"))
    pairs = today.join(tomorrow, ["city", "as_of"]).where("x is not null and y is not null")
    middle = observations.groupBy("city").agg(F.avg("pm2_5").alias("m"))
    shifted = pairs.join(middle, "city").withColumns({"x": F.col("x") - F.col("m"), "y": F.col("y") - F.col("m")})
    x, y = F.col("x"), F.col("y")
    sums = before(shifted, ["city"], "as_of", {"n": F.lit(1), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y})
    spread = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    slope = F.when(spread > 1e-12 * F.col("sxx"), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / spread)
    predicted = F.col("m") + F.col("sy") / F.col("n") + slope * (x - F.col("sx") / F.col("n"))
    return sums.where(F.col("n") >= min_train).select("city", F.date_add("as_of", 1).alias("forecast_date"), predicted.alias("predicted_pm2_5"), (y + F.col("m")).alias("actual_pm2_5"))
