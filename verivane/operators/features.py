"""Lag, rolling and calendar features of daily series.

One window specification serves all: a shuffle by series, a sort by date, one window operator. A series has at most a row
a day (the table's key), which bounds the partition of a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from verivane.schema import FEATURE_COLUMNS, LAGS, ROLLS

ROWS = max(n for _, n in ROLLS.values())  #: rows that a row's features reach back to, itself included


def series() -> WindowSpec:
    return Window.partitionBy("city").orderBy("as_of")


def lag_columns(line: WindowSpec | None = None) -> dict[str, Column]:
    """The row before counts only if it is the day before. line: the window, if not the whole series."""
    line = series() if line is None else line
    adjacent = F.datediff("as_of", F.lag("as_of").over(line)) == 1
    return {name: F.when(adjacent, F.lag(source).over(line)) for name, source in LAGS.items()}


def rolling_columns(before: str | Column | None = None, line: WindowSpec | None = None, row: Column | None = None) -> dict[str, Column]:
    """Means over the last n rows including today's, nulls skipped; null before the n-th row. before: how many rows of the series lie before those given;
    line: the window, if not the whole series; row: a row's number in its series, if known."""
    line = series() if line is None else line
    if row is None:
        row = F.row_number().over(line) + (F.lit(0) if before is None else F.coalesce(before, F.lit(0)))
    return {name: F.when(row >= n, F.avg(source).over(line.rowsBetween(1 - n, 0))) for name, (source, n) in ROLLS.items()}


def calendar_columns(date: str = "as_of") -> dict[str, Column]:
    """Monday is 0."""
    return {"day_of_week": F.weekday(date), "month": F.month(date), "is_weekend": F.weekday(date) >= 5}


def lag_features(observations: DataFrame) -> DataFrame:
    return observations.select("city", "as_of", *[c.alias(n) for n, c in lag_columns().items()])


def rolling_features(observations: DataFrame) -> DataFrame:
    return observations.select("city", "as_of", *[c.alias(n) for n, c in rolling_columns().items()])


def features(observations: DataFrame) -> DataFrame:
    """city, as_of and the model's columns."""
    return observations.withColumns(lag_columns() | rolling_columns() | calendar_columns()).select("city", "as_of", *FEATURE_COLUMNS)


# ---- changed days --------------------------------------------------------------------------------------


def reached(observations: DataFrame, changed: DataFrame) -> DataFrame:
    """city, as_of of the rows whose features a change of the days `changed` (city, as_of) reaches: the day's own row and the ROWS - 1 after it; of a
    day that is gone, the ROWS after it."""
    return _stretches(observations.select("city", "as_of"), changed).where("_reached").select("city", "as_of")


def _stretches(observations: DataFrame, changed: DataFrame) -> DataFrame:
    """The rows of the changed series from ROWS before their first changed day to ROWS after their last, with _before (rows of the series before
    the stretch) and _reached. Only the changed series are joined, and of what lies before and after a stretch only ROWS rows pass the shuffle."""
    days = changed.select("city", "as_of").distinct()
    spans = days.groupBy("city").agg(F.min("as_of").alias("_from"), F.max("as_of").alias("_to"))
    rows = observations.join(spans, "city")
    near = lambda side, order: side.withColumn("_rank", F.row_number().over(Window.partitionBy("city").orderBy(order))).where(F.col("_rank") <= ROWS).drop("_rank")
    before = rows.where("as_of < _from")
    inside = rows.where("as_of between _from and _to")
    stretch = near(before, F.desc("as_of")).unionByName(inside).unionByName(near(rows.where("as_of > _to"), F.asc("as_of"))).drop("_from", "_to")
    counts = before.groupBy("city").agg(F.greatest(F.count("*") - ROWS, F.lit(0)).alias("_before"))
    marks = days.select("city", "as_of", F.lit(0).alias("_row"))
    line = Window.partitionBy("city").orderBy("as_of", "_row")
    both = stretch.withColumn("_row", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    both = both.withColumn("_n", F.sum("_row").over(line)).withColumn("_mark", F.max(F.when(F.col("_row") == 0, F.col("_n"))).over(line))
    reach = F.coalesce(F.col("_n") - F.col("_mark") <= ROWS, F.lit(False))
    return both.where("_row = 1").withColumn("_reached", reach).drop("_row", "_n", "_mark").join(counts, "city", "left")


def changed_features(observations: DataFrame, changed: DataFrame) -> DataFrame:
    """The features of the rows that a change of the days `changed` reaches, and of no others: equal to those of features()."""
    stretch = _stretches(observations, changed)
    rows = stretch.withColumns(lag_columns() | rolling_columns("_before") | calendar_columns())
    return rows.where("_reached").select("city", "as_of", *FEATURE_COLUMNS)


def date_gaps(observations: DataFrame) -> DataFrame:
    """Where more than a day lies between a row and the one before."""
    before = observations.select("city", F.lag("as_of").over(series()).alias("prev_date"), "as_of")
    return before.withColumn("gap_days", F.datediff("as_of", "prev_date").cast("long")).where("gap_days > 1")
