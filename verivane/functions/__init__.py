"""Scalar expressions of the ledger."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def absolute_error(actual="actual_pm2_5", predicted="predicted_pm2_5") -> Column:
    """Null where either is."""
    return F.abs(F.col(actual) - F.col(predicted))


def same(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Both null, or both there and at most `tolerance` apart; never null."""
    return (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def status(actual="actual_pm2_5") -> Column:
    return F.when(F.col(actual).isNotNull(), "verified").otherwise("pending")


def band(value: Column, edges=((30, "LOW"), (60, "MODERATE"), (90, "ELEVATED"), (120, "HIGH")), above="VERY HIGH / EXTREME") -> Column:
    """The first band whose upper edge is not exceeded; null for null."""
    out = F.when(value.isNull(), None)
    for edge, name in edges:
        out = out.when(value <= edge, name)
    return out.otherwise(above)


def badge(error: Column, edges=((3, "EXCELLENT"), (6, "GOOD")), above="MODERATE", without="PENDING") -> Column:
    out = F.when(error.isNull(), without)
    for edge, name in edges:
        out = out.when(error <= edge, name)
    return out.otherwise(above)


def accuracy_percent(actual: Column, error: Column) -> Column:
    """max(0, 100 - error / actual * 100); null without an actual or for an actual of 0."""
    return F.when(actual.isNotNull() & error.isNotNull() & (actual != 0), F.greatest(F.lit(0.0), 100 - error / actual * 100))


def percent_change(new: Column, old: Column) -> Column:
    return F.try_divide(new - old, old) * 100


def local_day(utc: Column, zone: str = "Asia/Kolkata") -> Column:
    """The calendar day of a UTC time in the business's zone."""
    return F.to_date(F.from_utc_timestamp(utc, zone))


def day(value: date | str) -> Column:
    return F.lit(str(value)).cast("date")


def settled(value: Column) -> Column:
    """Rounded so that engines agree on exact ties."""
    return F.round(value + 1e-7, 4)
