"""As-of reads: versions, moments, and forecasts against the time their outcome came in."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from verivane.operators import history

DAY = date(2024, 1, 10)
LOG = "city string, forecast_date date, model string, predicted_pm2_5 double, created_at timestamp"
SEEN = "city string, as_of date, pm2_5 double, created_at timestamp"


def at(hour):
    """So many hours after the forecast's day began."""
    return datetime(2024, 1, 10) + timedelta(hours=hour)


@pytest.fixture
def log(spark):
    return lambda *rows: spark.createDataFrame([("a", DAY, m, v, None if h is None else at(h)) for m, v, h in rows], LOG)


@pytest.fixture
def seen(spark):
    return lambda *rows: spark.createDataFrame([("a", DAY, v, None if h is None else at(h)) for v, h in rows], SEEN)


def test_a_version_holds_until_the_next(log):
    got = history.versions(log(("m", 1.0, 0), ("m", 2.0, 5), ("m", 3.0, 5), ("n", 9.0, 2), ("m", 7.0, None)), history.FORECAST)
    rows = sorted((r["model"], r["predicted_pm2_5"], r["valid_from"], r["valid_to"]) for r in got.collect())
    assert rows == [("m", 1.0, at(0), at(5)), ("m", 3.0, at(5), None), ("n", 9.0, at(2), None)]


@pytest.mark.parametrize("hour, want", [(-1, {}), (0, {"m": 1.0}), (4, {"m": 1.0, "n": 9.0}), (5, {"m": 2.0, "n": 9.0}), (99, {"m": 2.0, "n": 9.0})])
def test_what_stood_at_a_moment(log, hour, want):
    got = history.as_of(log(("m", 1.0, 0), ("m", 2.0, 5), ("n", 9.0, 2)), F.lit(at(hour)), history.FORECAST)
    assert {r["model"]: r["predicted_pm2_5"] for r in got.collect()} == want


def test_the_version_just_before_the_outcome_counts(log, seen):
    forecasts = log(("m", 1.0, 0), ("m", 2.0, 25), ("m", 3.0, 26), ("m", 4.0, 40), ("n", 9.0, 30))
    outcome = seen((50.0, 26), (55.0, 50), (None, 3))
    got = {r["model"]: (r["predicted_pm2_5"], r["created_at"], r["actual_pm2_5"], r["arrived_at"]) for r in history.published_before_outcome(forecasts, outcome).collect()}
    assert got == {"m": (2.0, at(25), 50.0, at(26)), "n": (None, None, 50.0, at(26))}
    late = history.late_publications(forecasts, outcome)
    assert sorted((r["model"], r["predicted_pm2_5"]) for r in late.collect()) == [("m", 3.0), ("m", 4.0), ("n", 9.0)]


def test_pending_forecasts_and_empty_logs(log, seen):
    forecasts = log(("m", 1.0, 0))
    for outcome in (seen(), seen((None, 1)), seen((3.0, None))):
        assert history.published_before_outcome(forecasts, outcome).collect() == [] and history.late_publications(forecasts, outcome).collect() == []
    assert history.versions(log(), history.FORECAST).collect() == []
    assert history.as_of(log(), F.lit(at(0)), history.FORECAST).collect() == []


def test_each_event_meets_its_own_key(spark):
    events = spark.createDataFrame([("a", 10, "x"), ("a", 10, "x"), ("b", 5, "y"), ("c", 1, "z")], "k string, t int, note string")
    log = spark.createDataFrame([("a", 1, 1.0), ("a", 9, None), ("b", 5, 2.0), ("b", 4, 3.0)], "k string, created_at int, v double")
    got = sorted(((r["k"], r["note"], r["created_at"], r["v"]) for r in history.as_of_join(events, log, ["k"], "t").collect()), key=repr)
    assert got == [("a", "x", 9, None), ("a", "x", 9, None), ("b", "y", 4, 3.0), ("c", "z", None, None)]
