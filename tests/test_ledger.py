"""Hand-made series: gaps, warm-up, nulls, duplicates, pending rows."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from verivane.functions import accuracy_percent, badge, band, percent_change, same
from verivane.operators import backtest, features, ingest, ledger, models, quality, serve
from verivane.schema import FEATURE_COLUMNS, KEYS, MEASURES, TABLES
from verivane.sources import payloads, tables

START = date(2024, 1, 1)
OBS = "city string, as_of date, pm2_5 double, pm10 double, temperature_2m_mean double, wind_speed_10m_max double, precipitation_sum double"
PRED = "city string, forecast_date date, predicted_pm2_5 double, actual_pm2_5 double, model string"


def observations(spark, values, days=None, city="a"):
    days = days or range(len(values))
    return spark.createDataFrame([(city, START + timedelta(d), v, v and v * 2, 20.0, 5.0, 0.0) for d, v in zip(days, values)], OBS)


def features_of(df):
    return [r.asDict() for r in features.features(df).orderBy("city", "as_of").collect()]


def test_single_row(spark):
    (row,) = features_of(observations(spark, [1.0]))
    assert row["pm2_5_lag_1"] is None and row["pm2_5_roll_7"] is None and row["temperature_2m_mean"] == 20.0
    assert (row["day_of_week"], row["month"], row["is_weekend"]) == (0, 1, False)


def test_lag_is_null_across_a_gap(spark):
    rows = features_of(observations(spark, [1.0, 2.0, 3.0], [0, 2, 3]))
    assert [r["pm2_5_lag_1"] for r in rows] == [None, None, 2.0]
    gaps = features.date_gaps(observations(spark, [1.0, 2.0, 3.0], [0, 2, 3])).collect()
    assert [(g["prev_date"], g["as_of"], g["gap_days"]) for g in gaps] == [(START, START + timedelta(2), 2)]


def test_lag_of_a_null_is_null(spark):
    assert [r["pm2_5_lag_1"] for r in features_of(observations(spark, [None, 2.0]))] == [None, None]


@pytest.mark.parametrize("n, seven, thirty", [(6, False, False), (7, True, False), (29, True, False), (30, True, True)])
def test_warm_up_counts_rows(spark, n, seven, thirty):
    last = features_of(observations(spark, [float(i) for i in range(n)]))[-1]
    assert (last["pm2_5_roll_7"] is not None, last["pm2_5_roll_30"] is not None) == (seven, thirty)
    if seven:
        assert last["pm2_5_roll_7"] == pytest.approx(sum(range(n - 7, n)) / 7)


def test_rolling_means_skip_nulls_and_ignore_gaps(spark):
    assert features_of(observations(spark, [None] * 7))[-1]["pm2_5_roll_7"] is None
    assert features_of(observations(spark, [None] * 6 + [3.0]))[-1]["pm2_5_roll_7"] == 3.0
    assert features_of(observations(spark, [1.0] * 6 + [8.0], [0, 1, 2, 3, 4, 5, 40]))[-1]["pm2_5_roll_7"] == 2.0


def test_empty_tables(spark):
    empty = observations(spark, [1.0]).where("false")
    assert features_of(empty) == []
    assert ingest.date_range(empty).collect() == [] and serve.history(empty).collect() == []
    assert quality.leakage_report(features.features(empty), empty).isEmpty()
    assert backtest.walkforward_ses(empty).collect() == []
    (row,) = quality.null_counts(empty, MEASURES).collect()
    assert set(row) == {0}


def test_daily_means(spark):
    rows = [("a", "2024-01-01 00:00:00", 1.0, None), ("a", "2024-01-01 23:59:59", 3.0, None), ("a", "2024-01-02 00:00:00", None, 4.0)]
    df = spark.createDataFrame(rows, "city string, ts string, pm2_5 double, pm10 double").withColumn("ts", F.to_timestamp("ts"))
    assert [tuple(r) for r in ingest.daily_means(df).orderBy("as_of").collect()] == [("a", date(2024, 1, 1), 2.0, None), ("a", date(2024, 1, 2), None, 4.0)]


def test_payloads(spark):
    lines = ['{"city":"a","hourly":{"time":["2024-01-01T00:00:00Z","2024-01-01T01:00:00Z"],"pm2_5":[1.5],"pm10":[null,2]},"daily":{"time":["2024-01-01","2024-01-01"],"temperature_2m_mean":[1,2],"wind_speed_10m_max":[3,4],"precipitation_sum":[null,0]}}']
    p = payloads.parse_payloads(spark.createDataFrame([(x,) for x in lines], "payload string"))
    assert [(r["pm2_5"], r["pm10"]) for r in payloads.hourly_readings(p).orderBy("ts").collect()] == [(1.5, None), (None, 2.0)]
    assert [tuple(r)[1:] for r in payloads.daily_weather(p).collect()] == [(date(2024, 1, 1), 1.0, 3.0, None)]


def test_next_range(spark):
    df = observations(spark, [1.0])
    (row,) = ingest.next_range(df, "2024-01-05").collect()
    assert (row["start_date"], row["end_date"]) == (date(2024, 1, 2), date(2024, 1, 4))
    assert ingest.next_range(df, "2024-01-02").collect() == []


def test_upsert_all_columns(spark):
    stored = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "k string, v int, w double")
    new = spark.createDataFrame([("b", 2, None, 1), ("c", 3, 3.0, 1), ("c", 4, 4.0, 2)], "k string, v int, w double, seq int")
    assert sorted(map(tuple, ledger.upsert(stored, new, ["k"], order="seq").collect())) == [("a", 1, 1.0), ("b", 2, None), ("c", 4, 4.0)]


def test_upsert_keeps_actuals(spark):
    stored = spark.createDataFrame([("a", START, 1.0, 9.0, "m"), ("a", START + timedelta(1), 1.0, 8.0, "m")], PRED)
    new = spark.createDataFrame([("a", START, None, None, "m"), ("a", START + timedelta(2), 5.0, None, "m")], PRED)
    got = {r["forecast_date"].day: (r["predicted_pm2_5"], r["actual_pm2_5"]) for r in ledger.upsert(stored, new, KEYS["predictions"], keep=["actual_pm2_5"]).collect()}
    assert got == {1: (None, 9.0), 2: (1.0, 8.0), 3: (5.0, None)}


def test_stored_tables(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert tables.read(spark, root, "predictions").isEmpty()
    row = lambda p, a: spark.createDataFrame([("a", START, p, a, "m", None)], TABLES["predictions"])
    tables.merge(row(1.0, 2.0), root, "predictions", keep=["actual_pm2_5"])
    tables.merge(row(3.0, None), root, "predictions", keep=["actual_pm2_5"])
    assert [(r["predicted_pm2_5"], r["actual_pm2_5"]) for r in tables.read(spark, root, "predictions").collect()] == [(3.0, 2.0)]


def stored_rows(spark, root, name="predictions", **kw):
    return sorted((r["city"], r["forecast_date"].isoformat(), r["predicted_pm2_5"]) for r in tables.read(spark, root, name, **kw).collect())


def batch(spark, *rows):
    return spark.createDataFrame([(c, date(y, 1, 1), p, None, "m", None) for c, y, p in rows], TABLES["predictions"])


def test_an_upsert_rewrites_only_its_parts_and_sets_created_at(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "AGE_MS", 0)
    root = f"file://{tmp_path}"
    tables.merge(batch(spark, ("a", 2023, 1.0), ("a", 2024, 2.0), ("b", 2024, 3.0)), root, "predictions")
    first = {(r["city"], r["forecast_date"].year): r["created_at"] for r in tables.read(spark, root, "predictions").collect()}
    before = tables._parts(spark, root, "predictions", 1)
    tables.merge(batch(spark, ("a", 2024, 5.0)), root, "predictions")
    after = tables._parts(spark, root, "predictions", 2)
    assert len(before) == 2 and sum(before[k] != after[k] for k in before) == 1  # a year's few cities share a part
    assert stored_rows(spark, root) == [("a", "2023-01-01", 1.0), ("a", "2024-01-01", 5.0), ("b", "2024-01-01", 3.0)]
    assert stored_rows(spark, root, city="b") == [("b", "2024-01-01", 3.0)]
    second = {(r["city"], r["forecast_date"].year): r["created_at"] for r in tables.read(spark, root, "predictions").collect()}
    assert None not in first.values() and second["a", 2024] > first["a", 2024] and second["b", 2024] == first["b", 2024]
    for p in range(4):
        tables.merge(batch(spark, ("a", 2024, float(p))), root, "predictions")
    assert len(list((tmp_path / "predictions/log").glob("*.json"))) == tables.KEPT  # old versions go
    assert stored_rows(spark, root)[1:] == [("a", "2024-01-01", 3.0), ("b", "2024-01-01", 3.0)]


@pytest.mark.parametrize("step", ["_write", "_commit"])
def test_a_crash_between_the_steps_loses_nothing(spark, tmp_path, monkeypatch, step):
    root = f"file://{tmp_path}"
    tables.merge(batch(spark, ("a", 2024, 1.0)), root, "predictions")
    inner = getattr(tables, step)

    def crash(*args):
        if step == "_write":
            inner(*args)  # data are there, no version yet
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(tables, step, crash)
        for write in (lambda: tables.merge(batch(spark, ("a", 2024, 2.0)), root, "predictions"), lambda: tables.replace(batch(spark, ("b", 2024, 2.0)), root, "predictions")):
            with pytest.raises(OSError):
                write()
            assert stored_rows(spark, root) == [("a", "2024-01-01", 1.0)]
    tables.merge(batch(spark, ("b", 2024, 4.0)), root, "predictions")
    assert stored_rows(spark, root) == [("a", "2024-01-01", 1.0), ("b", "2024-01-01", 4.0)]


def test_two_writers_at_once(spark, tmp_path):
    root = f"file://{tmp_path}"
    tables.merge(batch(spark, ("a", 2024, 1.0)), root, "predictions")
    with pytest.raises(tables.Conflict):
        tables._commit(spark, root, "predictions", {}, 0)
    written = tables._write(batch(spark, ("b", 2024, 2.0)), root, "predictions")
    with pytest.raises(tables.Conflict):
        tables._commit(spark, root, "predictions", written, 0)
    assert len(list((tmp_path / "predictions/data").iterdir())) == 1  # what the loser wrote is gone
    assert stored_rows(spark, root) == [("a", "2024-01-01", 1.0)]


def test_keys_are_enforced(spark, tmp_path):
    for rows in ([("a", 2024, 1.0), ("a", 2024, 2.0)],):
        with pytest.raises(ValueError):
            tables.merge(batch(spark, *rows), f"file://{tmp_path}", "predictions")
    null = batch(spark, ("a", 2024, 1.0)).withColumn("model", F.lit(None).cast("string"))
    with pytest.raises(ValueError):
        tables.merge(null, f"file://{tmp_path}", "predictions")


def test_smoothing_equals_the_recursion(spark):
    import random

    rng = random.Random(1)
    values = [rng.random() * 50 for _ in range(400)]
    got = [r["predicted_pm2_5"] for r in backtest.walkforward_ses(observations(spark, values)).orderBy("forecast_date").collect()]
    level, want = values[0], []
    for v in values:
        want.append(level)
        level = 0.3 * v + 0.7 * level
    assert got == pytest.approx(want[30:], rel=1e-12)


def test_the_ladder_takes_the_fitted_level_where_no_ar_term_can_be_fitted(spark):
    obs = observations(spark, [5.0] * 32 + [9.0, 1.0, 2.0])
    rows = {r["n"]: r for r in backtest.recursions(obs).collect()}
    assert rows[33]["ar"] is None and rows[34]["ar"] is None and rows[35]["ar"] is not None
    assert rows[34]["weight"] == 1.0  # all weights have made the same error so far
    got = [r["predicted_pm2_5"] for r in backtest.walkforward_ar1(obs).orderBy("forecast_date").collect()]
    assert got == [5.0, 5.0, 5.0, 9.0, rows[35]["ar"]]


def bank_of(values, weights):
    """Forecast and weight before each value: every weight's recursion from the start, by its definition."""
    out = []
    for t in range(len(values)):
        scored = []
        for w in weights:
            level, squares = values[0], 0.0
            for v in values[:t]:
                squares += (v - level) ** 2
                level = w * v + (1 - w) * level
            scored.append((round(squares, 6), abs(w - 1), w, level))
        out.append(min(scored)[2:])
    return out


def test_the_moving_average_is_fitted_anew_before_each_row(spark):
    import random

    rng = random.Random(2)
    walk = [50.0]
    for _ in range(79):
        walk.append(walk[-1] + rng.gauss(0, 3))
    noise = [50 + rng.gauss(0, 3) for _ in range(80)]
    weights = [k / 20 for k in range(1, 40)]
    for values in (walk, noise):
        got = backtest.walkforward_ma1(observations(spark, values)).orderBy("forecast_date").collect()
        want = bank_of(values, weights)[30:]
        assert [r["weight"] for r in got] == pytest.approx([w for w, _ in want])
        assert [r["predicted_pm2_5"] for r in got] == pytest.approx([p for _, p in want])
    assert got[-1]["weight"] < 0.3  # noise around a level asks for much smoothing
    assert backtest.walkforward_ma1(observations(spark, walk)).orderBy(F.desc("forecast_date")).first()["weight"] > 0.6  # a walk for little


def test_recursions_keep_series_apart_and_skip_nulls(spark):
    a = [float((i * 37) % 50) for i in range(40)]
    alone = backtest.recursions(observations(spark, a)).drop("city").collect()
    both = backtest.recursions(observations(spark, a).unionByName(observations(spark, [None] + [v + 7 for v in a] + [None], city="b")))
    assert sorted(both.where("city = 'a'").drop("city").collect()) == sorted(alone)
    assert [r["n"] for r in both.where("city = 'b'").orderBy("as_of").collect()] == list(range(1, 41))
    assert backtest.recursions(observations(spark, [None, None])).collect() == []


def test_scored_only_asks_for_the_actual_alone(spark):
    p = spark.createDataFrame([("a", START, None, 2.0, "m"), ("a", START, 1.0, None, "n")], PRED)
    assert [r["model"] for r in serve.prediction_log(p, scored_only=True).collect()] == ["m"]


def test_a_later_forecast_is_not_tomorrows(spark):
    obs = observations(spark, [1.0])
    p = spark.createDataFrame([("a", START + timedelta(3), 1.0, None, "m"), ("a", START + timedelta(1), 1.0, None, "n")], PRED)
    report = quality.readiness_report(obs, features.features(obs), p, ["m", "n"], "2024-01-01")
    checks = {r["check"]: r["passed"] for r in report.collect()}
    assert not checks["m forecast exists"] and checks["n forecast exists"] and checks["n forecast is for the next day"]


def test_scoring_is_strict_and_repeatable(spark):
    obs = observations(spark, [1.0, None, 3.0])
    p = spark.createDataFrame([("a", START + timedelta(d), 2.0 if d else None, None, "m") for d in range(4)], PRED)
    new = ledger.newly_scored(p, obs)
    assert sorted(r["forecast_date"].day for r in new.collect()) == [1, 3]
    again = ledger.score_pending(p, obs).drop("newly")
    assert ledger.newly_scored(again, obs).isEmpty()
    metrics = {r["score_date"].day: (r["mae"], r["sample_size"]) for r in ledger.daily_metrics(new).collect()}
    assert metrics == {1: (None, 0), 3: (1.0, 1)}


def test_evaluation_golden_numbers(spark):
    rows = [("lightgbm", 15.0, 14.5), ("lightgbm", 16.0, 15.8), ("lightgbm", 15.5, None), ("naive", 12.0, 12.2), ("naive", None, 12.0), ("pending", 1.0, None)]
    p = spark.createDataFrame([("a", START + timedelta(i), pr, ac, m) for i, (m, pr, ac) in enumerate(rows)], PRED)
    got = {r["model"]: r for r in serve.evaluation(p, "2024-01-10").collect()}
    assert (got["lightgbm"]["scored"], got["lightgbm"]["pending"]) == (2, 1)
    assert got["lightgbm"]["mae"] == pytest.approx(0.35) and got["lightgbm"]["rmse"] == pytest.approx(0.381, abs=0.01)
    assert (got["naive"]["scored"], got["naive"]["pending"]) == (1, 1) and got["naive"]["rmse"] == pytest.approx(0.2)
    assert (got["pending"]["scored"], got["pending"]["mae"]) == (0, None)


def test_leaderboard_sorts_nulls_last(spark):
    df = spark.createDataFrame([("x", START, None, None, 0), ("persistence", START, 9.0, 9.0, 1), ("persistence", START + timedelta(1), 2.0, 2.0, 1), ("rolling_7", START, 3.0, 3.0, 1)], "model string, score_date date, mae double, rmse double, sample_size int")
    assert [(r["model"], r["mae"], r["description"]) for r in serve.leaderboard(df).collect()] == [("persistence", 2.0, "Tomorrow is as today"), ("rolling_7", 3.0, "Mean of the last seven rows"), ("x", None, "")]


def test_unknown_model(spark):
    p = spark.createDataFrame([], PRED)
    with pytest.raises(ValueError):
        serve.latest_forecast(p, "invalid_model")
    assert serve.prediction_log(p, "", limit=5).collect() == []


def test_scalars(spark):
    df = spark.createDataFrame([(None, None), (0.0, 1.0), (100.0, 5.0), (10.0, 50.0)], "a double, e double")
    got = df.select(accuracy_percent(F.col("a"), F.col("e")), band(F.col("a")), badge(F.col("e")), percent_change(F.col("e"), F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(None, None, "PENDING", None), (None, "LOW", "EXCELLENT", None), (95.0, "HIGH", "GOOD", -95.0), (0.0, "LOW", "MODERATE", 400.0)]
    cases = spark.createDataFrame([(None, None), (None, 1.0), (1.0, 1.0 + 1e-10), (1.0, 1.1)], "a double, b double")
    assert [r[0] for r in cases.select(same(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]


def test_leakage_report(spark):
    obs = observations(spark, [float(i) for i in range(10)])
    clean = features.features(obs)
    assert quality.leakage_report(clean, obs).isEmpty()
    assert quality.leakage_report(clean.where("day(as_of) <> 5"), obs).isEmpty()  # a missing row shifts nothing
    dirty = clean.withColumn("pm2_5_lag_1", F.when(F.dayofmonth("as_of") == 4, 99.0).otherwise(F.col("pm2_5_lag_1")))
    (row,) = quality.leakage_report(dirty, obs).collect()
    assert (row["column"], row["stored"], row["expected"]) == ("pm2_5_lag_1", 99.0, 2.0)
    (gone,) = quality.leakage_report(clean, obs.where("day(as_of) <> 10")).collect()
    assert gone["column"] == "missing in observations"


def test_publish_guard(spark):
    obs = observations(spark, [float(i) for i in range(31)])
    feat = features.features(obs)
    model = spark.createDataFrame([("a", 7.0)], "city string, predicted_pm2_5 double")
    names = lambda f: sorted(r["model"] for r in ledger.publishable(obs, f, model, "m").collect())
    assert names(feat) == ["m", "persistence"]
    assert names(feat.where("as_of < date'2024-01-31'")) == ["persistence"]
    assert names(feat.withColumn("wind_speed_10m_max", F.lit(None).cast("double"))) == ["persistence"]


def test_readiness(spark):
    obs = observations(spark, [float(i) for i in range(31)])
    feat, p = features.features(obs), ledger.with_actuals(ledger.persistence(obs), obs)
    report = {r["check"]: r["passed"] for r in quality.readiness_report(obs, feat, p, ["persistence", "m"], "2024-02-01").collect()}
    assert report["observations fresh"] and report["latest features whole"] and report["persistence forecast is for the next day"]
    assert not report["m forecast exists"]
    (s,) = quality.readiness_summary(quality.readiness_report(obs, feat, p, ["persistence", "m"], "2024-02-01")).collect()
    assert (s["ready"], s["n_passed"], s["n_checks"]) == (False, 5, 7)


def test_walk_forward_knows_only_the_past(spark):
    values = [float((i * 37) % 50) for i in range(45)]
    changed = values[:40] + [1000.0] * 5
    for method in (backtest.walkforward_ols, backtest.walkforward_ar1, backtest.walkforward_ma1, backtest.walkforward_ses):
        before = lambda v: [(r["forecast_date"], round(r["predicted_pm2_5"], 6)) for r in method(observations(spark, v)).where("forecast_date <= date'2024-02-09'").orderBy("forecast_date").collect()]  # noqa: E731, B023
        assert before(values) == before(changed) != []


def test_ar1_without_variation_repeats_the_last_value(spark):
    got = backtest.walkforward_ar1(observations(spark, [5.0] * 35)).collect()
    assert len(got) == 5 and all(r["predicted_pm2_5"] == 5.0 for r in got)


def test_ridge_equals_direct_fits(spark):
    import numpy as np

    obs = observations(spark, [float((i * 37) % 50) + i for i in range(50)])
    t = backtest.training_set(features.features(obs), obs)
    got = {r["forecast_date"]: r["predicted_pm2_5"] for r in backtest.walkforward_ridge(t).collect()}
    g = t.toPandas().sort_values("as_of")
    x = np.c_[np.nan_to_num(g[FEATURE_COLUMNS].astype(float).to_numpy()), np.ones(len(g))]
    for i in (30, len(g) - 1):
        w = np.linalg.solve(x[:i].T @ x[:i] + np.eye(x.shape[1]), x[:i].T @ g["target"].to_numpy()[:i])
        assert got[g["target_date"].iloc[i]] == pytest.approx(x[i] @ w, rel=1e-6)


def test_model_round_trip(spark, tmp_path):
    obs = observations(spark, [float((i * 37) % 50) for i in range(60)])
    feat = features.features(obs)
    assert models.load(spark, f"file://{tmp_path}/none") is None and models.forecast(None, feat) is None
    fitted = models.fit(backtest.training_set(feat, obs), rounds=2)
    models.save(fitted, f"file://{tmp_path}/model")
    a, b = (models.forecast(m, feat).collect() for m in (fitted, models.load(spark, f"file://{tmp_path}/model")))
    assert a == b and a[0]["forecast_date"] == START + timedelta(60)
