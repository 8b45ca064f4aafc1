"""Walk-forward boosted trees: the plan, the trees, and that no forecast knows its future."""

import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.test_ledger import START, observations
from verivane.operators import backtest, boosting, features
from verivane.operators.boosting import Settings
from verivane.schema import FEATURE_COLUMNS

QUICK = Settings(rounds=20, leaf=5)


def training(obs):
    return backtest.training_set(features.features(obs), obs)


def reverting(n, seed=3):
    """Values that return to 50 from wherever chance takes them."""
    rng, out = random.Random(seed), [50.0]
    for _ in range(n - 1):
        out.append(50 + 0.3 * (out[-1] - 50) + rng.gauss(0, 5))
    return out


def test_the_plan_covers_each_pair_once(spark):
    pairs = training(observations(spark, reverting(140)).unionByName(observations(spark, reverting(20), city="b")))
    n = pairs.where("city = 'a'").count()
    rows = sorted(boosting.plan(pairs, every=25, folds=3).collect(), key=lambda r: r["cutoff"])
    assert {r["city"] for r in rows} == {"a"}  # the other has too few pairs
    assert [i for r in rows for i in range(r["cutoff"], r["until"])] == list(range(30, n))
    assert [r["fold"] for r in rows] == [k % 3 for k in range(len(rows))]


def test_forecasts_equal_direct_fits(spark):
    pairs = training(observations(spark, reverting(120)))
    got = {r["forecast_date"]: r for r in boosting.walkforward_trees(pairs, every=40, folds=2, settings=QUICK).collect()}
    g = pairs.toPandas().sort_values("as_of")
    x, y = g[FEATURE_COLUMNS].astype(float).to_numpy(), g["target"].to_numpy()
    assert len(got) == len(g) - 30
    for i in (30, 69, 70, len(g) - 1):
        cutoff = 30 + (i - 30) // 40 * 40
        row = got[g["target_date"].iloc[i]]
        assert row["cutoff"] == cutoff and row["actual_pm2_5"] == y[i]
        assert row["predicted_pm2_5"] == pytest.approx(boosting.fit_predict(x[:cutoff], y[:cutoff], x[i : i + 1], QUICK, cutoff)[0], rel=1e-12)


def test_no_forecast_knows_its_future(spark):
    values = reverting(110)
    changed = values[:90] + [1000.0 + i for i in range(20)]
    known = START + timedelta(90)  # targets up to the day before are the same
    before = lambda v: {r["forecast_date"]: r["predicted_pm2_5"] for r in boosting.walkforward_trees(training(observations(spark, v)), every=7, settings=QUICK).collect() if r["forecast_date"] <= known}
    assert before(values) == before(changed) and max(before(values)) == known


def test_features_are_of_the_day_before_and_models_older(spark):
    pairs = training(observations(spark, reverting(100)))
    days = {r["target_date"]: (n, r["as_of"]) for n, r in enumerate(pairs.orderBy("as_of").collect())}
    order = [d for d, _ in sorted(days.items(), key=lambda kv: kv[1])]
    for r in boosting.walkforward_trees(pairs, every=20, settings=QUICK).collect():
        n, as_of = days[r["forecast_date"]]
        assert r["cutoff"] <= n and order[r["cutoff"] - 1] <= as_of < r["forecast_date"]  # the last target that the model saw was there by then


def test_better_than_the_baseline_where_values_return(spark):
    obs = observations(spark, reverting(500)).unionByName(observations(spark, reverting(500, 4), city="b"))
    pairs = training(obs)
    rows = backtest.summary(backtest.naive_backtest(pairs), boosting.walkforward_trees(pairs)).collect()
    assert {r["city"]: r["winner"] for r in rows} == {"a": "model", "b": "model"}
    assert all(r["improvement_percent"] > 10 and r["samples"] > 400 for r in rows)


def test_trees_find_steps_and_missing_values():
    draw = np.random.default_rng(1)
    x = draw.uniform(0, 1, (400, 3))
    x[::4, 2] = np.nan
    y = np.where(x[:, 0] > 0.4, 5.0, 1.0) + np.where(np.isnan(x[:, 2]), 10.0, 0.0)
    s = Settings(rounds=150, step=0.1, columns=1, rows=1)
    ahead = np.array([[0.1, 0.5, 0.3], [0.9, 0.5, 0.3], [0.1, 0.5, np.nan], [0.9, 0.1, np.nan]])
    assert boosting.fit_predict(x, y, ahead, s, 0) == pytest.approx([1, 5, 11, 15], abs=0.1)


def test_leaves_have_enough_rows_and_a_constant_gives_its_mean():
    draw = np.random.default_rng(2)
    b, r = boosting.binned(x := draw.normal(size=(100, 2)), boosting.edges_of(x, 64)), draw.normal(size=100)
    levels, means = boosting.grow(b, r, np.ones(2, bool), Settings(leaf=15))
    leaf = boosting.leaf_of(b, levels)
    assert min(np.bincount(leaf)[np.unique(leaf)]) >= 15
    assert all(means[k] == pytest.approx(r[leaf == k].mean()) for k in np.unique(leaf))
    assert boosting.fit_predict(x[:5], np.full(5, 3.0), x[5:7], QUICK, 0).tolist() == [3.0, 3.0]
    assert boosting.fit_predict(np.full((30, 2), np.nan), np.arange(30.0), x[:1], Settings(rows=1), 0)[0] == pytest.approx(14.5)


def test_empty_and_short_series(spark):
    assert boosting.walkforward_trees(training(observations(spark, [1.0] * 20))).collect() == []
    assert boosting.walkforward_trees(training(observations(spark, [1.0]).where("false"))).collect() == []


def test_query(spark):
    from verivane.plans.ledger_queries import QUERIES

    rows = QUERIES["walkforward_gbt"](spark, SMALL)
    assert rows.columns == ["city", "forecast_date", "cutoff", "predicted_pm2_5", "actual_pm2_5"]
    keys = rows.groupBy("city", "forecast_date").count()
    naive = QUERIES["naive_backtest"](spark, SMALL)
    assert keys.where("count > 1").isEmpty() and rows.count() == naive.count()
    assert keys.join(naive, ["city", "forecast_date"], "left_anti").isEmpty() and rows.where(F.isnan("predicted_pm2_5") | F.col("predicted_pm2_5").isNull()).isEmpty()
