"""SQL twins of the ledger's queries, over the same tables."""

from __future__ import annotations

from verivane.schema import FEATURE_COLUMNS, LAGS, MEASURES, ROLLS, WEATHER
from verivane.sources.constants import AS_OF, OPEN_FROM, SHIFT, TODAY

ORACLE_SQL: dict[str, str] = {}

OBS = """
weather AS (SELECT CAST(l_shipdate AS DATE) AS as_of, avg(l_quantity) AS temperature_2m_mean, max(l_discount * 100) AS wind_speed_10m_max, sum(l_tax) AS precipitation_sum FROM lineitem GROUP BY 1),
obs AS (
  SELECT o.city, o.as_of, o.pm2_5, o.pm10, w.temperature_2m_mean, w.wind_speed_10m_max, w.precipitation_sum
  FROM (SELECT o_orderpriority AS city, CAST(o_orderdate AS DATE) AS as_of, avg(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) / 1000 AS pm2_5, max(o_totalprice) / 1000 AS pm10 FROM orders GROUP BY 1, 2) o
  LEFT JOIN weather w ON o.as_of = w.as_of
)"""

_lags = ", ".join(f"CASE WHEN as_of - lag(as_of) OVER w = 1 THEN lag({s}) OVER w END AS {n}" for n, s in LAGS.items())
_rolls = ", ".join(f"CASE WHEN row_number() OVER w >= {k} THEN avg({s}) OVER (PARTITION BY city ORDER BY as_of ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) END AS {n}" for n, (s, k) in ROLLS.items())
CALENDAR = "CAST(extract(isodow FROM as_of) - 1 AS INTEGER) AS day_of_week, CAST(extract(month FROM as_of) AS INTEGER) AS month, extract(isodow FROM as_of) >= 6 AS is_weekend"
FEAT = f"""{OBS},
feat AS (SELECT city, as_of, {_lags}, {_rolls}, {CALENDAR}, {", ".join(WEATHER)} FROM obs WINDOW w AS (PARTITION BY city ORDER BY as_of))"""
LEDGER = f"""{FEAT},
ledger AS (
  SELECT p.city, p.as_of + 1 AS forecast_date, p.model, p.predicted_pm2_5, CASE WHEN p.as_of + 1 < DATE '{OPEN_FROM}' THEN o.pm2_5 END AS actual_pm2_5
  FROM (SELECT city, as_of, 'persistence' AS model, pm2_5 AS predicted_pm2_5 FROM obs UNION ALL SELECT city, as_of, 'rolling_7', pm2_5_roll_7 FROM feat) p
  LEFT JOIN obs o ON o.city = p.city AND o.as_of = p.as_of + 1
),
judged AS (SELECT *, abs(actual_pm2_5 - predicted_pm2_5) AS e FROM ledger),
performance AS (SELECT forecast_date AS score_date, model, avg(e) AS mae, sqrt(avg(e * e)) AS rmse, count(e) AS sample_size FROM judged WHERE actual_pm2_5 IS NOT NULL GROUP BY 1, 2)"""
TRAINING = f"""{FEAT},
pairs AS (SELECT f.*, o.as_of AS target_date, o.pm2_5 AS target FROM feat f JOIN obs o ON o.city = f.city AND o.as_of = f.as_of + 1),
training AS (SELECT * FROM pairs WHERE pm2_5_lag_1 IS NOT NULL AND target IS NOT NULL),
naive AS (
  SELECT city, target_date AS forecast_date, pm2_5_lag_1 AS predicted_pm2_5, target AS actual_pm2_5
  FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY as_of) AS n FROM training) WHERE n > 30
),
xy AS (SELECT a.city, a.as_of, a.pm2_5 AS x, b.pm2_5 AS y FROM obs a JOIN obs b ON a.city = b.city AND b.as_of = a.as_of + 1 WHERE a.pm2_5 IS NOT NULL AND b.pm2_5 IS NOT NULL),
ols AS (
  SELECT city, as_of + 1 AS forecast_date, i + s * x AS predicted_pm2_5, y AS actual_pm2_5
  FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY as_of) AS n, regr_slope(y, x) OVER b AS s, regr_intercept(y, x) OVER b AS i
        FROM xy WINDOW b AS (PARTITION BY city ORDER BY as_of ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE n > 30
)"""
READINGS = "readings AS (SELECT event_type AS city, ts, CASE WHEN user_id % 7 <> 0 THEN value END AS pm2_5, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS pm10 FROM events)"


def r(e: str, name: str | None = None) -> str:
    """Settled to four places, as the queries' doubles are."""
    return f"round({e} + 1e-7, 4) AS {name or e}"


def each(names) -> str:
    return ", ".join(r(n) for n in names)


def sql(name: str, tables: str, body: str, recursive: bool = False) -> None:
    ORACLE_SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{tables.strip()}\n{body}"


_features = ", ".join(c if c in ("day_of_week", "month", "is_weekend") else r(c) for c in FEATURE_COLUMNS)
_double_features = [c for c in FEATURE_COLUMNS if c not in ("day_of_week", "month", "is_weekend")]
_results = "forecast_date, " + each(["predicted_pm2_5", "actual_pm2_5"])

# ---- sources and ingest ------------------------------------------------------------------------------

sql("payload_unzip", READINGS, f"SELECT city, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, CAST(ts AS DATE) AS as_of, {each(['pm2_5', 'pm10'])} FROM readings")
sql("payload_weather", OBS, f"SELECT 'all' AS city, as_of, {each(WEATHER)} FROM weather")
_tables = {
    "observations": ("obs", [("city", "string"), ("as_of", "date"), *((c, "double") for c in MEASURES)]),
    "features": ("feat", [("city", "string"), ("as_of", "date"), *((c, {"day_of_week": "int", "month": "int", "is_weekend": "boolean"}.get(c, "double")) for c in FEATURE_COLUMNS)]),
    "predictions": ("ledger", [("city", "string"), ("forecast_date", "date"), ("model", "string"), ("predicted_pm2_5", "double"), ("actual_pm2_5", "double")]),
    "model_performance": ("performance", [("score_date", "date"), ("model", "string"), ("mae", "double"), ("rmse", "double"), ("sample_size", "bigint")]),
}
sql("describe_tables", LEDGER, " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows, {i} AS ordinal, '{c}' AS column_name, '{kind}' AS data_type, count(*) - count({c}) AS nulls FROM {source}"
    for t, (source, columns) in _tables.items() for i, (c, kind) in enumerate(columns, 1)
))
sql("daily_observations", f"{READINGS}, {OBS}", f"""
SELECT d.city, d.as_of, {each(['pm2_5', 'pm10'])}, {each(WEATHER)}
FROM (SELECT city, CAST(ts AS DATE) AS as_of, avg(pm2_5) AS pm2_5, avg(pm10) AS pm10 FROM readings GROUP BY 1, 2) d LEFT JOIN weather w ON w.as_of + {SHIFT} = d.as_of""")
sql("source_quality", f"{READINGS}, {OBS}", """
SELECT h AS hours, m AS missing_hours, d AS weather_days, h > 15000 AND d > 700 AS go
FROM (SELECT count(*) AS h, count(*) - count(pm2_5) AS m FROM readings), (SELECT count(*) AS d FROM weather)""")
sql("missing_hours", READINGS, "SELECT city, count(*) AS hours, count(*) - count(pm2_5) AS missing FROM readings GROUP BY 1")
sql("ingest_range", OBS, f"""
SELECT city, max(as_of) + 1 AS start_date, DATE '{TODAY}' - 1 AS end_date FROM obs WHERE as_of < DATE '2001-07-30' OR city = '1-URGENT'
GROUP BY 1 HAVING max(as_of) + 1 <= DATE '{TODAY}' - 1""")
sql("date_range", OBS, "SELECT city, min(as_of) AS first_date, max(as_of) AS last_date FROM obs GROUP BY 1")
sql("staleness", OBS, f"SELECT city, max(as_of) AS latest_observation, DATE '{TODAY}' - max(as_of) AS stale_days FROM obs GROUP BY 1")
sql("row_counts", OBS, "SELECT city, count(*) AS rows FROM obs GROUP BY 1")
sql("local_day_counts", READINGS, "SELECT CAST(ts + INTERVAL 330 MINUTE AS DATE) AS local_date, count(*) AS readings FROM readings GROUP BY 1")

# ---- features ----------------------------------------------------------------------------------------

sql("lag_features", FEAT, f"SELECT city, as_of, {each(LAGS)} FROM feat")
sql("rolling_features", FEAT, f"SELECT city, as_of, {each(ROLLS)} FROM feat")
sql("calendar_features", OBS, f"SELECT city, as_of, {CALENDAR} FROM obs")
sql("features", FEAT, f"SELECT city, as_of, {_features} FROM feat")
sql("incremental_features", FEAT, f"SELECT city, as_of, {_features} FROM feat")
sql("stored_features", FEAT, f"SELECT city, as_of, {_features} FROM feat")
sql("stored_window", OBS, f"SELECT city, as_of, {each(MEASURES)} FROM obs WHERE as_of BETWEEN DATE '1995-11-20' AND DATE '1996-02-10'")
sql("stored_digests", FEAT, "SELECT CAST(extract(year FROM as_of) AS INTEGER) AS year, count(*) AS rows, min(as_of) AS first_date, max(as_of) AS last_date, 0 AS differing FROM feat GROUP BY 1")
sql("reached_rows", OBS, """
, n AS (SELECT city, as_of, row_number() OVER (PARTITION BY city ORDER BY as_of) AS n, extract(month FROM as_of) % 3 = 1 AND extract(day FROM as_of) IN (3, 17) AS changed FROM obs)
SELECT city, as_of FROM n a WHERE EXISTS (SELECT 1 FROM n b WHERE b.city = a.city AND b.changed AND a.n - b.n BETWEEN 0 AND 29)""")
sql("date_gaps", OBS, """
SELECT * FROM (SELECT city, lag(as_of) OVER w AS prev_date, as_of, as_of - lag(as_of) OVER w AS gap_days FROM obs WINDOW w AS (PARTITION BY city ORDER BY as_of)) WHERE gap_days > 1""")
sql("latest_features", FEAT, f"SELECT city, as_of, {_features} FROM feat QUALIFY row_number() OVER (PARTITION BY city ORDER BY as_of DESC) = 1")

# ---- ledger ------------------------------------------------------------------------------------------

sql("persistence_forecast", OBS, f"SELECT city, as_of + 1 AS forecast_date, 'persistence' AS model, {r('pm2_5', 'predicted_pm2_5')} FROM obs")
sql("upsert_observations", OBS, f"""
SELECT city, as_of, {r("CASE WHEN as_of >= DATE '2001-01-01' THEN pm2_5 + 2 WHEN as_of >= DATE '2000-01-01' THEN pm2_5 + 1 ELSE pm2_5 END", 'pm2_5')}, {each(MEASURES[1:])} FROM obs""")
sql("upsert_features", FEAT, f"SELECT city, as_of, {r('CASE WHEN as_of < DATE $$2000-01-01$$ THEN -1.0 ELSE pm2_5_lag_1 END', 'pm2_5_lag_1').replace('$$', chr(39))}, {', '.join(c if c in ('day_of_week', 'month', 'is_weekend') else r(c) for c in FEATURE_COLUMNS[1:])} FROM feat")
sql("upsert_forecasts", LEDGER, f"""
SELECT city, forecast_date, model,
  {r("CASE WHEN model = 'persistence' AND forecast_date >= DATE '2001-05-01' THEN predicted_pm2_5 * 2 ELSE predicted_pm2_5 END", 'predicted_pm2_5')},
  {r("CASE WHEN forecast_date < DATE '2001-06-01' THEN actual_pm2_5 END", 'actual_pm2_5')}
FROM ledger WHERE forecast_date < DATE '2001-06-01' OR model = 'persistence'""")
sql("upsert_backtest", f"{TRAINING}, {LEDGER.removeprefix(FEAT).lstrip(',')}", f"""
SELECT city, model, {_results} FROM (
  SELECT city, model, forecast_date, predicted_pm2_5, actual_pm2_5 FROM ledger l WHERE model <> 'persistence' OR NOT EXISTS (SELECT 1 FROM naive n WHERE n.city = l.city AND n.forecast_date = l.forecast_date)
  UNION ALL SELECT city, 'persistence', forecast_date, predicted_pm2_5, actual_pm2_5 FROM naive)""")
sql("upsert_performance", LEDGER, f"""
SELECT score_date, model, {each(['mae', 'rmse'])}, sample_size FROM (
  SELECT *, row_number() OVER (PARTITION BY score_date, model ORDER BY batch DESC) AS n FROM (
    SELECT *, 1 AS batch FROM performance
    UNION ALL SELECT max(forecast_date), model, avg(e), sqrt(avg(e * e)), count(e), 2 FROM judged WHERE actual_pm2_5 IS NOT NULL GROUP BY model)) WHERE n = 1""")
_whole = " AND ".join(f"f.{c} IS NOT NULL" for c in FEATURE_COLUMNS)
sql("publishable_forecasts", FEAT, f"""
, last AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY city ORDER BY as_of DESC) = 1),
last_feat AS (SELECT * FROM feat QUALIFY row_number() OVER (PARTITION BY city ORDER BY as_of DESC) = 1)
SELECT city, as_of + 1 AS forecast_date, 'persistence' AS model, {r('pm2_5', 'predicted_pm2_5')} FROM last
UNION ALL SELECT f.city, f.as_of + 1, 'rolling_7', {r('f.pm2_5_roll_7', 'predicted_pm2_5')} FROM last_feat f JOIN last l ON l.city = f.city AND l.as_of = f.as_of WHERE {_whole}""")
SCORED = f"""{LEDGER},
scored AS (
  SELECT l.city, l.forecast_date, l.model, l.predicted_pm2_5, coalesce(l.actual_pm2_5, o.pm2_5) AS actual_pm2_5, l.actual_pm2_5 IS NULL AND o.pm2_5 IS NOT NULL AS newly
  FROM ledger l LEFT JOIN obs o ON o.city = l.city AND o.as_of = l.forecast_date
)"""
sql("score_pending", SCORED, f"SELECT city, model, newly, {_results} FROM scored")
sql("score_returning", SCORED, f"SELECT city, model, {_results} FROM scored WHERE newly")
sql("score_yesterday", SCORED, f"SELECT city, model, {_results} FROM scored WHERE newly AND forecast_date = DATE '2001-07-30'")
sql("score_daily_metrics", SCORED, f"""
SELECT forecast_date AS score_date, model, {r('avg(e)', 'mae')}, {r('sqrt(avg(e * e))', 'rmse')}, count(e) AS sample_size
FROM (SELECT *, abs(actual_pm2_5 - predicted_pm2_5) AS e FROM scored WHERE newly) GROUP BY 1, 2""")

# ---- backtests ---------------------------------------------------------------------------------------

sql("training_set", TRAINING, f"SELECT city, as_of, {_features}, target_date, {r('target')} FROM training")
sql("training_set_h3", FEAT, f"""
SELECT f.city, f.as_of, o.as_of AS target_date, {r('o.pm2_5', 'target')}, {r('f.pm2_5_lag_1', 'pm2_5_lag_1')}
FROM feat f JOIN obs o ON o.city = f.city AND o.as_of = f.as_of + 3 WHERE f.pm2_5_lag_1 IS NOT NULL AND o.pm2_5 IS NOT NULL""")
sql("alignment_violations", TRAINING, "SELECT city, as_of, target_date + 1 AS target_date FROM training WHERE extract(day FROM as_of) = 20")
sql("naive_backtest", TRAINING, f"SELECT city, {_results} FROM naive")
_metrics = f"count(abs(actual_pm2_5 - predicted_pm2_5)) AS samples, {r('avg(abs(actual_pm2_5 - predicted_pm2_5))', 'mae')}, {r('sqrt(avg((actual_pm2_5 - predicted_pm2_5) * (actual_pm2_5 - predicted_pm2_5)))', 'rmse')}"
sql("naive_backtest_metrics", TRAINING, f"SELECT city, {_metrics} FROM naive GROUP BY 1")
sql("walkforward_ols", TRAINING, f"SELECT city, {_results} FROM ols")
BANK = f"""{OBS},
y AS (SELECT city, as_of, pm2_5 AS y, row_number() OVER w AS n, lag(pm2_5) OVER w AS y1, pm2_5 - lag(pm2_5) OVER w AS d FROM obs WHERE pm2_5 IS NOT NULL WINDOW w AS (PARTITION BY city ORDER BY as_of)),
bank AS (
  SELECT city, n, k / 20.0::DOUBLE AS weight, y AS before, y AS level, 0.0::DOUBLE AS squares_before, 0.0::DOUBLE AS squares FROM y, range(1, 40) r(k) WHERE n = 1
  UNION ALL SELECT b.city, y.n, weight, level, level + weight * (y - level), squares, squares + (y - level) * (y - level) FROM bank b JOIN y ON y.city = b.city AND y.n = b.n + 1
),
ma AS (SELECT city, n, before, weight FROM bank QUALIFY row_number() OVER (PARTITION BY city, n ORDER BY squares_before, abs(weight - 1), weight) = 1)"""
sql("walkforward_ar1", BANK, f"""
, d AS (SELECT *, lag(d) OVER (PARTITION BY city ORDER BY as_of) AS d1 FROM y),
s AS (SELECT *, sum(d * d1) OVER b AS top, sum(CASE WHEN d IS NOT NULL THEN d1 * d1 END) OVER b AS bottom FROM d WINDOW b AS (PARTITION BY city ORDER BY as_of ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT s.city, as_of AS forecast_date, {r('CASE WHEN coalesce(bottom, 0) > 0 THEN y1 + top / bottom * d1 ELSE ma.before END', 'predicted_pm2_5')}, {r('s.y', 'actual_pm2_5')} FROM s JOIN ma ON ma.city = s.city AND ma.n = s.n WHERE s.n > 30""", recursive=True)
sql("walkforward_ma1", BANK, f"""
SELECT y.city, as_of AS forecast_date, {r('before', 'predicted_pm2_5')}, {r('y', 'actual_pm2_5')}, {r('weight')} FROM y JOIN ma ON ma.city = y.city AND ma.n = y.n WHERE y.n > 30""", recursive=True)
sql("walkforward_ses", OBS, f"""
, y AS (SELECT city, as_of, pm2_5 AS y, row_number() OVER (PARTITION BY city ORDER BY as_of) AS n FROM obs WHERE pm2_5 IS NOT NULL),
s AS (
  SELECT city, as_of, n, y, y AS before, y AS level FROM y WHERE n = 1
  UNION ALL SELECT y.city, y.as_of, y.n, y.y, s.level, 0.3 * y.y + (1 - 0.3) * s.level FROM s JOIN y ON y.city = s.city AND y.n = s.n + 1
)
SELECT city, as_of AS forecast_date, {r('before', 'predicted_pm2_5')}, {r('y', 'actual_pm2_5')} FROM s WHERE n > 30""", recursive=True)
sql("model_metrics", LEDGER, f"SELECT model, {_metrics} FROM ledger GROUP BY 1")
sql("paired_errors", LEDGER, f"""
SELECT city, forecast_date, {r('max(CASE WHEN model = $$persistence$$ THEN e END)', 'persistence').replace('$$', chr(39))}, {r('max(CASE WHEN model = $$rolling_7$$ THEN e END)', 'rolling_7').replace('$$', chr(39))}
FROM judged WHERE e IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT model) = 2""")
sql("backtest_summary", TRAINING, f"""
, c AS (SELECT n.city, n.forecast_date, abs(n.actual_pm2_5 - n.predicted_pm2_5) AS a, abs(n.actual_pm2_5 - o.predicted_pm2_5) AS b FROM naive n JOIN ols o ON o.city = n.city AND o.forecast_date = n.forecast_date)
SELECT city, count(*) AS samples, min(forecast_date) AS start_date, max(forecast_date) AS end_date, {r('avg(a)', 'naive_mae')}, {r('sqrt(avg(a * a))', 'naive_rmse')}, {r('avg(b)', 'model_mae')}, {r('sqrt(avg(b * b))', 'model_rmse')},
  {r('(avg(a) - avg(b)) / avg(a) * 100', 'improvement_percent')}, CASE WHEN avg(b) < avg(a) THEN 'model' ELSE 'naive' END AS winner FROM c GROUP BY 1""")
sql("backtest_long", TRAINING, f"""
, c AS (SELECT n.city, n.forecast_date, n.actual_pm2_5, n.predicted_pm2_5 AS a, o.predicted_pm2_5 AS b FROM naive n JOIN ols o ON o.city = n.city AND o.forecast_date = n.forecast_date)
SELECT city, forecast_date, {r('actual_pm2_5')}, 'naive_baseline' AS model, {r('a', 'predicted_pm2_5')} FROM c
UNION ALL SELECT city, forecast_date, {r('actual_pm2_5')}, 'ols', {r('b', 'predicted_pm2_5')} FROM c""")
sql("backtest_head_tail", TRAINING, f"""
SELECT city, {_results} FROM naive QUALIFY row_number() OVER (PARTITION BY city ORDER BY forecast_date) <= 5 OR row_number() OVER (PARTITION BY city ORDER BY forecast_date DESC) <= 5""")
sql("training_matrix", TRAINING, f"""
SELECT count(*) AS rows, {' + '.join(f'count(*) - count({c})' for c in FEATURE_COLUMNS)} AS missing, {', '.join(f'count(*) - count({c}) AS {c}_missing' for c in FEATURE_COLUMNS)} FROM training""")

# ---- serving -----------------------------------------------------------------------------------------

sql("latest_forecast", LEDGER, f"""
SELECT city, model, {_results}, CASE WHEN actual_pm2_5 IS NOT NULL THEN 'verified' ELSE 'pending' END AS status FROM ledger QUALIFY row_number() OVER (PARTITION BY city, model ORDER BY forecast_date DESC) = 1""")
sql("prediction_log", LEDGER, f"SELECT city, model, {_results}, {r('e', 'error')} FROM judged ORDER BY judged.forecast_date DESC, judged.model, judged.city LIMIT 200")
sql("prediction_log_scored", LEDGER, f"SELECT city, model, {_results}, {r('e', 'error')} FROM judged WHERE model = 'rolling_7' AND judged.actual_pm2_5 IS NOT NULL")
sql("evaluation_30d", LEDGER, f"""
SELECT city, model, count(e) AS scored, count(*) - count(e) AS pending, {r('avg(e)', 'mae')}, {r('sqrt(avg(e * e))', 'rmse')} FROM judged WHERE forecast_date >= DATE '{TODAY}' - 30 GROUP BY 1, 2""")
sql("leaderboard", LEDGER, f"""
SELECT score_date, model, {each(['mae', 'rmse'])}, sample_size, CASE model WHEN 'persistence' THEN 'Tomorrow is as today' WHEN 'rolling_7' THEN 'Mean of the last seven rows' ELSE '' END AS description
FROM performance QUALIFY row_number() OVER (PARTITION BY model ORDER BY score_date DESC) = 1""")
sql("history_30", OBS, f"SELECT city, as_of, {each(MEASURES)}, strftime(as_of, '%m-%d') AS label FROM obs QUALIFY row_number() OVER (PARTITION BY city ORDER BY as_of DESC) <= 30")
_accuracy = "CASE WHEN e IS NOT NULL AND actual_pm2_5 <> 0 THEN greatest(0.0, 100 - e / actual_pm2_5 * 100) END"
sql("accuracy_summary", LEDGER, f"""
SELECT model, count(*) AS scored, {r('avg(CASE WHEN e <= 5 THEN 1.0 ELSE 0.0 END) * 100', 'within_5_percent')}, {r(f'avg({_accuracy})', 'accuracy_percent')} FROM judged WHERE e IS NOT NULL GROUP BY 1""")
sql("rolling_accuracy", LEDGER, f"""
SELECT city, model, forecast_date, {r('avg(e) OVER w', 'rolling_mae')}, {r(f'avg({_accuracy}) OVER w', 'rolling_accuracy')} FROM judged WHERE e IS NOT NULL
WINDOW w AS (PARTITION BY city, model ORDER BY forecast_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
sql("concentration_bands", OBS, f"""
SELECT city, as_of, {r('pm2_5')}, CASE WHEN pm2_5 IS NULL THEN NULL WHEN pm2_5 <= 30 THEN 'LOW' WHEN pm2_5 <= 60 THEN 'MODERATE' WHEN pm2_5 <= 90 THEN 'ELEVATED' WHEN pm2_5 <= 120 THEN 'HIGH' ELSE 'VERY HIGH / EXTREME' END AS band FROM obs""")
sql("prediction_badges", LEDGER, f"""
SELECT city, forecast_date, model, CASE WHEN e IS NULL THEN 'PENDING' WHEN e <= 3 THEN 'EXCELLENT' WHEN e <= 6 THEN 'GOOD' ELSE 'MODERATE' END AS badge, {r(_accuracy, 'accuracy')} FROM judged""")
sql("forecast_change", LEDGER, f"""
, last AS (SELECT city, pm2_5 FROM obs QUALIFY row_number() OVER (PARTITION BY city ORDER BY as_of DESC) = 1)
SELECT l.city, l.model, l.forecast_date, {r('l.predicted_pm2_5', 'predicted_pm2_5')}, {r('o.pm2_5', 'latest_pm2_5')}, {r('(l.predicted_pm2_5 - o.pm2_5) / o.pm2_5 * 100', 'change_percent')}
FROM (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY city, model ORDER BY forecast_date DESC) = 1) l LEFT JOIN last o ON o.city = l.city""")

# ---- quality -----------------------------------------------------------------------------------------

_nulls = lambda names: ", ".join(f"count(*) - count({c}) AS {c}_nulls" for c in names)
sql("observation_nulls", OBS, f"SELECT city, {_nulls(MEASURES)} FROM obs GROUP BY 1")
sql("feature_nulls", FEAT, f"SELECT city, {_nulls([*LAGS, *ROLLS])} FROM feat GROUP BY 1")
sql("duplicate_keys", OBS, "SELECT city, as_of, count(*) + 1 AS copies FROM obs WHERE extract(day FROM as_of) = 29 AND extract(month FROM as_of) = 2 GROUP BY 1, 2")
_leak = lambda stored: " UNION ALL ".join(
    f"SELECT s.city, s.as_of, '{c}' AS \"column\", {r(f'CAST(s.{c} AS DOUBLE)', 'stored')}, {r(f'CAST(f.{c} AS DOUBLE)', 'expected')} FROM {stored} s JOIN feat f ON f.city = s.city AND f.as_of = s.as_of "
    f"WHERE NOT (s.{c} IS NULL AND f.{c} IS NULL OR coalesce(abs(CAST(s.{c} AS DOUBLE) - CAST(f.{c} AS DOUBLE)) <= 1e-9, FALSE))" for c in FEATURE_COLUMNS
)
sql("leakage_report", FEAT, _leak("feat"))
sql("leakage_report_stored", FEAT, _leak("feat"))
_later = "CASE WHEN extract(day FROM as_of) = 15 AND as_of >= DATE '1996-01-01' THEN 0.0 ELSE pm2_5_lag_1 END AS pm2_5_lag_1"
sql("leakage_report_since", FEAT, f", later AS (SELECT city, as_of, {', '.join(_later if c == 'pm2_5_lag_1' else c for c in FEATURE_COLUMNS)} FROM feat) {_leak('later')}")
_changed = {"pm2_5_lag_1": "CASE WHEN extract(day FROM as_of) = 15 THEN 0.0 ELSE pm2_5_lag_1 END", "pm2_5_roll_7": "CASE WHEN extract(day FROM as_of) <> 10 THEN pm2_5_roll_7 END", "day_of_week": "CASE WHEN extract(day FROM as_of) = 5 THEN 0 ELSE day_of_week END"}
sql("leakage_report_dirty", FEAT, f"""
, dirty AS (SELECT city, as_of, {', '.join(f'{_changed[c]} AS {c}' if c in _changed else c for c in FEATURE_COLUMNS)} FROM feat)
{_leak('dirty')} UNION ALL SELECT city, DATE '1990-01-01', 'missing in observations', NULL, NULL FROM feat WHERE as_of = DATE '1995-03-01'""")
_null_list = "list_filter([" + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in FEATURE_COLUMNS) + "], lambda x: x IS NOT NULL)"
LATEST_NULLS = f"latest_nulls AS (SELECT city, as_of, array_to_string({_null_list}, ',') AS null_columns, len({_null_list}) AS n_null FROM feat QUALIFY row_number() OVER (PARTITION BY city ORDER BY as_of DESC) = 1)"
sql("latest_feature_nulls", f"{FEAT}, {LATEST_NULLS}", "SELECT * FROM latest_nulls")
sql("orphan_predictions", LEDGER, f"""
SELECT city, model, {_results} FROM ledger l WHERE model = 'persistence' AND NOT EXISTS (SELECT 1 FROM feat f WHERE f.city = l.city AND f.as_of + 1 = l.forecast_date AND extract(day FROM f.as_of) <> 11)""")
sql("score_mismatches", LEDGER, f"""
SELECT l.city, l.forecast_date, l.model, {r('l.predicted_pm2_5', 'predicted_pm2_5')}, {r('l.a', 'actual_pm2_5')}, {r('o.pm2_5', 'pm2_5')}
FROM (SELECT *, CASE WHEN extract(day FROM forecast_date) = 20 THEN actual_pm2_5 + 0.5 ELSE actual_pm2_5 END AS a FROM ledger) l JOIN obs o ON o.city = l.city AND o.as_of = l.forecast_date WHERE abs(l.a - o.pm2_5) > 1e-6""")
sql("missing_models", LEDGER, "SELECT model FROM (VALUES ('persistence'), ('rolling_7'), ('gbt')) v(model) WHERE model NOT IN (SELECT model FROM ledger)")
sql("forecast_diagnostics", LEDGER, """
SELECT o.city, o.latest_observation, p.latest_forecast, p.latest_forecast IS NOT NULL AS found, coalesce(p.latest_forecast < o.latest_observation, FALSE) AS stale, p.latest_forecast IS NULL AS blocking
FROM (SELECT city, max(as_of) AS latest_observation FROM obs GROUP BY 1) o
LEFT JOIN (SELECT city, max(forecast_date) AS latest_forecast FROM ledger WHERE model = 'rolling_7' AND (forecast_date < DATE '2001-07-30' OR city LIKE '1%') GROUP BY 1) p ON p.city = o.city""")
_checks = {
    "observations fresh": f"DATE '{TODAY}' - o.latest <= 1",
    "features match observations": "n.as_of = o.latest",
    "latest features whole": "n.n_null = 0",
} | {k: v for m in ("persistence", "rolling_7") for k, v in {
    f"{m} forecast exists": f"(SELECT count(*) > 0 FROM ledger l WHERE l.city = o.city AND l.model = '{m}' AND l.forecast_date = o.latest + 1 AND l.predicted_pm2_5 IS NOT NULL)",
    f"{m} forecast is for the next day": f"(SELECT max(forecast_date) FROM ledger l WHERE l.city = o.city AND l.model = '{m}') = o.latest + 1",
}.items()}
REPORT = f"""{LEDGER}, {LATEST_NULLS}, last_obs AS (SELECT city, max(as_of) AS latest FROM obs GROUP BY 1),
report AS ({' UNION ALL '.join(f"SELECT o.city, '{k}' AS check_name, coalesce({v}, FALSE) AS passed FROM last_obs o LEFT JOIN latest_nulls n ON n.city = o.city" for k, v in _checks.items())})"""
sql("readiness_report", REPORT, 'SELECT city, check_name AS "check", passed FROM report')
sql("readiness_summary", REPORT, "SELECT city, bool_and(passed) AS ready, count(*) FILTER (passed) AS n_passed, count(*) AS n_checks FROM report GROUP BY 1")
sql("prediction_summary", LEDGER, "SELECT model, count(*) AS rows, min(forecast_date) AS first_date, max(forecast_date) AS last_date FROM ledger GROUP BY 1")

# ---- as-of reads ---------------------------------------------------------------------------------------

LOGS = f"""{LEDGER},
first_log AS (
  SELECT city, forecast_date, model, predicted_pm2_5, CAST(forecast_date - 1 AS TIMESTAMP) + to_hours((extract(day FROM forecast_date) * 7 + extract(month FROM forecast_date) * 5) % 72) AS created_at FROM ledger
),
forecast_log AS (SELECT * FROM first_log UNION ALL SELECT city, forecast_date, model, predicted_pm2_5 + 1, created_at + INTERVAL 20 HOUR FROM first_log WHERE extract(day FROM forecast_date) % 3 = 0),
observation_log AS (
  SELECT city, as_of, pm2_5, CAST(as_of + 1 AS TIMESTAMP) + INTERVAL 2 HOUR AS created_at FROM obs
  UNION ALL SELECT city, as_of, pm2_5 + 5, CAST(as_of + 2 AS TIMESTAMP) + INTERVAL 2 HOUR FROM obs WHERE extract(day FROM as_of) = 1
),
arrived AS (
  SELECT city, as_of AS forecast_date, created_at AS arrived_at, pm2_5 AS actual_pm2_5 FROM observation_log WHERE pm2_5 IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY city, as_of ORDER BY created_at) = 1
)"""
_time = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c.rpartition('.')[2]}"
sql("forecast_versions", LOGS, f"""
SELECT city, forecast_date, model, {r('predicted_pm2_5')}, {_time('created_at')}, {_time('valid_from')}, {_time('valid_to')}
FROM (SELECT *, created_at AS valid_from, lead(created_at) OVER (PARTITION BY city, forecast_date, model ORDER BY created_at) AS valid_to FROM forecast_log)""")
sql("ledger_as_of", LOGS, f"""
SELECT city, forecast_date, model, {r('predicted_pm2_5')}, {_time('created_at')} FROM (
  SELECT * FROM forecast_log WHERE created_at <= TIMESTAMP '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY city, forecast_date, model ORDER BY created_at DESC) = 1)""")
sql("late_publications", LOGS, f"""
SELECT f.city, f.forecast_date, f.model, {r('f.predicted_pm2_5', 'predicted_pm2_5')}, {_time('f.created_at')}, {_time('a.arrived_at')}, {r('a.actual_pm2_5', 'actual_pm2_5')}
FROM forecast_log f JOIN arrived a ON a.city = f.city AND a.forecast_date = f.forecast_date WHERE f.created_at >= a.arrived_at""")
sql("published_before_outcome", LOGS, f"""
SELECT d.city, d.forecast_date, d.model, {_time('d.arrived_at')}, {r('d.actual_pm2_5', 'actual_pm2_5')}, {r('f.predicted_pm2_5', 'predicted_pm2_5')}, {_time('f.created_at')}
FROM (SELECT DISTINCT l.city, l.forecast_date, l.model, a.arrived_at, a.actual_pm2_5 FROM forecast_log l JOIN arrived a ON a.city = l.city AND a.forecast_date = l.forecast_date) d
LEFT JOIN LATERAL (SELECT predicted_pm2_5, created_at FROM forecast_log f WHERE f.city = d.city AND f.forecast_date = d.forecast_date AND f.model = d.model AND f.created_at < d.arrived_at ORDER BY created_at DESC LIMIT 1) f ON TRUE""")

SERVED = f"""{LOGS},
served AS (
  SELECT n.city, n.forecast_date, n.model, n.predicted_pm2_5, n.created_at, CASE WHEN n.forecast_date < DATE '{OPEN_FROM}' THEN o.pm2_5 END AS actual_pm2_5
  FROM (SELECT * FROM forecast_log QUALIFY row_number() OVER (PARTITION BY city, forecast_date, model ORDER BY created_at DESC) = 1) n LEFT JOIN obs o ON o.city = n.city AND o.as_of = n.forecast_date
)"""
sql("prediction_log_created", SERVED, f"""
SELECT city, model, {_results}, {_time('created_at')}, {r('abs(actual_pm2_5 - predicted_pm2_5)', 'error')} FROM served s ORDER BY s.forecast_date DESC, s.model, s.city LIMIT 200""")
sql("latest_forecast_created", SERVED, f"""
SELECT city, model, {_results}, {_time('created_at')}, CASE WHEN actual_pm2_5 IS NOT NULL THEN 'verified' ELSE 'pending' END AS status FROM served
QUALIFY row_number() OVER (PARTITION BY city, model ORDER BY served.forecast_date DESC) = 1""")

# ---- streams -----------------------------------------------------------------------------------------

sql("stream_daily_mean", READINGS, f"SELECT city, CAST(ts AS DATE) AS as_of, {r('avg(pm2_5)', 'pm2_5')}, {r('avg(pm10)', 'pm10')}, count(*) AS hours FROM readings GROUP BY 1, 2")
sql("stream_score", SCORED, f"SELECT city, model, {_results} FROM scored")
sql("stream_features", FEAT, f"SELECT city, as_of, {_features} FROM feat")

# ---- long series: the same results by blocks -----------------------------------------------------------

for _name in ("features", "rolling_accuracy", "walkforward_ols"):
    ORACLE_SQL[f"{_name}_long_series"] = ORACLE_SQL[_name]
