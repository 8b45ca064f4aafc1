"""Streams with keyed state: equal to the batch operators, also after restarts, replays, corrections and late rows."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_ledger import OBS, PRED, START
from verivane import streaming
from verivane.operators import features, ledger
from verivane.schema import FEATURE_COLUMNS
from verivane.sources.shared import land

DAY = timedelta(1)


class Folder:
    """A folder of landed files, read as a stream of one file a batch."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, path, schema, 0

    def add(self, *rows):
        """A file of its own, later than those before."""
        self.n += 1
        inbox = f"{self.path}-{self.n}"
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.parquet(inbox)
        java = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        fs = java.Path(self.path).getFileSystem(conf)
        fs.mkdirs(java.Path(self.path))
        (part,) = [f.getPath() for f in fs.listStatus(java.Path(inbox)) if f.getPath().getName().startswith("part-")]
        to = java.Path(f"{self.path}/{self.n:03d}.parquet")
        fs.rename(part, to)
        fs.setTimes(to, 1_700_000_000_000 + self.n * 1000, -1)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


@pytest.fixture
def folders(spark, tmp_path):
    root = f"file://{tmp_path}"
    return root, Folder(spark, f"{root}/f", PRED), Folder(spark, f"{root}/o", "city string, as_of date, pm2_5 double")


def forecast(day, value, model="m", actual=None, city="a"):
    return (city, START + day * DAY, value, actual, model)


def seen(day, value, city="a"):
    return (city, START + day * DAY, value)


def rows(df):
    return sorted(((r["city"], (r["forecast_date"] - START).days, r["model"], r["predicted_pm2_5"], r["actual_pm2_5"]) for r in df.collect()), key=repr)


def test_files_land_in_order(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    land(spark.range(100).repartition(7), -F.col("id"), path, 4)
    files = sorted((tmp_path / "x").glob("part-*"), key=lambda f: f.stat().st_mtime)
    assert len(files) == 4 and len({f.stat().st_mtime for f in files}) == 4
    got = [[r["id"] for r in spark.read.parquet(f"file://{f}").collect()] for f in files]
    assert sum(got, []) == list(range(99, -1, -1))


def test_scores_equal_the_batch_after_restarts(spark, folders):
    root, f, o = folders
    f.add(*[forecast(d, float(d), m) for d in range(10) for m in "mn"], forecast(0, 1.0, "old", 4.0))
    o.add(*[seen(d, d + 0.5 if d != 3 else None) for d in range(5)])
    run = lambda: streaming.stream_scores(f.stream(), o.stream(), root)
    assert rows(run()) == [("a", d, m, float(d), d + 0.5) for d in (0, 1, 2, 4) for m in "mn"]
    o.add(seen(2, 99.0), seen(3, 3.5), *[seen(d, d + 0.5) for d in range(5, 9)], seen(5, 77.0, "b"))
    f.add(forecast(2, 55.0), forecast(8, 66.0), forecast(1, 7.0, "late"))  # two again, one new after its outcome
    settled = run()
    scored = {r[1:3]: r[3:] for r in rows(settled)}
    assert scored == {(d, m): (float(d), d + 0.5) for d in range(9) for m in "mn"} | {(1, "late"): (7.0, 1.5)}
    published = spark.createDataFrame([forecast(d, float(d), m) for d in range(10) for m in "mn"] + [forecast(0, 1.0, "old", 4.0), forecast(1, 7.0, "late")], PRED)
    outcomes = spark.createDataFrame([seen(d, d + 0.5) for d in range(9)], o.schema)
    assert rows(ledger.with_scores(published, settled)) == rows(ledger.score_pending(published, outcomes).drop("newly"))
    assert rows(run()) == rows(settled)  # nothing new, nothing twice


def test_a_batch_that_is_run_again_is_written_once(spark, folders, tmp_path):
    root, f, o = folders
    f.add(*[forecast(d, 1.0) for d in range(4)])
    o.add(*[seen(d, 2.0) for d in range(4)])
    first = rows(streaming.stream_scores(f.stream(), o.stream(), root))
    commits = sorted((tmp_path / "_checkpoint-scores/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in [commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")]:
        p.unlink(missing_ok=True)  # as if the driver had died before it noted the last batch
    assert rows(streaming.stream_scores(f.stream(), o.stream(), root)) == first and len(first) == 4


def test_what_the_watermark_has_passed_is_left_to_the_batch(spark, folders):
    root, f, o = folders
    run = lambda: streaming.stream_scores(f.stream(), o.stream(), root, lateness="3 days")
    f.add(forecast(0, 1.0), forecast(1, 1.0), forecast(2, 1.0))
    o.add(seen(2, 9.0))
    run()
    o.add(seen(1, 8.0))  # late, but within the watermark
    f.add(forecast(20, 1.0))
    o.add(seen(20, 5.0))
    run()
    f.add(forecast(40, 1.0))
    o.add(seen(0, 7.0), seen(40, 6.0))  # day 0 is long past
    settled = run()
    got = {r[1]: r[4] for r in rows(settled)}
    assert (got[1], got[2], got[20], got[40]) == (8.0, 9.0, 5.0, 6.0) and got[0] is None
    published = spark.createDataFrame([forecast(d, 1.0) for d in (0, 1, 2, 20, 40)], PRED)
    whole = ledger.score_pending(ledger.with_scores(published, settled), spark.createDataFrame([seen(0, 7.0)], o.schema))
    assert {r["forecast_date"]: r["actual_pm2_5"] for r in whole.collect()}[START] == 7.0


# ---- features ----------------------------------------------------------------------------------------


def made(n, seed, city="a", gaps=()):
    rng = random.Random(seed)
    some = lambda top: None if rng.random() < 0.15 else rng.random() * top
    return [(city, START + d * DAY, some(50), some(90), some(30), some(10), some(3)) for d in range(n) if d not in gaps]


def same_features(got, want):
    key = lambda r: (r["city"], r["as_of"])
    a, b = ({key(r): [r[c] for c in FEATURE_COLUMNS] for r in df.collect()} for df in (got, want))
    assert set(a) == set(b)
    for k in a:
        assert all(x == y if x is None or y is None else x == pytest.approx(y, rel=1e-12) for x, y in zip(a[k], b[k])), k


@pytest.fixture
def inbox(spark, tmp_path):
    root = f"file://{tmp_path}"
    return root, Folder(spark, f"{root}/in", OBS)


def test_any_order_within_the_lateness_gives_the_same_features(spark, inbox):
    root, box = inbox
    data = made(75, 1, gaps=(11, 12, 40)) + made(50, 2, "b") + made(3, 3, "c")
    rng = random.Random(4)
    arrival = sorted(data, key=lambda r: ((r[1] - START).days + rng.randrange(6), r[0]))
    for at in range(0, len(arrival), 26):
        box.add(*arrival[at : at + 26])
    got = streaming.stream_features(box.stream(), root, lateness=6)
    assert got.where("late").isEmpty()
    same_features(got, features.features(spark.createDataFrame(data, OBS)))


def test_corrections_restarts_and_rows_that_come_too_late(spark, inbox):
    root, box = inbox
    data = {r[1]: r for r in made(70, 5)}
    days = sorted(data)
    run = lambda: streaming.stream_features(box.stream(), root, lateness=5)
    missing = days[8]
    box.add(*[data[d] for d in days[:40] if d != missing])
    box.add(*[data[d] for d in days[40:60]])
    run()
    data[days[57]] = (*data[days[57]][:2], 1000.0, *data[days[57]][3:])
    box.add(data[days[57]])  # corrected
    box.add(*[data[d] for d in days[60:]])
    box.add(data[missing])  # its neighbours have left the ring
    got = run()
    late = got.where("late").collect()
    assert [r["as_of"] for r in late] == [missing] and all(late[0][c] is None for c in FEATURE_COLUMNS)
    known = spark.createDataFrame([data[d] for d in days if d != missing], OBS)
    same_features(got.where("not late"), features.features(known))
    versions = {r["as_of"]: r["version"] for r in got.collect()}
    assert versions[days[56]] == 2 and versions[days[57]] == 3 and versions[days[59]] == 3 and versions[days[60]] == 4
    again = run()
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, got.collect()), key=repr)


def test_a_ring_holds_no_more_than_it_needs():
    import numpy as np

    # A row's features from the ring alone equal those from the whole series.
    rng = np.random.default_rng(6)
    days, cells = np.arange(200), rng.normal(size=(200, 5))
    cells[rng.random(cells.shape) < 0.2] = np.nan
    whole = streaming.ring_features(days, cells, 0)
    for at in (31, 100, 199):
        start = at - streaming.ROWS + 1
        part = streaming.ring_features(days[start : at + 1], cells[start : at + 1], start)
        for c, v in part.items():
            assert v[-1] == pytest.approx(whole[c][at], nan_ok=True)


def test_empty_streams(spark, inbox, folders):
    root, box = inbox
    box.add()
    assert streaming.stream_features(box.stream(), root).collect() == []
    root, f, o = folders
    f.add()
    o.add()
    assert streaming.stream_scores(f.stream(), o.stream(), root).collect() == []
