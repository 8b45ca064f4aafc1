"""Stored tables whose parts split, are skipped by date and city, and are checked by digest."""

from datetime import date, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from verivane.operators import features
from verivane.schema import TABLES
from verivane.sources import digests, tables

START = date(2022, 11, 1)


def made(spark, cities, days, moved=0.0, start=START):
    rows = [(f"c{c}", start + timedelta(d), float((c * 7 + d * 13) % 50) + moved, 1.0, 2.0, 3.0, float(d % 3), None) for c in cities for d in days]
    return spark.createDataFrame(rows, TABLES["observations"])


def values(df):
    return sorted(tuple(r) for r in df.drop("created_at").collect())


def opened(df):
    return {"/".join(f.split("/")[-3:-1]) for f in df.inputFiles()}


def test_growth_moves_rows_out_of_the_named_buckets_alone(spark):
    cities = spark.range(500).select(F.concat(F.lit("c"), "id").alias("city"))
    for before, after in ((1, 2), (1, 7), (3, 4), (3, 9), (6, 6), (5, 20)):
        rows = cities.select(tables._bucket(before).alias("a"), tables._bucket(after).alias("b")).collect()
        assert {r["a"] for r in rows if r["a"] != r["b"]} <= tables._sources(before, after) <= set(range(before))
        assert {r["b"] for r in rows} == set(range(after))


def test_parts_stay_bounded_as_cities_come(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "PART_ROWS", 600)
    root = f"file://{tmp_path}"
    few, many = made(spark, range(20), range(60)), made(spark, range(20, 200), range(60))
    tables.merge(few, root, "observations")
    one = tables.state(spark, root, "observations")
    tables.merge(many, root, "observations")
    ten = tables.state(spark, root, "observations")
    assert values(tables.read(spark, root, "observations")) == values(few.unionByName(many))
    assert (one.buckets, ten.buckets) == ({"2022": 2}, {"2022": 18})  # 1200 rows, then 10800 that come
    assert max(p["rows"] for p in ten.parts.values()) <= 4 * 600
    city = tables.read(spark, root, "observations", "c7")
    assert city.count() == 60 and len(opened(city)) == 1


def test_only_parts_of_the_split_are_rewritten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "PART_ROWS", 100)
    root, start = f"file://{tmp_path}", date(2024, 1, 1)
    tables.merge(made(spark, range(40), range(10), start=start), root, "observations")
    first = tables.state(spark, root, "observations")
    tables.merge(made(spark, range(40, 50), range(10), start=start), root, "observations")  # 500 rows: seen by the next write
    second = tables.state(spark, root, "observations")
    tables.merge(made(spark, [0], [0], moved=1.0, start=start), root, "observations")
    third = tables.state(spark, root, "observations")
    assert [s.buckets["2024"] for s in (first, second, third)] == [4, 4, 5]
    moved = {p for p in third.parts if p not in second.parts or third.parts[p]["folder"] != second.parts[p]["folder"]}
    assert {third.of(p)[0] for p in moved} <= {0, 4, third.of(next(iter(tables.parts_of_cities(made(spark, [0], [0]), third))))[0]}
    assert tables.read(spark, root, "observations").count() == 500


def test_a_window_opens_only_parts_that_reach_into_it(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = made(spark, range(3), range(800))  # 2022 to 2025
    tables.merge(rows, root, "observations")
    window = tables.read(spark, root, "observations", since="2023-12-30", until="2024-01-02")
    assert opened(window) == {"part_bucket=0/part_year=2023", "part_bucket=0/part_year=2024"}
    assert values(window) == values(rows.where("as_of between '2023-12-30' and '2024-01-02'"))
    assert tables.read(spark, root, "observations", since="2031-01-01").isEmpty()
    assert tables.read(spark, root, "observations", "nobody").isEmpty()


def test_versions_stay_by_age(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    tables.merge(made(spark, [1], [0]), root, "observations")
    reader = tables.read(spark, root, "observations")
    for k in range(1, 5):
        tables.merge(made(spark, [1], [k]), root, "observations")
    assert reader.count() == 1 and len(tables._versions(spark, root, "observations")) == 5
    monkeypatch.setattr(tables, "AGE_MS", 0)
    tables.merge(made(spark, [1], [5]), root, "observations")
    assert list(tables._versions(spark, root, "observations")) == [5, 6]
    assert len(list((tmp_path / "observations/data").iterdir())) == 2
    assert tables.read(spark, root, "observations").count() == 6


def test_a_corrupted_cell_is_found(spark, tmp_path):
    root = f"file://{tmp_path}"
    tables.merge(made(spark, range(4), range(400)), root, "observations")
    assert digests.verify(spark, root, "observations").isEmpty()
    file = next((tmp_path / "observations/data").glob("*/*/part_year=2023/*.parquet"))
    table = pq.read_table(file, partitioning=None)
    pm10 = table.column("pm10").to_pylist()
    pm10[17] += 1e-9
    pq.write_table(table.set_column(table.column_names.index("pm10"), "pm10", pa.array(pm10)), file, use_deprecated_int96_timestamps=True)
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert [tuple(r) for r in digests.verify(spark, root, "observations").collect()] == [("part_bucket=0/part_year=2023", "pm10")]
    repeated = pa.concat_tables([table, table.slice(0, 1)])
    pq.write_table(repeated, file, use_deprecated_int96_timestamps=True)
    assert {r["column"] for r in digests.verify(spark, root, "observations").collect()} == {"rows", *TABLES["observations"].names}


@pytest.fixture
def built(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "PART_ROWS", 1500)
    root, rows = f"file://{tmp_path}", made(spark, range(16), range(800))
    tables.merge(rows, root, "observations")
    tables.refresh_features(spark, root, rows.select("city", "as_of"))
    return root


def found(report):
    return {(r["city"], r["as_of"], r["column"]) for r in report.collect()}


def test_leakage_is_sought_where_something_changed(spark, built, monkeypatch):
    read = []
    inner = digests.read_parts
    monkeypatch.setattr(digests, "read_parts", lambda spark, root, name, schema, now, parts: read.append((name, set(parts))) or inner(spark, root, name, schema, now, parts))
    assert digests.leakage_gate(spark, built).isEmpty()
    now = digests.mark(spark, built)
    assert dict(read) == {n: now[n].parts.keys() for n in digests.READ}  # the first time, all
    read.clear()
    assert digests.leakage_gate(spark, built).isEmpty()
    assert dict(read) == {"features": set(), "observations": set()}

    # A feature that its observations don't give.
    day = date(2023, 6, 1)
    wrong = tables.read(spark, built, "features", "c3").where(F.col("as_of") == day).withColumn("pm10_roll_7", F.lit(-1.0))
    tables.merge(wrong, built, "features")
    read.clear()
    for _ in range(2):  # found again as long as it is there
        assert found(digests.leakage_gate(spark, built)) == {("c3", day, "pm10_roll_7")}
    now = digests.mark(spark, built)
    part = {p for p in tables.parts_of_cities(wrong, now["features"]) if now["features"].of(p)[1] == 2023}
    assert dict(read)["features"] == part and {now["observations"].of(p)[1] for p in dict(read)["observations"]} == {2022, 2023}
    assert len(dict(read)["observations"]) < len(now["observations"].parts)
    tables.refresh_features(spark, built, wrong.select("city", "as_of"))
    assert digests.leakage_gate(spark, built).isEmpty()

    # An observation that was corrected without its features, some of which lie in the next year.
    tables.merge(made(spark, [5], [(date(2023, 12, 30) - START).days], moved=100.0), built, "observations")
    read.clear()
    some = found(digests.leakage_gate(spark, built))
    whole = digests.leakage_since(spark, built)
    assert some == found(whole) and {d.year for _, d, _ in some} == {2023, 2024}
    assert {digests.mark(spark, built)["features"].of(p)[1] for p in read[0][1]} == {2023, 2024, 2025}
    assert len(read[0][1]) < len(digests.mark(spark, built)["features"].parts)


def test_a_split_between_checks_hides_nothing(spark, built, monkeypatch):
    assert digests.leakage_gate(spark, built).isEmpty()
    monkeypatch.setattr(tables, "PART_ROWS", 400)  # observations split finer than features
    tables.merge(made(spark, [5], [700], moved=9.0), built, "observations")
    assert found(digests.leakage_gate(spark, built)) == found(digests.leakage_since(spark, built)) != set()
    expected = features.features(tables.read(spark, built, "observations"))
    tables.refresh_features(spark, built, made(spark, [5], [700]).select("city", "as_of"))
    assert values(tables.read(spark, built, "features").drop("created_at")) == values(expected)
    assert digests.leakage_gate(spark, built).isEmpty()
