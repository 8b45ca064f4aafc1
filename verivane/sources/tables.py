"""Stored tables: fixed schemas, description, and upserts that rewrite the parts they touch, as atomic versions."""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable, Iterable
from functools import reduce
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructType

from verivane.operators.features import changed_features
from verivane.operators.ledger import upsert
from verivane.schema import KEYS, TABLES


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def describe(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, ordinal, column_name, data_type, rows, nulls of every column; one pass over each table."""
    out = []
    for name, df in tables.items():
        counted = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
        kinds = F.array(*[F.struct(F.lit(i).cast("long").alias("ordinal"), F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), F.col(c).alias("nulls")) for i, (c, t) in enumerate(df.dtypes, 1)])
        out.append(counted.select(F.lit(name).alias("table_name"), F.col("_rows").alias("rows"), F.inline(kinds)))
    return reduce(DataFrame.unionByName, out)


# ---- stored snapshots --------------------------------------------------------------------------------
#
# <root>/<name>/data/<id>/part_bucket=<b>/part_year=<y>/ holds rows, written once and never changed.
# <root>/<name>/log/<version>.json says how many buckets each year has and, of each part, its folder, rows, first and last date and a
# digest of each column. A version comes into being by one rename that fails where the name is taken: readers see a version whole or
# not at all, and of two writers at once one fails. HDFS and local disks rename in that way; on an object store the log folder has to
# lie on a store that can.
#
# A year's buckets grow one by one with its rows (linear hashing of the city): bucket i comes out of bucket i without its top bit, so that
# growth rewrites these alone. A city has at most its key's rows in a year, which bounds what no split can divide.

PART_ROWS = 2_000_000  #: rows for which a year gets another bucket
KEPT = 2  #: versions that stay whatever their age
AGE_MS = 24 * 3600 * 1000  #: for so long a version stays after the next one has come, for readers that have begun


class Conflict(RuntimeError):
    """Someone else has written a version in between."""


class State(NamedTuple):
    """What a version says."""

    version: int
    buckets: dict[str, int]  # of years that have more than one
    parts: dict[str, dict]

    def of(self, part: str) -> tuple[int, int, int]:
        """A part's bucket, year and how many buckets the year has."""
        bucket, year = (p.split("=")[1] for p in part.split("/"))
        return int(bucket), int(year), self.buckets.get(year, 1)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _listed(spark: SparkSession, path: str) -> dict[str, int]:
    """Names in a folder and when they were written."""
    fs, p = _fs(spark, path)
    return {x.getPath().getName(): x.getModificationTime() for x in fs.listStatus(p)} if fs.exists(p) else {}


def _versions(spark: SparkSession, root: str, name: str) -> dict[int, int]:
    """Versions in order and when they were written."""
    return {int(n.removesuffix(".json")): t for n, t in sorted(_listed(spark, f"{root}/{name}/log").items()) if n.endswith(".json")}


def _states(spark: SparkSession, root: str, name: str, versions: Iterable[int]) -> list[State]:
    paths = [f"{root}/{name}/log/{v:012d}.json" for v in versions]
    return [State(**json.loads(r[0])) for r in spark.read.text(paths, wholetext=True).collect()] if paths else []


def state(spark: SparkSession, root: str, name: str) -> State:
    """The newest version; without any, version 0 with nothing in it."""
    newest = max(_versions(spark, root, name), default=0)
    return _states(spark, root, name, [newest])[0] if newest else State(0, {}, {})


def _parts(spark: SparkSession, root: str, name: str, version: int) -> dict[str, str]:
    """Parts of a version and their folders."""
    return {k: v["folder"] for s in _states(spark, root, name, [version]) for k, v in s.parts.items()}


def _date_column(schema: StructType) -> str:
    return next(f.name for f in schema if isinstance(f.dataType, DateType))


def _bucket(n: int) -> Column:
    """The city's bucket of n."""
    low = lambda bits: F.xxhash64("city").bitwiseAND(F.lit((1 << bits) - 1))
    bits = (n - 1).bit_length()
    return F.when(low(bits) < n, low(bits)).otherwise(low(bits - 1)) if n > 1 else F.lit(0).cast("long")


def _sources(before: int, after: int) -> set[int]:
    """Of `before` buckets, those that give rows to the new ones where there will be `after`."""
    out = set()
    for i in range(before, after):
        while i >= before:
            i -= 1 << (i.bit_length() - 1)
        out.add(i)
    return out


def _placed(df: DataFrame, date: str, buckets: dict[str, int]) -> DataFrame:
    """With the part that each row belongs to."""
    year, bucket = F.year(date), F.lit(0).cast("long")
    for n in sorted(set(buckets.values())):
        bucket = F.when(year.isin([int(y) for y, m in buckets.items() if m == n]), _bucket(n)).otherwise(bucket)
    return df.withColumns({"part_bucket": bucket.cast("int"), "part_year": year})


def parts_of_cities(cities: DataFrame, now: State) -> set[str]:
    """The parts of all years in which these cities have their rows."""
    kinds = sorted({now.buckets.get(str(now.of(p)[1]), 1) for p in now.parts})
    if not kinds:
        return set()
    at = F.array(*[F.struct(F.lit(n).alias("n"), _bucket(n).alias("b")) for n in kinds])
    found = {(r[0], r[1]) for r in cities.select(F.inline(at)).distinct().collect()}  # at most a row a bucket
    return {p for p in now.parts if (now.of(p)[2], now.of(p)[0]) in found}


def read_parts(spark: SparkSession, root: str, name: str, schema: StructType, now: State, parts: Iterable[str]) -> DataFrame:
    paths = [f"{root}/{name}/data/{now.parts[p]['folder']}/{p}" for p in sorted(parts)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_snapshot(spark: SparkSession, root: str, name: str, schema: StructType, city: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """The stored rows, of one city or all, and of the days from `since` to `until` (yyyy-mm-dd, both included); none before the first write.
    Only parts that can hold such rows are opened."""
    now, date = state(spark, root, name), F.col(_date_column(schema))
    parts = {p for p, about in now.parts.items() if (since is None or about["last"] >= since) and (until is None or about["first"] <= until)}
    if city is not None:
        parts &= parts_of_cities(spark.range(1).select(F.lit(city).alias("city")), now)
    rows = read_parts(spark, root, name, schema, now, parts)
    wanted = [F.col("city") == city] * (city is not None) + [date >= F.lit(since).cast("date")] * (since is not None) + [date <= F.lit(until).cast("date")] * (until is not None)
    return rows.where(reduce(lambda a, b: a & b, wanted)) if wanted else rows


def read(spark: SparkSession, root: str, name: str, city: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    return read_snapshot(spark, root, name, TABLES[name], city, since, until)


def measure(spark: SparkSession, root: str, name: str, schema: StructType, now: State, parts: Iterable[str]) -> dict[str, dict]:
    """Rows, first and last date and digests of parts as they are in their files. A column's digest is the sum, modulo 2^64, of hashes of key
    and value: the order of rows doesn't count, repeated rows do. One row a part comes back."""
    date = _date_column(schema)
    keys = KEYS.get(name, [*(["city"] if "city" in schema.names else []), date])
    part = F.regexp_extract(F.col("_metadata.file_path"), r"/(part_bucket=\d+/part_year=-?\d+)/[^/]*$", 1)
    digests = [F.sum(F.xxhash64(*keys, c).cast("decimal(20,0)")).alias(f"_{i}") for i, c in enumerate(schema.names)]
    rows = read_parts(spark, root, name, schema, now, parts).select("*", part.alias("_part")) if parts else None
    found = rows.groupBy("_part").agg(F.count("*").alias("_rows"), F.min(date).cast("string").alias("_first"), F.max(date).cast("string").alias("_last"), *digests).collect() if parts else []
    return {
        r["_part"]: {"folder": now.parts[r["_part"]]["folder"], "rows": r["_rows"], "first": r["_first"], "last": r["_last"], "digests": {c: int(r[f"_{i}"]) % 2**64 for i, c in enumerate(schema.names)}}
        for r in found
    }


def _write(df: DataFrame, root: str, name: str, buckets: dict[str, int] | None = None) -> dict[str, dict]:
    """Writes rows into a folder of their own; which parts they have there, as read back."""
    spark, folder = df.sparkSession, uuid.uuid4().hex
    path = f"{root}/{name}/data/{folder}"
    placed = _placed(df, _date_column(df.schema), buckets or {})
    placed.repartition("part_bucket", "part_year").write.partitionBy("part_bucket", "part_year").parquet(path)
    parts = {f"{b}/{y}": {"folder": folder} for b in _listed(spark, path) if b.startswith("part_") for y in _listed(spark, f"{path}/{b}") if y.startswith("part_")}
    return measure(spark, root, name, df.schema, State(0, {}, parts), parts)


def put(spark: SparkSession, text: str, path: str, overwrite: bool = False) -> None:
    """Writes a small file whole or not at all; fails where it is there, unless overwrite."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, fresh = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(fresh, False)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, int(overwrite))
    if overwrite:
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), conf).rename(fresh, jvm.org.apache.hadoop.fs.Path(path), options)
    except Py4JJavaError:
        fs.delete(fresh, False)
        raise


def _folders(states: Iterable[State]) -> set[str]:
    return {about["folder"] for s in states for about in s.parts.values()}


def _commit(spark: SparkSession, root: str, name: str, parts: dict[str, dict], before: int, buckets: dict[str, int] | None = None) -> None:
    """Makes parts the version after `before`, then clears what no kept version needs."""
    log, fresh = f"{root}/{name}/log", State(before + 1, buckets or {}, parts)
    fs, _ = _fs(spark, log)
    try:
        put(spark, json.dumps(fresh._asdict()), f"{log}/{before + 1:012d}.json")
    except Py4JJavaError as e:
        there = _versions(spark, root, name)
        if before + 1 > max(there, default=0):
            raise
        for folder in _folders([fresh]) - _folders(_states(spark, root, name, there)):  # no version will need what was written
            fs.delete(_fs(spark, f"{root}/{name}/data/{folder}")[1], True)
        raise Conflict(f"{name} has been written since version {before}") from e
    times = _versions(spark, root, name)
    order, last = list(times), max(times.values())
    gone = [v for v, after in zip(order[:-KEPT], order[1:]) if last - times[after] >= AGE_MS]
    if gone:
        # A folder that a version no longer names is never named again: the first kept version shows what is still needed.
        first = next(v for v in order if v not in gone)
        for folder in _folders(_states(spark, root, name, gone)) - _folders(_states(spark, root, name, [first])):
            fs.delete(_fs(spark, f"{root}/{name}/data/{folder}")[1], True)
    for v in gone:
        fs.delete(_fs(spark, f"{log}/{v:012d}.json")[1], True)


def _grown(now: dict[str, int], rows: dict[str, int], schema: StructType) -> dict[str, int]:
    """Buckets of the years for so many rows; never fewer than before. Tables without cities have one a year."""
    needed = {y: max(now.get(y, 1), -(-n // PART_ROWS)) for y, n in rows.items()} if "city" in schema.names else {}
    return now | {y: n for y, n in needed.items() if n > 1}


def replace(df: DataFrame, root: str, name: str) -> None:
    """Writes all rows as a new version."""
    spark = df.sparkSession
    before = max(_versions(spark, root, name), default=0)
    rows = {str(r[0]): r[1] for r in df.groupBy(F.year(_date_column(df.schema))).count().collect()}  # a row a year
    buckets = _grown({}, rows, df.schema)
    _commit(spark, root, name, _write(df, root, name, buckets), before, buckets)


def update(touched: DataFrame, root: str, name: str, schema: StructType, change: Callable[[DataFrame], DataFrame]) -> None:
    """Rewrites the parts that hold the (city, date) pairs of touched, with change(their stored rows), and those that are split; others stay
    as they are. touched: rows with the table's city, if it has one, and a date."""
    spark = touched.sparkSession
    now = state(spark, root, name)
    found = _placed(touched, _date_column(touched.schema), now.buckets).groupBy("part_bucket", "part_year").count().collect()  # at most a row a part
    if not found:
        return
    names, rows = {f"part_bucket={r[0]}/part_year={r[1]}" for r in found}, Counter()
    for r in found:
        rows[str(r[1])] += r[2]
    held = Counter()
    for part, about in now.parts.items():
        held[str(now.of(part)[1])] += about["rows"]
    # Of rows stored and rows that come, the greater number is at least half of what there will be.
    buckets = _grown(now.buckets, {y: max(n, held[y]) for y, n in rows.items()}, schema)
    names |= {f"part_bucket={b}/part_year={y}" for y in rows for b in _sources(now.buckets.get(y, 1), buckets.get(y, 1))}
    stored = read_parts(spark, root, name, schema, now, names & now.parts.keys())
    written = _write(change(stored).select(schema.names), root, name, buckets)
    _commit(spark, root, name, {k: v for k, v in now.parts.items() if k not in names} | written, now.version, buckets)


def check_keys(df: DataFrame, keys: list[str]) -> None:
    """Raises where a key is null or comes twice."""
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    if not df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | null).isEmpty():
        raise ValueError(f"null or repeated keys {keys}")


def merge(incoming: DataFrame, root: str, name: str, keep: list[str] | None = None) -> None:
    """Upserts a batch on the table's key and sets created_at of its rows to now; columns in `keep` hold on to what is stored."""
    check_keys(incoming, KEYS[name])
    fresh = incoming.withColumn("created_at", F.current_timestamp())
    update(incoming, root, name, TABLES[name], lambda stored: upsert(stored, fresh, KEYS[name], keep=keep))


def refresh_features(spark: SparkSession, root: str, changed: DataFrame) -> None:
    """Brings the stored features up to date with the stored observations after the days `changed` (city, as_of) came, changed or went: of the
    observations, the parts of the changed cities are read, of the features, the parts that hold a reached row are written."""
    now = state(spark, root, "observations")
    observations = read_parts(spark, root, "observations", TABLES["observations"], now, parts_of_cities(changed, now))
    fresh = changed_features(observations, changed).withColumn("created_at", F.current_timestamp())
    keys = KEYS["features"]
    gone = changed.select(*keys).join(observations.select(*keys), keys, "left_anti")
    touched = fresh.select(*keys).unionByName(gone)
    update(touched, root, "features", TABLES["features"], lambda stored: upsert(stored.join(gone, keys, "left_anti"), fresh, keys))
