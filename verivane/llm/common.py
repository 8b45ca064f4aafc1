"""What several operators share: reading tables, shared-folder tables, word hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and all is on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Writes a table to the shared folder, with a folder for each value of the columns `by`, and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by or []).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, so that what Python makes of one stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


#: Rows of a few numbers up to which a side is broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame) -> DataFrame:
    """With a broadcast hint where it is small; df: a written table of keys, so that counting is cheap."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def text_hashes(text: str | Column = "text") -> list[Column]:
    """128 bits of a text's hash: h and g."""
    return [F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g")]


def discard(df: DataFrame) -> None:
    """Deletes a table that materialize() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {re.sub("(/[^/=]*=[^/]*)*/[^/]*$", "", f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# ---- vectorised word hashing -------------------------------------------------------------------

_R = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII characters but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


_SPAN = 1 << 16
_SLICE = 1 << 20  #: bytes hashed at a time


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    """R^i modulo 2^64."""
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.r_[np.uint64(1), np.full(_SPAN - 1, _R, np.uint64)])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that don't part words: ASCII white space, if no others are given."""
    inside = np.zeros(len(raw) + 2, bool)
    np.logical_not(space[raw], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def slices(raw: np.ndarray, space: np.ndarray = _SPACE) -> Iterator[np.ndarray]:
    """Pieces of a bounded size that end between words; a word longer than that stays whole."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + _SLICE)
        while end < len(raw) and not space[raw[end]]:
            ahead = np.flatnonzero(space[raw[end : end + _SLICE]])
            end += int(ahead[0]) if len(ahead) else min(_SLICE, len(raw) - end)
        yield raw[at:end]
        at = end


def word_hashes(data: bytes, space: np.ndarray = _SPACE) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 data, `[^\\x20\\x09-\\x0D]+` if no other separators are given."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= _SLICE:
        return span_hashes(raw, *word_spans(raw, space))
    return np.concatenate([span_hashes(x, *word_spans(x, space)) for x in slices(raw, space)])


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes; spans in order, apart from each other."""
    if not len(starts):
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        n = ends - starts
        first = np.cumsum(n) - n
        place = np.arange(int(first[-1] + n[-1])) - np.repeat(first, n)
        value = (raw[place + np.repeat(starts, n)].astype(np.uint64) + np.uint64(1)) * _powers()[place & (_SPAN - 1)]
        if len(place) > _SPAN and (far := place >> 16).any():  # words longer than the table
            value *= mix64(far.astype(np.uint64)) | np.uint64(1)
        return mix64(np.add.reduceat(value, first) + n.astype(np.uint64))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of runs of `size` words, sorted; with fewer words the whole sequence is one; without words none."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    return np.unique(run_hashes(words, width))


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` words, in order of place."""
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out += words[i : i + n] * np.uint64(pow(_R, i + 1, 1 << 64))
    return mix64(out)
