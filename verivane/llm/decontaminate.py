"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact verification.

Words are runs of letters and digits in lower case, shingles five of them (an item of fewer is one shingle). A shingle weighs
more the fewer items of the whole benchmark hold it: 1 + ln(items / items with it). These counts are kept in SLOTS slots by
the shingle's hash, so that their table is bounded whatever the benchmark's size; shingles that share a slot count as one there.
A window has as many words as an item, or the whole document if that is shorter; every place in a document is a window's start, but for windows whose shingles known to the
benchmark weigh less than the threshold's share of the lightest item of that size: their similarity to any is below it.

- The 64-bit SimHash of a window is the sign of its shingles' weighted bit sums, by differences of running sums.
- Fingerprints are cut into BLOCKS blocks. Two within RADIUS differ by at most RADIUS // BLOCKS bits in one of them
  (pigeonhole), so a table of each block's values with all items that near finds every item within the radius.
- Survivors are verified: weighted Jaccard similarity of the two multisets of shingles, THRESHOLD or more.

Items are read in blocks, by hash, of about ITEMS items and ITEM_BYTES bytes at most: a query set held against all documents, a
block at a time, so that neither a task nor the driver holds more than one. A pair's similarity and fingerprints don't depend on the blocks.

Null and empty texts and items match nothing. Items are told apart by item_id and text, so that an id may be null or have
several texts; equal items count once. Repeated documents give repeated rows; of an item's windows the best, of equally good ones the
first, is reported. Texts are read whole; windows are compared in pieces of PAIRS pairs at most. An empty table of documents
or items gives no rows. Other columns of either table may have any names; clean() keeps those of docs.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verivane.llm.common import NOT_ALNUM, materialize, mix64, run_hashes, small, small_side, table, text_hashes, word_hashes

WIDTH, THRESHOLD = 5, 0.8
RADIUS, BLOCKS = 22, 8
ITEMS, ITEM_BYTES, PAIRS = 2000, 1 << 23, 1 << 20
SLOTS = 1 << 22
SCALE = 16  #: weights as whole numbers


def words(data: bytes | None) -> np.ndarray:
    return word_hashes((data or b"").lower(), NOT_ALNUM)


def bits(hashes: np.ndarray) -> np.ndarray:
    """(n, 64) of -1 and 1."""
    return np.unpackbits(mix64(hashes).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def near(block: int) -> np.ndarray:
    """Which of 256 block values are within the block's share of the radius."""
    return np.bitwise_count(np.arange(256, dtype=np.uint8) ^ np.uint8(block)) <= RADIUS // BLOCKS


def slots(runs: np.ndarray) -> np.ndarray:
    return (runs & np.uint64(SLOTS - 1)).astype(np.int64)


def weight(items: int, holders: int) -> int:
    return round(SCALE * (1 + math.log(max(1.0, items / holders))))


class Index:
    """The items of a block, grouped by their number of words. weights: of each slot of the whole benchmark."""

    def __init__(self, items: list[tuple[int | None, bytes]], weights: np.ndarray):
        self.table = weights
        hashed = [(k, w) for k, (_, t) in enumerate(items) if len(w := words(t))]
        self.names = [i for i, _ in items]
        self.runs = {k: run_hashes(w, min(WIDTH, len(w))) for k, w in hashed}
        self.known = np.unique(np.concatenate([*self.runs.values(), np.empty(0, np.uint64)]))
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True
        groups: dict[int, list[int]] = defaultdict(list)
        for k, w in hashed:
            groups[len(w)].append(k)
        self.groups = {}
        for size, ids in sorted(groups.items()):
            prints = np.stack([self.fingerprints(self.runs[i], len(self.runs[i]))[0] for i in ids])
            tables = np.zeros((BLOCKS, 256, len(ids)), bool)
            for k in range(len(ids)):
                for b in range(BLOCKS):
                    tables[b, :, k] = near(prints[k, b])
            least = THRESHOLD * min(int(self.lookup(self.runs[i])[1].sum()) for i in ids)
            self.groups[size] = (np.array(ids), prints, tables, least)

    def lookup(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which shingles some item of the block holds; all shingles' weights."""
        known = np.zeros(len(runs), bool)
        maybe = np.flatnonzero(self.filter[(runs & np.uint64(0xFFFF)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.known, runs[maybe]), len(self.known) - 1)
            known[maybe] = self.known[at] == runs[maybe]
        return known, self.table[slots(runs)].astype(np.int64)

    def fingerprints(self, runs: np.ndarray, size: int) -> np.ndarray:
        """(windows, 8 bytes) of the windows of `size` shingles."""
        total = np.zeros((len(runs) + 1, 64), np.int64)
        np.cumsum(bits(runs) * self.lookup(runs)[1][:, None], axis=0, out=total[1:])
        return np.packbits(total[size:] - total[:-size] > 0, axis=1)

    def similarity(self, runs: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's and an item's shingles, as multisets."""
        both, inverse = np.unique(np.concatenate([runs, self.runs[item]]), return_inverse=True)
        a = np.bincount(inverse[: len(runs)], minlength=len(both))
        b = np.bincount(inverse[len(runs) :], minlength=len(both))
        weight = self.lookup(both)[1]
        return float((np.minimum(a, b) * weight).sum() / (np.maximum(a, b) * weight).sum())

    def matches(self, data: bytes | None) -> list[tuple[int | None, int, int, float]]:
        """Item, first word, number of words, similarity of each item found."""
        w = words(data)
        best: dict[int, tuple[float, int, int]] = {}
        for width in sorted({min(WIDTH, size) for size in self.groups}):
            if len(w) < width:
                continue
            runs = run_hashes(w, width)
            known, weight = self.lookup(runs)
            if not known.any():
                continue
            heavy = np.concatenate([[0], np.cumsum(np.where(known, weight, 0))])
            for size, (ids, prints, tables, least) in self.groups.items():
                if min(WIDTH, size) != width:
                    continue
                span = min(size - width + 1, len(runs))  # a shorter document is one window
                starts = np.flatnonzero(heavy[span:] - heavy[:-span] >= least)
                if not len(starts):
                    continue
                most = max(1, PAIRS // len(ids))
                for near_by in (x[i : i + most] for x in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1) for i in range(0, len(x), most)):
                    first = int(near_by[0])
                    part = runs[first : int(near_by[-1]) + span]
                    own = self.fingerprints(part, span)[near_by - first]
                    candidate = np.zeros((len(own), len(ids)), bool)
                    for k in range(BLOCKS):
                        candidate |= tables[k][own[:, k]]
                    x, y = np.nonzero(candidate)
                    close = np.bitwise_count(own[x] ^ prints[y]).sum(1) <= RADIUS
                    for at, k in zip(near_by[x[close]].tolist(), y[close].tolist()):
                        s = self.similarity(runs[at : at + span], int(ids[k]))
                        if s >= THRESHOLD and s > best.get(int(ids[k]), (0.0, 0, 0))[0]:
                            best[int(ids[k])] = (s, at, span + width - 1)
        return [(self.names[k], at, size, s) for k, (s, at, size) in sorted(best.items())]


def usable(items: DataFrame) -> DataFrame:
    """Distinct item_id, text (bytes) of the items with a text."""
    return items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()


def slot_weights(items: DataFrame) -> np.ndarray:
    """The weight of each slot, by counts over the whole benchmark; items as usable() gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [np.unique(slots(run_hashes(w, min(WIDTH, len(w))))) for w in map(words, b.column(0).to_pylist()) if len(w)]
            yield pa.record_batch([pa.array(np.concatenate([*found, np.full(len(found), -1)]).astype(np.int64))], names=["slot"])

    counted = items.select("text").mapInArrow(run, "slot long").groupBy("slot").agg(F.count("*").alias("n")).toArrow()  # at most SLOTS + 1 rows
    slot, n = (counted.column(c).to_numpy() for c in ("slot", "n"))
    total = int(n[slot < 0].sum())  # one row of slot -1 an item
    holders, at = np.unique(n[slot >= 0], return_inverse=True)
    out = np.full(SLOTS, weight(max(1, total), 1), np.int16)
    if len(at):
        out[slot[slot >= 0]] = np.array([weight(total, h) for h in holders.tolist()])[at]
    return out


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, h and g (hash of the text), item_id, start_word, n_words, similarity of each item found in a document."""
    schema = "doc_id long, h long, g long, item_id long, start_word long, n_words long, similarity double"
    names = ["doc_id", "h", "g", "item_id", "start_word", "n_words", "similarity"]
    kinds = [pa.int64()] * 6 + [pa.float64()]
    context = docs.sparkSession.sparkContext
    items = materialize(usable(items), "items")
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if not count:
        return docs.sparkSession.createDataFrame([], schema)
    weights = context.broadcast(slot_weights(items))
    blocks = max(-(-count // ITEMS), -(-size // ITEM_BYTES))
    source = docs.select(F.col("doc_id").cast("long"), *text_hashes(), "text")

    def scan(k: int) -> DataFrame:
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        block = context.broadcast([(r[0], bytes(r[1])) for r in own])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(block.value, weights.value)
            for b in small(batches):
                rows = [(*own, *m) for *own, t in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3).cast(pa.binary()).to_pylist()) for m in index.matches(t)]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names=names)

        found = source.mapInArrow(run, schema)
        if blocks == 1:
            return found
        found = materialize(found, f"contaminated-{k}")
        block.destroy()
        return found

    return reduce(DataFrame.unionByName, [scan(k) for k in range(blocks)])


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold an item."""
    gone = materialize(contaminated(docs, items).select(F.col("doc_id").alias("d"), "h", "g").distinct(), "contaminated")
    h, g = (c == gone[n] for c, n in zip(text_hashes(docs["text"]), "hg"))
    return docs.join(small_side(gone), docs["doc_id"].eqNullSafe(gone["d"]) & h & g, "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h", "g")


QUERIES = {"op7_decontamination": op7_decontamination}
ORACLE_SQL: dict[str, str] = {}  # windows of every size at every place: tests compare with brute force
