"""Hard negatives from zone-mapped blocks in Hilbert order.

Rows are sorted along a Hilbert curve through a projection of their vectors (ranges of the key, sorted in Spark) and written as Parquet, in
blocks of BLOCK rows. A zone map keeps each block's least and greatest component in every dimension and its labels. The inner product of
an anchor with any row of a block lies between the sums, over dimensions, of the anchor's component times whichever end of the block's interval
makes the product least or greatest. A block is read for an anchor only where that interval meets what the anchor looks for:

- positives: a block with the anchor's label whose greatest product reaches the score of the last positive found in the anchor's own
  part, where similar rows lie;
- negatives: a block with another label whose interval meets one of the anchor's windows, which its positives' scores span.

Bounds come from the zone maps alone: first the pairs of blocks and tiles of anchors (TILE ranks) in which any anchor needs the block, then, for what
is read, those of each anchor. Files lie in a folder for each part of PART ranks; those without a needed block aren't opened. A task holds a part's rows and a tile's anchors, and
returns at most `negatives` rows for an anchor, positive and part; a ranking by anchor and positive merges the parts.

Vectors are whole numbers, scores exact. Rows with a null id, label or vector, an empty vector or null or non-finite components take no part, nor do rows of
another length than the commonest (of several the longest). Ties go to the smaller id. Repeated rows are rows of their own, also as anchors: each gives its own
result. A window below a negative positive score is empty; an anchor without another row of its label gives none. An empty table gives no rows.
Only the id, the label and the vector are read; other columns, of any name, play no part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verivane.llm.common import discard, materialize, table
from verivane.llm.vectors import dots, keyed, matrix, projections, ranked, spread, usable, whole

BLOCK = 512  #: rows of a zone map
PART = 1 << 14  #: ranks read together
TILE = 1 << 17  #: ranks whose anchors meet a part together
SLICE = 128  #: anchors whose products are held at a time
POSITIVES, NEGATIVES = 5, 10
WINDOW = (30, 90)  #: of a positive's score, in percent

POSITIVE = "anchor long, id long, score long, rank long"
NEGATIVE = "anchor long, slot int, id long, score long, rank long"


def intervals(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (anchors x blocks) of the inner products of anchors with anything between a block's least and greatest components; exact."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return dots(up, low) + dots(down, high), dots(up, high) + dots(down, low)


def zones(blocks: DataFrame, d: int) -> DataFrame:
    """block, low, high (component by component) and labels of each block."""

    def zone(t: pa.Table) -> pa.Table:
        x = matrix(t["x"], d, np.int64)
        labels = np.unique(t["label"].to_numpy())
        one = lambda v: pa.array([v], pa.list_(pa.int64()))
        return pa.table({"block": t["block"][:1].combine_chunks(), "low": one(x.min(0)), "high": one(x.max(0)), "labels": one(labels)})

    return blocks.select("block", "label", "x").groupBy("block").applyInArrow(zone, "block long, low array<long>, high array<long>, labels array<long>")


Need = Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def has(labels: list[np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors x blocks: whether the block has the anchor's label, and whether it has another."""
    same = np.array([[w in s for s in labels] for w in wanted], bool).reshape(len(wanted), len(labels))
    return same, np.array([len(s) for s in labels]) > same


def need_positives(anchors: pa.Table, low: np.ndarray, high: np.ndarray, same: np.ndarray, other: np.ndarray) -> np.ndarray:
    return same & (high >= anchors["floor"].to_numpy()[:, None])


def need_negatives(anchors: pa.Table, low: np.ndarray, high: np.ndarray, same: np.ndarray, other: np.ndarray) -> np.ndarray:
    out = np.zeros(low.shape, bool)
    for i, (a, b) in enumerate(zip(anchors["low"].to_pylist(), anchors["high"].to_pylist(), strict=True)):
        for x, y in zip(a, b, strict=True):
            out[i] |= (high[i] >= x) & (low[i] <= y)
    return out & other


def needed(zone_maps: DataFrame, anchors: DataFrame, d: int, need: Need, skip_home: bool) -> DataFrame:
    """tile, block of the blocks that any anchor of the tile needs, from the zone maps."""
    keys = ["tile", "part"]
    most = F.lit(anchors.agg(F.max("tile")).first()[0] or 0)
    parts = F.lit(zone_maps.agg(F.max("part")).first()[0] or 0)
    z = zone_maps.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), most.cast("long"))))
    a = anchors.withColumn("home", F.col("part")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long"))))

    def choose(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"tile": pa.array([], pa.int64()), "block": pa.array([], pa.int64())})
        lo, hi = intervals(matrix(right["x"], d, np.int64), matrix(left["low"], d, np.int64), matrix(left["high"], d, np.int64))
        wanted = need(right, lo, hi, *has([np.array(x) for x in left["labels"].to_pylist()], right["label"].to_numpy()))
        if skip_home:
            wanted[right["home"].to_numpy() == key[1].as_py()] = False
        blocks = left["block"].to_numpy()[wanted.any(0)]
        return pa.table({"tile": pa.array(np.full(len(blocks), key[0].as_py())), "block": pa.array(blocks)})

    return z.groupBy(*keys).cogroup(a.toDF(*a.columns).groupBy(*keys)).applyInArrow(choose, "tile long, block long")


def scan(rows: DataFrame, anchors: DataFrame, keys: list[str], d: int, need: Need, pick: Callable, kinds: str, skip_home: bool) -> DataFrame:
    """What pick() takes of the rows for each anchor of the same keys; rows: block, rank, id, label, x."""
    names = [k.split()[0] for k in kinds.split(", ")]
    none = pa.table({n: pa.array([], pa.int32() if n == "slot" else pa.int64()) for n in names})

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return none
        order = np.lexsort((left["id"].to_numpy(), left["block"].to_numpy()))
        left = left.take(pa.array(order))
        x, blocks = matrix(left["x"], d, np.int64), left["block"].to_numpy()
        starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
        low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
        label = left["label"].to_numpy()
        labels = [np.unique(s) for s in np.split(label, starts[1:])]
        sizes = np.diff(np.r_[starts, len(x)])
        out: list[list[np.ndarray]] = []
        for at in range(0, len(right), SLICE):
            some = right.slice(at, SLICE)
            a = matrix(some["x"], d, np.int64)
            wanted = need(some, *intervals(a, low, high), *has(labels, some["label"].to_numpy()))
            if skip_home:
                wanted[some["home"].to_numpy() == key[1].as_py()] = False
            read = np.flatnonzero(wanted.any(0))
            if not len(read):
                continue
            places = np.flatnonzero(np.isin(np.repeat(np.arange(len(starts)), sizes), read))
            allowed = np.repeat(wanted[:, read], sizes[read], axis=1)
            out += pick(some, dots(a, x[places]), allowed, left["id"].to_numpy()[places], label[places], left["rank"].to_numpy()[places])
        if not out:
            return none
        return pa.table({n: pa.array(np.concatenate([o[i] for o in out]), none.schema.field(n).type) for i, n in enumerate(names)})

    return rows.groupBy(*keys).cogroup(anchors.toDF(*anchors.columns).groupBy(*keys)).applyInArrow(meet, kinds)


def pick_positives(anchors: pa.Table, s: np.ndarray, allowed: np.ndarray, ids: np.ndarray, label: np.ndarray, rank: np.ndarray, most: int) -> list[list[np.ndarray]]:
    out = []
    for i, (own, mine) in enumerate(zip(anchors["anchor"].to_pylist(), anchors["label"].to_pylist(), strict=True)):
        p = np.flatnonzero(allowed[i] & (label == mine) & (rank != own))
        p = p[np.lexsort((ids[p], -s[i, p]))][:most]
        out.append([np.full(len(p), own), ids[p], s[i, p], rank[p]])
    return out


def pick_negatives(anchors: pa.Table, s: np.ndarray, allowed: np.ndarray, ids: np.ndarray, label: np.ndarray, rank: np.ndarray, most: int) -> list[list[np.ndarray]]:
    out = []
    for i, (own, mine, low, high) in enumerate(zip(*[anchors[c].to_pylist() for c in ("anchor", "label", "low", "high")], strict=True)):
        if not low:
            continue
        p = np.flatnonzero(allowed[i] & (label != mine) & (s[i] >= min(low)) & (s[i] <= max(high)))
        p = p[np.lexsort((ids[p], -s[i, p]))]
        falling = -s[i, p]
        for slot, (a, b) in enumerate(zip(low, high, strict=True)):
            q = p[np.searchsorted(falling, -b, "left") : np.searchsorted(falling, -a, "right")][:most]
            out.append([np.full(len(q), own), np.full(len(q), slot), ids[q], s[i, q], rank[q]])
    return out


def ends(scores: Column, window: tuple[int, int]) -> tuple[Column, Column]:
    """The least and greatest whole score in the window of each positive's score."""
    part = lambda share: lambda s: s.cast("decimal(20,0)") * share / 100
    return F.transform(scores, lambda s: F.ceil(part(window[0])(s)).cast("long")), F.transform(scores, lambda s: F.floor(part(window[1])(s)).cast("long"))


def first(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The `most` best of each key; what can't be among them goes before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "rank"))
    return found.withColumn("_place", place).where(F.col("_place") <= most)


def mine(rows: DataFrame, is_anchor: Column, id_column: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; is_anchor: a condition on the columns of rows."""
    spark = rows.sparkSession
    columns = [F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks")]
    good, d = usable(rows.where(F.col(id_column).isNotNull() & F.col(label).isNotNull()), columns, vector)
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not d:
        return empty
    project = projections(d, 1)
    entries = keyed(good, project, spread(good, project)).withColumn("x", whole()).drop("v")
    placed = ranked(entries, ["id"], 0, "negatives-rows")
    at = lambda size, c="rank": F.floor(F.col(c) / size)
    blocks = materialize(placed.select("rank", "id", "label", "x", "asks", at(BLOCK).alias("block"), at(PART).alias("part")), "negatives-blocks", ["part"])
    discard(placed)
    maps = materialize(zones(blocks, d).withColumn("part", F.floor(F.col("block") * BLOCK / PART)), "negatives-zones")
    used = [blocks, maps]
    nothing = F.array().cast("array<long>")
    asking = blocks.where("asks").select(F.col("rank").alias("anchor"), F.col("id").alias("anchor_id"), "label", "x", "part", at(TILE).alias("tile"))
    asking = asking.withColumns({"floor": F.lit(-(1 << 63)), "low": nothing, "high": nothing})

    def search(anchors: DataFrame, need: Need, pick: Callable, kinds: str, skip_home: bool) -> DataFrame:
        """Both steps: which blocks are needed, then what they hold."""
        wanted = materialize(needed(maps, anchors, d, need, skip_home), "negatives-needed")
        used.append(wanted)
        parts = [r[0] for r in wanted.select(F.floor(F.col("block") * BLOCK / PART).alias("p")).distinct().collect()]
        read = blocks.where(F.col("part").isin(parts)) if parts else blocks.where("false")
        read = read.select("block", "part", "rank", "id", "label", "x").join(wanted, "block")
        by_part = anchors.withColumn("home", F.col("part")).drop("part").join(wanted.select("tile", F.floor(F.col("block") * BLOCK / PART).alias("part")).distinct(), "tile")
        return scan(read, by_part, ["tile", "part"], d, need, pick, kinds, skip_home)

    take = lambda most: lambda *a: pick_positives(*a, most)
    home = scan(blocks, asking.withColumn("home", F.col("part")), ["part"], d, lambda a, lo, hi, same, other: same, take(positives), POSITIVE, False)
    home = materialize(first(home, ["anchor"], positives).drop("_place"), "negatives-home")
    floors = home.groupBy("anchor").agg(F.when(F.count("*") >= positives, F.min("score")).alias("_floor"))
    floor = F.coalesce("_floor", "floor")
    raised = materialize(asking.join(floors, "anchor", "left").withColumn("floor", floor).drop("_floor"), "negatives-anchors")
    used += [home, raised]
    found = first(home.unionByName(search(raised, need_positives, take(positives), POSITIVE, True)), ["anchor"], positives)
    best = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("_place", "score", "id"))).alias("p"))
    scores = F.col("p.score")
    low, high = ends(scores, window)
    chosen = raised.join(best, "anchor").withColumns({"low": low, "high": high, "names": F.col("p.id"), "scores": scores}).drop("p")
    chosen = materialize(chosen, "negatives-windows")
    used.append(chosen)
    pairs = search(chosen, need_negatives, lambda *a: pick_negatives(*a, negatives), NEGATIVE, False)
    result = first(pairs, ["anchor", "slot"], negatives).withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
    named = result.join(chosen.select("anchor", "anchor_id", "names", "scores"), "anchor")
    out = named.select("anchor_id", F.get("names", "slot").alias("positive_id"), F.col("_place").alias("rank"), "negative_id", F.get("scores", "slot").alias("positive_score"), "negative_score")
    out = materialize(out, "negatives")
    for t in used:
        discard(t)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLE_SQL: dict[str, str] = {}
