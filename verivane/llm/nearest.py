"""Approximate nearest neighbours by largest inner product, over several shifted Hilbert orderings.

Distinct vectors are classes; a class keeps its smallest top + 1 ids, which no result can go beyond. A further coordinate brings all
candidates to the length of the longest, and queries are stretched to it, so that the nearest point has the largest
inner product. Each of ORDERS orderings projects the points on DIMS random directions, moves the grid by a random part of its spread and
sorts candidates and queries along a Hilbert curve: ranges of keys, sorted in Spark, give every point a rank.

A query's candidates in an ordering are the points within a window of ranks around its own. The window's width is learned: for a
bounded sample of queries (SAMPLE) the nearest are found among all candidates, and the width is that at which TARGET of these lie inside a
window of at least one ordering. Where vectors have structure, windows are narrow; on vectors spread evenly in many dimensions no curve
keeps neighbours together, and they grow with the table.

Blocks of BLOCK ranks of candidates meet the queries of TILE ranks whose windows reach them; a group is bounded by both. The best of each block,
reranked in double precision on the original vectors, are merged over blocks and orderings.

Rows whose vector is null, empty, zero or holds null or non-finite components take no part, nor do rows of another length than the commonest (of
several the longest), and rows without an id. Ties go to the smaller id. A repeated row counts once; rows of the query's id are its own.
An empty table, of queries or of candidates, gives no rows; with fewer candidates than `top` all that are found are returned. Only the id and the vector are read; other columns, of any name, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verivane.llm.common import discard, materialize, table
from verivane.llm.vectors import keyed, matrix, projections, ranked, spread, usable

ORDERS = 4
SAMPLE = 256  #: queries that the windows are learned from
TARGET = 0.95  #: share of their nearest that the windows hold
BLOCK = 8192  #: ranks whose candidates are read together
TILE = 1 << 17  #: ranks whose queries meet a block together
SLICE = 128  #: queries whose products are held at a time
TOP = 20
SPARE = 8  #: candidates beyond `top` that are reranked, so that rounding in the fast product decides nothing


def classes_of(rows: DataFrame, top: int) -> DataFrame:
    """class (the smallest id), ids (the top + 1 smallest, sorted) and v of each distinct vector of rows (id, v); copies are cut before they are shuffled."""
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("_place", place).where(F.col("_place") <= top + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("class"), "ids", "v")


def best(q: np.ndarray, c: np.ndarray, ids: np.ndarray, top: int, allowed: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its place, and ids and scores of its `top` best of c, best first, ties by id."""
    for at in range(0, len(q), SLICE):
        s = q[at : at + SLICE] @ c.T
        if allowed is not None:
            s[~allowed[at : at + SLICE]] = -np.inf
        some = min(top + SPARE, s.shape[1])
        places = np.argpartition(-s, some - 1, axis=1)[:, :some]
        for i in range(len(s)):
            p = places[i][s[i, places[i]] > -np.inf]
            exact = (q[at + i] * c[p]).sum(1)  # in one order of summing, wherever the pair meets
            order = np.lexsort((ids[p], -exact))[:top]
            yield at + i, ids[p[order]], exact[order]


def _rows(keys: np.ndarray, found: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    at, ids, scores = [], [], []
    for i, x, s in found:
        at.append(np.full(len(x), keys[i]))
        ids.append(x)
        scores.append(s)
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in ((at, np.int64), (ids, np.int64), (scores, np.float64))]


FOUND = "qclass long, class long, score double"


def sample_nearest(classes: DataFrame, queries: DataFrame, d: int, top: int, size: int) -> DataFrame:
    """qclass, class of the nearest of at most `size` queries, of all classes but the query's own vector: exact."""
    some = queries.orderBy(F.xxhash64(F.lit(1), "qclass"), "qclass").limit(size).collect()
    q, keys = np.array([r["v"] for r in some], np.float64).reshape(-1, d), np.array([r["qclass"] for r in some], np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, ids = matrix(b["v"], d), b["class"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _rows(keys, best(q, c, ids, top + 1))], ["qclass", "class", "score"])

    own = queries.join(classes.select("v", "class"), "v").select("qclass", "class")
    found = classes.select("class", "v").mapInArrow(scan, FOUND).join(own, ["qclass", "class"], "left_anti")
    place = F.row_number().over(Window.partitionBy("qclass").orderBy(F.desc("score"), "class"))
    return found.withColumn("_place", place).where(F.col("_place") <= top).select("qclass", "class")


def window(points: DataFrame, pairs: DataFrame, target: float) -> int:
    """The least distance in ranks within which `target` of the pairs lie in at least one ordering."""
    at = lambda query, name: points.where(F.col("query") == query).select("o", F.col("class").alias(name), F.col("rank").alias(f"_{name}"))
    apart = pairs.join(at(False, "class"), "class").join(at(True, "qclass"), ["qclass", "o"])
    least = apart.groupBy("qclass", "class").agg(F.min(F.abs(F.col("_class") - F.col("_qclass"))).alias("apart"))
    w = least.agg(F.percentile("apart", target)).first()[0]
    return int(np.ceil(w or 0))


def searched(points: DataFrame, width: int, d: int, top: int) -> DataFrame:
    """FOUND rows: the best of each block for each query whose window reaches it."""
    last = points.agg(F.max("rank")).first()[0] or 0
    reach = lambda low, high, size: F.explode(F.sequence(F.floor(F.greatest(low, F.lit(0)) / size), F.floor(F.least(high, F.lit(last)) / size)))
    rank, block = F.col("rank"), F.floor(F.col("rank") / BLOCK)
    c = points.where("not query").select("o", "rank", "class", "v", block.alias("block"))
    c = c.withColumn("tile", reach(F.col("block") * BLOCK - width, F.col("block") * BLOCK + BLOCK - 1 + width, TILE))
    q = points.where("query").select("o", "rank", "class", "v", F.floor(rank / TILE).alias("tile"), reach(rank - width, rank + width, BLOCK).alias("block"))
    keys = ["o", "block", "tile"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        cr, qr = left["rank"].to_numpy(), right["rank"].to_numpy()
        cv, ids, keys = matrix(left["v"], d), left["class"].to_numpy(), right["class"].to_numpy()
        parts = []
        for at in range(0, len(qr) if len(cr) else 0, SLICE):
            here = slice(at, at + SLICE)
            near = np.abs(qr[here, None] - cr) <= width
            parts.append(_rows(keys[here], best(matrix(right["v"][here], d), cv, ids, top + 1, near)))
        columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate((np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(("qclass", "class", "score"), map(pa.array, columns), strict=True)))

    return c.groupBy(*keys).cogroup(q.toDF(*q.columns).groupBy(*keys)).applyInArrow(meet, FOUND)  # new names: both sides come from one table


def nearest(rows: DataFrame, queries: DataFrame, top: int = TOP, id_column: str = "vec_id", vector: str = "embedding", orders: int = ORDERS, target: float = TARGET, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest rows to each query, which may be one of them."""
    spark = rows.sparkSession
    nonzero = F.exists("v", lambda c: c != 0)
    take = lambda df: usable(df.where(F.col(id_column).isNotNull()), [F.col(id_column).cast("long").alias("id")], vector)
    good, d = take(rows)
    asked, e = take(queries)
    good, asked = good.where(nonzero), asked.where(nonzero)
    classes = materialize(classes_of(good, top), "nearest-classes")
    if not d or d != e or classes.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    distinct = materialize(asked.groupBy("v").agg(F.min("id").alias("qclass")), "nearest-queries")
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    longest = classes.agg(F.max(size)).first()[0]
    wide = lambda v, more: F.concat(F.transform(v, lambda c: c.cast("double")), F.array(more))
    rest = F.sqrt(F.greatest(F.lit(longest) * longest - size * size, F.lit(0.0)))
    stretched = F.transform("v", lambda c: c.cast("double") / size * longest)
    points = classes.select(F.lit(False).alias("query"), "class", F.col("v").alias("own"), wide(F.col("v"), rest).alias("v"))
    points = points.unionByName(distinct.select(F.lit(True).alias("query"), F.col("qclass").alias("class"), F.col("v").alias("own"), wide(stretched, F.lit(0.0)).alias("v")))
    project = projections(d + 1, orders)
    each = classes.count() + distinct.count()
    entries = keyed(points, project, spread(points, project)).drop("v").withColumnRenamed("own", "v")
    placed = ranked(entries, ["query", "class"], each, "nearest-points")
    width = window(placed, sample_nearest(classes, distinct, d, top, sample), target)
    place = F.dense_rank().over(Window.partitionBy("qclass").orderBy(F.desc("score"), "class"))
    found = searched(placed, width, d, top).withColumn("_place", place).where(F.col("_place") <= top + 1).dropDuplicates(["qclass", "class"])
    each_id = found.join(classes.select("class", "ids"), "class").select("qclass", "score", F.explode("ids").alias("id"))
    place = F.row_number().over(Window.partitionBy("qclass").orderBy(F.desc("score"), "id"))
    few = each_id.withColumn("_place", place).where(F.col("_place") <= top + 1)
    lists = few.groupBy("qclass").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("found"))
    named = asked.distinct().join(distinct, "v").select("id", "qclass").join(lists, "qclass")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, top)
    out = named.select(F.col("id").alias("query_id"), F.posexplode(others).alias("_k", "x"))
    out = materialize(out.select("query_id", (F.col("_k") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.less")).alias("score")), "nearest")
    for t in (classes, distinct, placed):
        discard(t)
    return out


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))


QUERIES = {"op13_nearest_neighbours": op13_nearest_neighbours}
ORACLE_SQL: dict[str, str] = {}
