"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find by rounds.

1. Each text becomes a set of hashed word shingles. Texts with equal sets form one class; classes are the nodes.
2. SuperMinHash: every element draws, step by step, a rank for one more register of its own random permutation; step j draws
   from [j, j + 1), so that once all registers are below j + 1 no element can change them and all stop. The
   steps are taken for all elements at once.
3. BANDS bands of ROWS registers each: classes that agree in a band share a bucket. A pair at the threshold 0.8 misses
   all 32 bands of 4 with a probability of 4e-8. A pair of a bucket is likely if the lengths allow it and the
   signatures come near enough (within five standard deviations); pairs that aren't are not looked at.
4. Stars: of each bucket the class whose buckets are largest leads. Each class is compared with its most similar leader, on full
   sets; leaders' groups are split by salt, with the leader's text in each piece, so that a task holds one set at a time.
   Links lead to a class higher in that order, so they form trees, which pointer jumping turns into stars.
5. Rest: only buckets with classes of several stars go on, and only pairs across stars. A bucket's largest star stays in its
   blocks, the other classes visit each block; stars that likely pairs connect form families. In a family, dealt out in
   the same way, the sets across stars are compared exactly, by an index of a block's shingles, until they are connected.
   So rows grow with the classes, plus what lies outside the largest star times the number of blocks; no pair is left out.
6. Links between stars are contracted: each star hooks onto its smallest neighbour, edges are renamed, doubles and loops go.

Null and empty texts and those without words have no shingles, stay and are linked with nothing. Repeated rows are
copies of each other; of rows with equal doc_id and text deduplicate() keeps one, whatever their other columns hold. Rows without
doc_id take part; a component's id is its smallest doc_id, null only if none has one. Texts are read whole, whatever their
length; ties between leaders go to the larger node number. An empty table gives no rows. Only doc_id and text are read, other
columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verivane.llm.common import discard, materialize, mix64, shingles, small, small_side, table, text_hashes, word_hashes

REGISTERS, BANDS = 128, 32
ROWS = REGISTERS // BANDS
PERCENT = 80
BLOCK = 512  #: classes in a block of texts, or that visit one copy of a leader
BLOCK_SHINGLES = 1 << 19  #: and their shingles
BUCKET = 4096  #: classes in a block of signatures


def super_minhash(elements: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Registers as step << 32 | rank; elements: distinct hashes."""
    n = len(elements)
    registers = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    order = None
    every = np.arange(n)
    for j in range(m):
        with np.errstate(over="ignore"):
            drawn = mix64(elements + np.uint64((2 * j + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            first, target = k, k
        else:
            if order is None:  # the permutations so far: one swap each
                order = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (n, m)).copy()
                order[every, first] = 0
                order[:, 0] = first
            target = order[every, k].astype(np.int64)
            order[every, k] = order[:, j]
            order[:, j] = target
        np.minimum.at(registers, target, np.uint64(j << 32) | drawn >> np.uint64(32))
        if registers.max() < np.uint64((j + 1) << 32):
            break
    return registers


def sketch(elements: np.ndarray) -> np.ndarray:
    """The signature with 16 bits a register."""
    return (mix64(super_minhash(elements)) & np.uint64(0xFFFF)).astype("<u2")


def set_hash(elements: np.ndarray) -> tuple[int, int]:
    """128 bits of a set's hash as two signed numbers."""
    with np.errstate(over="ignore"):
        size = np.uint64(len(elements))
        first = mix64(elements).sum() * np.uint64(0x9E3779B97F4A7C15) + np.bitwise_xor.reduce(elements) + size
        second = mix64(elements ^ np.uint64(0xA0761D6478BD642F)).sum() + size
    a, b = mix64(np.array([first, second])).view(np.int64).tolist()
    return a, b


def text_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for data in column.cast(pa.binary()).to_pylist():
        yield shingles(word_hashes((data or b"").lower()), width)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, h and g (hash of the text), n (size of its set), c and k (class: hash of its set, null if empty), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for b in small(batches):
            rows = [(len(s), *set_hash(s), sketch(s).tobytes()) if len(s) else (0, None, None, None) for s in text_sets(b.column(3), width)]
            own = [pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else [()] * 4, kinds)]
            yield pa.record_batch([*b.columns[:3], *own], names=["doc_id", "h", "g", "n", "c", "k", "sig"])

    return docs.select(F.col("doc_id").cast("long"), *text_hashes(), "text").mapInArrow(run, "doc_id long, h long, g long, n long, c long, k long, sig binary")


def in_buckets(classes: DataFrame) -> DataFrame:
    """key, v, m: each class's buckets that hold m > 1 classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), sig.shape[:2])
            for i in range(ROWS):
                key = mix64(key ^ sig[:, :, i] + np.uint64(i << 16))
            v = np.repeat(b.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.record_batch([pa.array(key.reshape(-1).astype(np.int64)), pa.array(v)], names=["key", "v"])

    every = classes.select("v", "sig").mapInArrow(run, "key long, v long")
    return every.join(every.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key")


def least_equal(percent: int) -> int:
    """Equal registers that a pair at the threshold has but for five standard deviations."""
    p = percent / 100
    return int(REGISTERS * p - 5 * (REGISTERS * p * (1 - p)) ** 0.5)


def pair_table(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*found) if found else [()] * 2)], names=["a", "b"])


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


# ---- stars ------------------------------------------------------------------------------------------


def best_leaders(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """v, p: the most similar likely leader of each class that has one."""
    places = shared.join(shared.groupBy("v").agg(F.sum("m").alias("s")), "v")
    leaders = places.groupBy("key").agg(F.max(F.struct("s", "v")).alias("top")).select("key", F.col("top.v").alias("p"))
    pairs = shared.join(leaders, "key").where("v <> p").select("v", "p").distinct()
    own, theirs = classes.select("v", "n", "sig"), classes.select(F.col("v").alias("p"), F.col("n").alias("pn"), F.col("sig").alias("psig"))
    least = least_equal(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u2").reshape(-1, REGISTERS) for i in (2, 3))
            equal = (x == y).sum(1)
            keep = pa.array(equal >= least)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(equal)], names=["v", "p", "equal"]).filter(keep)

    allowed = F.lit(percent) * F.greatest("n", "pn") <= F.lit(100) * F.least("n", "pn")
    both = pairs.join(own, "v").join(theirs, "p").where(allowed).select("v", "p", "sig", "psig")
    return both.mapInArrow(run, "v long, p long, equal long").groupBy("v").agg(F.max(F.struct("equal", "p")).alias("top")).select("v", F.col("top.p").alias("p"))


def texts_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """v, text of each of the nodes (v)."""
    wanted = materialize(classes.join(nodes.select("v").distinct(), "v", "left_semi").select("v", "h", "g"), "wanted")
    texts = docs.select(*text_hashes(), "text").join(small_side(wanted), ["h", "g"])
    return texts.groupBy("v").agg(F.first("text").alias("text"))


def star_links(pointers: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pointers (v, p) that full sets confirm."""
    sizes = pointers.groupBy("p").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("pieces"))
    members = pointers.join(sizes, "p").select("p", F.pmod(F.xxhash64("v"), "pieces").cast("int").alias("piece"), "v", F.lit(1).alias("place"))
    heads = sizes.select("p", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("p").alias("v"), F.lit(0).alias("place"))
    texts = texts_of(pointers.select("v").unionByName(pointers.select(F.col("p").alias("v"))), classes, docs)
    rows = members.unionByName(heads).join(texts, "v").select("p", "piece", "place", "v", "text")
    rows = rows.repartition("p", "piece").sortWithinPartitions("p", "piece", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.empty(0, np.uint64)
        for b in small(batches):
            found = []
            for p, place, v, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), text_sets(b.column(4), width)):
                if place == 0:
                    head = s
                elif linked(common(s, head), len(s), len(head), percent):
                    found.append((v, p))
            yield pair_table(found)

    return rows.mapInArrow(run, "a long, b long").toDF("v", "p")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def roots(pointers: DataFrame) -> DataFrame:
    """v, p of acyclic pointers, led to the end."""
    current = materialize(pointers.select("v", "p"), "pointers")
    while True:
        up = current.select(F.col("v").alias("p"), F.col("p").alias("q"))
        further = materialize(current.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "pointers")
        discard(current)
        if further.where("moved").isEmpty():
            return further.select("v", "p")
        current = further.drop("moved")


# ---- the rest ---------------------------------------------------------------------------------------


class Forest:
    """Union-find over any keys."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def join_all(self, x: int, others: list[int]) -> list[int]:
        """Connects x with the others; the roots that they had."""
        roots = sorted({self.find(y) for y in [x, *others]})
        for y in roots[1:]:
            self.parent[y] = roots[0]
        return roots


def in_blocks(rows: DataFrame, key: str, most: int, weight: str | None = None, heaviest: int = 0) -> DataFrame:
    """rows (key, v, a: its star, ...) of keys with several stars, with block and guest: each row in a block of its own, and where there
    are several blocks, the rows outside the key's largest star as guests in all of them. main: whether in that star."""
    stars = rows.groupBy(key, "a").agg(F.count("*").alias("size"), (F.sum(weight) if weight else F.lit(0)).alias("weight"))
    blocks = F.greatest(F.lit(1), F.ceil(F.sum("size") / most), F.ceil(F.sum("weight") / heaviest) if weight else F.lit(0)).cast("int")
    keys = stars.groupBy(key).agg(F.max(F.struct("size", "a")).alias("top"), blocks.alias("blocks"), F.count("*").alias("stars")).where("stars > 1")
    both = rows.join(keys.select(key, F.col("top.a").alias("largest"), "blocks"), key).withColumn("main", F.col("a") == F.col("largest"))
    home = both.withColumns({"block": F.pmod(F.xxhash64("v"), "blocks").cast("int"), "guest": F.lit(False)})
    visits = both.where("blocks > 1 and not main").withColumns({"block": F.explode(F.expr("sequence(0, blocks - 1)")), "guest": F.lit(True)})
    return home.unionByName(visits).drop("largest", "blocks")


def runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[bool, list[tuple]]]:
    """Rows in order, cut where the first `width` columns change and after 256 rows that follow a group's own ones (whose next
    column, guest, is false): whether a group begins, and its rows."""
    held: list[tuple] = []
    begins = True
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and (row[:width] != held[0][:width] or row[width] != held[0][width] or row[width] and len(held) >= 256):
                yield begins, held
                begins = row[:width] != held[0][:width]
                held = []
            held.append(row)
    if held:
        yield begins, held


def visits(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[bool, list[tuple], list[tuple]]]:
    """Whether they are a group's first, guests, and the rows they visit: those outside the main star themselves if none come."""
    own: list[tuple] = []
    seen = True
    alone = lambda: [r for r in own if not r[width + 1]]
    for begins, rows in runs(batches, width):
        if begins or not rows[0][width]:
            if own and not seen:
                yield True, alone(), own
            own, seen = ([] if rows[0][width] else rows), False
            if not own:
                seen = True
        else:
            if own:
                yield not seen, rows, own
            seen = True
    if own and not seen:
        yield True, alone(), own


def star_families(shared: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b: stars that likely pairs of a bucket connect, each with the smallest."""
    named = shared.select("key", "v").join(labels, "v", "left").select("key", "v", F.coalesce("p", "v").alias("a"))
    rows = in_blocks(named, "key", BUCKET).join(classes.select("v", "n", "sig"), "v").select("key", "block", "guest", "main", "v", "a", "n", "sig")
    rows = rows.repartition("key", "block").sortWithinPartitions("key", "block", "guest")
    least = least_equal(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()
        forest = Forest()

        def done() -> None:
            out.update((forest.find(x), x) for x in list(forest.parent) if forest.find(x) != x)

        for first, guests, own in visits(batches, 2):
            if first:
                done()
                forest = Forest()
            columns = lambda rows: (np.array([r[5] for r in rows]), np.array([r[6] for r in rows]), np.frombuffer(b"".join(r[7] for r in rows), "<u2").reshape(-1, REGISTERS))
            (xa, xn, xs), (ya, yn, ys) = columns(guests), columns(own)
            names, place = np.unique(ya, return_inverse=True)
            root = np.array([forest.find(a) for a in names.tolist()])
            for i in range(len(guests)):
                a = int(xa[i])
                to = np.flatnonzero((percent * np.maximum(xn[i], yn) <= 100 * np.minimum(xn[i], yn)) & (root[place] != forest.find(a)))
                hit = to[(ys[to] == xs[i]).sum(1) >= least] if len(to) else to
                if len(hit):
                    root[np.isin(root, forest.join_all(a, np.unique(root[place[hit]]).tolist()))] = forest.find(a)
            if len(out) > 100_000:
                yield pair_table(list(out))
                out = set()
        done()
        yield pair_table(list(out))

    return rows.mapInArrow(run, "a long, b long").distinct()


def family_links(families: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: links between stars of a family (v: star, p: family), enough to connect all that is linked. labels: v, p (star)."""
    stars = families.select(F.col("v").alias("a"), F.col("p").alias("f")).unionByName(families.select(F.col("p").alias("a"), F.col("p").alias("f"))).distinct()
    nodes = labels.select("v", F.col("p").alias("a")).unionByName(stars.select(F.col("a").alias("v"), "a"))  # a star's root has no pointer
    members = materialize(nodes.join(stars, "a").join(classes.select("v", "n"), "v").select("f", "v", "a", "n"), "members")
    rows = in_blocks(members, "f", BLOCK, "n", BLOCK_SHINGLES).join(texts_of(members, classes, docs), "v").select("f", "block", "guest", "main", "v", "a", "text")
    rows = rows.repartition("f", "block").sortWithinPartitions("f", "block", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        forest, held, index = Forest(), None, None
        of = lambda rows: list(text_sets(pa.array([r[6] for r in rows], pa.string()), width))
        for _, guests, own in visits(small(batches), 2):
            if own is not held:
                forest, held = Forest(), own
                sets = of(own)
                sizes = np.array([len(s) for s in sets])
                elements, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                order = np.argsort(elements, kind="stable")
                elements, owners = elements[order], owners[order]
                names, place = np.unique(np.array([r[5] for r in own]), return_inverse=True)
                root = names.copy()
                index = {id(r): s for r, s in zip(own, sets)}
            for r, s in zip(guests, [index[id(r)] for r in guests] if guests and id(guests[0]) in index else of(guests)):
                a = r[5]
                lo, hi = np.searchsorted(elements, s, "left"), np.searchsorted(elements, s, "right")
                n = hi - lo
                at = np.repeat(hi - np.cumsum(n), n) + np.arange(int(n.sum()))
                shared = np.bincount(owners[at], minlength=len(sizes))
                hit = (100 * shared >= percent * (len(s) + sizes - shared)) & (root[place] != forest.find(a))
                if hit.any():
                    found = np.unique(root[place[hit]]).tolist()
                    out += [(a, b) for b in found]
                    root[np.isin(root, forest.join_all(a, found))] = forest.find(a)
            if len(out) > 10_000:
                yield pair_table(out)
                out = []
        yield pair_table(out)

    return rows.mapInArrow(run, "a long, b long")


def contracted(links: DataFrame) -> DataFrame:
    """v, p: the node that stands for each linked one; links: a, b."""
    edges = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    total = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).where("p < v")
        new = roots(hooks)
        if total is None:
            total = new
        else:
            moved = total.join(new.toDF("p", "q"), "p", "left").select("v", F.coalesce("q", "p").alias("p"))
            total = materialize(moved.unionByName(new), "contracted")
        one, two = new.toDF("a", "x"), new.toDF("b", "y")
        renamed = edges.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
        further = materialize(renamed.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        discard(edges)
        edges = further
    return links.select(F.col("a").alias("v"), F.col("b").alias("p")).where("false") if total is None else total


#: Columns that are joined to a caller's table and dropped again.
_OWN = [f"__near_dedup_{c}" for c in ("id", "h", "g", "own_h", "own_g")]


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, h and g (hash of the text), n_shingles, component_id, kept of each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    every = materialize(sketches(docs, width), "sketches")
    distinct = every.where("c is not null").groupBy("c", "k").agg(F.min("doc_id").alias("d"), F.first(F.struct("h", "g", "n", "sig")).alias("r"))
    # Written once, the numbers of the nodes stay as they are.
    classes = materialize(distinct.select(F.monotonically_increasing_id().alias("v"), "c", "k", "d", "r.*"), "classes")
    shared = materialize(in_buckets(classes), "buckets")
    pointers = materialize(best_leaders(shared, classes, percent), "leaders")
    labels = roots(star_links(pointers, classes, docs, width, percent))
    families = contracted(star_families(shared, labels, classes, percent))
    stars = contracted(family_links(families, labels, classes, docs, width, percent))
    star = F.coalesce("p", "v")
    ids = classes.select("v", "c", "k", "d").join(labels, "v", "left").select("c", "k", "d", star.alias("v"))
    ids = ids.join(stars, "v", "left").select("c", "k", "d", star.alias("l"))
    ids = materialize(ids, "class-ids")
    several = materialize(ids.groupBy("l").agg(F.min("d").alias("component_id"), F.count("*").alias("size")).where("size > 1").drop("size"), "components")
    of_class = ids.join(small_side(several), "l", "left").select("c", "k", F.coalesce("component_id", "d").alias("component_id"))
    out = every.select("doc_id", "h", "g", F.col("n").alias("n_shingles"), "c", "k").join(of_class, ["c", "k"], "left")
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "h", "g", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: its smallest doc_id; of several texts under that the first by hash. Rows without shingles stay."""
    found = materialize(near_duplicates(docs, width, percent), "near-duplicates").where("n_shingles > 0")
    rows = found.groupBy("doc_id", "h", "g", "component_id").agg(F.first("kept").alias("kept"), F.count("*").alias("times"))
    first = found.where("kept").groupBy("doc_id", "component_id").agg(F.min(F.struct("h", "g")).alias("first"), F.count("*").alias("all"))
    first = first.where("all > 1").drop("all")  # several rows under one id
    rows = rows.join(first, rows["doc_id"].eqNullSafe(first["doc_id"]) & rows["component_id"].eqNullSafe(first["component_id"]), "left").select(rows["doc_id"].alias("d"), "h", "g", "kept", "times", "first")
    stays = F.col("kept") & F.coalesce((F.col("h") == F.col("first.h")) & (F.col("g") == F.col("first.g")), F.lit(True))
    odd = materialize(rows.select("d", "h", "g", stays.alias("stays"), (stays & (F.col("times") > 1)).alias("repeated")).where("not stays or repeated"), "gone")
    name = lambda df: df.select("d", "h", "g").toDF(*_OWN[:3])
    own = docs.withColumns(dict(zip(_OWN[3:], text_hashes())))
    match = lambda k: own["doc_id"].eqNullSafe(k[_OWN[0]]) & (own[_OWN[3]] == k[_OWN[1]]) & (own[_OWN[4]] == k[_OWN[2]])
    rest, again = name(odd), name(odd.where("repeated"))
    out = own.join(small_side(rest), match(rest), "left_anti").drop(*_OWN)
    if again.isEmpty():
        return out
    return out.unionByName(own.join(small_side(again), match(again), "left_semi").dropDuplicates(["doc_id", *_OWN[3:]]).drop(*_OWN))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2).drop("h", "g")


QUERIES = {"op3_near_dedup": op3_near_dedup}
ORACLE_SQL: dict[str, str] = {}  # all pairs are too slow on whole tables: tests compare with brute force
