"""Quality classifier by co-training: what a text holds, and what is known about it.

The first view is the text's content: shares of character kinds, word and line statistics, repetition, and a hashed bag of
words. The second is its metadata: source, language, length in characters. Each has a logistic regression, calibrated by models of
three quarters of the labels on the fourth. In each round both score all unlabelled documents, and the GROWTH ones that each is most sure of (calibrated logit
above SURE), in both classes in the proportion of the labelled ones, are added to the other's training set.

A view teaches only if its held-out loss is below that of the classes' shares by more than LIFT standard errors, so that a view
without signal teaches nothing; what a view has learned from the other it keeps only if its own held-out loss falls as surely by it, else it
stays as it was. In the end the sum of the calibrated logits, itself calibrated, scores every document: P(good). 0.5 and above is kept.

Views are computed once and written (content in 16 bits a feature); rounds and scores read them. The labelled sample is bounded: at
most LABELLED documents, the smallest by a hash of doc_id. Pseudo-labels come from all unlabelled rows: each task keeps its
most confident GROWTH, of which the most confident of all are taken; copies count once, ties go by hash.
Toxicity is not quality: `labels.toxic` is not read.

Every whole text is scored. Null texts count as empty, null metadata as a value of their own, a null n_chars as the text's length.
Columns of the metadata may be missing, others may have any names. Labels without doc_id or quality are not used; of several
labels of a document the best counts, of several rows of a labelled document the smallest by its columns. Repeated rows get
equal scores. Without labels of both classes nothing can be learned: score 0.5, all are kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verivane.llm.common import NOT_ALNUM, materialize, mix64, run_hashes, small, small_side, table, word_hashes, word_spans

LABELLED, ROUNDS, GROWTH = 8000, 3, 400
BAG, SOURCES, LANGS, LENGTHS = 256, 64, 16, 24
OWN_ROWS = 200  #: labelled rows for each unit of the views' penalty
FOLD = 4  #: parts of the labelled documents; each is judged by models of the others, for calibration
LIFT = 1.0  #: standard errors by which a view that teaches is better than the classes' shares, and one that has learned than before


# ---- views -----------------------------------------------------------------------------------------

_KIND = np.full(256, 5)  # other ASCII
for _k, _chars in enumerate(("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", " \t\n\v\f\r", ".,;:!?'\"-()")):
    _KIND[[ord(c) for c in _chars]] = _k
_KIND[128:] = 6
CONTENT = 7 + 13 + BAG


def content_view(text: bytes) -> np.ndarray:
    out = np.zeros(CONTENT, np.float32)
    raw = np.frombuffer(text, np.uint8)
    n = len(raw)
    if not n:
        return out
    out[:7] = np.bincount(_KIND[raw], minlength=7)[:7] / n
    lower = text.lower()
    words = word_hashes(lower)
    if not len(words):
        return out
    starts, ends = word_spans(raw)
    length = ends - starts
    u, counts = np.unique(words, return_counts=True)
    pairs = run_hashes(words, min(3, len(words)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    common = Counter(lines).most_common(1)[0][1] if lines else 0
    edge = raw[ends - 1]
    odd = (_KIND[edge] == 5).mean()
    out[7:20] = (
        np.log1p(len(words)), length.mean() / 10, length.std() / 10, len(u) / len(words), counts.max() / len(words), len(np.unique(pairs)) / len(pairs),
        np.log1p(len(lines)), common / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), odd, (length == 1).mean(), (raw == 124).mean(), (raw[starts] <= 57).mean(),
    )
    bag = np.bincount((word_hashes(lower, NOT_ALNUM) % np.uint64(BAG)).astype(np.int64), minlength=BAG)
    out[20:] = np.log1p(bag) / np.log1p(len(words))
    return out


METADATA = SOURCES + LANGS + LENGTHS


def metadata_view(source: str | None, lang: str | None, n_chars: int | None) -> tuple[int, int, int]:
    """Which of the METADATA features are 1."""
    out = []
    for value, size, at in ((source, SOURCES, 0), (lang, LANGS, SOURCES)):
        key = word_hashes(b"v" + ("\0" if value is None else str(value)).encode("utf-8", "surrogatepass").replace(b" ", b"_"))
        out.append(at + int(key[0] % np.uint64(size)))
    return *out, SOURCES + LANGS + (0 if n_chars is None else min(LENGTHS - 1, 1 + max(0, int(n_chars)).bit_length()))


def unpacked(content: list[bytes], metadata: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both views of rows as stored."""
    a = np.frombuffer(b"".join(content), "<f2").reshape(-1, CONTENT).astype(np.float32)
    m = np.zeros((len(metadata), METADATA), np.float32)
    if len(metadata):
        m[np.arange(len(metadata))[:, None], np.frombuffer(b"".join(metadata), np.uint8).reshape(-1, 3)] = 1
    return a, m


def known_columns(docs: DataFrame) -> list[Column]:
    """text, source, lang, n_chars: all that scores depend on."""
    column = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    length = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    n_chars = F.coalesce(F.col("n_chars").cast("long"), length) if "n_chars" in docs.columns else length
    return [F.col("text"), column("source").alias("source"), column("lang").alias("lang"), n_chars.alias("n_chars")]


def row_hashes(docs: DataFrame) -> list[Column]:
    """128 bits of a hash of known_columns(): h and g."""
    columns = known_columns(docs)
    return [F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit(1), *columns).alias("g")]


def views(docs: DataFrame) -> DataFrame:
    """d (doc_id), h and g (row_hashes), a (content), m (metadata)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = b.column(3).cast(pa.binary()).to_pylist()
            a = [content_view(t or b"").astype("<f2").tobytes() for t in texts]
            m = [bytes(metadata_view(*r)) for r in zip(*(b.column(i).to_pylist() for i in (4, 5, 6)))]
            yield pa.record_batch([*b.columns[:3], pa.array(a, pa.binary()), pa.array(m, pa.binary())], names=["d", "h", "g", "a", "m"])

    return docs.select(F.col("doc_id").cast("long").alias("d"), *row_hashes(docs), *known_columns(docs)).mapInArrow(run, "d long, h long, g long, a binary, m binary")


# ---- learning --------------------------------------------------------------------------------------


class Logistic:
    """Regularised logistic regression on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 12):
        x = x.astype(np.float64)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))].clip(-10, 10)
        self.w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], penalty)
        ridge[-1] = 1e-3
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(z @ self.w).clip(-30, 30)))
            h = z.T @ (z * (p * (1 - p) + 1e-4)[:, None]) + np.diag(ridge)
            step = np.linalg.solve(h, z.T @ (y - p) - ridge * self.w)
            self.w += step
            if np.abs(step).max() < 1e-4:
                break

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (np.c_[(x - self.mean) / self.scale, np.ones(len(x))].clip(-10, 10) @ self.w).clip(-30, 30)


def loss(logit: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row, in nats."""
    return np.logaddexp(0, np.where(y == 1, -logit, logit))


def surely_less(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether losses a of the same rows are less than b by more than LIFT standard errors."""
    gain = b - a
    return bool(gain.mean() > LIFT * gain.std() / np.sqrt(len(gain)))


class View:
    """A view's model of labelled and pseudo-labelled rows, calibrated by models that have not seen the labelled rows which they judge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, more: list[tuple[np.ndarray, np.ndarray]]):
        """more: pseudo-labelled rows and their labels."""
        fold, penalty = np.arange(len(y)) % FOLD, max(1.0, len(y) / OWN_ROWS)
        all_x, all_y = np.concatenate([x, *(a for a, _ in more)]), np.concatenate([y, *(b for _, b in more)])
        unseen = np.empty(len(y))
        for k in np.unique(fold):
            rest = np.r_[fold != k, np.ones(len(all_y) - len(y), bool)]
            unseen[fold == k] = Logistic(all_x[rest], all_y[rest], penalty).logit(x[fold == k])
        self.model = Logistic(all_x, all_y, penalty)
        self.calibrated = Logistic(unseen[:, None], y)
        self.unseen = self.calibrated.logit(unseen[:, None])
        self.loss = loss(self.unseen, y)
        share = y.mean()
        self.teaches = surely_less(self.loss, loss(np.full(len(y), np.log(share / (1 - share))), y))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated.logit(self.model.logit(x)[:, None])


#: Of two views (content, metadata): for each, what it is most sure of among unlabelled rows not taken before, good and bad
#: ones in that order: (content, metadata) of their rows; nothing of a view that is None. Arguments: the views, how many good, how many bad.
Confident = Callable[[list[View | None], int, int], list[list[tuple[np.ndarray, np.ndarray]]]]


class CoTrained:
    def __init__(self, content: np.ndarray, metadata: np.ndarray, quality: np.ndarray, confident: Confident, rounds: int = ROUNDS, growth: int = GROWTH):
        """Labelled rows, quality 1 or 0."""
        labels, x = quality.astype(float), (content, metadata)
        share = labels.mean()
        more: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        self.views = [View(x[v], labels, more[v]) for v in (0, 1)]
        self.history = []  #: how many rows each round has added to each view's training set, and whether the view kept what it learned
        for _ in range(rounds):
            if not any(v.teaches for v in self.views):
                break
            found = confident([v if v.teaches else None for v in self.views], max(1, round(growth * share)), max(1, round(growth * (1 - share))))
            before, added, kept = self.views, [], []
            self.views = list(before)
            for v in (0, 1):  # what the other view is sure of teaches this one
                learned = [(rows[v], np.full(len(rows[0]), label)) for label, rows in zip((1.0, 0.0), found[1 - v])]
                added.append(sum(len(y) for _, y in learned))
                taught = View(x[v], labels, more[v] + learned) if added[v] else before[v]
                kept.append(added[v] > 0 and surely_less(taught.loss, before[v].loss))
                if kept[v]:
                    self.views[v], more[v] = taught, more[v] + learned
            self.history.append((*added, *kept))
            if not any(added):
                break
        self.both = Logistic(np.c_[self.views[0].unseen, self.views[1].unseen], labels)

    def view(self, v: int, x: np.ndarray) -> np.ndarray:
        return self.views[v].logit(x)

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) by content, by metadata, by both."""
        a, b = self.view(0, content), self.view(1, metadata)
        p = lambda z: 1 / (1 + np.exp(-z))
        return p(a), p(b), p(self.both.logit(np.c_[a, b]))


SURE = 1.5  #: calibrated logit from which a view is sure
_TOP = "view int, good boolean, sure double, h long, g long, a binary, m binary"


def most_confident(pool: DataFrame, models: list[View | None], sizes: tuple[int, int], taken: np.ndarray) -> DataFrame:
    """view, good, sure, h, g, a, m: of each task the rows that each view is most sure of, in each class; of equal rows one."""
    sent = pool.sparkSession.sparkContext.broadcast((models, taken))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, taken = sent.value
        best: dict[tuple[int, bool], dict[tuple[int, int], tuple[float, bytes, bytes]]] = {(v, good): {} for v in (0, 1) if models[v] for good in (True, False)}
        for b in small(batches, 4000):
            x = unpacked(b.column(3).to_pylist(), b.column(4).to_pylist())
            fresh = ~np.isin(b.column(1).to_numpy(), taken)
            for (v, good), held in best.items():
                logit = models[v].logit(x[v]) if b.num_rows else np.empty(0)
                sure = logit if good else -logit
                size = sizes[0] if good else sizes[1]
                for i in np.flatnonzero(fresh & (sure > SURE))[np.argsort(-sure[fresh & (sure > SURE)], kind="stable")[: 4 * size]].tolist():
                    held[b.column(1)[i].as_py(), b.column(2)[i].as_py()] = (float(sure[i]), b.column(3)[i].as_py(), b.column(4)[i].as_py())
                if len(held) > 4 * size:
                    best[v, good] = dict(sorted(held.items(), key=lambda r: (-r[1][0], r[0]))[:size])
        rows = [(v, good, s, h, g, a, m) for (v, good), held in best.items() for (h, g), (s, a, m) in sorted(held.items(), key=lambda r: (-r[1][0], r[0]))[: sizes[0] if good else sizes[1]]]
        kinds = [pa.int32(), pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names=["view", "good", "sure", "h", "g", "a", "m"])

    return pool.select("d", "h", "g", "a", "m").mapInArrow(run, _TOP)


def fit(stored: DataFrame, labels: DataFrame) -> CoTrained | None:
    """stored: views(), written."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("d")).agg(F.max("quality").cast("int").alias("quality"))
    known = materialize(known, "known-labels")
    chosen = stored.select("d").distinct().join(known, "d").orderBy(F.xxhash64("d"), "d").limit(LABELLED)
    sample = stored.join(F.broadcast(chosen), "d").groupBy("d").agg(F.min(F.struct("quality", "h", "g", "a", "m")).alias("r")).select("d", "r.*").toArrow()  # at most LABELLED rows
    order = np.argsort(mix64(sample.column("d").to_numpy().view(np.uint64)))
    quality = np.array(sample.column("quality").to_pylist(), int)[order]
    if len(np.unique(quality)) < 2:
        return None
    content, metadata = unpacked(sample.column("a").to_pylist(), sample.column("m").to_pylist())
    pool = stored.join(small_side(known.select("d")), "d", "left_anti")
    taken = np.empty(0, np.int64)

    def confident(models: list[View | None], good: int, bad: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        nonlocal taken
        tops = materialize(most_confident(pool, models, (good, bad), taken), "confident")
        found = []
        for v in (0, 1):
            found.append([])
            for is_good, size in ((True, good), (False, bad)):
                own = tops.where((F.col("view") == v) & (F.col("good") == is_good)).dropDuplicates(["h", "g"]).orderBy(F.desc("sure"), "h", "g").limit(size).toArrow()
                found[-1].append(unpacked(own.column("a").to_pylist(), own.column("m").to_pylist()))
                taken = np.union1d(taken, own.column("h").to_numpy())
        return found

    return CoTrained(content[order], metadata[order], quality, confident)


def scores(stored: DataFrame, model: CoTrained | None, threshold: float) -> DataFrame:
    """doc_id, h, g, text_score, metadata_score, score, keep of each row."""
    sent = stored.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 4000):
            found = (np.full(b.num_rows, 0.5),) * 3
            if sent.value is not None and b.num_rows:
                found = sent.value.scores(*unpacked(b.column(3).to_pylist(), b.column(4).to_pylist()))
            yield pa.record_batch([*b.columns[:3], *map(pa.array, found), pa.array(found[2] >= threshold)], names=["doc_id", "h", "g", "text_score", "metadata_score", "score", "keep"])

    return stored.select("d", "h", "g", "a", "m").mapInArrow(run, "doc_id long, h long, g long, text_score double, metadata_score double, score double, keep boolean")


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, text_score, metadata_score, score, keep of each row."""
    stored = materialize(views(docs), "views")
    return scores(stored, fit(stored, labels), threshold).drop("h", "g")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those that the classifier rejects."""
    stored = materialize(views(docs), "views")
    bad = materialize(scores(stored, fit(stored, labels), threshold).where("not keep").select("h", "g").distinct(), "rejected")
    h, g = row_hashes(docs)
    return docs.join(small_side(bad), (h == bad["h"]) & (g == bad["g"]), "left_anti")


def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_quality_cotraining": op1_quality_cotraining}
ORACLE_SQL: dict[str, str] = {}  # trained classifiers: tests measure held-out accuracy
