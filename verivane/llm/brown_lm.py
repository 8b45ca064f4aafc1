"""Class-based bigram scores after Brown et al., classes by exchange clustering.

Tokens are words `[^\\x20\\x09-\\x0D]+` in A-Z lower case, by a 64-bit hash, and one end a text. Documents whose
crc32(doc_id as text) mod 7 is not 2 are for training; all of them count.

1. Counts of all training tokens: summed in each task, then by word.
2. Seeds: the CORE most frequent words are clustered by exchange on the driver: one at a time, each moves to the class, of
   CLASSES, that raises the likelihood of the class bigrams most, in sweeps until none moves. Their bigrams have a bounded size.
3. Exchange for all words: what stands before and after a word, counted over all its training tokens and gathered by word in
   Spark; each word, however rare, moves to the class with the largest gain in likelihood, all at once, in SWEEPS sweeps. Every
   neighbour counts: a seed as its class among the seeds, the end as itself, any other word as one of TAIL groups by its last two
   bytes, as in step 2. Neighbours keep these numbers: words that moved at once by each other's classes would chase each other.
   The unseen share a class by their last two bytes, in GROUPS groups, that of the words with fewer than RARE tokens in it.
4. The texts as classes: tasks hold the TABLE most frequent words (bounded), all other words meet their class and count in a join,
   with the same result. Transitions are counted over all training texts and smoothed with the class's share.
5. Score: log10 of P(class | class before) * P(word | class), summed; a class that the unseen may have has one count for them.

Null and empty texts have one token, the end. Texts are read whole, in pieces of bounded size. Repeated rows get equal scores.
Without training texts all counts are 0. A null
doc_id trains. An empty table gives no rows. Only doc_id and text are read, other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verivane.llm.common import discard, materialize, mix64, slices, small, span_hashes, table, word_spans

CORE, CLASSES, SEED_SWEEPS, SWEEPS = 1024, 64, 8, 2  #: two sweeps at least; at most 128 - TAIL classes, so that a neighbour's number and side fit a byte
HEAD: int | None = None  #: words with a class of their own choice, the most frequent; None: all. Others go with their group
TABLE = 1 << 19  #: words that tasks hold; changes no result
PRIOR = 2.0  #: tokens that a word's group counts beside its own
RARE = 3  #: tokens below which a word's contexts tell of the unseen of its group
GROUPS, TAIL = 1024, 32  #: of unseen words; of words outside the core, as neighbours
CHUNK = 1 << 20  #: tokens whose contexts a task sums at a time
FEW = 16  #: tokens up to which gains are looked up
BETA = 5.0  #: counts that a class's share is worth in its transitions
END = int(mix64(np.array([0x656E64], np.uint64))[0])  #: the end's hash
HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 7 = 2, false)"
_GAP = np.array([32], np.uint8)


def tokens(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hash, group and number of text of each token, in pieces of bounded size that end with a text where they can."""

    def piece(held: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.concatenate([y for _, x in held for y in (x, _GAP)])
        text_ends = np.cumsum([len(x) + 1 for _, x in held])
        starts, ends = word_spans(raw)
        n = np.array([i for i, _ in held])[np.searchsorted(text_ends, starts, side="right")]
        before = np.where(ends - starts > 1, raw[np.maximum(ends - 2, 0)], 0)
        last = raw[ends - 1].astype(np.uint64) | before.astype(np.uint64) << np.uint64(8)
        return span_hashes(raw, starts, ends), (mix64(last + np.uint64(1)) % np.uint64(GROUPS)).astype(np.int64), n

    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for i, t in enumerate(texts):
        for x in slices(np.frombuffer((t or b"").lower(), np.uint8)):
            held.append((i, x))
            size += len(x)
            if size >= 1 << 20:
                yield piece(held)
                held, size = [], 0
    if held:
        yield piece(held)


def with_ends(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """As tokens(), with each text's end after its last word; and whether a token is an end."""
    after = 0  # texts whose end has been given
    for h, t, n in tokens(texts):
        last = int(n[-1]) if len(n) else after
        # Ends of all texts before the last one of this piece: that one may go on.
        due = np.arange(after, last)
        yield _merge(h, t, n, due)
        after = last
    yield _merge(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.arange(after, len(texts)))


def _merge(h, t, n, due):
    at = np.searchsorted(n, due, side="right")
    ends = np.zeros(len(n), bool)
    return np.insert(h, at, np.uint64(END)), np.insert(t, at, GROUPS), np.insert(n, at, due), np.insert(ends, at, True)


# ---- counts ----------------------------------------------------------------------------------------


def word_counts(training: DataFrame) -> DataFrame:
    """w, t (group; GROUPS for the end), n of all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            w, t, n = (np.concatenate(x) for x in zip(*held))
            u, first, inverse = np.unique(w, return_index=True, return_inverse=True)
            return u, t[first], np.bincount(inverse, n).astype(np.int64)

        def batch() -> pa.RecordBatch:
            w, t, n = summed()
            return pa.record_batch([pa.array(w.view(np.int64)), pa.array(t.astype(np.int32)), pa.array(n)], names=["w", "t", "n"])

        size = 0
        for b in small(batches):
            for h, t, _, _ in with_ends(b.column(0).cast(pa.binary()).to_pylist()):
                held.append((h, t, np.ones(len(h), np.int64)))
                size += len(h)
                if size > 1 << 20:
                    held = [summed()]
                    if len(held[0][0]) > 1 << 19:
                        yield batch()
                        held = []
                    size = 0
        if held:
            yield batch()

    return training.select("text").mapInArrow(run, "w long, t int, n long").groupBy("w").agg(F.first("t").alias("t"), F.sum("n").alias("n"))


def pieces(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """As with_ends(), of the texts of a batch's last column."""
    for piece in with_ends(b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()):
        if len(piece[0]):
            yield piece


def pair_counts(training: DataFrame, states: int, state_of) -> np.ndarray:
    """(states, states): how often one follows the other; state_of: of hash, group, whether an end. The last state is the end's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(states * states, np.int64)
        for b in small(batches):
            before = states - 1  # a text begins after an end
            for h, t, _, end in pieces(b):
                s = state_of(h, t, end)
                total += np.bincount(np.concatenate([[before], s[:-1]]) * states + s, minlength=states * states)
                before = s[-1]
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array((seen // states).astype(np.int32)), pa.array((seen % states).astype(np.int32)), pa.array(total[seen])], names=["i", "j", "n"])

    found = training.select("text").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()  # at most states * states rows
    out = np.zeros((states, states))
    out[found.column("i").to_numpy(), found.column("j").to_numpy()] = found.column("n").to_numpy()
    return out


def place_of(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places in the sorted table, -1 for others."""
    if not len(known):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)


# ---- classes ---------------------------------------------------------------------------------------


def exchange(bigrams: np.ndarray, core: int, classes: int = CLASSES, sweeps: int = SEED_SWEEPS) -> np.ndarray:
    """The class of each state: core words share `classes` of them, every other state has its own."""
    states = len(bigrams)
    classes = max(1, min(classes, core))
    unigrams = bigrams.sum(0)
    of = np.concatenate([np.empty(core, np.int64), classes + np.arange(states - core)])
    of[np.argsort(-unigrams[:core], kind="stable")] = np.arange(core) % classes
    total = classes + states - core
    onto = np.zeros((states, total))
    onto[np.arange(states), of] = 1
    right, left = bigrams @ onto, onto.T @ bigrams  # state -> class, class -> state
    c = onto.T @ right
    x = lambda v: v * np.log(np.maximum(v, 1))
    for _ in range(sweeps if classes > 1 else 0):
        moved = 0
        for w in np.argsort(-unigrams[:core], kind="stable"):
            a = of[w]
            r, l, self_count = right[w].copy(), left[:, w].copy(), bigrams[w, w]
            # The counts without w.
            r[a] -= self_count
            l[a] -= self_count
            c[a, :] -= r
            c[:, a] -= l
            c[a, a] -= self_count
            sizes = c.sum(1)
            n_w = r.sum() + self_count
            rows, columns = c[:classes], c[:, :classes]
            gain = (x(rows + r) - x(rows)).sum(1) + (x(columns + l[:, None]) - x(columns)).sum(0)
            d = np.diagonal(c)[:classes]
            gain += x(d + r[:classes] + l[:classes] + self_count) - x(d + r[:classes]) - x(d + l[:classes]) + x(d)
            gain -= 2 * (x(sizes[:classes] + n_w) - x(sizes[:classes]))
            b = int(gain.argmax())
            b = a if gain[b] <= gain[a] + 1e-9 else b
            c[b, :] += r
            c[:, b] += l
            c[b, b] += self_count
            if a != b:
                of[w] = b
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[a] -= bigrams[w]
                left[b] += bigrams[w]
                moved += 1
        if not moved:
            break
    return of


class States:
    """Classes of words. States: places in the sorted table of words, then groups, then the end."""

    def __init__(self, head: np.ndarray, classes: int):
        self.head, self.classes = head, classes
        self.of = np.full(len(head) + GROUPS + 1, -1, np.int16)  # the class of each state, -1 while it has none
        self.of[-1] = classes

    def of_places(self, at: np.ndarray, t: np.ndarray, end: np.ndarray) -> np.ndarray:
        """at: places in the table, -1 for other words."""
        return np.where(end, len(self.of) - 1, np.where(at >= 0, at, len(self.head) + t))


class Seeds:
    """The core's words, sorted; their classes; the numbers of neighbours: classes, then groups of other words, then the end."""

    def __init__(self, core: np.ndarray, of: np.ndarray):
        """of: as exchange() returns it."""
        self.core, self.of = core, of[: len(core)]
        self.classes = max(1, min(CLASSES, len(core)))
        self.kinds = self.classes + TAIL + 1

    def near(self, h: np.ndarray, t: np.ndarray, end: np.ndarray) -> np.ndarray:
        at = place_of(h, self.core)
        own = self.of[at] if len(self.core) else at
        return np.where(end, self.kinds - 1, np.where(at >= 0, own, self.classes + t % TAIL))


def packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values of so many entries each."""
    offsets = np.concatenate([[0], np.cumsum(lengths * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The entries of binary values, and how many each has."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return raw.copy().view(kind), np.diff(offsets) // np.dtype(kind).itemsize


def contexts(training: DataFrame, seeds) -> DataFrame:
    """w, t, n (tokens), c of all words: c has, for each neighbour before (its number) and after (kinds + its number), that and, times
    256, how often, as 64-bit integers."""
    chunk = CHUNK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = seeds.value.kinds
        start = [np.array([x]) for x in (np.uint64(END), GROUPS, kinds - 1, True)]  # a text begins after an end
        held, size = [start], 0

        def batch() -> pa.RecordBatch:
            h, t, near, end = (np.concatenate(x) for x in zip(*held))
            words, of = np.unique(h, return_inverse=True)
            group = np.empty(len(words), np.int32)
            group[of] = t
            before, after = ~end[1:], ~end[:-1]  # ends have no contexts
            key, n = np.unique(np.concatenate([of[1:][before] * 256 + near[:-1][before], of[:-1][after] * 256 + kinds + near[1:][after]]), return_counts=True)
            seen, lengths = np.unique(key >> 8, return_counts=True)
            return pa.record_batch([pa.array(words[seen].view(np.int64)), pa.array(group[seen]), packed((n << 8 | key & 255).astype(np.uint32), lengths)], names=["w", "t", "c"])

        for b in small(batches):
            for h, t, _, end in pieces(b):
                for at in range(0, len(h), chunk):
                    x, y, z = (v[at : at + chunk] for v in (h, t, end))
                    held.append([x, y, seeds.value.near(x, y, z), z])
                    size += len(x)
                    if size >= chunk:
                        yield batch()
                        held, size = [[v[-1:] for v in held[-1]]], 0
        if size:
            yield batch()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = seeds.value.kinds

        def batch(w, t, c, lengths) -> pa.RecordBatch:
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            word = np.cumsum(np.concatenate([[False], w[1:] != w[:-1]]))
            key, at = np.unique(np.repeat(word, lengths) * 256 + (c & 255).astype(np.int64), return_inverse=True)
            n = np.bincount(at, c >> 8).astype(np.int64)
            tokens = np.bincount(key >> 8, np.where(key & 255 < kinds, n, 0)).astype(np.int64)
            return pa.record_batch([pa.array(w[first]), pa.array(t[first]), pa.array(tokens), packed(n << 8 | key & 255, np.bincount(key >> 8))], names=["w", "t", "n", "c"])

        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), *unpacked(b.column(2), np.uint32)))
            if held[0][0][0] == held[-1][0][-1]:
                continue
            w, t, c, lengths = (np.concatenate(x) for x in zip(*held))
            whole = int(np.searchsorted(w, w[-1]))  # the last word may go on
            entries = int(lengths[:whole].sum())
            yield batch(w[:whole], t[:whole], c[:entries], lengths[:whole])
            held = [(w[whole:], t[whole:], c[entries:], lengths[whole:])]
        if held:
            yield batch(*(np.concatenate(x) for x in zip(*held)))

    counted = training.select("text").mapInArrow(count, "w long, t int, c binary")
    return counted.repartition("w").sortWithinPartitions("w").mapInArrow(merge, "w long, t int, n long, c binary")


def _xlog(v: np.ndarray) -> np.ndarray:
    return v * np.log(np.maximum(v, 1))


def gains(x: np.ndarray, c: np.ndarray, n: np.ndarray, own: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States and (states, classes): what the likelihood of class bigrams gains by each in each class. x, c, n: all contexts of some
    states, by state; own: the class of each row's state or -1, whose counts hold the state's already; table: contexts of classes,
    half of them those before."""
    key, at = np.unique(x.astype(np.int64) * len(table) + c, return_inverse=True)
    first_own = np.zeros(len(key), np.int64)
    first_own[at] = own
    return Gains(table).of(key // len(table), key % len(table), np.bincount(at, n), first_own)


class Gains:
    """gains() of a table, with those of few tokens looked up."""

    def __init__(self, table: np.ndarray, groups: np.ndarray | None = None):
        """groups: contexts of groups, for `prior`: what each gains by PRIOR tokens in each class."""
        self.table, self.half = table, len(table) // 2
        self.sizes = table[: self.half].sum(0), table[self.half :].sum(0)
        few = np.arange(FEW + 1)
        self.steps = _xlog(table + few[:, None, None]) - _xlog(table)
        self.size_steps = [_xlog(x + few[:, None]) - _xlog(x) for x in self.sizes]
        self.prior = np.zeros((GROUPS, table.shape[1]))
        if groups is not None and groups.any():
            t, c = np.nonzero(groups)
            names, gain = self.of(t, c, groups[t, c], np.full(len(t), -1))
            self.prior[names] = PRIOR * gain / groups[names, : self.half].sum(1)[:, None]

    def best(self, gain: np.ndarray) -> np.ndarray:
        """Classes without tokens are left out: any word alone in one gains most, so that all words would move there at once."""
        used = self.sizes[0] + self.sizes[1] > 0
        return np.where(used, gain, -np.inf).argmax(1)

    def of(self, x: np.ndarray, c: np.ndarray, n: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each context of a state once."""
        gain = self.steps[np.minimum(n, FEW).astype(np.int64), c]
        many = np.flatnonzero(n > FEW)
        base = self.table[c[many]]
        gain[many] = _xlog(base + n[many, None]) - _xlog(base)
        mine = np.flatnonzero(own >= 0)
        held = self.table[c[mine], own[mine]]
        gain[mine, own[mine]] = _xlog(held) - _xlog(np.maximum(held - n[mine], 0))
        names, first = np.unique(x, return_index=True)
        out = np.add.reduceat(gain, first, axis=0)
        own = own[first]
        mine = np.flatnonzero(own >= 0)
        for side, sizes, steps in zip((c < self.half, c >= self.half), self.sizes, self.size_steps):
            total = np.add.reduceat(np.where(side, n, 0), first)
            part = steps[np.minimum(total, FEW).astype(np.int64)]
            many = np.flatnonzero(total > FEW)
            part[many] = _xlog(sizes + total[many, None]) - _xlog(sizes)
            held = sizes[own[mine]]
            part[mine, own[mine]] = _xlog(held) - _xlog(np.maximum(held - total[mine], 0))
            out -= part
        return names, out


def moved(b: pa.RecordBatch, seeds: Seeds, sweeps: list[Gains]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's words (w, c, among others), the class of each after so many sweeps; word, context and count of their contexts."""
    w = b.column("w").to_numpy().view(np.uint64)
    entries, lengths = unpacked(b.column("c"), np.int64)
    x, c, n = np.repeat(np.arange(len(w)), lengths), entries & 255, entries >> 8
    at = place_of(w, seeds.core)
    k = np.where(at >= 0, seeds.of[at], -1) if len(seeds.core) else at
    for g in sweeps if len(w) else []:
        k = g.best(g.of(x, c, n, k[x])[1] + g.prior[b.column("t").to_numpy()])
    return k, x, c, n


def summed(words: DataFrame, run, shape: tuple[int, int]) -> np.ndarray:
    """The sums of what run() gives for batches of words: places in a table, and how much there."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape[0] * shape[1])
        for b in small(batches, 2000):
            at, n = run(b)
            total += np.bincount(at, n, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["i", "n"])

    found = words.mapInArrow(each, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # at most shape[0] * shape[1] rows
    out = np.zeros(shape[0] * shape[1])
    out[found.column("i").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(shape)


def class_contexts(words: DataFrame, seeds, sweeps) -> np.ndarray:
    """(2 * kinds, classes): contexts of classes after so many sweeps."""
    kinds, classes = 2 * seeds.value.kinds, seeds.value.classes

    def run(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        k, x, c, n = moved(b, seeds.value, sweeps.value)
        return c * classes + k[x], n

    return summed(words.where("own"), run, (kinds, classes))


def group_contexts(words: DataFrame, kinds: int) -> np.ndarray:
    """(GROUPS, 2 * kinds): contexts of groups, by their rare words and those without a class of their own."""

    def run(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        entries, lengths = unpacked(b.column("c"), np.int64)
        return np.repeat(b.column("t").to_numpy().astype(np.int64), lengths) * 2 * kinds + (entries & 255), entries >> 8

    return summed(words.where(~F.col("own") | (F.col("n") < RARE)), run, (GROUPS, 2 * kinds))


def classed(words: DataFrame, seeds, sweeps, group: np.ndarray) -> DataFrame:
    """w, t, n, k (class), own (whether of its own choice) of all words; group: the groups' classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 2000):
            if b.num_rows:
                k = moved(b, seeds.value, sweeps.value)[0]
                own, t = (b.column(i).to_numpy(zero_copy_only=False) for i in ("own", "t"))
                yield pa.record_batch([b.column("w"), b.column("t"), b.column("n"), pa.array(np.where(own, k, group[t]).astype(np.int32)), b.column("own")], names=["w", "t", "n", "k", "own"])

    return words.mapInArrow(run, "w long, t int, n long, k int, own boolean")


class Model:
    """What tasks need: the table's counts and classes, and logarithms of bounded size."""

    def __init__(self, states: States, counts: np.ndarray, pairs: np.ndarray, groups: dict[int, tuple[int, int]], n: int, v: int, ends: int, rest: np.ndarray | float = 0.0):
        """pairs: bigram counts of classes; groups: count and number of words that go with their group; ends: the end's count; rest:
        counts by class of words of their own class outside the table."""
        self.states, self.counts, self.n, self.v, self.ends = states, counts, n, v, ends
        share = (pairs.sum(0) + 0.5) / (pairs.sum(0) + 0.5).sum()
        self.transition = np.log10((pairs + BETA * share) / (pairs.sum(1, keepdims=True) + BETA))
        # Of P(word | class): all its words' counts, one more for each that goes with a group, and one for the unseen if it has a group.
        head, group = states.of[: len(counts)], states.of[len(counts) : -1]
        outside = np.bincount(group, [float(sum(groups.get(t, (0, 0)))) for t in range(GROUPS)], minlength=states.classes + 1)
        self.below = np.bincount(head, counts, minlength=states.classes + 1) + outside + np.isin(np.arange(states.classes + 1), group) + rest
        self.below[-1] = 1.0


def learn(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the training texts, and lines() of all."""
    context = docs.sparkSession.sparkContext
    training = docs.where(~F.expr(HELD_OUT)).select("text")
    counts = materialize(word_counts(training), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.col("t") == GROUPS).agg(F.sum("n")).first()[0] or 0
    in_head = F.lit(True) if HEAD is None else most_frequent(counts.where(F.col("t") < GROUPS), HEAD)
    in_table = in_head & most_frequent(counts.where(F.col("t") < GROUPS), TABLE)
    core = np.array([r["w"] for r in counts.where(F.col("t") < GROUPS).orderBy(F.desc("n"), "w").limit(CORE).collect()], np.int64)
    core = np.sort(core.view(np.uint64))
    discard(counts)
    size = len(core) + TAIL + 1

    def core_state(h: np.ndarray, t: np.ndarray, end: np.ndarray) -> np.ndarray:
        at = place_of(h, core)
        return np.where(end, size - 1, np.where(at >= 0, at, len(core) + t % TAIL))

    bigrams = pair_counts(training, size, core_state)
    number = exchange(bigrams, len(core), CLASSES, SEED_SWEEPS)
    seeds = Seeds(core, number)
    sent = context.broadcast(seeds)
    words = materialize(contexts(training, sent), "word-contexts").withColumn("own", in_head)
    onto = np.zeros((size, seeds.kinds))
    onto[np.arange(size), number] = 1
    pairs = onto.T @ bigrams @ onto
    groups = group_contexts(words, seeds.kinds)
    sweeps = [Gains(np.concatenate([pairs[:, : seeds.classes], pairs[: seeds.classes].T]), groups)]  # the seeds' contexts
    for _ in range(SWEEPS - 1):
        sweeps.append(Gains(class_contexts(words, sent, context.broadcast(sweeps[:])), groups))
    group = sweeps[-1].best(sweeps[-1].prior)  # without tokens, the first class in use
    learned = materialize(classed(words, sent, context.broadcast(sweeps), group), "word-classes")
    discard(words)

    table = learned.where(in_table).select("w", "n", "k").toArrow()
    w, n_w, k = (table.column(x).to_numpy() for x in ("w", "n", "k"))
    order = np.argsort(w.view(np.uint64))
    states = States(w.view(np.uint64)[order], seeds.classes)
    states.of[: len(w)], states.of[len(w) : -1] = k[order], group
    others = learned.where(~in_table)
    rest = np.zeros(seeds.classes + 1)
    for r in others.where("own").groupBy("k").agg(F.sum("n").alias("n")).collect():
        rest[r["k"]] = r["n"]
    grouped = {r["t"]: (r["n"], r["v"]) for r in others.where("not own").groupBy("t").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    found = lines(docs, context.broadcast((states, n_w[order], n, v, ends)), others)
    return Model(states, n_w[order], line_pairs(found, seeds.classes), grouped, n, v, ends, rest), found


# ---- scores ----------------------------------------------------------------------------------------


def lines(docs: DataFrame, known, others: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, known, base (score), count (log10 of the words' counts, summed), line (a class for each token, a
    byte each) of each row. known: the table; others: classed() words outside it."""
    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, count double, line binary"
    names = ["doc_id", "held_out", "n_tokens", "known", "base", "count", "line"]
    place = pa.struct([("at", pa.int32()), ("w", pa.int64())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """As if other words were unseen; others: where they stand."""
        states, counts, total, v, ends = known.value
        for b in small(batches):
            size = b.num_rows
            n_tokens, found = np.zeros(size, np.int64), np.zeros(size, np.int64)
            base, log_count = np.zeros(size), np.zeros(size)
            line, left = [np.empty(0, np.uint8)], [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64))]
            for h, t, n, end in pieces(b):
                at = place_of(h, states.head)
                count = np.where(end, ends, np.where(at >= 0, counts[at], 0) if len(counts) else 0)
                line.append(states.of[states.of_places(at, t, end)].astype(np.uint8))
                if len(unknown := np.flatnonzero((at < 0) & ~end)):
                    first = np.searchsorted(n, n[unknown])
                    left.append((n[unknown], (unknown - first + n_tokens[n[unknown]]).astype(np.int32), h[unknown].view(np.int64)))
                n_tokens += np.bincount(n, minlength=size)
                found += np.bincount(n, count > 0, minlength=size).astype(np.int64)
                base += np.bincount(n, np.log10(count + 1.0) - np.log10(total + (v + 1.0)), minlength=size)
                log_count += np.bincount(n, np.where(end, 0, np.log10(np.maximum(count, 1))), minlength=size)
            n, at, w = (np.concatenate(x) for x in zip(*left))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(n, minlength=size))]).astype(np.int32)
            others = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(at), pa.array(w)], fields=list(place)))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n_tokens), pa.array(found), pa.array(base), pa.array(log_count), packed(np.concatenate(line), n_tokens), others], names=[*names, "others"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found, base, log_count = (b.column(x).to_numpy().copy() for x in ("known", "base", "count"))
            line, n_tokens = unpacked(b.column("line"), np.uint8)
            lists = b.column("found")
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            at, k, n, m = (x.to_numpy() for x in lists.flatten().flatten())
            n_row = np.repeat(np.arange(b.num_rows), lengths)
            order = np.lexsort((at, n_row))  # repeated rows are summed alike
            line[(np.cumsum(n_tokens) - n_tokens)[n_row] + at] = k
            found += lengths
            base += np.bincount(n_row, np.log10(n + 1.0)[order], minlength=b.num_rows)
            log_count += np.bincount(n_row, np.log10(m)[order], minlength=b.num_rows)
            yield pa.record_batch([*b.columns[:3], pa.array(found), pa.array(base), pa.array(log_count), packed(line, n_tokens)], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), F.expr(HELD_OUT).alias("held_out"), "text")
    # Written once, the row numbers stay as they are.
    parts = materialize(rows.mapInArrow(look_up, f"{schema}, others array<struct<at:int,w:long>>").withColumn("row", F.monotonically_increasing_id()), "lm-parts")
    places = parts.select("row", F.inline("others")).join(others, "w")
    places = places.select("row", F.struct("at", "k", "n", (F.col("n") + F.when(F.col("own"), 0).otherwise(1)).alias("m")).alias("found"))
    joined = parts.drop("others").join(places.groupBy("row").agg(F.collect_list("found").alias("found")), "row", "left")
    out = materialize(joined.select(*names, "found").mapInArrow(fill, schema), "lm-lines")
    discard(parts)
    return out


def line_pairs(found: DataFrame, classes: int) -> np.ndarray:
    """(classes + 1, classes + 1): how often a class follows another in the training texts; the last is the end's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes + 1) ** 2, np.int64)
        for b in small(batches):
            s = unpacked(b.column(0), np.uint8)[0].astype(np.int64)
            total += np.bincount(np.concatenate([[classes], s])[:-1] * (classes + 1) + s, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["i", "n"])

    pairs = found.where("not held_out").select("line").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # at most (classes + 1)^2 rows
    out = np.zeros((classes + 1) ** 2)
    out[pairs.column("i").to_numpy()] = pairs.column("n").to_numpy()
    return out.reshape(classes + 1, classes + 1)


def most_frequent(counts: DataFrame, most: int) -> Column:
    """A condition for about `most` words, the most frequent: whole steps (32 for each doubling of the count) from above, and of the
    step where they end, a share by hash. No task gathers more than it returns."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 32)
    total = 0
    for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("k")).orderBy(F.desc("s")).collect():
        if total + r["k"] > most:
            share = int((most - total) / r["k"] * (1 << 30))
            return (step > r["s"]) | (step == r["s"]) & (F.pmod(F.xxhash64("w"), F.lit(1 << 30)) < share)
        total += r["k"]
    return F.lit(True)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row."""
    model, found = learn(docs)
    classes, cost = model.states.classes, model.transition - np.log10(np.maximum(model.below, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            line, n_tokens = unpacked(b.column(6), np.uint8)
            before = np.concatenate([[classes], line])[:-1].astype(np.int64)  # every row ends with an end
            of_row = np.repeat(np.arange(b.num_rows), n_tokens)
            total = b.column(5).to_numpy() + np.bincount(of_row, cost[before, line], minlength=b.num_rows)
            yield pa.record_batch([*b.columns[:5], pa.array(total)], names=["doc_id", "held_out", "n_tokens", "known", "base", "score"])

    out = found.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, base double, score double")
    out = out.select("doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op5_brown_lm": op5_brown_lm}
ORACLE_SQL: dict[str, str] = {}  # trained classes: tests compare counts, the base score and a direct evaluation
