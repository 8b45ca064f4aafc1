"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents become token ids and a closing id 0; those longer than a sequence are cut into full pieces, the first one
may be shorter. Full pieces are sequences of their own. The others are dealt by hash into parts of about PART pieces
(so that a part's lengths are distributed as the corpus's are), and each part is solved by ISLANDS populations:

- crossover injects the best-filled whole sequences of one parent into another, drops those that hold a piece
  twice, exchanges pieces left for longer displaced ones that fill their sequence better, and best-fits the rest, longest first;
- mutation dissolves the emptiest sequence and some others in the same way;
- fitness is the number of sequences, then the mean squared fill; the lower bound (total / capacity) ends the search;
- after each epoch every island's elite migrates to the next island of its part (a shuffle of one row an island).

The first member of each population is plain best-fit; where that meets the bound nothing can be better and nothing is searched.
What ends up in sequences filled below REPACK is pooled over all parts and packed again in the same way, until one part
holds it or a level pools nearly all it was given. A solution is one row of a bounded size; no group grows with the input.

Null texts count as empty and take one token. Texts are encoded whole; equal rows are packed each on their own; pieces of equal
lengths go by their number. An empty table gives no rows. Only doc_id and text are read, other columns may have any names.
The vocabulary's own marks in a text (`<|endoftext|>`) become their ids, as the JSON file says.
"""

from __future__ import annotations

import bisect
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verivane.llm.common import materialize, small, table

CAPACITY = 2048
PART, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4096, 3, 2, 12, 6
REPACK = 0.95
TOKENIZER = "byte_bpe_50k"

#: Characters on whose classes all regular-expression engines agree; texts with others take the slower library.
_OTHER = re.compile("[^\x00-ɏ‐-‧€]")


# ---- tokens ----------------------------------------------------------------------------------------


@lru_cache(2)
def encoder(name: str = TOKENIZER):
    """text -> ids as uint32. The vocabulary's two forms give equal ids; the ranked one is several times faster, but knows no marks."""
    import base64
    import json
    from pathlib import Path

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    described = public_tokenizers.path(f"{name}.json")
    marks = [t["content"] for t in json.loads(Path(described).read_text(encoding="utf-8"))["added_tokens"]]
    slow = lru_cache(1)(lambda: Tokenizer.from_file(described))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(public_tokenizers.path(f"{name}.tiktoken")).read_bytes().splitlines())}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        plain = not _OTHER.search(text) and not any(m in text for m in marks)
        return np.array([*(fast.encode_ordinary(text) if plain else slow().encode(text, add_special_tokens=False).ids), 0], "<u4")

    return ids


def cut(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int]]:
    """Start, end and number of each piece."""
    first = len(ids) % capacity or capacity
    for k, end in enumerate(range(first, len(ids) + 1, capacity)):
        yield max(0, end - capacity) if k else 0, end, k


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer)
        for b in small(batches):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = ids(text or "")
                rows += [(doc, k, start, end - start, zlib.crc32(t[start:end].tobytes())) for start, end, k in cut(t, capacity)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---- one part ---------------------------------------------------------------------------------------


class Bins:
    """Sequences by room left: finds the fullest one that a piece still fits in."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.fill = capacity, [], []
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0  # bit r is set while a sequence has room r

    def add(self, items: list[int], fill: int) -> None:
        self.items.append(items)
        self.fill.append(fill)
        self._list(len(self.items) - 1)

    def _list(self, k: int) -> None:
        room = self.capacity - self.fill[k]
        if room:
            self.by_room.setdefault(room, []).append(k)
            self.rooms |= 1 << room

    def put(self, item: int, length: int) -> None:
        fits = self.rooms >> length
        if not fits:
            self.add([item], length)
            return
        room = length + (fits & -fits).bit_length() - 1
        held = self.by_room[room]
        k = held.pop()
        if not held:
            self.rooms ^= 1 << room
        self.items[k].append(item)
        self.fill[k] += length
        self._list(k)

    def numbers(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int32)
        for k, items in enumerate(self.items):
            out[items] = k
        return out


def best_fit(lengths: list[int], order, capacity: int) -> np.ndarray:
    bins = Bins(capacity)
    for i in order:
        bins.put(i, lengths[i])
    return bins.numbers(len(lengths))


def fills(solution: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(solution, lengths)


def fitness(solution: np.ndarray, lengths: np.ndarray, capacity: int) -> float:
    f = fills(solution, lengths) / capacity
    return float((f * f).mean())


def repaired(parents: list[tuple[np.ndarray, np.ndarray]], lengths: list[int], array: np.ndarray, capacity: int, rng: random.Random) -> np.ndarray:
    """The solution of the pieces that each parent keeps (solution, kept; whole sequences), the others displaced. Where a longer displaced
    piece, by the room at most, can take the place of one in a sequence of the last parent, the best such exchange is made; then the
    rest is best-fitted. Full sequences stay as they are."""
    out = np.full(len(lengths), -1, np.int32)
    number, open_groups = 0, []
    for k, (solution, kept) in enumerate(parents):
        where = np.flatnonzero(kept)
        fill = np.bincount(solution[where], array[where], minlength=1)
        full = fill == capacity
        mine = full[solution[where]]
        out[where[mine]] = number + (np.cumsum(full) - 1)[solution[where[mine]]]
        number += int(full.sum())
        rest = where[~mine]
        rest = rest[np.argsort(solution[rest], kind="stable")]
        ends = np.flatnonzero(np.diff(solution[rest])) + 1
        open_groups += [(k == len(parents) - 1, g.tolist()) for g in np.split(rest, ends)] if len(rest) else []
    taken = np.logical_or.reduce([kept for _, kept in parents])
    waiting = sorted((lengths[i], i) for i in np.flatnonzero(~taken).tolist())
    rng.shuffle(open_groups)
    bins = Bins(capacity)
    for free, group in open_groups:
        fill = sum(lengths[i] for i in group)
        room = capacity - fill
        if free and waiting:
            best = (0, 0, 0)
            for i, item in enumerate(group):
                at = bisect.bisect_right(waiting, (lengths[item] + room, len(lengths))) - 1
                if at >= 0 and waiting[at][0] - lengths[item] > best[0]:
                    best = (waiting[at][0] - lengths[item], i, at)
            if best[0]:
                gain, i, at = best
                new, old = waiting.pop(at)[1], group[i]
                group = [*group[:i], new, *group[i + 1 :]]
                bisect.insort(waiting, (lengths[old], old))
                fill += gain
        bins.add(group, fill)
    for length, i in reversed(waiting):
        bins.put(i, length)
    for k, items in enumerate(bins.items):
        out[items] = number + k
    return out


def crossover(a: np.ndarray, b: np.ndarray, lengths: list[int], capacity: int, rng: random.Random) -> np.ndarray:
    """Well-filled sequences of b go whole into a; a's sequences that share a piece with them are dissolved."""
    array = np.asarray(lengths)
    fb = fills(b, array)
    best = np.argsort(-fb, kind="stable")[: max(1, len(fb) // 2)]
    chosen = np.zeros(len(fb), bool)
    chosen[rng.sample(best.tolist(), max(1, len(best) // 2))] = True
    injected = chosen[b]
    dissolved = np.zeros(int(a.max()) + 1, bool)
    dissolved[a[injected]] = True
    return repaired([(b, injected), (a, ~dissolved[a] & ~injected)], lengths, array, capacity, rng)


def mutation(a: np.ndarray, lengths: list[int], capacity: int, rng: random.Random) -> np.ndarray:
    """The emptiest sequence and a few others are dissolved."""
    array = np.asarray(lengths)
    fill = fills(a, array)
    dissolved = np.zeros(len(fill), bool)
    dissolved[rng.sample(range(len(fill)), max(1, len(fill) // 20))] = True
    dissolved[int(fill.argmin())] = True
    return repaired([(a, ~dissolved[a])], lengths, array, capacity, rng)


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, seed: int, generations: int | None = None) -> list[np.ndarray]:
    """The next population, best first. An empty one is filled up first."""
    rng, plain, n = random.Random(seed), lengths.tolist(), len(lengths)
    bound = -(-int(lengths.sum()) // capacity)
    by_length = np.argsort(-lengths, kind="stable").tolist()
    out = list(population)
    if not out:
        out.append(best_fit(plain, by_length, capacity))
    while len(out) < POPULATION and int(out[0].max()) + 1 > bound:
        jitter = np.random.default_rng(rng.randrange(1 << 30)).random(n) * 0.2 + 0.9
        out.append(best_fit(plain, np.argsort(-lengths * jitter, kind="stable").tolist(), capacity))
    score = lambda s: (int(s.max()) + 1, -fitness(s, lengths, capacity))
    out = sorted(((score(s), k, s) for k, s in enumerate(out)), key=lambda x: x[:2])
    for _ in range(GENERATIONS if generations is None else generations):
        if out[0][0][0] <= bound:
            break
        a, b = rng.sample(range(len(out)), 2) if len(out) > 1 else (0, 0)
        new = [crossover(out[a][2], out[b][2], plain, capacity, rng), crossover(out[b][2], out[a][2], plain, capacity, rng)]
        new += [mutation(new[0], plain, capacity, rng), mutation(out[0][2], plain, capacity, rng)]
        seen: dict = {}
        for k, (grade, s) in enumerate([(x[0], x[2]) for x in out] + [(score(s), s) for s in new]):
            seen.setdefault(grade, (grade, k, s))  # equal fitness: most likely the same sequences
        out = sorted(seen.values(), key=lambda x: x[:2])[:POPULATION]
    return [x[2] for x in out]


# ---- all parts --------------------------------------------------------------------------------------

_STATE = "part long, island int, ids binary, lengths binary, population array<binary>"


def solve(items: DataFrame, n: int, capacity: int, name: str) -> DataFrame:
    """item, part, bin (in its part), at (place in it), fill of each of n items (item long, length long)."""
    parts = max(1, -(-n // PART))
    dealt = items.select(F.pmod(F.xxhash64("item"), F.lit(parts)).alias("part"), "item", "length", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))

    def begin(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "item"], ascending=[False, True])
        lengths = g["length"].to_numpy(np.int32)
        found = evolve(lengths, [], capacity, hash((int(key[0]), int(key[1]), 0)))
        return pd.DataFrame({"part": [key[0]], "island": [key[1]], "ids": [g["item"].to_numpy(np.int64).tobytes()], "lengths": [lengths.tobytes()], "population": [[s.tobytes() for s in found]]})

    def go_on(epoch: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for r in b.itertuples():
                    own = [np.frombuffer(x, np.int32) for x in [*r.population, r.immigrant]]
                    rows.append([x.tobytes() for x in evolve(np.frombuffer(r.lengths, np.int32), own, capacity, hash((int(r.part), int(r.island), epoch)))])
                yield b.drop(columns="immigrant").assign(population=rows)

        return run

    def end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                ids, lengths, s = np.frombuffer(r.ids, np.int64), np.frombuffer(r.lengths, np.int32), np.frombuffer(r.best, np.int32)
                order = np.argsort(s, kind="stable")
                through = np.cumsum(lengths[order].astype(np.int64))
                first = np.r_[True, np.diff(s[order]) != 0]
                base = np.maximum.accumulate(np.where(first, through - lengths[order], 0))
                yield pd.DataFrame({"item": ids[order], "part": r.part, "bin": s[order], "at": through - lengths[order] - base, "fill": fills(s, lengths)[s[order]].astype(np.int64)})

    state = dealt.groupBy("part", "island").applyInPandas(begin, _STATE)
    for epoch in range(1, EPOCHS + 1):
        state = materialize(state, f"pack-{name}-{epoch}")
        migrants = state.select("part", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("population")[0].alias("immigrant"))
        state = state.join(migrants, ["part", "island"]).select("part", "island", "ids", "lengths", "population", "immigrant").mapInPandas(go_on(epoch), _STATE)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            best = [np.frombuffer(p[0], np.int32) for p in b["population"]]
            yield b[["part", "ids", "lengths"]].assign(best=[x.tobytes() for x in best], bins=[int(x.max()) + 1 for x in best], island=b["island"])

    scored = state.mapInPandas(score, "part long, ids binary, lengths binary, best binary, bins int, island int")
    winners = scored.groupBy("part").agg(F.min_by(F.struct("ids", "lengths", "best"), F.struct("bins", "island")).alias("w")).select("part", "w.*")
    return winners.mapInPandas(end, "item long, part long, bin int, at long, fill long")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    # Written once, the numbers stay as they are.
    every = materialize(pieces(docs, capacity, tokenizer).withColumn("item", F.monotonically_increasing_id()), "pieces")
    full = every.where(F.col("length") == capacity).select("*", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = every.where(F.col("length") < capacity)
    placed: list[DataFrame] = []
    left, level = items.count(), 0
    while True:
        solved = materialize(solve(items.select("item", "length"), left, capacity, str(level)), f"packed-{level}")
        good = F.col("fill") >= REPACK * capacity
        poor = 0 if left <= PART else solved.where(~good).count()
        last = poor == 0 or poor > 0.9 * left  # one part, or nothing gained by pooling
        number = F.lit(level * (1 << 50)) + F.col("part") * (1 << 20) + F.col("bin")
        kept = solved if last else solved.where(good)
        placed.append(items.join(kept, "item").select(*every.columns, number.alias("sequence_id"), F.col("at").alias("offset")))
        if last:
            break
        items = materialize(items.join(solved.where(~good).select("item"), "item", "left_semi"), f"repack-{level}")
        left, level = poor, level + 1
    out = full
    for p in placed:
        out = out.unionByName(p)
    return out.drop("item")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}  # a search: tests check the rules, the round trip and the distance from the lower bound
