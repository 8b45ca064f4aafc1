import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import ODD
from verivane.llm import brown_lm as b

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def check(df, rows):
    train = Counter(w for i, t in rows if not held_out(i) for w in words(t))
    n, v = sum(train.values()), len(train)
    got = df.collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        w = words(t)
        want.setdefault(i, []).append((held_out(i), len(w), sum(train[x] > 0 for x in w), n, sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)))
    for r in got:
        assert any((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == x[:4] and r["base_score"] == pytest.approx(x[4], rel=1e-9) for x in want[r["doc_id"]])
        assert r["score"] <= 0 and r["perplexity"] >= 1
    return got


def test_odd_rows(docs):
    check(b.score(docs(ODD)), ODD)
    assert b.score(docs([])).collect() == []


def test_only_held_out_rows(docs):
    rows = [(i, "some words") for i in range(40) if held_out(i)]
    check(b.score(docs(rows)), rows)


def test_given_table(docs, small, monkeypatch):
    monkeypatch.setattr(b, "HEAD", 300)  # most words meet their counts in the join
    monkeypatch.setattr(b, "CORE", 100)
    rows = [tuple(r) for r in small("documents").select("doc_id", "text").collect()]
    held = [r for r in check(b.score(small("documents")), rows) if r["held_out"]]
    perplexity = lambda c: 10 ** (-sum(r[c] for r in held) / sum(r["n_tokens"] for r in held))
    assert perplexity("score") < perplexity("base_score")


def direct(rows, model, counts):
    """Scores by the definition: classes as learned, transitions and counts from the texts."""
    place = {int(h): i for i, h in enumerate(model.states.head)}
    of = model.states.of

    def state(word):
        h, t, _ = next(b.tokens([word.encode()]))
        return place.get(int(h[0]), len(place) + int(t[0]))

    states = {w: state(w) for _, t in rows for w in words(t) if w is not None}
    k = model.states.classes
    line = lambda t: [k, *(k if w is None else int(of[states[w]]) for w in words(t))]
    pairs = np.zeros((k + 1, k + 1))
    for i, t in rows:
        if not held_out(i):
            c = line(t)
            np.add.at(pairs, (c[:-1], c[1:]), 1)
    share = (pairs.sum(0) + 0.5) / (pairs.sum(0) + 0.5).sum()
    p = (pairs + b.BETA * share) / (pairs.sum(1, keepdims=True) + b.BETA)
    mass = np.zeros(k + 1)
    for w, n in counts.items():
        if w is not None:
            mass[of[states[w]]] += n + (states[w] >= len(place))
    mass[np.unique(of[len(place) : -1])] += 1
    out = []
    for i, t in rows:
        c, total = line(t), 0.0
        for x, y, w in zip(c, c[1:], words(t)):
            total += math.log10(p[x, y])
            if w is not None:
                total += math.log10((counts[w] + (states[w] >= len(place))) / mass[y])
        out.append((i, total))
    return out


@pytest.mark.parametrize("head", [40, 100_000])
def test_scores_follow_the_definition(docs, small, monkeypatch, head):
    monkeypatch.setattr(b, "HEAD", head)
    monkeypatch.setattr(b, "CORE", 30)
    monkeypatch.setattr(b, "CLASSES", 8)
    rows = [tuple(r) for r in small("documents").select("doc_id", "text").orderBy("doc_id").limit(60).collect()]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(ODD)]
    model, _ = b.learn(docs(rows))
    counts = Counter(w for i, t in rows if not held_out(i) for w in words(t))
    got = {r["doc_id"]: r["score"] for r in b.score(docs(rows)).collect()}
    assert len(got) == len(rows)
    for i, s in direct(rows, model, counts):
        assert got[i] == pytest.approx(s, rel=1e-9)


def test_every_word_is_clustered(small, monkeypatch):
    """More words with classes of their own than the seeds: the held-out texts become likelier."""
    monkeypatch.setattr(b, "CORE", 60)
    monkeypatch.setattr(b, "CLASSES", 16)
    monkeypatch.setattr(b, "SEED_SWEEPS", 4)

    def perplexity():
        held = [r for r in b.score(small("documents")).collect() if r["held_out"]]
        return 10 ** (-sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held))

    whole = perplexity()
    monkeypatch.setattr(b, "HEAD", 60)
    assert whole < perplexity()


def test_rare_words_choose_their_classes(docs, monkeypatch):
    """Words that occur once, with the same last two bytes, have the classes of the words that stand where they do."""
    monkeypatch.setattr(b, "CORE", 52)
    monkeypatch.setattr(b, "CLASSES", 4)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        x, y = (f"{w}{rng.integers(5)}{'abcde'[rng.integers(5)]}" for w in ("noun", "verb"))
        rows.append(f"the {x} to {y} " * 4 + f"the n{i:05}zz to v{i:05}zz")
    rows = [(i, t) for i, t in enumerate(rows)]
    model, _ = b.learn(docs(rows))
    place = {int(h): k for h, k in zip(model.states.head, model.states.of)}
    of = lambda w: place[int(next(b.tokens([w.encode()]))[0][0])]
    train = [i for i, _ in rows if not held_out(i)]
    nouns, verbs = ({of(f"{c}{i:05}zz") for i in train} for c in "nv")
    assert nouns and verbs and not nouns & verbs


def test_the_tables_size_changes_no_result(docs, small, monkeypatch):
    """Words outside the table have the classes and scores that they have in it."""
    monkeypatch.setattr(b, "CORE", 30)
    monkeypatch.setattr(b, "CLASSES", 8)
    rows = [tuple(r) for r in small("documents").select("doc_id", "text").orderBy("doc_id").limit(60).collect()]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(ODD)]
    got = []
    for size in (40, 100_000):
        monkeypatch.setattr(b, "TABLE", size)
        got.append({r["doc_id"]: r for r in check(b.score(docs(rows)), rows)})
    assert got[0].keys() == got[1].keys()
    for i, r in got[0].items():
        assert r["score"] == pytest.approx(got[1][i]["score"], rel=1e-9)


def test_all_neighbours_count(docs, spark, monkeypatch):
    """Contexts of all words, over chunks, pieces and batches, with seeds and others as neighbours."""
    monkeypatch.setattr(b, "CLASSES", 2)
    monkeypatch.setattr(b, "CHUNK", 7)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.5, rng.integers(0, 40)) % 60) for _ in range(50)] + [None, "", "w1"]
    number = lambda w: tuple(int(x[0]) for x in next(b.tokens([w.encode()]))[:2])
    core = np.sort(np.array([number(f"w{i}")[0] for i in (1, 2, 3)], np.uint64))
    seeds = b.Seeds(core, np.array([0, 1, 1, *range(2, b.TAIL + 3)]))
    of = dict(zip(core.tolist(), seeds.of.tolist()))

    def near(w):
        if w is None:
            return seeds.kinds - 1
        h, t = number(w)
        return of.get(h, seeds.classes + t % b.TAIL)

    want, tokens = Counter(), Counter()
    for t in texts:
        line = [None, *words(t)]
        for x, y in zip(line, line[1:]):
            if y is not None:
                tokens[number(y)] += 1
                want[number(y)[0], near(x)] += 1
            if x is not None:
                want[number(x)[0], seeds.kinds + near(y)] += 1
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = b.contexts(docs(texts).select("text"), spark.sparkContext.broadcast(seeds)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    assert {(r["w"] % (1 << 64), r["t"]): r["n"] for r in got} == tokens and len(got) == len(tokens)
    assert {(r["w"] % (1 << 64), int(e) & 255): int(e) >> 8 for r in got for e in np.frombuffer(r["c"], np.int64)} == want


def test_equally_frequent_words_fill_the_table(spark):
    counts = spark.createDataFrame([(i * 7919, 0, 3) for i in range(1000)], "w long, t int, n long")
    assert 800 < counts.where(b.most_frequent(counts, 900)).count() < 1000
    assert counts.where(b.most_frequent(counts, 1000)).count() == 1000
    more = counts.unionByName(spark.createDataFrame([(1, 0, 50), (2, 0, 40)], "w long, t int, n long"))
    assert {1, 2} <= {r["w"] for r in more.where(b.most_frequent(more, 100)).collect()}


def test_gains_are_those_of_the_likelihood():
    """A state's gain in a class, less that in its own, is the change of the likelihood (of states that don't follow themselves)."""
    rng = np.random.default_rng(5)
    n, k = 12, 3
    pairs = rng.poisson(4, (n + 1, n + 1)).astype(float)
    np.fill_diagonal(pairs, 0)
    of = np.r_[np.arange(n) % k, k]
    word = 4
    for c in (0, of[word]):  # nor members of these classes
        pairs[word, of == c] = pairs[of == c, word] = 0

    def table(of):
        out = np.zeros((2 * (k + 1), k))
        for i in range(n + 1):
            for j in range(n + 1):
                if j < n:
                    out[of[i], of[j]] += pairs[i, j]
                if i < n:
                    out[k + 1 + of[j], of[i]] += pairs[i, j]
        return out

    rows = [(of[i], pairs[i, word]) for i in range(n + 1)] + [(k + 1 + of[j], pairs[word, j]) for j in range(n + 1)]
    c, m = (np.array(x) for x in zip(*rows))
    _, gain = b.gains(np.full(len(c), word), c.astype(int), m, np.full(len(c), of[word]), table(of))

    def value(of):
        c = np.zeros((k + 1, k + 1))
        np.add.at(c, (of[:, None], of[None, :]), pairs)
        x = lambda v: (v * np.log(np.maximum(v, 1))).sum()
        return x(c) - x(c.sum(0)[:k]) - x(c.sum(1)[:k])

    for to in range(k):
        if to != of[word] and not pairs[word, of == to].any() and not pairs[of == to, word].any():
            new = of.copy()
            new[word] = to
            assert gain[0, to] - gain[0, of[word]] == pytest.approx(value(new) - value(of), rel=1e-6)
    assert np.isfinite(gain).all()


def test_pieces_and_ends(monkeypatch):
    texts = [b"a b", None, b"", b"c " * 50, b"d"]
    whole = [np.concatenate(x) for x in zip(*b.with_ends(texts))]
    assert whole[3].sum() == 5 and whole[2][whole[3]].tolist() == [0, 1, 2, 3, 4]
    monkeypatch.setattr("verivane.llm.common._SLICE", 16)
    assert all((x == y).all() for x, y in zip(whole, (np.concatenate(x) for x in zip(*b.with_ends(texts)))))


def likelihood(bigrams, of):
    k = of.max() + 1
    c = np.zeros((k, k))
    np.add.at(c, (of[:, None], of[None, :]), bigrams)
    x = lambda v: (v * np.log(np.maximum(v, 1))).sum()
    return x(c) - x(c.sum(0)) - x(c.sum(1))


def test_exchange_finds_classes_and_moves_uphill():
    rng = np.random.default_rng(1)
    core, states = 30, 34
    kind = np.arange(core) % 3
    bigrams = np.zeros((states, states))
    for i in range(core):
        for j in range(core):
            bigrams[i, j] = rng.poisson(20 if (kind[i] + 1) % 3 == kind[j] else 1)
    for e in range(core, states):
        bigrams[e, :core] = bigrams[:core, e] = rng.poisson(3)
    start = b.exchange(bigrams, core, classes=3, sweeps=0)
    end = b.exchange(bigrams, core, classes=3)
    assert likelihood(bigrams, end) >= likelihood(bigrams, start) - 1e-6
    assert len({(k, c) for k, c in zip(kind, end[:core])}) == 3  # the classes that made the data
    assert len(set(end[core:])) == states - core


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    states = b.States(np.sort(rng.integers(0, 2**63, 5).astype(np.uint64)), 3)
    states.of[:-1] = rng.integers(0, 3, len(states.of) - 1)
    counts = np.array([9, 8, 7, 6, 5])
    m = b.Model(states, counts, rng.poisson(2, (4, 4)).astype(float), {0: (10, 4)}, 100, 20, 7)
    assert np.allclose((10**m.transition).sum(1), 1)
    for c in range(3):
        groups = np.flatnonzero(states.of[5:-1] == c)
        outside = bool(len(groups)) + (14 if 0 in groups else 0)  # the unseen; ten tokens of four words, one more each
        assert np.isclose((counts[states.of[:5] == c].sum() + outside) / m.below[c], 1)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b a", 5, 6, 7), (5, "b a", 5, 6, 7)], "doc_id long, text string, w long, n long, row long")
    check(b.score(df), [(1, "a b a"), (5, "b a")])
