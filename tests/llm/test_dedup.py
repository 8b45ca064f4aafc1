import random
import re
from collections import defaultdict

import numpy as np

from tests.llm.conftest import ODD
from verivane.llm import dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width, percent=80):
    """component of each row, by all pairs."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for j in holders[g]:
                common[j] += 1
            holders[g].append(i)
        for j, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i in range(len(rows)):
        if rows[i][0] is not None:
            ids[find(i)].append(rows[i][0])
    return [(rows[i][0], len(sets[i]), (min(ids[find(i)], default=None) if sets[i] else rows[i][0])) for i in range(len(rows))]


def check(docs, rows, width=2):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in dedup.near_duplicates(docs(rows), width).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, width), key=repr)


def edited(rng, words, k):
    words = list(words)
    for i in rng.sample(range(len(words)), k):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_odd_rows(docs):
    check(docs, ODD)


def test_empty_table(docs):
    assert dedup.near_duplicates(docs([])).collect() == []
    assert dedup.deduplicate(docs([])).collect() == []


def test_families_with_borderline_links(docs):
    rng = random.Random(7)
    rows = []
    for f in range(6):
        base = [f"w{f}_{rng.randrange(400)}" for _ in range(60)]
        rows += [(len(rows) + k, edited(rng, base, rng.choice((0, 1, 3, 4, 5, 6)))) for k in range(40)]
    rng.shuffle(rows)
    check(docs, rows)


def test_blocks_of_large_buckets_and_families(docs, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 8)
    monkeypatch.setattr(dedup, "BUCKET", 8)
    rng = random.Random(8)
    rows = []
    for seed in range(3):
        base = [f"w{rng.randrange(400)}" for _ in range(80)]
        rows += [(len(rows) + i, edited(rng, base, rng.choice((0, 2, 5, 7, 8)))) for i in range(70)]
    check(docs, rows)


def test_chain_of_links(docs):
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):  # each links with its neighbours only
        words[i : i + 2] = [f"new{i}", f"other{i}"]
        rows.append((40 - i, " ".join(words)))
    check(docs, rows)


def test_rows_grow_with_the_classes(docs, monkeypatch):
    """Four times as many near copies in one group: at most five times as many rows in blocks and links."""
    counted = {}

    def watch(name):
        inner = getattr(dedup, name)

        def outer(*args, **kw):
            out = inner(*args, **kw)
            counted[name] = counted.get(name, 0) + out.count()
            return out

        monkeypatch.setattr(dedup, name, outer)

    monkeypatch.setattr(dedup, "BLOCK", 256)
    monkeypatch.setattr(dedup, "BUCKET", 512)
    for name in ("in_buckets", "best_leaders", "star_families", "in_blocks", "family_links"):
        watch(name)
    seen = []
    for n in (150, 600):
        counted.clear()
        rng = random.Random(9)
        base = [f"w{i}" for i in range(100)]
        check(docs, [(i, edited(rng, base, rng.choice((0, 1, 2, 3, 4, 5, 8)))) for i in range(n)])
        seen.append(dict(counted))
    for name, few in seen[0].items():
        assert seen[1][name] <= 5 * max(few, 200), (name, seen)


def test_given_table(docs, small):
    rows = [(r["doc_id"], r["text"]) for r in small("documents").collect()]
    check(docs, rows)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    for n, common in ((10, 8), (200, 160), (3000, 2400)):
        errors = []
        for _ in range(60):
            e = rng.integers(0, 2**63, 2 * n - common).astype(np.uint64)
            a, b = dedup.sketch(np.unique(e[:n])), dedup.sketch(np.unique(e[n - common :]))
            errors.append((a == b).mean() - common / (2 * n - common))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_registers_follow_the_definition():
    e = np.random.default_rng(4).integers(0, 2**63, 30).astype(np.uint64)
    m, want = 16, [2**64] * 16
    for x in e.tolist():
        p = list(range(m))
        for j in range(m):
            d = int(dedup.mix64(np.array([(x + (2 * j + 1) * 0xD1342543DE82EF95) % 2**64], np.uint64))[0])
            k = j + ((d & 0xFFFFFFFF) * (m - j) >> 32)
            p[j], p[k] = p[k], p[j]
            want[p[j]] = min(want[p[j]], (j << 32) | d >> 32)
    assert dedup.super_minhash(e, m).tolist() == want


def test_one_of_each_group_stays(docs):
    text = " ".join(f"w{i}" for i in range(50))
    kept = dedup.deduplicate(docs([(2, text), (1, text + " more"), (3, "other"), (3, "other"), (4, None)])).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == [1, 3, 4]


def test_repeated_rows_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(50))
    names = ["doc_id", "text", "h", "g", "c", "k", "v", "p", "d", "n", "kept", "component_id"]
    rows = [(i, t, *range(10)) for i, t in [(4, None), (4, None), (5, ""), (5, ""), (3, text), (3, text), (3, text + " tail"), (9, text), (None, "all alone"), (None, "all alone")]]
    out = dedup.deduplicate(spark.createDataFrame(rows, ", ".join(f"{c} {'string' if c == 'text' else 'long'}" for c in names)))
    assert out.columns == names
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(kept[i][0] or -1 for i in range(len(kept))) == [-1, 3, 4, 4, 5, 5]
    assert all(r["h"] == 0 and r["component_id"] == 9 for r in out.collect())


def test_class_hash_has_128_bits():
    rng = np.random.default_rng(1)
    found = {dedup.set_hash(np.unique(rng.integers(0, 2**63, 5).astype(np.uint64))) for _ in range(2000)}
    assert len({a for a, _ in found}) == len({b for _, b in found}) == 2000
