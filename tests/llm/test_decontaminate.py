import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from verivane.llm import decontaminate as d


def tokens(t):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, items):
    """Best similarity of any window, over all pairs of windows and items."""
    runs = {}
    for i, t in items:
        w = tokens(t)
        if w:
            k = min(d.WIDTH, len(w))
            runs[i] = (len(w), k, [tuple(w[a : a + k]) for a in range(len(w) - k + 1)])
    slot = lambda s: int(d.slots(d.run_hashes(d.words(" ".join(s).encode()), len(s)))[0])
    holders, count = defaultdict(set), Counter()
    for i, (_, _, r) in runs.items():
        for s in set(r):
            holders[s].add(i)
        count.update({slot(s) for s in r})
    cache = {}
    weight = lambda s: cache.setdefault(s, round(d.SCALE * (1 + math.log(len(runs) / max(1, count[slot(s)])))))
    out = {}
    for doc, t in rows:
        w = tokens(t)
        for i, (size, k, r) in runs.items():
            b, best = Counter(r), 0.0
            for at in range(max(0, len(w) - size) + 1):
                own = [tuple(w[at + x : at + x + k]) for x in range(min(size, len(w)) - k + 1)]
                if not holders.keys() & set(own):
                    continue
                a = Counter(own)
                union = a | b
                best = max(best, sum(n * weight(s) for s, n in (a & b).items()) / sum(n * weight(s) for s, n in union.items()))
            if best >= d.THRESHOLD:
                out[doc, i] = round(best, 9)
    return out


def test_same_as_brute_force(spark, docs):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.choice((3, 5, 12, 12, 30, 60))))) for i in range(25)]
    items += [(25, items[3][1]), (26, items[5][1] + " and more"), (27, None), (28, " ,. ")]
    rows = []
    for n in range(160):
        w = [word() for _ in range(rng.randrange(120))]
        _, t = items[rng.randrange(27)]
        passage = t.split()
        for _ in range(rng.choice((0, 0, 0, 1, 2))):
            passage[rng.randrange(len(passage))] = word()
        at = rng.randrange(len(w) + 1)
        rows.append((n, " ".join([*w[:at], *(passage if n % 2 else []), *w[at:]]).replace(" w1", " W1").replace(" w20 ", " w20,\n")))
    want = brute(rows, items)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in d.contaminated(docs(rows), table).collect()}
    assert got == want and len(want) > 20


def test_documents_shorter_than_the_item(spark, docs):
    """As a document that lost words at its ends, or some inside, and as the same with words before it."""
    item = [f"v{i}" for i in range(40)]
    rows = [(n, " ".join(w)) for n, w in enumerate((item[:-1], item[1:], item[2:-2], ["x", "y", *item[:-1]], item[:20], item[:3], []))]
    items = [(1, " ".join(item)), (2, " ".join(item[:4])), (3, "v1 v2")]
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["n_words"]) for r in d.contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got.keys() == brute(rows, items).keys() and {(n, 1) for n in range(4)} <= got.keys() and (4, 1) not in got
    assert got[0, 1] == (0, 39) and got[2, 1] == (0, 36) and got[3, 1][1] == 40


def test_given_tables(small):
    rows = [tuple(r) for r in small("documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in small("benchmark").select("item_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in d.contaminated(small("documents"), small("benchmark")).collect()}
    inside = {(doc, i) for doc, t in rows for i, x in items if f" {' '.join(tokens(x))} " in f" {' '.join(tokens(t))} "}
    assert inside <= got and len(got) <= len(inside) + 3


def test_blocks_of_items_change_nothing(small, monkeypatch):
    key = lambda r: (r["doc_id"], r["item_id"], r["start_word"], round(r["similarity"], 12))
    pairs = lambda: {key(r) for r in d.contaminated(small("documents"), small("benchmark")).collect()}
    whole = pairs()
    monkeypatch.setattr(d, "ITEMS", 15)
    assert pairs() == whole
    monkeypatch.setattr(d, "ITEMS", 2000)
    monkeypatch.setattr(d, "ITEM_BYTES", 1500)
    monkeypatch.setattr(d, "PAIRS", 3)
    assert pairs() == whole


def test_ids_that_are_null_or_shared_and_clashing_columns(spark):
    one, two, three = (" ".join(f"{p}{i}" for i in range(30)) for p in "abc")
    items = spark.createDataFrame([(1, one, 0), (1, two, 0), (1, two, 0), (None, three, 0)], "item_id long, text string, h long")
    rows = [(i, f"x y {t} z", 7, 8, 9) for i, t in enumerate((one, two, three, "none"))]
    table = spark.createDataFrame(rows, "doc_id long, text string, h long, g long, d long")
    assert sorted((r["doc_id"], r["item_id"] or 0) for r in d.contaminated(table, items).collect()) == [(0, 1), (1, 1), (2, 0)]
    left = d.clean(table, items)
    assert left.columns == table.columns and [tuple(r) for r in left.collect()] == [(3, "x y none z", 7, 8, 9)]



def test_odd_rows(spark, docs, small):
    assert d.contaminated(docs(ODD), small("benchmark")).collect() == []
    none = small("benchmark").where("false")
    assert d.contaminated(docs(ODD), none).collect() == [] and d.clean(docs(ODD), none).count() == len(ODD)
    assert d.contaminated(docs([]), small("benchmark")).collect() == []


def test_clean_drops_leaks_alone(spark, docs, small):
    item = small("benchmark").orderBy("item_id").first()["text"]
    df = docs([(1, f"before {item} after"), (2, "a clean one"), (None, item), (1, "same id, clean")]).withColumn("k", F.lit(1))
    assert sorted((r["doc_id"], r["text"]) for r in d.clean(df, small("benchmark")).collect()) == [(1, "same id, clean"), (2, "a clean one")]


def test_table_holds_all_within_the_radius():
    rng = random.Random(6)
    for _ in range(300):
        a = [rng.randrange(256) for _ in range(d.BLOCKS)]
        b = list(a)
        for bit in rng.sample(range(64), d.RADIUS):
            b[bit // 8] ^= 1 << bit % 8
        assert any(d.near(x)[y] for x, y in zip(a, b))
