"""Hard negatives: equality with brute force, and that bounds leave out what can't matter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_vectors import ODD, TABLE
from verivane.llm import hard_negatives

ANCHOR = "vec_id % 4 = 0"


def brute(rows, positives=5, negatives=10):
    """rows: (id, whole numbers, label). Every row stands for itself."""
    out = []
    for i, (a, x, label) in enumerate(rows):
        if a is None or a % 4:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), b, j, other) for j, (b, y, other) in enumerate(rows) if j != i)
        for s, b, _, other in [r for r in scored if r[3] == label][:positives]:
            fits = [(-t, c) for t, c, _, o in scored if o != label and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(a, b, k + 1, c, -s, t) for k, (t, c) in enumerate(fits[:negatives])]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, [v / 256 for v in x], label) for i, x, label in rows], TABLE)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.expr(ANCHOR), **more).collect())


def made(n, d, seed, labels=3, top=40):
    draw = np.random.default_rng(seed)
    return [(i, draw.integers(-top, top, d).tolist(), int(draw.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("n, d, top", [(300, 4, 40), (300, 3, 2), (40, 1, 5)])  # the second and third are full of ties and copies
def test_as_brute_force_in_small_blocks(spark, monkeypatch, n, d, top):
    for name, size in (("BLOCK", 8), ("PART", 32), ("TILE", 64), ("SLICE", 5)):
        monkeypatch.setattr(hard_negatives, name, size)
    rows = made(n, d, 1, top=top)
    assert mined(spark, rows) == brute(rows)


def test_repeated_rows_are_rows(spark):
    rows = made(30, 3, 2) + made(30, 3, 2)[:10]
    assert mined(spark, rows, positives=3, negatives=4) == brute(rows, 3, 4)


def test_given_table(spark, small):
    table = small("embeddings")
    data = table.toPandas()
    rows = [(int(i), np.floor(np.asarray(v, float) * 256).astype(int).tolist(), int(y)) for i, v, y in zip(data.vec_id, data.embedding, data.label)]
    want = [r for r in brute([(i, x, y) if i % 40 == 0 else (i * 4 + 1, x, y) for i, x, y in rows]) if r[0] % 40 == 0]
    back = lambda i: i if i % 40 == 0 else (i - 1) // 4
    got = sorted(tuple(r) for r in hard_negatives.mine(table, F.col("vec_id") % 40 == 0).collect())
    assert [(r[0], r[2], r[4], r[5]) for r in got] == [(r[0], r[2], r[4], r[5]) for r in sorted((a, back(b), k, back(c), s, t) for a, b, k, c, s, t in want)]


def test_bounds_hold_and_are_reached():
    draw = np.random.default_rng(3)
    a, x = draw.integers(-9, 9, (20, 3)), draw.integers(-9, 9, (50, 3))
    low, high = hard_negatives.intervals(a, x.min(0)[None], x.max(0)[None])
    s = a @ x.T
    assert (low[:, 0] <= s.min(1)).all() and (s.max(1) <= high[:, 0]).all()
    corners = np.stack(np.meshgrid(*zip(x.min(0), x.max(0)), indexing="ij"), -1).reshape(-1, 3)
    assert (low[:, 0] == (a @ corners.T).min(1)).all() and (high[:, 0] == (a @ corners.T).max(1)).all()


def test_blocks_far_away_are_not_read(spark, monkeypatch):
    for name, size in (("BLOCK", 16), ("PART", 256), ("TILE", 256)):
        monkeypatch.setattr(hard_negatives, name, size)
    draw = np.random.default_rng(4)
    centres = np.eye(8) * 200
    rows = [(i, (centres[i % 8] + draw.integers(-5, 5, 8)).astype(int).tolist(), i // 8 % 2) for i in range(1600)]
    seen = []
    inner = hard_negatives.needed
    monkeypatch.setattr(hard_negatives, "needed", lambda *a: seen.append(inner(*a).count()) or inner(*a))
    assert mined(spark, rows, positives=2, negatives=3) == brute(rows, 2, 3)
    pairs = (1600 // 16) * -(-1600 // 256)  # of blocks and tiles
    assert seen[0] < pairs / 4  # positives: beyond the anchors' own parts, few blocks can hold a better one


def test_odd_rows_and_clashing_names(spark):
    rows = spark.createDataFrame(ODD + [(0, [0.5, 0.5], 1), (9, [0.6, 0.2], None), (None, [0.6, 0.2], 1), (4, [0.3, 0.3], 2)], TABLE)
    got = sorted(tuple(r) for r in hard_negatives.mine(rows.withColumns({c: F.lit("z") for c in ("id", "x", "v", "rank", "block", "part", "tile", "score", "o", "key", "asks")}), F.expr(ANCHOR)).collect())
    fine = [(1, [128, 64], 1), (2, [-128, 192], 2), (0, [128, 128], 1), (4, [76, 76], 2)]
    assert got == brute(fine)


@pytest.mark.parametrize("rows", [[], [(0, None, 1)], [(0, [0.5], 1)], [(0, [0.5], 1), (1, [0.5], 2)], [(1, [0.5], 1), (2, [0.5], 1)]])
def test_nothing_to_find(spark, rows):
    got = hard_negatives.mine(spark.createDataFrame(rows, TABLE), F.expr(ANCHOR))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and got.collect() == []


def test_query(spark):
    from tests.conftest import SMALL

    got = hard_negatives.op12_hard_negatives(spark, SMALL)
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    assert {r["anchor_id"] % 100 for r in got.collect()} == {0}
