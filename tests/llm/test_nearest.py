"""Nearest neighbours: recall against brute force, exact ties, copies, odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_vectors import ODD, TABLE
from verivane.llm import nearest

QUERY = "vec_id % 20 = 0"


def brute(ids, x, queries, top=20):
    s = x[queries] @ x.T
    out = {}
    for row, q in zip(s, queries):
        order = [j for j in np.lexsort((ids, -row)) if ids[j] != ids[q]][:top]
        out[int(ids[q])] = [(int(ids[j]), row[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def recall(got, want):
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in near}) for q, near in want.items())
    return hits / sum(map(len, want.values()))


def as_table(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], TABLE.replace("float", "double"))


def test_given_table(spark, small):
    rows = small("embeddings")
    data = rows.toPandas()
    ids, x = data.vec_id.to_numpy(), np.stack(data.embedding).astype(float)
    want = brute(ids, x, np.flatnonzero(ids % 20 == 0))
    got = found(nearest.nearest(rows, rows.where(QUERY)))
    assert set(got) == set(want) and recall(got, want) >= 0.9
    place = {v: i for i, v in enumerate(ids)}
    for q, near in got.items():
        assert [r for r, _, _ in near] == list(range(1, 21)) and q not in {v for _, v, _ in near}
        assert near == sorted(near, key=lambda n: (-n[2], n[1]))
        assert all(abs(s - x[place[q]] @ x[place[v]]) < 1e-12 for _, v, s in near)


def test_clusters_need_narrow_windows_and_lengths_count(spark, monkeypatch):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(60, 16))
    x = (centres[np.arange(3000) % 60] + draw.normal(size=(3000, 16)) * 0.02) * draw.uniform(0.98, 1.02, (3000, 1))
    seen = []
    inner = nearest.window
    monkeypatch.setattr(nearest, "window", lambda *a: seen.append(inner(*a)) or seen[-1])
    monkeypatch.setattr(nearest, "BLOCK", 64)
    monkeypatch.setattr(nearest, "TILE", 256)
    df = as_table(spark, x)
    got = found(nearest.nearest(df, df.where(QUERY), top=10))
    assert recall(got, brute(np.arange(3000), x, np.arange(0, 3000, 20), 10)) >= 0.9
    assert seen[0] < 600


def test_copies_give_the_smallest_ids(spark):
    x = np.zeros((400, 4))
    x[:300] = [1, 0, 0, 0]  # three quarters are one vector
    x[300:] = np.random.default_rng(6).normal(size=(100, 4)) * 0.1
    df = as_table(spark, x)
    got = found(nearest.nearest(df, df.where(QUERY), top=5))
    for q in range(0, 300, 20):
        assert [v for _, v, _ in got[q]] == [i for i in range(6) if i != q][:5] and {s for _, _, s in got[q]} == {1.0}


def test_all_candidates_where_there_are_few(spark):
    df = as_table(spark, np.eye(3)[:, :2][:2])
    assert found(nearest.nearest(df, df)) == {0: [(1, 1, 0.0)], 1: [(1, 0, 0.0)]}


def test_queries_from_outside(spark):
    df = as_table(spark, np.eye(4))
    asked = spark.createDataFrame([(100, [0.0, 2.0, 1.0, 0.0], 0)], TABLE)
    assert [(v, s) for _, v, s in found(nearest.nearest(df, asked, top=2))[100]] == [(1, 2.0), (2, 1.0)]


def test_odd_rows_and_clashing_names(spark):
    more = [(20, [0.0, 0.0], 1), (None, [0.6, 0.2], 1), (2, [-0.5, 0.75], 2), (40, [0.25, 0.25], 1)]
    df = spark.createDataFrame(ODD + more, TABLE).withColumns({c: F.lit("z") for c in ("id", "v", "o", "key", "class", "rank", "score", "query", "query_id")})
    got = found(nearest.nearest(df, df.where("vec_id in (20, 40, 2, 3) or vec_id is null")))
    assert {q: [(v, s) for _, v, s in near] for q, near in got.items()} == {40: [(1, 0.1875), (2, 0.0625)], 2: [(40, 0.0625), (1, -0.0625)]}


@pytest.mark.parametrize("rows", [[], [(20, None, 1)], [(20, [0.0], 1)], [(20, [0.5], 1)], [(1, [0.5], 1), (2, [0.5], 1)]])
def test_nothing_to_find(spark, rows):
    df = spark.createDataFrame(rows, TABLE)
    got = nearest.nearest(df, df.where(QUERY))
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.collect() == []
