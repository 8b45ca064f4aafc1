import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from verivane.llm import quality as q


def test_held_out_accuracy(spark):
    """Trained on two thirds of the labels, judged on the others."""
    small = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    labels = small("labels").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)))
    scores = q.score(small("documents"), labels.where("fold <> 0"))
    rows = scores.join(labels.where("fold = 0"), "doc_id").select("keep", "quality", "metadata_score").collect()
    assert len(rows) > 20 and sum(r["keep"] == (r["quality"] == 1) for r in rows) / len(rows) > 0.9


def test_odd_rows_and_missing_columns(docs, small):
    labels = small("labels")
    assert q.score(docs(ODD), labels.where("false")).select("score", "keep").distinct().collect() == [(0.5, True)]
    assert q.score(docs([]), labels).collect() == []
    one_class = labels.where("quality = 1")
    assert all(r["keep"] for r in q.score(docs(ODD), one_class).collect())
    plain = docs(ODD).select("text", "doc_id")
    assert q.score(plain, labels).count() == len(ODD)


def test_null_labels_and_metadata(spark, docs):
    rows = [(i, ("good plain words of a text " if i % 2 else "%%% ### $$$ ") * 20) for i in range(80)] + [(None, None)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(61, None, 0), (None, 1, 0), (500, 1, 0)], "doc_id long, quality int, toxic int")
    df = docs(rows).withColumns({"source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long"), "__view_0": F.lit(1)})
    got = {r["doc_id"]: r["keep"] for r in q.score(df, labels).collect()}
    assert all(got[i] == bool(i % 2) for i in range(80))
    kept = q.keep_good(df, labels)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.where("doc_id is not null").collect()} == set(range(1, 80, 2))


def in_memory(x, y):
    """Confident rows from arrays."""
    taken = set()

    def confident(models, good, bad):
        found, new = [], set()
        for v in (0, 1):
            s = models[v].logit(x[v]) if models[v] else np.zeros(len(x[v]))
            own = []
            for sure, size in ((s, good), (-s, bad)):
                rows = [i for i in np.argsort(-sure, kind="stable").tolist() if sure[i] > q.SURE and i not in taken][:size]
                new.update(rows)
                own.append((x[0][rows], x[1][rows]))
            found.append(own)
        taken.update(new)
        return found

    return confident


def test_views_teach_each_other():
    """Few labels: with pseudo-labels the classifier is better than with the labels alone, over several draws."""
    alone, taught = [], []
    for seed in range(6):
        rng = np.random.default_rng(seed)
        y = rng.integers(0, 2, 4000)
        a = np.c_[y + rng.normal(0, 0.5, 4000), rng.normal(size=(4000, 60))].astype(np.float32)
        m = np.c_[y + rng.normal(0, 0.5, 4000), rng.normal(size=(4000, 60))].astype(np.float32)
        pool = (a[80:], m[80:])
        for out, rounds in ((alone, 0), (taught, 3)):
            model = q.CoTrained(a[:80], m[:80], y[:80], in_memory(pool, y), rounds=rounds, growth=300)
            assert len(model.history) == rounds and all(sum(n[:2]) for n in model.history)
            out.append(((model.scores(*pool)[2] >= 0.5) == y[80:]).mean())
    assert np.mean(taught) > np.mean(alone) + 0.01, (alone, taught)


def test_a_view_without_signal_does_no_harm():
    """With noise for metadata and classes of one to six, co-training is on average as good as the labels alone, and on no draw much worse."""
    alone, taught = [], []
    for seed in range(8):
        rng = np.random.default_rng(seed)
        y = (rng.random(3000) < 6 / 7).astype(int)
        a = np.c_[y + rng.normal(0, 0.25, 3000), rng.normal(size=(3000, 30))].astype(np.float32)
        m = np.eye(20, dtype=np.float32)[rng.integers(0, 20, 3000)]
        for out, rounds in ((alone, 0), (taught, 3)):
            model = q.CoTrained(a[:120], m[:120], y[:120], in_memory((a[120:], m[120:]), y), rounds=rounds, growth=300)
            out.append(((model.scores(a[120:], m[120:])[2] >= 0.5) == y[120:]).mean())
    assert np.mean(taught) > np.mean(alone) - 0.003 and min(np.subtract(taught, alone)) > -0.02, (alone, taught)


@pytest.mark.parametrize("share", [25, 1])
def test_rounds_lose_nothing_on_the_given_tables(spark, monkeypatch, share):
    """About 80 and all 2000 labels of half the labelled documents, judged on the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2 * share))
    docs = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi") if share == 1 else docs
    stored = q.materialize(q.views(docs), "views")
    right = []
    for rounds in (0, 3):
        monkeypatch.setattr(q.CoTrained.__init__, "__defaults__", (rounds, q.GROWTH))
        found = q.scores(stored, q.fit(stored, labels.where(place == 0)), 0.5)
        right.append(found.join(labels.where(place % 2 == 1), "doc_id").agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("int"))).first()[0])
    print("accuracy by labels alone, with rounds:", share, right)
    assert right[1] >= right[0] and right[1] > 0.9


def test_pseudo_labels_come_from_all_rows(spark):
    """The most confident rows of all tasks, once each; those taken before don't come again."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=(3000, q.CONTENT)).astype(np.float16)
    a[:, 0] = rng.permutation(3000) / 1000 - 1.5
    a[1500:] = a[:1500]  # copies
    rows = [(i, i % 1500, 0, a[i].tobytes(), bytes([0, q.SOURCES, q.SOURCES + q.LANGS])) for i in range(3000)]
    pool = spark.createDataFrame(rows, "d long, h long, g long, a binary, m binary").repartition(7)
    y = (a[:1500, 0] > 0).astype(float)
    model = q.Logistic(a[:1500].astype(np.float32), y)
    flat = q.Logistic(np.zeros((4, q.METADATA), np.float32), np.array([0, 1, 0, 1.0]))
    s = model.logit(a[:1500].astype(np.float32))
    taken = np.argsort(-s)[:5]
    tops = q.most_confident(pool, [model, flat], (20, 30), taken).where("view = 0").dropDuplicates(["good", "h"])
    for good, size in ((True, 20), (False, 30)):
        got = [r["h"] for r in tops.where("good" if good else "not good").orderBy("sure", ascending=False).limit(size).collect()]
        sure = s if good else -s
        want = [i for i in np.argsort(-sure, kind="stable").tolist() if i not in taken and sure[i] > q.SURE][:size]
        assert sorted(got) == sorted(want)


def test_keep_good_agrees_with_score_and_keeps_clashing_columns(spark):
    small = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    df = small("documents").withColumns({"h": F.lit(1), "g": F.lit(2), "d": F.lit(3), "a": F.lit(4), "keep": F.lit(5), "score": F.lit(6)})
    kept = q.keep_good(df, small("labels"))
    assert kept.columns == df.columns
    want = sorted(r["doc_id"] for r in q.score(df, small("labels")).where("keep").collect())
    assert sorted(r["doc_id"] for r in kept.collect()) == want and len(want) > 50
    assert {tuple(r) for r in kept.select("h", "g", "d", "a", "keep", "score").distinct().collect()} == {(1, 2, 3, 4, 5, 6)}


def test_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 1))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = 1 / (1 + np.exp(-q.Logistic(x, y).logit(x)))
    for lo in np.arange(0.1, 0.9, 0.2):
        part = (p >= lo) & (p < lo + 0.2)
        assert y[part].mean() == pytest.approx(p[part].mean(), abs=0.07)
