"""Hilbert keys, ranks and exact products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verivane.llm import vectors

TABLE = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")
#: Null, empty, null entries, not finite, of another length; ids 1 and 2 are fine.
ODD = [(1, [0.5, 0.25], 1), (2, [-0.5, 0.75], 2), (3, None, 1), (4, [], 1), (5, [0.5, None], 1), (6, [NAN, 0.1], 1), (7, [INF, 0.1], 1), (8, [0.1, 0.2, 0.3], 1)]


@pytest.mark.parametrize("m, bits", [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_the_curve_visits_each_cell_once_and_moves_by_one_step(m, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * m, indexing="ij"), -1).reshape(-1, m)
    key = vectors.hilbert(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_usable_rows(spark):
    good, d = vectors.usable(spark.createDataFrame(ODD, TABLE), ["vec_id"], "embedding")
    assert d == 2 and sorted(r["vec_id"] for r in good.collect()) == [1, 2]
    none, d = vectors.usable(spark.createDataFrame([], TABLE), ["vec_id"], "embedding")
    assert d == 0 and none.isEmpty()


def test_products_are_exact():
    a = np.array([[3, -(1 << 40)], [1, 2]])
    b = np.array([[(1 << 20) + 1, 1 << 20], [0, 5]])
    assert vectors.dots(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    with pytest.raises(OverflowError):
        vectors.dots(np.array([[1 << 40]]), np.array([[1 << 40]]))


def test_ranks_follow_key_and_ties_in_every_ordering(spark):
    rows = [(o, k % 7, i) for o in range(3) for i, k in enumerate(range(200))]
    df = spark.createDataFrame(rows, "o int, key long, id long").repartition(5)
    got = vectors.ranked(df, ["id"], 200, "t").collect()
    for o in range(3):
        mine = sorted((r["rank"], r["key"], r["id"]) for r in got if r["o"] == o)
        assert [r[0] for r in mine] == list(range(200)) and [r[1:] for r in mine] == sorted(r[1:] for r in mine)


def test_a_table_in_folders_is_deleted_whole(spark):
    from verivane.llm.common import discard, materialize, shared_folder

    t = materialize(spark.range(10).withColumn("p", F.col("id") % 3), "folders", ["p"])
    (path,) = {f.split("/p=")[0] for f in t.inputFiles()}
    assert path.startswith(shared_folder(spark))
    discard(t)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
