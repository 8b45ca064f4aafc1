import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.conftest import ODD
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_dedup import brute as groups
from tests.llm.test_packing import check as packed
from tests.llm.test_pii import plain
from verivane.llm.common import materialize


def test_each_stage(spark, small):
    docs = small("documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "pii", "packing"]
    quality = {r["doc_id"]: r["quality"] for r in small("labels").collect()}
    items = [tuple(r) for r in small("benchmark").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = materialize(stage(spark, docs, SMALL), name)
        if name == "packing":
            bins, bound = packed(out, before, 2048)
            assert bins <= bound * 1.02 + 1
            break
        assert out.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality":
            known = [i for i, _ in before if i in quality]
            assert sum((i in after) == (quality[i] == 1) for i in known) > 0.95 * len(known)
            assert all(dict(before)[i] == t for i, t in after.items())
        elif name == "near_dedup":
            assert set(after) == {i for i, _, c in groups(before, 5) if i == c}
        elif name == "decontaminate":
            assert set(after) == {i for i, _ in before} - {i for i, _ in leaks(before, items)}
        else:
            assert set(after) == {i for i, _ in before}
            assert not any(spans for t in after.values() for kind, spans in plain(t or "").items() if kind in ("email", "card", "phone"))
        docs = out


def test_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert sum(n.startswith("op") for n in __spark_entry__.queries()) == 13


def folder(spark, path, documents, small):
    documents.write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        small(name).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_odd_rows_and_further_columns(spark, small, tmp_path):
    """Null, empty, very long and repeated texts, no ids, columns with names that stages use inside."""
    extra = ["h", "g", "c", "k", "v", "d", "p", "item", "part", "length", "spans", "kept", "keep", "score"]
    known = [tuple(r) for r in small("documents").select("doc_id", "text", "lang", "source", "n_chars").limit(60).collect()]
    odd = [(i if i is None else i + 10**6, t, None, None, None) for i, t in ODD]
    df = spark.createDataFrame([(*r, *range(len(extra))) for r in [*known, *odd, *odd[:2]]], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in extra))
    path = folder(spark, tmp_path, df, small)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, path), name)
        if name != "packing":
            assert docs.columns == df.columns
            assert docs.select(*extra).distinct().collect() == ([tuple(range(len(extra)))] if not docs.isEmpty() else [])
    assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count() > 10


def test_empty_documents(spark, small, tmp_path):
    path = folder(spark, tmp_path, small("documents").where("false"), small)
    assert corpus_pipeline.run(spark, path).collect() == []
