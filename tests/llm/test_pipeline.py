import helpers as H
import pytest

from strandloom.llm.common import written

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf_dir))
        assert out.dtypes == docs.dtypes
        if name == "n-gram Jaccard join":
            rows = docs.orderBy("doc_id").collect()
            want, _ = H.components([r.text for r in rows], 5, 80)
            assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for i, r in enumerate(rows) if want[i] == i)
        docs = out
        n.append(docs.count())
    assert n[0] > n[1] > n[2] >= n[3] > 0
    packed = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_run(spark, sf_dir):
    assert pipeline.run(spark, sf_dir).count() > 0


@pytest.mark.parametrize("k", range(4))
def test_stage_on_odd_and_empty_rows(spark, sf_dir, k):
    name, stage = pipeline.STAGES[k]
    odd = H.odd_rows(spark)
    assert stage(spark, odd, sf_dir).count() > 0
    assert stage(spark, odd.limit(0), sf_dir).count() == 0
    extra = H.docs(spark, ["some words here and there", "other words go elsewhere"], extra=True)
    assert stage(spark, extra, sf_dir).count() == 2


def _ids(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in df.collect())


def test_near_copies_go_by_row(spark, sf_dir):
    """Rows of one id and different texts are documents of their own; rows equal in both are one."""
    a, b = "one two three four five six seven", "other words make up this text here"
    near = lambda t: spark.createDataFrame(t, "doc_id long, text string")
    assert _ids(pipeline.near_copies(spark, near([(1, a), (5, a), (5, b)]), sf_dir)) == [(1, a), (5, b)]
    assert _ids(pipeline.near_copies(spark, near([(5, a), (5, b), (5, b), (9, b), (None, a), (3, None), (4, "")]), sf_dir)) == [(-1, a), (3, None), (4, ""), (5, a), (5, b)]


CLASHING = ("keep", "p_low", "p_toxic", "_bad", "_toxic", "_doc", "_text", "_flags", "_left", "_gone", "_source", "_lang", "c0", "n_", "text_key", "of_doc")


def test_clashing_names(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = H.docs(spark, ["some words here and there", "other words go elsewhere"])
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns, name
        assert [[r[c] for c in CLASHING] for r in got.collect()] == [[f"own {c}" for c in CLASHING]] * 2, name
