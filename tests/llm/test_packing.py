import random

import helpers as H
import pytest

from strandloom.llm import packing as P


def _naive(sizes, sources, clusters, capacity):
    """Best fit by looking at every bin: the least residual, then the oldest bin."""
    bins, out = [], []
    for s, a, c in zip(sizes, sources, clusters, strict=True):
        fit = [(capacity - b["used"], i) for i, b in enumerate(bins) if capacity - b["used"] >= s and a not in b["a"] and c not in b["c"]]
        if not fit:
            bins.append({"used": 0, "a": set(), "c": set()})
            fit = [(0, len(bins) - 1)]
        b = bins[min(fit)[1]]
        out.append((min(fit)[1], b["used"]))
        b["used"] += s
        b["a"].add(a)
        b["c"].add(c)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_against_looking_at_every_bin(seed):
    rng = random.Random(seed)
    n = 400
    sizes = sorted((rng.randint(1, 100) for _ in range(n)), reverse=True)
    sources = [None if rng.random() < 0.35 else rng.randrange(8) for _ in range(n)]
    clusters = [rng.randrange(150) for _ in range(n)]
    bins, offsets = P.best_fit(sizes, sources, clusters, 100)
    assert list(zip(bins, offsets, strict=True)) == _naive(sizes, sources, clusters, 100)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = P.pack_documents(docs, 512, 64).toPandas()
    source = {r.doc_id: r.source for r in docs.collect()}
    n = {r.doc_id: len(H.words(r.text)) for r in docs.collect()}
    assert rows.groupby("doc_id").n_tokens.sum().to_dict() == n
    some = rows.dropna(subset=["bin_id"]).assign(source=lambda d: d.doc_id.map(source))
    assert some.groupby("bin_id").n_tokens.sum().max() <= 512
    assert not some.duplicated(["bin_id", "source"]).any()
    for _, b in some.sort_values("bin_offset").groupby("bin_id"):
        assert (b.bin_offset.to_numpy()[1:] == (b.bin_offset + b.n_tokens).to_numpy()[:-1]).all() and b.bin_offset.min() == 0


def test_clusters_and_long_texts(spark):
    rng = random.Random(1)
    one = H.sentence(rng, 10)
    df = spark.createDataFrame([(1, one, "en", "a", 0), (2, one.upper() + " ", "en", "b", 0), (3, H.sentence(rng, 250), "en", "c", 0)], H.SCHEMA)
    rows = P.pack_documents(df, 100, 10).collect()
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in rows) == [(1, 0, 10), (2, 0, 10), (3, 0, 100), (3, 1, 100), (3, 2, 50)]
    assert len({r.bin_id for r in rows if r.doc_id < 3}) == 2


def test_odd_rows(spark):
    rows = P.pack_documents(H.odd_rows(spark), 100_000).collect()
    assert len(rows) == 9
    assert sum(r.bin_id is None for r in rows) == 4
    same = [r.bin_id for r in rows if r.doc_id == 4]
    assert len(same) == 2 and same[0] != same[1]
    assert P.pack_documents(H.docs(spark, ["a"]).limit(0)).collect() == []
    assert P.pack_documents(H.docs(spark, ["a", "b"], extra=True)).count() == 2
    with pytest.raises(ValueError):
        P.pack_documents(H.docs(spark, ["a"]), 0)


def test_partitions_change_nothing(spark):
    """Two hundred equal rows and some others, in one partition and in fifty."""
    docs = H.docs(spark, [f"w{i} " * (i % 50) for i in range(150)]).union(spark.createDataFrame([(7, "the same words again", "en", "s", 5)] * 200, H.SCHEMA))
    rows = [sorted(tuple(r) for r in P.pack_documents(docs.repartition(n), 64, 16).fillna(-1).collect()) for n in (1, 50)]
    assert rows[0] == rows[1]
    bins = [r[3] for r in rows[0] if r[0] == 7 and r[2] == 4]
    assert len(bins) == len(set(bins)) == 200


def test_named_clusters(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"s{i}", i % 2) for i in range(8)], "doc_id long, text string, source string, cluster long")
    got = P.pack_documents(docs, 64, 100, cluster="cluster").collect()
    assert len({r.bin_id for r in got}) == 4
    assert len({r.bin_id for r in P.pack_documents(docs, 64, 100).collect()}) == 1
