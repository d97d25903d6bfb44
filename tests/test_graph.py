"""Golden cases, random graphs against the sequential model, invariants and edge cases."""

import random

import model
import pytest
from pyspark.sql import functions as F

from strandloom.operators import ordinals, pack, packed, reads, unitig, varorder
from strandloom.operators.graph import Graph


def _kmers(spark, kmers):
    return spark.createDataFrame([(x,) for x in kmers], "kmer string")


def _of_read(read, k):
    return [read[i : i + k] for i in range(len(read) - k + 1)]


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


GOLDEN = [
    (_of_read("tacgacgtcgact", 4), 4, False, [0x09AD6F8B9E7898E3, 0x0580000000000000], [1, 3, 7, 10, 13]),
    (["acgt"], 4, True, [0x03ADF31800000000], [1, 2, 3, 4, 5]),
    (["aac", "cca"], 3, True, [0x03A5B13AC6B19E63, 0x07BE630000000000], [4, 7, 10, 13, 16]),
]


@pytest.mark.parametrize(("kmers", "k", "revcomps", "words", "running"), GOLDEN)
def test_golden_packed(spark, kmers, k, revcomps, words, running):
    g = Graph.of_kmers(_kmers(spark, kmers), k, revcomps)
    assert [r.word for r in packed.words(g.edges).orderBy("block_no").collect()] == words
    assert [r.running for r in packed.f_table(g.edges).orderBy("f").collect()] == running
    got = packed.unpack(packed.words(g.edges), running[-1])
    assert _rows(got, "pos", "w", "node_first", "end_first") == _rows(g.edges, "pos", "w", "node_first", "end_first")


def test_golden_forward_and_orders(spark):
    g = Graph.of_kmers(_kmers(spark, _of_read("tacgacgtcgact", 4)), 4, False)
    assert dict(_rows(g.forward(), "pos", "to"))[5] == 7  # a minus edge
    assert {r.hkey: (r.first, r.last) for r in varorder.shorter(g, 2).collect()}["ac"] == (3, 5)
    assert {r.hkey: (r.first, r.last) for r in varorder.shorter(g, 1).collect()}["c"] == (3, 6)
    values = g.edges.select(F.col("lcs"), varorder.quantized("lcs", [1, 3]).alias("q"), varorder.thresholded("lcs", 2).alias("t")).distinct()
    assert _rows(values, "lcs", "q", "t") == [(0, 0, 0), (1, 1, 0), (2, 1, 2), (3, 3, 3)]


def test_in_dummies(spark):
    got = pack.in_dummies(spark.createDataFrame([("acgt",), ("ccag",)], "node string"), 5)
    assert sorted(r.node + r.w for r in got.collect()) == sorted("$$$$a $$$$c $$$ac $ccag $$$cc $$acg $$cca $acgt".split())


@pytest.mark.parametrize("seed", range(6))
def test_random_against_model(spark, seed):
    rng = random.Random(seed)
    k = rng.choice([2, 3, 4, 5, 8])
    kmers = ["".join(rng.choice("acgt") for _ in range(k)) for _ in range(rng.randint(1, 60))]
    revcomps = bool(seed % 2)
    g = Graph.of_kmers(_kmers(spark, kmers), k, revcomps)
    columns = ["pos", "node_id", "node", "w", "tag", "node_first", "end_first", "lcs"]
    want = sorted(tuple(r[c] for c in columns) for r in model.edges(kmers, k, revcomps))
    assert _rows(g.edges, *columns) == want
    n_out = sum(r.outdegree for r in g.outdegree().collect())
    assert n_out == sum(r.indegree for r in g.indegree().collect()) == sum(r[3] != "$" for r in want)
    assert {(r.unitig_id, r.n_edges, r.label, r.is_cycle) for r in unitig.unitigs(pack.edge_set(_kmers(spark, kmers), revcomps), k).collect()} == model.unitigs({r[2] + r[3] for r in want if r[4] == "standard"}, k)


def test_cycle_and_saturated(spark):
    ring = [("acgtt" * 2)[i : i + 5] for i in range(5)]
    assert [(r.n_edges, r.is_cycle) for r in unitig.unitigs(_kmers(spark, ring), 5).collect()] == [(5, True)]
    every = [a + b for a in "acgt" for b in "acgt"]
    assert {r.tag for r in Graph.of_kmers(_kmers(spark, every), 2).edges.collect()} == {"standard"}


def test_reads(spark):
    texts = [("GATTACA! x acgt",), (None,), ("zzz",), ("A" * 1500,)]
    got = reads.kmers(reads.reads(spark.createDataFrame(texts, "text string")), 4).groupBy("kmer").count()
    want = {}
    for t in ["GATTACAacgt".lower().replace("x", ""), "a" * 1500]:
        for x in _of_read(t, 4):
            want[x] = want.get(x, 0) + 1
    assert {r.kmer: r["count"] for r in got.collect()} == want
    with pytest.raises(ValueError):
        reads.kmers(reads.reads(spark.createDataFrame(texts, "text string")), 1)


def test_empty(spark):
    g = Graph.of_kmers(spark.createDataFrame([], "kmer string"), 5)
    assert g.edges.count() == 0
    assert unitig.unitigs(spark.createDataFrame([], "kmer string"), 5).count() == 0


def test_no_single_partition(spark):
    g = Graph.of_kmers(_kmers(spark, _of_read("acgtacgattacagatta", 6)), 6)
    plan = g.edges._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "SinglePartition" in line]
    # only the table of buckets, of fixed size, is ordered as a whole
    assert len(wide) <= 2


def test_save_and_load(spark, tmp_path):
    g = Graph.of_kmers(_kmers(spark, ["acgta", "cgtac"]), 5)
    g.save(str(tmp_path))
    back = Graph.load(spark, str(tmp_path))
    assert back.k == 5 and _rows(back.edges, "pos", "node", "w") == _rows(g.edges, "pos", "node", "w")


def test_ordinals_prefix(spark):
    e = pack.pack(_kmers(spark, _of_read("acgtacgattacagatta", 6)), 6)
    one, three = (_rows(ordinals.index(e, 6, p), "pos", "node", "w", "lcs") for p in (1, 3))
    assert one == three


def test_packed_labels_keep_their_order_and_come_back(spark):
    import random

    from pyspark.sql import functions as F

    from strandloom.functions import kmer as K

    rng = random.Random(3)
    for width in (1, 6, 30, 31, 62):
        labels = sorted({"".join(rng.choice("acgt") for _ in range(width)) for _ in range(50)})
        df = spark.createDataFrame([(x,) for x in labels], "s string").withColumn("p", K.packed("s", width))
        got = df.select("s", "p", K.label("p", width).alias("back"), F.length("p").alias("n")).collect()
        assert all(r.s == r.back and r.n == -(-width // 4) for r in got)
        assert [r.s for r in sorted(got, key=lambda r: bytes(r.p))] == labels


def test_compact_index_and_written_tables(spark):
    """Compact shuffles give the same index; of what is written only the edges and the few sources stay, and common suffixes are no sum of k comparisons."""
    import os
    import random

    from strandloom.functions import kmer as K
    from strandloom.operators import graph, reads
    from strandloom.operators.lineage import shared_folder

    rng = random.Random(4)
    texts = ["".join(rng.choice("acgt") for _ in range(n)) for n in (5, 9, 40, 80, 200)] + [None, ""]
    df = reads.reads(spark.createDataFrame([(x,) for x in texts + texts[:3]], "text string"))
    rows = lambda compact, rc, k: sorted(map(str, graph.indexed(reads.kmers(df, k), k, rc, compact=compact).collect()))
    folder = f"{shared_folder(spark)}/strandloom"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    for k, rc in ((2, True), (5, True), (9, True), (12, True), (9, False)):
        assert rows(False, rc, k) == rows(True, rc, k)
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} <= {"edges", "sources"}
    assert len(str(K.common_suffix("a", "b", 62))) < 2000
