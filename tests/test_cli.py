"""Sequence files, the command line and the workload."""

import struct

import pytest

from strandloom.__main__ import main, output
from strandloom.operators import ordinals, workload
from strandloom.operators.graph import Graph
from strandloom.sources import dsk, fasta, packed_file, register

READ = "tacgacgtcgact"


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def _kmers(spark, read=READ, k=4):
    return spark.createDataFrame([(read[i : i + k],) for i in range(len(read) - k + 1)], "kmer string")


def test_fasta(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">one first\nACGT\nAC\n>two\r\nGG\r\n>none\n")
    assert _rows(fasta.read_fasta(spark, str(tmp_path / "r.fa")), "name", "text") == [("none", ""), ("one first", "ACGTAC"), ("two", "GG")]
    (tmp_path / "r.fq").write_text("@one\nACGT\n+\n!!!!\n@two\nAC\n+two\n##\n")
    assert _rows(fasta.read_fastq(spark, str(tmp_path / "r.fq")), "name", "text", "quality") == [("one", "ACGT", "!!!!"), ("two", "AC", "##")]
    (tmp_path / "bad.fq").write_text("@one\nACGT\n+\n@!!!\n@two\nAC\n+two\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        fasta.read_fastq(spark, str(tmp_path / "bad.fq")).collect()


def test_pack_build_quantize_and_benchmark(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "r.fa").write_text(f">r\n{READ}\n")
    path = main(["pack", str(tmp_path / "r.fa"), "-k", "4", "--no-revcomps", "--variable-order"], spark)
    assert path == str(tmp_path / "r.fa.packed")
    assert (tmp_path / "r.fa.packed").read_bytes() == struct.pack("<QQ", 0x09AD6F8B9E7898E3, 0x0580000000000000) + struct.pack("<6Q", 1, 3, 7, 10, 13, 4)
    assert list((tmp_path / "r.fa.packed.lcs").read_bytes()) == [0, 0, 1, 0, 3, 2, 1, 0, 3, 2, 0, 1, 1]
    built = main(["build", path, "-o", str(tmp_path / "g")], spark)
    want = Graph.of_kmers(_kmers(spark), 4, False)
    columns = ("pos", "node_id", "node", "w", "tag", "node_first", "end_first", "f", "end_node", "lcs")
    key = lambda rows: sorted(map(str, rows))
    assert key(Graph.load(spark, built).edges.select(*columns).collect()) == key(want.edges.select(*columns).collect())
    assert {r.lcs_q for r in spark.read.parquet(main(["quantize", built, "1", "3"], spark)).collect()} == {0, 1, 3}
    took = main(["benchmark", built, "-n", "5"], spark)
    assert took["forward"]["rows"] >= 5 and set(took) >= {"backward", "lastchar", "shorter", "longer", "maxlen", "maxlen_symbol"}
    contigs = main(["unitigs", str(tmp_path / "r.fa"), "-k", "4"], spark)
    assert sum(r.value.startswith(">") for r in spark.read.text(contigs).collect()) > 0
    assert [r.first for r in Graph.load(spark, built).find("GAC").collect()] == [3]


def test_names():
    assert output(None, "/a/b/reads.fa", ".packed") == "reads.fa.packed"
    assert output("x", "/a/b/reads.fa", ".packed") == "x.packed"


def test_workload_is_repeatable(spark):
    g = Graph.of_kmers(_kmers(spark), 4)
    assert _rows(workload.drawn(g, 5, 1), "node", "x", "order") == _rows(workload.drawn(g, 5, 1), "node", "x", "order")


def test_packed_file_of_short_dummies_is_refused(spark, tmp_path):
    register(spark)
    packed_file.write_packed(Graph.of_kmers(_kmers(spark, "aacctg"), 4, False, False), str(tmp_path / "g.packed"))
    with pytest.raises(ValueError, match="predecessor"):
        Graph.of_packed(spark, str(tmp_path / "g.packed"))


def test_large_counts_are_refused(spark, tmp_path):
    register(spark)
    with pytest.raises(Exception, match="does not fit"):
        spark.createDataFrame([("acgt", 2**32)], "kmer string, count long").write.format("dsk").option("k", 4).mode("append").save(str(tmp_path / "d"))
    assert issubclass(dsk.DskError, ValueError)


@pytest.mark.parametrize("rows", [1, 7])
def test_buckets_of_any_size_give_one_order(spark, monkeypatch, rows):
    from strandloom.operators import pack

    edges = pack.pack(_kmers(spark, "aaaaaaaaacgtacgaaaaaattgaaaaaac", 6), 6)
    want = _rows(ordinals.index(edges, 6), "pos", "node", "w", "node_id", "lcs")
    monkeypatch.setattr(ordinals.with_bucket, "__defaults__", (2, rows))
    assert _rows(ordinals.index(edges, 6, 2), "pos", "node", "w", "node_id", "lcs") == want
