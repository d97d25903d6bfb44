"""Binary sources: bytes, round trips and rejected files."""

import struct

import pytest

from strandloom.operators.graph import Graph
from strandloom.sources import dsk, packed_file, register


def test_dsk_codes():
    assert [dsk.encode(x) for x in ("tacg", "acgt", "gact")] == [0x87, 0x1E, 0xC6]
    assert dsk.decode(0x87, 4) == "tacg"


@pytest.mark.parametrize("k", [4, 32, 33, 64])
def test_dsk_round_trip(spark, tmp_path, k):
    register(spark)
    rows = [(("acgt" * 20)[i : i + k], i + 1) for i in range(4)]
    spark.createDataFrame(rows, "kmer string, count long").write.format("dsk").option("k", k).mode("append").save(str(tmp_path / "d"))
    assert sorted(tuple(r) for r in spark.read.format("dsk").load(str(tmp_path / "d")).collect()) == sorted(rows)


@pytest.mark.parametrize(("data", "message"), [(b"", "header"), (struct.pack("<II", 256, 10) + bytes(40), "256 bits"), (struct.pack("<II", 64, 33) + bytes(24), "does not fit"), (struct.pack("<II", 64, 5), "no records")])
def test_dsk_rejects(tmp_path, data, message):
    p = tmp_path / "x"
    p.write_bytes(data)
    with pytest.raises(dsk.DskError, match=message):
        dsk.header(str(p))


def test_packed_bytes(spark, tmp_path):
    register(spark)
    kmers = spark.createDataFrame([("tacgacgtcgact"[i : i + 4],) for i in range(10)], "kmer string")
    g = Graph.of_kmers(kmers, 4, False)
    path = str(tmp_path / "g.packed")
    packed_file.write_packed(g, path)
    want = struct.pack("<QQ", 0x09AD6F8B9E7898E3, 0x0580000000000000) + struct.pack("<6Q", 1, 3, 7, 10, 13, 4)
    assert open(path, "rb").read() == want
    back, k = packed_file.read_packed(spark, path)
    cols = ["pos", "w", "node_first", "end_first"]
    assert k == 4 and sorted(tuple(r) for r in back.select(cols).collect()) == sorted(tuple(r) for r in g.edges.select(cols).collect())


def test_streaming_counts(spark, tmp_path):
    from strandloom import streaming

    spark.createDataFrame([("acgtac",), ("acgt",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    q = streaming.kmer_counts(stream, 4).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r.kmer: r["count"] for r in spark.sql("SELECT * FROM counts").collect()} == {"acgt": 2, "cgta": 1, "gtac": 1}
