import hashlib

import pytest
from sqlcheck import compare_with_sql

from strandloom.llm import queries, warc

PAGES = "page_id long, url string, html string"


def _want(rows):
    top = {}
    for p, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 1000 and p is not None:
            top[h] = max(p, top.get(h, p))
    out = []
    for p, _, h in rows:
        h = (h or "").encode()
        to = top.get(h) if len(h) >= 1000 and p is not None else None
        revisit = to is not None and to != p
        out.append((str(p), len(h), hashlib.sha1(h).hexdigest(), "revisit" if revisit else "response", str(to if revisit else None)))
    return sorted(out)


@pytest.mark.parametrize("chunk", [7, 1000, 1 << 18])
def test_round_trip(spark, tmp_path, chunk):
    big = "é\r\n\r\nWARC/1.1\r\n" * 300
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (9, "http://b", big), (9, "http://b", big), (3, "u", None), (4, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", "y" * 1000), (8, "u", "y" * 1000), (None, "n", big), (10, "u", "\r\n\r\n")]
    warc.write_warc(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"), chunk=chunk, per_file=5)
    got = warc.read_warc(spark, str(tmp_path / "w"))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got.collect()) == _want(rows)


def test_files_are_warc(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([(1, "http://a", "x" * 50)], PAGES), str(tmp_path / "w"), chunk=20)
    data = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    got = list(warc.records(data))
    assert [f["WARC-Type"] for f, _ in got] == ["response", "continuation", "continuation"]
    assert [f["WARC-Segment-Number"] for f, _ in got] == ["1", "2", "3"]
    assert got[2][0]["WARC-Segment-Total-Length"] == str(sum(len(b) for _, b in got))
    running = hashlib.sha1()
    for f, b in got:
        running.update(bytes(b).split(b"\r\n\r\n")[-1])
        assert f["X-Running-Digest"] == "sha1:" + running.hexdigest()


def test_damage_is_noticed(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([(1, "http://a", "x" * 50)], PAGES), str(tmp_path / "w"))
    file = max((tmp_path / "w").glob("part-*"), key=lambda p: p.stat().st_size)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0").write_bytes(file.read_bytes().replace(b"xxxx", b"xxyx"))
    with pytest.raises(Exception, match="payload digest"):
        warc.read_warc(spark, str(tmp_path / "bad")).collect()


def test_empty(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_against_sql(spark, sf_dir):
    got, want = compare_with_sql(spark, sf_dir, queries.op3_warc, queries.oracle_sql()["op3_warc"])
    assert got == want
