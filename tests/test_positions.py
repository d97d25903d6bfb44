import random

import pytest

from strandloom.operators import positions


def _model(texts, k):
    rc = lambda s: s[::-1].translate(str.maketrans("acgt", "tgca"))
    reads = ["".join(c for c in (t or "").translate(str.maketrans("ACGT", "acgt")) if c in "acgt") for t in texts]
    edges = {r[i : i + k] for r in reads for i in range(len(r) - k + 1)}
    edges |= {rc(e) for e in edges}
    starts, ends = {e[:-1] for e in edges}, {e[1:] for e in edges}
    rows = {(e[:-1], e[-1]) for e in edges} | {(n, "$") for n in ends - starts} | {(n[:i].rjust(k - 1, "$"), n[i]) for n in starts - ends for i in range(k - 1)}
    out, node, prev = [], -1, None
    for pos, (n, w) in enumerate(sorted(rows, key=lambda r: (r[0][::-1], r[1]))):
        node += n != prev
        lcs = 0 if prev is None else k - 1 if n == prev else next((i for i in range(k - 1) if n[-1 - i] != prev[-1 - i] or n[-1 - i] == "$"), k - 1)
        out.append((pos, node, n, w, lcs))
        prev = n
    return out


@pytest.mark.parametrize("k", [2, 3, 12, 31, 32, 45, 63, 64])
def test_equals_plain_model(spark, monkeypatch, k):
    """Several buckets; copies, low complexity, palindromes, short, null and non-ASCII texts."""
    monkeypatch.setattr(positions, "ROWS", 3000)
    rng = random.Random(k)
    base = "".join(rng.choice("acgt") for _ in range(9000))
    texts = [base, base, base[:100] + "A" + base[101:300], "a" * 200, "a" * 70 + "c" * 70, "acgt" * 40, "acg", "", None, "N\u00e9\u00df" + base[500:700].upper() + " x", base[:63], "ta" * 40 + "g"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = sorted(tuple(r) for r in positions.positions(df, k).collect())
    assert got == _model(texts, k)


def test_no_reads(spark):
    assert positions.positions(spark.createDataFrame([("ac",), (None,)], "text string"), 31).count() == 0


def test_registered_queries_use_it(spark, sf_dir):
    """Labels are made last: no row of a label is shuffled."""
    from strandloom import plans

    for name in ("edge_positions_31", "edge_positions_63"):
        plan = plans.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Window" not in plan
