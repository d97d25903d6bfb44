import random
import re

import helpers as H
import pytest
from pyspark.sql import functions as F

from strandloom.llm import line_dedup as L


def _norm(line):
    return " ".join(x for x in re.split(r"[\x09\x0b-\x0d\x20-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+", line.lower()) if x)


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_exact_repeats(spark):
    texts = ["One line here\nshared, line!\n\n--\nend a", "Shared line\nother\n--", "shared LINE", "solo\nsolo\nsolo", "", "\n\n"]
    got = {r.doc_id: r.text for r in L.dedup_lines(H.docs(spark, texts)).collect()}
    assert got == {0: texts[0], 1: "other\n--", 3: "solo", 4: "", 5: "\n\n"}


def _groups(spark, lines, **options):
    """Which lines stay, each being a document."""
    return {r.doc_id for r in L.dedup_lines(H.docs(spark, lines), **options).collect()}


def test_fuzzy_against_all_pairs(spark):
    """Kept lines: none is like an earlier kept one that it shares blocks with, and all that went are linked to a kept one."""
    rng = random.Random(3)
    lines = []
    for _ in range(30):
        base = H.sentence(rng, rng.choice([4, 10, 30, 60]))
        lines += [base] + H.near_copies(rng, base, rng.randint(0, 4), (0, 3))
    kept = _groups(spark, lines)
    like = lambda i, j: _lev(_norm(lines[i]).split(), _norm(lines[j]).split()) <= int(0.1 * max(len(_norm(lines[i]).split()), len(_norm(lines[j]).split())) + 1e-9)
    linked = {i: {j for j in range(len(lines)) if like(i, j)} for i in range(len(lines))}
    component = {}
    for i in range(len(lines)):
        if i not in component:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in component:
                    component[x] = i
                    todo += linked[x]
    # nothing is lost: every true group keeps its first line, and only lines of true groups go
    assert all(c in kept for c in component.values())
    gone = set(range(len(lines))) - kept
    assert all(component[x] != x for x in gone)
    multiple = [i for i in range(len(lines)) if component[i] != i]
    assert len(gone) >= 0.9 * len(multiple)


def test_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(L, "SMALL", 3)
    rng = random.Random(4)
    base = H.sentence(rng, 80)
    lines = [base] + [base + f" x{i}" for i in range(40)]
    assert _groups(spark, lines) == {0}


def test_no_python_in_the_plan(spark, sf_dir):
    df = L.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_odd_rows(spark):
    got = L.dedup_lines(H.odd_rows(spark)).collect()
    texts = sorted((r.doc_id or -1, r.text or "") for r in got)
    assert (5, "lorem Ipsum\n") in [(i, t[:12]) for i, t in texts]
    assert [t for i, t in texts if i == 4] == ["one", "one"]
    assert len(got) == 9
    assert L.dedup_lines(H.docs(spark, ["a"]).limit(0)).collect() == []
    assert L.dedup_lines(H.docs(spark, ["a", "b"], extra=True)).count() == 2


def _all_pairs(lines):
    """The lines that stay if all pairs are compared, by number."""
    words = [_norm(x).split() for x in lines]
    like = lambda a, b: a == b or _lev(a, b) <= int(0.1 * max(len(a), len(b)) + 1e-9)
    first = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if first[i] != first[j] and like(words[i], words[j]):
                low, high = sorted((first[i], first[j]))
                first = [low if f == high else f for f in first]
    return {i for i in range(len(lines)) if first[i] == i}


def _recall(spark, lines):
    """The share of the lines that should go, by comparing all pairs, that do; none that should stay may go."""
    want, kept = _all_pairs(lines), _groups(spark, lines)
    assert want <= kept
    return (len(lines) - len(kept)) / (len(lines) - len(want))


def test_recall(spark):
    """Of families whose lines are as far apart as a link may be, at least 0.95 are found, short lines included."""
    rng = random.Random(8)
    lines = []
    for k in range(60):
        n = (10, 13, 17, 20, 25, 29, 30, 40, 60, 110)[k % 10]
        base = H.sentence(rng, n, 300).split()
        lines.append(" ".join(base))
        for _ in range(2):
            w = list(base)
            for at in rng.sample(range(n), n // 10):
                w[at] = f"e{rng.randrange(10**6)}"
            if n % 2:
                w.insert(rng.randrange(n), "more") if n // 10 == 1 and w == base else w.pop(rng.randrange(n)) if w == base else None
            lines.append(" ".join(w))
    assert len(lines) - len(_all_pairs(lines)) > 90
    assert _recall(spark, lines) >= 0.95


def test_one_edit_is_never_lost(spark):
    """Lines of fewer than twenty words, with a word changed, put in or taken out at every place."""
    lines = []
    for n in (9, 10, 11, 15, 19):
        for at in range(n):
            base = [f"k{n}a{at}w{i}" for i in range(n)]
            lines.append(" ".join(base))
            lines.append(" ".join(base[:at] + ["x"] + base[at + 1 :]))
            lines.append(" ".join(base[:at] + ["x"] + base[at:]))
    assert _groups(spark, lines) == _all_pairs(lines)


def test_chain_in_large_block(spark, monkeypatch):
    """A is like B and B is like C, but not A like C: all go to A, also by way of leaders."""
    monkeypatch.setattr(L, "SMALL", 1)
    rng = random.Random(5)
    lines = []
    for c in range(12):
        base = H.sentence(rng, 20).split()
        lines += [" ".join([f"n{c}x{i}" for i in range(2 * step)] + base[2 * step :]) for step in range(4)]
    want = _all_pairs(lines)
    assert len(want) == 12
    assert _recall(spark, lines) >= 0.9


def test_common_passage_in_unlike_lines(spark, monkeypatch):
    """Lines that share a passage and nothing else stay, and repeats among them are found through blocks of several runs."""
    monkeypatch.setattr(L, "SMALL", 4)
    rng = random.Random(6)
    passage = H.sentence(rng, 15)
    lines = [f"{H.sentence(rng, 12)} {passage} {H.sentence(rng, 12)}" for _ in range(60)]
    lines += [H.near_copies(rng, x, 1, (1, 2))[0] for x in lines[:30]]
    assert _groups(spark, lines) >= set(range(60))
    assert _recall(spark, lines) >= 0.9


def test_unique_lines_stay(spark):
    """A line that is like none stays, whatever other rows have its document's id or none."""
    rng = random.Random(9)
    one, two = H.sentence(rng, 20), H.sentence(rng, 20)
    near = " ".join([*one.split()[:-1], "changed"])
    back = " ".join(reversed(two.split()))
    rows = [(3, back), (5, two), (5, one), (7, near), (None, two), (None, "alone in the world, without an id"), (None, one), (8, f"{one}\r\n\ttab and end"), (9, "x"), (9, "y")]
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == sorted([(3, back), (5, two), (5, one), (-1, "alone in the world, without an id"), (8, "\ttab and end"), (9, "x"), (9, "y")])


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    docs = H.docs(spark, ["shared line\nown", "other\nshared line"])
    for c in ("doc", "text_key", "flags", "left", "goes", "_doc", "_flags", "keep", "p_low", "_bad", "Doc", "a.b"):
        docs = docs if c.lower() in (x.lower() for x in docs.columns) else docs.withColumn(c, F.lit(f"own {c}"))
    got = L.dedup_lines(docs)
    assert got.columns == docs.columns
    assert {(r.doc_id, r.text, r.doc, r["a.b"], r.left) for r in got.collect()} == {(0, "shared line\nown", "own doc", "own a.b", "own left"), (1, "other", "own doc", "own a.b", "own left")}


def test_lines_of_few_distinct_words(spark):
    """Ten words of which few are distinct may differ in one, and nine words are like ten."""
    lines = ["a b a b a b a b a b", "a b a b a x a b a b", "one two three four five six seven eight nine", "one two three four five six seven eight nine ten", "p q r s t u v w", "p q r s t u v w x"]
    assert _groups(spark, lines) == _all_pairs(lines) == {0, 2, 4, 5}


def test_alike_lines_share_a_rare_word(spark):
    """Lines within the edits that a link allows have a rarest word in common, whichever words are common in the table."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        n = rng.randint(9, 60)
        a = [f"w{min(rng.randrange(200), rng.randrange(200))}" for _ in range(n)]
        b = list(a)
        for at in rng.sample(range(n), int(n * 0.1 + 1e-9)):
            b[at] = f"w{rng.randrange(200)}"
        c = a + [f"x{rng.randrange(9)}" for _ in range(int(n / 9 + 1e-9))]
        rows += [(3 * i + j, len(x), " ".join(x)) for j, x in enumerate((a, b, c))]
    texts = spark.createDataFrame(rows, "line_id long, n int, line string")
    texts = texts.select("line_id", "n", L._coded(L._words(F.col("line"))).alias("coded"))
    rare: dict[int, set] = {}
    for r in L._rarest(texts.select("line_id"), texts, 0.9).collect():
        rare.setdefault(r.line_id, set()).add(r.w)
    assert all(rare[3 * i] & rare[3 * i + j] for i in range(60) for j in (1, 2))


def test_parities_admit_all_alike_lines(spark, monkeypatch):
    """Pairs within the edits that a link allows pass by their parities; of unlike members of one family few do, so that rows follow the links."""
    monkeypatch.setattr(L, "SMALL", 8)
    rng = random.Random(12)
    base = H.sentence(rng, 40)
    lines = [base] + H.near_copies(rng, base, 120, (1, 8))
    seen = []
    alike = L._alike
    monkeypatch.setattr(L, "_alike", lambda pairs, *rest: seen.append(pairs.count()) or alike(pairs, *rest))
    assert _groups(spark, lines) == _all_pairs(lines)
    words = [_norm(x).split() for x in lines]
    true = sum(_lev(words[i], words[j]) <= 4 for i in range(len(lines)) for j in range(i))
    assert sum(seen) <= 1.2 * true


def test_groups_joined_by_more_links(spark):
    group = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node long, component long")
    more = spark.createDataFrame([(2, 6), (3, 9), (10, 11), (5, 6)], "a long, b long")
    got = sorted((r.node, r.component) for r in L._joined(group, more).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (5, 1), (6, 1), (8, 3), (9, 3), (10, 10), (11, 10)]


def test_distinct_lines_are_told_without_sorting(spark, monkeypatch):
    """Keys of blocks are columns that hash aggregation can carry; anchors are sorted once, and no compiled method is longer than Java compiles further."""
    frames = {}
    written = L.written
    monkeypatch.setattr(L, "written", lambda df, name="table", **rest: frames.setdefault(name, df) and written(df, name, **rest))
    rng = random.Random(13)
    L.dedup_lines(H.docs(spark, [H.sentence(rng, n) for n in (5, 12, 18, 30)]))
    plan = lambda name: frames[name]._jdf.queryExecution().executedPlan()
    assert "SortAggregate" not in plan("distinct").toString()
    assert sum("sort_array" in x for x in plan("lines").toString().split("\n")) == 1
    code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenString(plan("lines"))
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


def test_keys_are_hashes_of_ends_and_runs(spark):
    """Up to 8 words: none; up to 17: both ends; 18 and 19: ends and runs; from 20 on runs, each of four words in a row, as many as ANCHORS."""
    rng = random.Random(14)
    lines = [H.sentence(rng, n, 400).lower() for n in (8, 9, 17, 18, 19, 20, 60)] + ["a b " * 15]
    got = L.lines(H.docs(spark, lines), 0.9).collect()
    assert len(got) == len(lines)
    for r in got:
        words = _norm(r.line).split()
        assert r.n == len(words)
        pieces = lambda k: [words[i : i + k] for i in range(len(words) - k + 1)]
        hashed = lambda rows, *tag: {x.h for x in spark.createDataFrame([(p,) for p in rows], "p array<string>").select(F.xxhash64(*(F.lit(t) for t in tag), "p").alias("h")).collect()}
        ends, runs = [r[b] for b in L.BLOCKS[:2]], [r[b] for b in L.BLOCKS[2:]]
        if 9 <= r.n < 20:
            assert {ends[0]} == hashed(pieces(5)[:1], 1) and {ends[1]} == hashed(pieces(5)[-1:], 2)
        else:
            assert ends == [None, None]
        if r.n >= 18:
            assert set(runs) <= hashed(pieces(4)) and (r.n != 60 or len(set(runs)) == L.ANCHORS)
        else:
            assert set(runs) == {None}
