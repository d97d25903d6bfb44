import collections
import math
import random
import zlib

import helpers as H
import numpy as np
import pytest

from strandloom.llm import context_tree as C
from strandloom.llm import lm_scoring as S
from strandloom.llm import queries


def _kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Brute:
    """Context-tree weighting by recursion over dictionaries."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, collections.Counter()
        for t in texts:
            for node, bit in self.choices(t):
                for d in range(depth + 1):
                    self.n[node[0][:d], node[1], bit] += 1
        self.below = collections.defaultdict(set)
        for c, x, _ in list(self.n):
            if c:
                self.below[c[:-1], x].add(c)
        self.memo = {}

    def choices(self, t):
        padded = b"\xff" * self.depth + t + b"\xff"
        for i in range(self.depth, len(padded)):
            context, byte = padded[i - self.depth : i][::-1], padded[i]
            for j in range(8):
                yield (context, 1 << j | byte >> (8 - j)), byte >> (7 - j) & 1

    def weighted(self, c, x):
        if (c, x) not in self.memo:
            own = _kt(self.n[c, x, 0], self.n[c, x, 1])
            self.memo[c, x] = own if len(c) == self.depth else float(np.logaddexp(own, sum(self.weighted(s, x) for s in self.below[c, x]))) - math.log(2)
        return self.memo[c, x]

    def score(self, t):
        total = 0.0
        for (context, x), bit in self.choices(t):
            p = None
            for d in range(self.depth, -1, -1):
                c = context[:d]
                a, b = self.n[c, x, 0], self.n[c, x, 1]
                own = ((b if bit else a) + 0.5) / (a + b + 1)
                w = 1.0 if d == self.depth else math.exp(_kt(a, b) - math.log(2) - self.weighted(c, x))
                p = own if p is None else w * own + (1 - w) * p
            total += math.log10(p)
        return total


def _held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def _base(texts):
    c = collections.Counter(w for i, t in texts.items() if not _held(i) for w in [*H.words(t), None])
    n, v = sum(c.values()), len(c)
    return {i: (len(H.words(t)) + 1, sum(c[w] > 0 for w in [*H.words(t), None]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*H.words(t), None])) for i, t in texts.items()}


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_against_recursion(spark, monkeypatch, depth):
    from pyspark.sql import functions as F

    monkeypatch.setattr(S, "AT_ONCE", 300)
    monkeypatch.setattr(S, "PENDING", 500)
    rng = random.Random(depth)
    texts = [H.sentence(rng, rng.randint(0, 12), 30).replace("w1", "Éx ").replace("w2", "\n") for _ in range(40)] + ["", "same text"] + ["same text"] * 3
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = {r.doc_id: r for r in S.score(H.docs(spark, texts), held, depth, block=10).collect()}
    lower = [t.encode().translate(H.LOWER) for t in texts]
    brute = Brute([t for i, t in enumerate(lower) if not _held(i)], depth)
    for i, t in enumerate(lower):
        assert got[i].held_out == _held(i)
        assert got[i].score == pytest.approx(brute.score(t), rel=1e-9)
    for i, (n, known, total, base) in _base(dict(enumerate(texts))).items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total)
        assert got[i].base_score == pytest.approx(base, rel=1e-12)


def test_is_a_probability():
    """The probabilities of all 256 next bytes sum to 1 after any context."""
    depth, train = 3, b"abracadabra abracadabra"
    k, n = np.unique(C.grams(np.frombuffer(b"\xff" * depth + train, np.uint8), depth), return_counts=True)
    for context in (b"abr", b"zzz", b"a a"):
        ask = np.array([int.from_bytes(context[::-1] + bytes([x]), "big") for x in range(256)], dtype=np.uint64)
        keys = np.union1d(k, ask)
        counts = np.zeros(len(keys), dtype=np.int64)
        counts[np.searchsorted(keys, k)] = n
        sums = collections.defaultdict(lambda: np.zeros(3))
        for near, choice, *v in C.tops(keys, counts, depth, 5):
            for c, x, *w in zip(near.tolist(), choice.tolist(), *v, strict=True):
                sums[c, x] += w
        tables = C.above({x: (int(v[0]), int(v[1]), v[2]) for x, v in sums.items()})
        log = C.log_probabilities(keys, counts, tables, depth, 5)
        assert (10 ** log[np.searchsorted(keys, ask)]).sum() == pytest.approx(1, abs=1e-12)


def test_estimates():
    a, b = np.array([0, 1, 5, 70_000]), np.array([0, 0, 9, 3])
    assert C.log_estimate(a, b) == pytest.approx([_kt(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)], rel=1e-9, abs=1e-9)


def test_table_and_odd_rows(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op7_lm_scoring(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for i, (n, known, total, base) in _base(texts).items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)
    from pyspark.sql import functions as F

    odd = S.score(H.odd_rows(spark), F.col("doc_id") == 3).collect()
    assert len(odd) == 9 and all(r.score < 0 for r in odd)
    assert S.score(H.odd_rows(spark).limit(0), F.lit(False)).collect() == []
    assert S.score(H.docs(spark, ["a b"], extra=True), F.lit(True)).first().train_tokens == 0
