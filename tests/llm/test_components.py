import random

import pytest

from strandloom.llm.components import components


@pytest.mark.parametrize("seed", range(3))
def test_against_union_find(spark, seed):
    rng = random.Random(seed)
    n = 60
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 230)] + [(5, 5), (None, 3)]
    rng.shuffle(pairs)
    parent = {x: x for p in pairs for x in p if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    linked = {x for a, b in pairs if a is not None and b is not None and a != b for x in (a, b)}
    got = components(spark.createDataFrame(pairs, "a long, b long"))
    assert sorted((r.node, r.component) for r in got.collect()) == sorted((x, find(x)) for x in linked)


def test_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
