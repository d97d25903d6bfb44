"""Fixtures of documents, and brute-force versions."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return (text or "").encode().translate(LOWER).split()


def docs(spark, texts, first=0, extra=False):
    rows = [(first + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:  # names that the operators use themselves
        from pyspark.sql import functions as F

        for c in ("n", "key", "node", "block", "bucket", "size", "run", "flags", "kept", "ids", "count", "shard"):
            df = df.withColumn(c, F.lit("x"))
    return df


def sentence(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows(spark):
    """Null texts, ids and sources, empty and blank texts, repeated rows, and a very long one."""
    long = "lorem Ipsum\n" * 20_000
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t ", "en", "a", 4), (None, "a text without id", "en", None, 5), (4, "one", "en", "a", 3), (4, "one", "en", "a", 3), (5, long, None, "b", None), (6, "é😀 ﬀ  x▁y", "fr", "b", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def shingles(text, n):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < n else zip(*(w[i:] for i in range(n))))


def components(texts, n, percent):
    """Least index of each text's component and the links between different sets, by comparing all pairs."""
    sets = [shingles(t, n) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = set()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                if a != b:
                    links.add(frozenset((a, b)))
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], links


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(*edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out
