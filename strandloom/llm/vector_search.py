"""Exact top-k inner products with multi-resolution segment statistics.

Every vector is cut into equal segments at several resolutions; a segment's mean and deviation bound the inner product of
two vectors from above (within a segment: length * mean * mean + norm of both deviations, by Cauchy and Schwarz), which is
the bound on distance turned about. From coarse to fine, candidates whose bound is below the k-th best exact score found so
far are dropped, and the survivors' products are computed exactly. Ties at the k-th place survive, so results are exact.

Queries and candidates are dealt into blocks of a fixed size by a hash of the row; each pair of blocks is one task's work,
so its memory is bounded however many rows there are, and each query's few best per block are ranked at the end.

Vectors that are null, empty or hold null or non-finite components, and rows without an id, take no part. Vectors of
unlike lengths are not compared. Repeated candidate rows count each; repeated query rows count once, and query rows of one id with unlike vectors are queries of their
own. Empty tables give empty results. Components must be
small enough for products to fit 63 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, QUERIES, AT_ONCE = 16_384, 1_024, 64
LEVELS = (4, 16)


def _segments(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cuts = np.unique(np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int))
    size = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / size
    rest = x - np.repeat(mean, size, axis=1)
    return mean, np.sqrt(np.add.reduceat(rest * rest, cuts[:-1], axis=1)), size


def _best(q_ids, keys, q, c_ids, c, k: int):
    """Rows (query, its key, candidate, score) of the k best candidates of each query, by score and then smaller id."""
    small = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2.0**53
    exact = (lambda a, b: np.rint(b @ a).astype(np.int64)) if small else (lambda a, b: b.astype(np.int64) @ a.astype(np.int64))
    stats = []
    for parts in LEVELS:
        (mq, dq, size), (mc, dc, _) = _segments(q, parts), _segments(c, parts)
        stats.append((np.hstack([mq * size, dq]), np.hstack([mc, dc])))
    slack = 1e-6 * (1 + np.sqrt((q * q).sum(1)) * np.sqrt((c * c).sum(1).max(initial=0)))
    for lo in range(0, len(q), AT_ONCE):
        bound = stats[0][0][lo : lo + AT_ONCE] @ stats[0][1].T
        for j in range(len(bound)):
            i = lo + j
            bound[j, c_ids == q_ids[i]] = -np.inf
            n = min(k, len(c_ids))
            first = np.argpartition(-bound[j], n - 1)[:n]
            first = first[np.isfinite(bound[j, first])]
            if not len(first):
                continue
            least = exact(q[i], c[first]).min() if len(first) == k else -np.inf
            left = np.flatnonzero(np.isfinite(bound[j]) & (bound[j] >= least - slack[i]))
            for a, b in stats[1:]:
                left = left[b[left] @ a[i] >= least - slack[i]]
            score = exact(q[i], c[left])
            top = np.lexsort((c_ids[left], -score))[:k]
            yield from zip([q_ids[i]] * len(top), [keys[i]] * len(top), c_ids[left[top]], score[top], strict=True)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows of `vectors` for each row of `queries` (vec_id, embedding).

    Components x count as floor(scale * x), in double precision.
    """
    def clean(df):
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"), "embedding").where(
            "vec_id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf'))").select("vec_id", F.size("v").alias("d"), F.col("v").cast("array<double>").alias("v"))

    cands, asked = clean(vectors), clean(queries).dropDuplicates(["vec_id", "v"])
    n_c, n_q = max(1, -(-cands.count() // CANDIDATES)), max(1, -(-asked.count() // QUERIES))
    block = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n))
    left = cands.withColumn("cb", block(n_c)).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))))
    right = asked.withColumn("key", F.xxhash64("v")).withColumn("qb", block(n_q)).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_c - 1).cast("long"))))

    def cell(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(c) and len(q):
            found = list(_best(q["vec_id"].to_numpy(), q["key"].to_numpy(), np.stack(q["v"].to_numpy()), c["vec_id"].to_numpy(), np.stack(c["v"].to_numpy()), k))
        return pd.DataFrame(found, columns=["query_id", "key", "vec_id", "score"]).astype("int64")

    cells = left.groupBy("d", "qb", "cb").cogroup(right.groupBy("d", "qb", "cb")).applyInPandas(cell, "query_id long, key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
