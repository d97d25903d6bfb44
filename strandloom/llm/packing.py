"""Best-fit packing of documents into bins of a fixed number of tokens, under conflicts.

No bin holds two documents of one source or of one duplicate cluster (equal word sequences, unless the input names
clusters, as with near copies found before). A document longer than a bin is cut into full pieces, each a bin of its own, and a rest. Documents are dealt by
a hash into shards of about SHARD pieces, whose number grows with the input; inside a shard, pieces go from the largest to
the smallest. Bins are held by residual, in order; each residual has a bitmap of its bins, each source and each cluster a
bitmap of the bins that hold it. The search begins at the least residual that fits and goes on to the next until a bin is
left when those of the piece's source and cluster are taken out: the tightest compatible bin. It has no limit of steps; a
new bin is opened only if none is compatible.

A hot source is spread over all shards. Only narrow rows (no texts) are shuffled, equal rows as one with their number. The
result depends on the rows alone, not on how they are dealt into partitions.

Nulls: a null text is empty; a null source, like any other, is one source; null ids are packed as any. A document without
words gets one row whose bin and offset are null. Repeated rows are documents of their own and, being of one cluster, never
share a bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices, utf8, written
from .words import lowered, mixed, word_hashes, word_spans

CAPACITY, SHARD, AT_ONCE = 2048, 4096, 4 << 20


def sequence_hashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each text's word sequence, from its words' hashes and places."""
    place = (np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(h, place + np.uint64(1)), dtype=np.uint64)])
    return mixed(total[first[1:]] - total[first[:-1]], np.diff(first).astype(np.uint64))


def _sized(batches):
    for b in batches:
        at, data = utf8(b.column("text"))
        size, cluster = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in slices(at, AT_ONCE):
            low = lowered(data[at[lo] : at[hi]])
            own = at[lo : hi + 1] - at[lo]
            starts, ends, first = word_spans(low, own)
            size.append(np.diff(first))
            cluster.append(sequence_hashes(word_hashes(low, starts, ends), first).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(np.concatenate(size)), b.column("cluster") if "cluster" in b.schema.names else pa.array(np.concatenate(cluster))], names=["doc_id", "source", "n_tokens", "cluster"])


def sized(docs: DataFrame, cluster: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens (words), cluster and copies of each document: how many rows are equal in all of these.

    cluster names a column of numbers to take clusters from, such as group_id of the n-gram Jaccard join; its nulls are a cluster.
    """
    bounded(docs.sparkSession)
    named = [F.col(cluster).cast("long").alias("cluster")] if cluster else []
    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text", *named)
    keys = ["doc_id", "source", "n_tokens", "cluster"]
    return rows_.mapInArrow(_sized, "doc_id long, source string, n_tokens long, cluster long").groupBy(*keys).agg(F.count("*").alias("copies"))


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, in the order given."""
    of_residual: dict[int, int] = {}
    residuals: list[int] = []
    with_source: dict = {}
    with_cluster: dict = {}
    used: list[int] = []
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        barred = with_source.get(source, 0) | with_cluster.get(cluster, 0)
        chosen = -1
        for i in range(bisect_left(residuals, size), len(residuals)):
            if free := of_residual[residuals[i]] & ~barred:
                chosen = (free & -free).bit_length() - 1
                left = residuals[i]
                break
        if chosen < 0:
            chosen, left = len(used), capacity
            used.append(0)
        else:
            of_residual[left] ^= 1 << chosen
            if not of_residual[left]:
                del of_residual[left]
                residuals.pop(i)
        bins.append(chosen)
        offsets.append(used[chosen])
        used[chosen] += size
        if left := left - size:
            if left not in of_residual:
                of_residual[left] = 0
                insort(residuals, left)
            of_residual[left] |= 1 << chosen
        with_source[source] = with_source.get(source, 0) | 1 << chosen
        with_cluster[cluster] = with_cluster.get(cluster, 0) | 1 << chosen
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """doc_id, piece, n_tokens, bin_id and bin_offset for distinct rows (doc_id, source, n_tokens, cluster, copies)."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    pieces = written(pieces, "sized")
    each = pieces.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    cut = each.select("*", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_tokens") - 1, F.lit(0)), F.lit(capacity).cast("long"))).alias("piece", "start"))
    cut = cut.withColumn("n_tokens", F.least(F.col("n_tokens") - F.col("start"), F.lit(capacity)))
    of_row = F.col("copies") * F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1))
    n = max(1, -(-(pieces.agg(F.sum(of_row)).first()[0] or 0) // shard))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "piece", "cluster"), F.lit(n)))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["n_tokens", "doc_id", "piece", "copy", "cluster", "source"], ascending=[False, True, True, True, True, True], kind="stable")
        some = g[g["n_tokens"] > 0]
        bins, offsets = best_fit(some["n_tokens"].tolist(), some["source"].where(some["source"].notna(), None).tolist(), some["cluster"].tolist(), capacity)
        out = g[["doc_id", "piece", "n_tokens"]].copy()
        base = int(g["shard"].iloc[0]) << 32
        out["bin_id"] = pd.Series([base + b for b in bins], index=some.index, dtype="Int64")
        out["bin_offset"] = pd.Series(offsets, index=some.index, dtype="Int64")
        return out

    return dealt.groupBy("shard").applyInPandas(packed, "doc_id long, piece int, n_tokens long, bin_id long, bin_offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, cluster: str | None = None) -> DataFrame:
    """doc_id, piece, n_tokens, bin_id and bin_offset of each piece of each row of docs; see above for nulls, repeated rows and empty texts.

    Empty tables give empty results; very long texts are cut; of pieces of one size the one of the smaller id, piece and copy goes first; columns other than doc_id, source,
    text and the one that names clusters are ignored.
    """
    return pack(sized(docs, cluster), capacity, shard)
