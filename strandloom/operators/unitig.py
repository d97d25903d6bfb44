"""Unitigs: maximal chains of standard edges through nodes with one edge in and one out.

Pointer doubling: each edge holds an edge some steps back and the least edge on the way; every round the steps double by
one self-join, so a chain of n edges needs log2(n) rounds. Edges of isolated cycles never reach a head; once the steps
cover every cycle, each is cut at its least edge and runs once more as a chain. Lineage is cut in every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kmer as K
from .lineage import cut


def _links(edges: DataFrame, k: int) -> DataFrame:
    """(e, back): for each edge, the one before it in its chain, if any. Edges are named by their colexicographic key."""
    e = edges.select(F.concat(F.reverse(K.start_node("kmer", k)), K.edge_symbol("kmer", k)).alias("e"), K.start_node("kmer", k).alias("s"), K.end_node("kmer", k).alias("t"))
    ends = e.select(F.inline(F.array(F.struct(F.col("s").alias("n"), F.col("e").alias("out"), F.lit(None).cast("string").alias("into")), F.struct(F.col("t").alias("n"), F.lit(None).cast("string").alias("out"), F.col("e").alias("into")))))
    through = ends.groupBy("n").agg(F.count("out").alias("a"), F.count("into").alias("b"), F.max("out").alias("e"), F.max("into").alias("back")).where("a = 1 and b = 1")
    return e.select("e").join(through.select("e", "back"), "e", "left")


def _heads(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(e, head, steps) of all edges of chains, and (e, back, least) of those of cycles."""
    now = cut(links.select("e", F.col("back").alias("p"), F.when(F.col("back").isNull(), F.col("e")).alias("head"), F.when(F.col("back").isNull(), F.lit(0).cast("long")).alias("steps"), F.least("e", "back").alias("least"), F.lit(1).cast("long").alias("span")))
    left, span = now.where("head is null").count(), 1
    while left:
        open_ = now.where("head is null")
        other = now.select(F.col("e").alias("p"), F.col("p").alias("p2"), F.col("head").alias("head2"), F.col("steps").alias("steps2"), F.col("least").alias("least2"), F.col("span").alias("span2"))
        moved = open_.join(other, "p").select("e", F.col("p2").alias("p"), F.col("head2").alias("head"), (F.col("span") + F.col("steps2")).alias("steps"), F.least("least", "least2").alias("least"), (F.col("span") + F.col("span2")).alias("span"))
        now, span = cut(now.where("head is not null").unionByName(moved)), span * 2
        before, left = left, now.where("head is null").count()
        if left == before and span >= left:
            break
    return now.where("head is not null").select("e", "head", "steps"), now.where("head is null").select("e", "least")


def unitigs(edges: DataFrame, k: int) -> DataFrame:
    """(unitig_id, n_edges, label, is_cycle) over a table of distinct k-mers; unitig_id is the first edge's k-mer."""
    links = cut(_links(edges, k))
    chains, cycles = _heads(links)
    opened = links.join(cycles, "e").select("e", F.when(F.col("e") != F.col("least"), F.col("back")).alias("back"))
    rings, _ = _heads(opened)
    every = chains.withColumn("is_cycle", F.lit(False)).unionByName(rings.withColumn("is_cycle", F.lit(True)))
    chain = F.array_sort(F.collect_list(F.struct("steps", F.right("e", F.lit(1)).alias("w"))))
    by = every.groupBy("head", "is_cycle").agg(F.count("*").alias("n_edges"), chain.alias("c"))
    first = F.reverse(F.substring("head", 1, k - 1))
    return by.select(F.concat(first, F.right("head", F.lit(1))).alias("unitig_id"), "n_edges", F.concat(first, F.array_join("c.w", "")).alias("label"), "is_cycle")
