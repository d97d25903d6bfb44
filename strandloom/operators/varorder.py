"""Navigation at any shorter order k' of a graph (order k-1 is the full one).

A hypernode of order k' is a maximal run of edges whose nodes share their last k' symbols; nodes with `$` among those are
runs of their own. That is a key of each row, so widening, splitting and following are aggregations and equi-joins on it,
not searches over a global order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kmer as K
from . import ordinals
from .graph import Graph


def hyper_key(node: Column | str, order: int) -> Column:
    node = F.col(node) if isinstance(node, str) else node
    if order < 1:
        return F.lit("")
    suffix = F.right(node, F.lit(order))
    return F.when(F.contains(suffix, F.lit(K.DUMMY)), node).otherwise(suffix)


def shorter(g: Graph, order: int) -> DataFrame:
    """(hkey, first, last): the hypernodes of this order."""
    return g.edges.groupBy(hyper_key("node", order).alias("hkey")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))


def longer(g: Graph, order: int, to: int) -> DataFrame:
    """(hkey, inner, first, last): each hypernode of an order, cut into those of a longer one."""
    return g.edges.groupBy(hyper_key("node", order).alias("hkey"), hyper_key("node", to).alias("inner")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))


def maxlen(g: Graph, order: int) -> DataFrame:
    """(hkey, node, first, last): a full-order node of each hypernode, the one that owns its first edge."""
    firsts = shorter(g, order).select("hkey", F.col("first").alias("pos"))
    owned = g.edges.select("pos", "node_id").join(firsts, "pos")
    return owned.select("hkey", "node_id").join(g.nodes(), "node_id").select("hkey", "node", "first", "last")


def maxlen_symbol(g: Graph, order: int) -> DataFrame:
    """(hkey, x, pos, node): a full-order node with an edge x in each hypernode, of the last leading x edge or else the last other."""
    rank = F.struct("end_first", "pos", "node")
    best = g.edges.where(F.col("w") != K.DUMMY).groupBy(hyper_key("node", order).alias("hkey"), F.col("w").alias("x")).agg(F.max(rank).alias("m"))
    return best.select("hkey", "x", "m.pos", "m.node")


def outgoing(g: Graph, order: int) -> DataFrame:
    """(hkey, x, target): the hypernode of the same order that an edge x leads to."""
    reached = F.concat(F.substring("node", 2, g.k), "x")
    return maxlen_symbol(g, order).select("hkey", "x", hyper_key(reached, order).alias("target"))


def lastchar(g: Graph, order: int) -> DataFrame:
    """(hkey, lastchar): the code of each hypernode's last symbol; at order 0 there is none."""
    return shorter(g, order).select("hkey", F.when(F.length("hkey") > 0, K.symbol_code(F.right("hkey", F.lit(1)))).alias("lastchar"))


def backward(g: Graph, order: int) -> DataFrame:
    """(hkey, pred): hypernodes of this order with an edge into each one without `$`. Below full order."""
    if not 1 <= order < g.k - 1:
        raise ValueError("the order must be positive and below the full one")
    made = F.concat(F.right("node", F.lit(order - 1)) if order > 1 else F.lit(""), F.col("w"))
    e = g.edges.where(F.col("w") != K.DUMMY).select(made.alias("hkey"), hyper_key("node", order).alias("pred")).where(~F.contains("hkey", F.lit(K.DUMMY)))
    there = g.edges.select(hyper_key("node", order).alias("hkey")).distinct()
    return e.distinct().join(there, "hkey", "left_semi")


def quantized(lcs: Column | str, levels: list[int]) -> Column:
    """The largest of the levels that is not above the value, or 0."""
    if not levels or levels != sorted(levels):
        raise ValueError("levels must be ascending")
    lcs = F.col(lcs) if isinstance(lcs, str) else lcs
    out = F.lit(0)
    for level in levels:
        out = F.when(lcs >= level, level).otherwise(out)
    return out.cast("long")


def thresholded(lcs: Column | str, least: int) -> Column:
    if least < 1:
        raise ValueError("the threshold must be positive")
    lcs = F.col(lcs) if isinstance(lcs, str) else lcs
    return F.when(lcs < least, 0).otherwise(lcs).cast("long")


def nearest_at_most(g: Graph, c: int) -> DataFrame:
    """(pos, prev_lte, next_lte), counted from 1: the nearest rows up to and from each one whose lcs is at most c; 0 and the number of rows plus 1 if none."""
    hit = F.when(F.col("lcs") <= c, F.col("pos") + 1)
    back = ordinals.carried(g.edges.select("pos", "node", "w", "lcs"), g.k, hit, False).withColumnRenamed("carried", "prev_lte")
    both = ordinals.carried(back, g.k, hit, True)
    total = g.edges.agg((F.count("*") + 1).alias("total"))
    return both.join(F.broadcast(total)).select("pos", F.coalesce("prev_lte", F.lit(0)).alias("prev_lte"), F.coalesce("carried", "total").alias("next_lte"))
