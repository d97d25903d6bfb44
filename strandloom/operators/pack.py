"""The edge table of a de Bruijn graph: distinct k-mers, their reverse complements and `$`-padded dummies, flagged.

Edges are gathered by their middle, the k - 2 symbols without the first and the last: a middle's edges are a mask of 16 bits, from which both
flags can be told. Shuffles: one for the middles, one in which each node learns whether edges leave and enter it (both kinds of
dummy come from that single aggregation, with partial sums before the shuffle), and a small one for the distinct dummies. With reverse complements,
only one strand of each edge and node is shuffled. Middles are written once to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kmer as K
from .lineage import cut, forget


def edge_set(kmers: DataFrame, revcomps: bool = True) -> DataFrame:
    """Distinct k-mers, with their reverse complements if asked for."""
    e = kmers.select("kmer")
    return (e.union(e.select(K.revcomp("kmer"))) if revcomps else e).distinct()


def _ends(edges: DataFrame, k: int) -> DataFrame:
    both = F.array(F.struct(K.start_node("kmer", k).alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(K.end_node("kmer", k).alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return edges.select(F.inline(both)).groupBy("node").agg(F.max("out").alias("out"), F.max("into").alias("into"))


def source_nodes(edges: DataFrame, k: int) -> DataFrame:
    """Nodes that no edge enters."""
    return _ends(edges, k).where("into = 0").select("node")


def sink_nodes(edges: DataFrame, k: int) -> DataFrame:
    """Nodes that no edge leaves."""
    return _ends(edges, k).where("out = 0").select("node")


def in_dummies(sources: DataFrame, k: int, all_dummies: bool = True) -> DataFrame:
    """Padded edges that lead from the root to each source node; without all_dummies only the last of each path."""
    return _padded(sources, k, all_dummies).distinct()


def _padded(sources: DataFrame, k: int, all_dummies: bool) -> DataFrame:
    lengths = F.sequence(F.lit(1), F.lit(k - 1)) if all_dummies else F.array(F.lit(k - 1))
    each = sources.select("node", F.explode(lengths).alias("n"))
    return each.select(F.lpad(F.substring(F.col("node"), F.lit(1), F.col("n") - 1), k - 1, K.DUMMY).alias("node"), F.substring(F.col("node"), F.col("n"), F.lit(1)).alias("w"))


def _code(c: Column) -> Column:
    """0 to 3 for a, c, g, t; a complement is 3 less it."""
    return F.instr(F.lit(K.SYMBOLS), c) - 1


def _symbol(code: str) -> str:
    return f"substring('{K.SYMBOLS}', {code} + 1, 1)"


def _gathered(df: DataFrame, name: str, width: int, compact: bool) -> DataFrame:
    """The bits of each label. Compact: labels are shuffled with two bits a symbol."""
    if not compact:
        return df.groupBy(name).agg(F.bit_or("bit").alias("bit"))
    sums = df.select(K.packed(name, width).alias("packed"), "bit").groupBy("packed").agg(F.bit_or("bit").alias("bit"))
    return sums.select(K.label("packed", width).alias(name), "bit")


def middles(kmers: DataFrame, k: int, revcomps: bool = True, compact: bool = False) -> DataFrame:
    """(mid, mask): bit 4x + w tells whether there is an edge of first symbol x and last symbol w round a middle. With revcomps, of a middle and its reverse complement the lesser stands for both."""
    e = kmers.select(F.substring("kmer", 2, k - 2).alias("mid"), _code(F.substring("kmer", 1, 1)).alias("x"), _code(F.substring("kmer", k, 1)).alias("w"))
    own = "shiftleft(1, 4 * x + w)"
    if not revcomps:
        return _gathered(e.select("mid", F.expr(own).alias("bit")), "mid", k - 2, compact).withColumnRenamed("bit", "mask")
    other = "shiftleft(1, 4 * (3 - w) + 3 - x)"
    e = e.withColumn("rc", K.revcomp("mid"))
    e = e.select(F.least("mid", "rc").alias("mid"), F.expr(f"case when mid < rc then {own} when mid > rc then {other} else {own} | {other} end").alias("bit"))
    return _gathered(e, "mid", k - 2, compact).withColumnRenamed("bit", "mask")


def _edges(mids: DataFrame, revcomps: bool) -> DataFrame:
    """(mid, mask, x, w) of each edge of the strand that is there."""
    each = mids.select("mid", "mask", F.explode(F.expr("filter(sequence(0, 15), i -> shiftright(mask, i) & 1 = 1)")).alias("i"))
    return each.selectExpr("mid", "mask", "shiftright(i, 2) as x", "i & 3 as w", *(["translate(reverse(mid), 'acgt', 'tgca') as rc"] if revcomps else []))


def _standard(mids: DataFrame, revcomps: bool) -> DataFrame:
    """Rows (node, w, node_first, end_first) of the edges, on both strands with revcomps."""
    out, into = "shiftright(mask, 4 * x) & 15", f"mask & shiftleft({0x1111}, w)"
    own = f"named_struct('node', concat({_symbol('x')}, mid), 'w', {_symbol('w')}, 'node_first', cast(({out}) & (shiftleft(1, w) - 1) = 0 as int), 'end_first', cast(({into}) & (shiftleft(1, 4 * x) - 1) = 0 as int))"
    if not revcomps:
        return _edges(mids, False).selectExpr(f"inline(array({own}))")
    # on the other strand an edge's first symbol is the complement of its last one here: the order turns round
    other = f"named_struct('node', concat({_symbol('3 - w')}, rc), 'w', {_symbol('3 - x')}, 'node_first', cast(shiftright({into}, 4 * x + 4) = 0 as int), 'end_first', cast(shiftright({out}, w + 1) = 0 as int))"
    return _edges(mids, True).selectExpr(f"inline(if(mid = rc, array({own}), array({own}, {other})))")


def _dummy_ends(mids: DataFrame, k: int, revcomps: bool, compact: bool) -> tuple[DataFrame, DataFrame]:
    """The sources and the sinks (node)."""
    if not revcomps:
        ends = _ends(_edges(mids, False).selectExpr(f"concat({_symbol('x')}, mid, {_symbol('w')}) as kmer"), k)
        return ends.where("into = 0").select("node"), ends.where("out = 0").select("node")
    # an edge leaves its start node and, on the other strand, its end node's reverse complement; each node is named by the lesser of both strands, with a bit for each that an edge leaves
    starts = _edges(mids, True).selectExpr(f"inline(array(named_struct('own', concat({_symbol('x')}, mid), 'other', concat(rc, {_symbol('3 - x')})), named_struct('own', concat({_symbol('3 - w')}, rc), 'other', concat(mid, {_symbol('w')}))))")
    left = _gathered(starts.selectExpr("least(own, other) as node", "case when own < other then 1 when own > other then 2 else 3 end as bit"), "node", k - 1, compact).where("bit < 3")
    rc = K.revcomp("node")
    ends = cut(left.select(F.when(F.col("bit") == 1, F.col("node")).otherwise(rc).alias("node")), "sources")
    return ends, ends.select(rc.alias("node"))


def pack(kmers: DataFrame, k: int, revcomps: bool = True, all_dummies: bool = True) -> DataFrame:
    """Rows (tag, node, w, node_first, end_first) of the graph, in no particular order. kmers may repeat."""
    return _packed(cut(middles(kmers, k, revcomps), "middles"), k, revcomps, all_dummies, False)


def written(kmers: DataFrame, k: int, revcomps: bool = True, all_dummies: bool = True, compact: bool = False) -> DataFrame:
    """The same as a table of the shared folder, from which the middles go again. Compact: shuffles take less disk and more time."""
    mids = cut(middles(kmers, k, revcomps, compact), "middles")
    out = cut(_packed(mids, k, revcomps, all_dummies, compact), "edges")
    forget(mids)
    return out


def _packed(mids: DataFrame, k: int, revcomps: bool, all_dummies: bool, compact: bool) -> DataFrame:
    sources, sinks = _dummy_ends(mids, k, revcomps, compact)
    # a padded node's edges are dummies alone, and the nodes that these reach have no other edge in; a sink has no other edge out
    padded = _padded(sources, k, all_dummies).groupBy("node").agg(F.sort_array(F.collect_set("w")).alias("ws")).select("node", F.posexplode("ws").alias("at", "w"))
    one = F.lit(1)
    tagged = lambda df, tag, first, end: df.select(F.lit(tag).alias("tag"), "node", "w", first.alias("node_first"), end.alias("end_first"))
    return tagged(_standard(mids, revcomps), "standard", F.col("node_first"), F.col("end_first")) \
        .unionByName(tagged(sinks.select("node", F.lit(K.DUMMY).alias("w")), "out_dummy", one, one)) \
        .unionByName(tagged(padded, "in_dummy", (F.col("at") == 0).cast("int"), one))
