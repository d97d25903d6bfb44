"""The packed form of a graph: five bits an edge, twelve edges a 64-bit word, and a footer of running counts and k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kmer as K
from .lineage import cut

#: Fixed values of the format: edges in a word, bits in an edge.
PER_WORD, BITS = 12, 5


def words(indexed: DataFrame) -> DataFrame:
    """(block_no, word): twelve edges a word, the first highest; the last word is left-aligned."""
    bits = (K.symbol_code("w") * 4 + F.col("node_first") * 2 + F.col("end_first")).cast("long")
    shifted = F.expr(f"shiftleft(_edge, cast({BITS} * ({PER_WORD - 1} - pos % {PER_WORD}) as int))")
    return indexed.select(bits.alias("_edge"), "pos").select(F.floor(F.col("pos") / PER_WORD).alias("block_no"), shifted.alias("_part")).groupBy("block_no").agg(F.sum("_part").alias("word"))


def f_table(edges: DataFrame) -> DataFrame:
    """(f, n, running) for the five symbols: how many rows have a node that ends so, and how many end so or lower."""
    spark = edges.sparkSession
    n = edges.groupBy(K.symbol_code(F.right("node", F.lit(1))).alias("f")).agg(F.count("*").alias("n"))
    five = spark.range(5).select(F.col("id").alias("f")).join(F.broadcast(n), "f", "left").select("f", F.coalesce("n", F.lit(0)).alias("n"))
    return five.withColumn("running", F.sum("n").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, 0)))


def unpack(words: DataFrame, n_edges: int | None = None) -> DataFrame:
    """(pos, w, node_first, end_first) of every packed edge; n_edges cuts off the last word's padding."""
    each = words.select("block_no", "word", F.explode(F.sequence(F.lit(0), F.lit(PER_WORD - 1))).alias("j"))
    each = each.select((F.col("block_no") * PER_WORD + F.col("j")).alias("pos"), F.expr(f"shiftright(word, {BITS} * ({PER_WORD - 1} - j)) & 31").alias("_edge"))
    if n_edges is not None:
        each = each.where(F.col("pos") < n_edges)
    return each.select("pos", F.substring(F.lit(K.ALPHABET), (F.shiftright("_edge", 2) + 1).cast("int"), F.lit(1)).alias("w"), F.shiftright("_edge", 1).bitwiseAND(1).cast("int").alias("node_first"), F.col("_edge").bitwiseAND(1).cast("int").alias("end_first"))


#: Positions in a slice, whose symbol counts are summed up on their own.
SLICE = 1 << 20


def _ranked(rows: DataFrame, of: dict[str, Column]) -> DataFrame:
    """Adds to rows (pos, ...), for each name, how many rows up to this one its condition holds for; slices of positions are summed up in a broadcast table of one row each."""
    b = rows.withColumn("_slice", F.floor(F.col("pos") / SLICE)).withColumns({f"_{n}": c.cast("long") for n, c in of.items()})
    totals = b.groupBy("_slice").agg(*(F.sum(f"_{n}").alias(f"_all_{n}") for n in of))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_slice", *(F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in of))
    within = Window.partitionBy("_slice").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = b.join(F.broadcast(offsets), "_slice").withColumns({n: F.sum(f"_{n}").over(within) + F.col(f"_before_{n}") for n in of})
    return out.select(*rows.columns, *of)


def labelled(rows: DataFrame, running: list[int], k: int) -> DataFrame:
    """(tag, node, w, node_first, end_first) of unpacked edges (pos, w, node_first, end_first), with the running symbol counts of their file.

    The n-th leading edge with a symbol enters the n-th node that ends with it, which gives each node its predecessor. Labels
    double in length each round: a node's is that of the node as many steps back, followed by its own.
    """
    bounds = [(0, running[0]), *zip(running[:-1], running[1:], strict=True)]
    f = F.coalesce(*(F.when((F.col("pos") >= lo) & (F.col("pos") < hi), F.lit(K.ALPHABET[i])) for i, (lo, hi) in enumerate(bounds)))
    lead = lambda c: (F.col("w") == c) & (F.col("end_first") == 1)
    ends = lambda c: (F.col("f") == c) & (F.col("node_first") == 1)
    names = list(enumerate(K.SYMBOLS))
    ranked = cut(_ranked(rows.withColumn("f", f), {"node_id": F.col("node_first"), **{f"e{i}": lead(c) for i, c in names}, **{f"n{i}": ends(c) for i, c in names}}), "ranked")
    pick = lambda by, x: F.coalesce(*(F.when(F.col(by) == c, F.col(f"{x}{i}")) for i, c in names))
    nodes = ranked.where("node_first = 1").select("node_id", "f", pick("f", "n").alias("rank"))
    into = ranked.where("end_first = 1 and w <> '$'").select(F.col("w").alias("f"), pick("w", "e").alias("rank"), F.col("node_id").alias("back"))
    now, size = cut(nodes.join(into, ["f", "rank"], "left").select("node_id", F.col("f").alias("label"), "back"), "labels"), 1
    if not now.where("back is null and label <> '$'").isEmpty():
        raise ValueError("a node without predecessor: only files with all dummies can be read back")
    while size < k - 1:
        other = now.select(F.col("node_id").alias("back"), F.col("label").alias("before"), F.col("back").alias("back2"))
        now, size = cut(now.join(other, "back", "left").select("node_id", F.concat(F.coalesce("before", F.lit("")), "label").alias("label"), F.col("back2").alias("back")), "labels"), size * 2
    label = now.select("node_id", F.lpad(F.right("label", F.lit(k - 1)), k - 1, K.DUMMY).alias("node"))
    tag = F.when(F.col("w") == K.DUMMY, "out_dummy").when(F.contains("node", F.lit(K.DUMMY)), "in_dummy").otherwise("standard")
    return ranked.join(label, "node_id").select(tag.alias("tag"), "node", "w", "node_first", "end_first")


def lcs_words(indexed: DataFrame) -> DataFrame:
    """(block_no, word): the common suffix lengths as bytes, eight to a little-endian word."""
    part = F.expr("shiftleft(lcs, cast(8 * (pos % 8) as int))")
    return indexed.select(F.floor(F.col("pos") / 8).alias("block_no"), part.alias("_part")).groupBy("block_no").agg(F.sum("_part").alias("word"))
