"""Navigation at full order. Every question is asked for all rows, or a table of them, at once, and is one equi-join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kmer as K
from . import ordinals, pack, packed, reads
from .lineage import cut


def indexed(kmers: DataFrame, k: int, revcomps: bool = True, all_dummies: bool = True, compact: bool = False) -> DataFrame:
    """The index of a graph that is read once: only the packed edges are written, and columns that aren't asked for aren't worked out. Compact: shuffles take less disk and more time."""
    return ordinals.index(pack.written(kmers, k, revcomps, all_dummies, compact), k, compact=compact)


@dataclass(frozen=True)
class Graph:
    """An indexed edge table (see ordinals.index) and its k."""

    edges: DataFrame
    k: int

    @classmethod
    def of_text(cls, docs: DataFrame, k: int, revcomps: bool = True, all_dummies: bool = True, text: str = "text") -> Graph:
        return cls.of_kmers(reads.kmers(reads.reads(docs, text), k), k, revcomps, all_dummies)

    @classmethod
    def of_kmers(cls, kmers: DataFrame, k: int, revcomps: bool = True, all_dummies: bool = True) -> Graph:
        """Packs and indexes once: both tables are written to the shared folder, so that every question reads the index as it is."""
        return cls(cut(indexed(kmers, k, revcomps, all_dummies), "index"), k)

    @classmethod
    def of_packed(cls, spark: SparkSession, path: str) -> Graph:
        """The graph of a packed file, with its labels made out again."""
        from ..sources.packed_file import footer, read_packed

        rows, k = read_packed(spark, path)
        return cls(cut(ordinals.index(cut(packed.labelled(rows, footer(path)[0], k), "edges"), k), "index"), k)

    def find(self, label: str) -> DataFrame:
        """(node_id, node, first, last) of the node with this label, in any case."""
        return self.nodes().where(F.col("node") == label.lower())

    @classmethod
    def load(cls, spark, path: str) -> Graph:
        return cls(spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/meta").first().k)

    def save(self, path: str) -> None:
        """Edges ordered by position in range partitions, so that position and node filters skip row groups; and a meta row."""
        self.edges.repartitionByRange("pos").sortWithinPartitions("pos").write.mode("overwrite").parquet(f"{path}/edges")
        self.edges.sparkSession.range(1).select(F.lit(self.k).alias("k")).write.mode("overwrite").parquet(f"{path}/meta")

    def nodes(self) -> DataFrame:
        """(node_id, node, first, last): each node's edge interval."""
        return self.edges.groupBy("node_id", "node").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))

    def starts(self) -> DataFrame:
        return self.edges.where("node_first = 1")

    def outdegree(self) -> DataFrame:
        """A node whose only edge is `$` has none."""
        return self.edges.groupBy("node_id", "node").agg(F.sum((F.col("w") != K.DUMMY).cast("long")).alias("outdegree"))

    def indegree(self) -> DataFrame:
        """Dummy edges count; the root has none."""
        into = self.edges.where("end_node is not null").groupBy(F.col("end_node").alias("node")).agg(F.count("*").alias("indegree"))
        return self.starts().select("node_id", "node").join(into, "node", "left").select("node_id", "node", F.coalesce("indegree", F.lit(0)).alias("indegree"))

    def outgoing(self) -> DataFrame:
        """(node_id, x, target_id): for each node and symbol, the node reached, or null."""
        asked = self.starts().select("node_id", "node", F.explode(F.array(*map(F.lit, K.SYMBOLS))).alias("x"))
        taken = self.edges.select("node", F.col("w").alias("x"), "end_node")
        to = self.starts().select(F.col("node").alias("end_node"), F.col("node_id").alias("target_id"))
        return asked.join(taken, ["node", "x"], "left").join(to, "end_node", "left").select("node_id", "x", "target_id")

    def predecessors(self) -> DataFrame:
        """(node_id, pred_id, first, last, x): each predecessor of each node, its interval and its first symbol."""
        into = self.edges.where("end_node is not null").select(F.col("end_node").alias("to"), "node_id")
        of = self.starts().select(F.col("node").alias("to"), F.col("node_id").alias("of_id"))
        ranges = self.nodes().select("node_id", "node", "first", "last")
        return into.join(of, "to").join(ranges, "node_id").select(F.col("of_id").alias("node_id"), F.col("node_id").alias("pred_id"), "first", "last", F.substring("node", 1, 1).alias("x"))

    def incoming(self) -> DataFrame:
        """(node_id, x, pred_id): for each node and first symbol, `$` included, the predecessor, or null."""
        asked = self.starts().select("node_id", F.explode(F.array(*map(F.lit, K.ALPHABET))).alias("x"))
        return asked.join(self.predecessors().select("node_id", "x", "pred_id"), ["node_id", "x"], "left")

    def forward(self) -> DataFrame:
        """(pos, to): the first edge of the node that each edge reaches; null after `$`."""
        to = self.starts().select(F.col("node").alias("end_node"), F.col("pos").alias("to"))
        return self.edges.select("pos", "end_node").join(to, "end_node", "left").select("pos", "to")

    def backward(self) -> DataFrame:
        """(pos, back): the first edge that enters each edge's node; 0 for the root's."""
        into = self.edges.where("end_first = 1 and end_node is not null").select(F.col("end_node").alias("node"), F.col("pos").alias("back"))
        return self.edges.select("pos", "node").join(into, "node", "left").select("pos", F.coalesce("back", F.lit(0)).alias("back"))

    def dump(self) -> DataFrame:
        """(pos, line): each edge's full label and both flags, as text."""
        return self.edges.select("pos", F.concat_ws(" ", F.concat("node", "w"), F.col("node_first").cast("string"), F.col("end_first").cast("string")).alias("line"))

    def labels(self) -> DataFrame:
        """(pos, node_label, edge_label, lastchar), upper case."""
        return self.edges.select("pos", F.upper("node").alias("node_label"), F.upper(F.concat("node", "w")).alias("edge_label"), F.col("f").alias("lastchar"))

    def symbol_ranks(self) -> DataFrame:
        """(pos, code, ord): code is 2 * symbol + minus flag; ord counts the edges of that code up to this one, from 1."""
        code = K.symbol_code("w") * 2 + 1 - F.col("end_first")
        e = self.edges.withColumn("code", code)
        ran = ordinals.running(e, self.k, {f"r{c}": F.col("code") == c for c in range(10)})
        return ran.select("pos", "code", F.element_at(F.array(*(F.col(f"r{c}") for c in range(10))), (F.col("code") + 1).cast("int")).alias("ord"))

    def next_edge(self) -> DataFrame:
        """(pos, next): the next leading edge with the same symbol after each edge; the number of edges if there is none, and the last edge is its own."""
        lead = lambda c: (F.col("w") == c) & (F.col("end_first") == 1)
        ran = ordinals.running(self.edges, self.k, {f"r{i}": lead(c) for i, c in enumerate(K.ALPHABET)})
        ran = ran.withColumn("n", F.element_at(F.array(*(F.col(f"r{i}") for i in range(5))), (K.symbol_code("w") + 1).cast("int")))
        after = ran.where("end_first = 1").select("w", (F.col("n") - 1).alias("n"), F.col("pos").alias("next"))
        total = self.edges.agg(F.count("*").alias("total"))
        found = ran.select("w", "n", "pos").join(after, ["w", "n"], "left").join(F.broadcast(total))
        return found.select("pos", F.when(F.col("pos") == F.col("total") - 1, F.col("pos")).otherwise(F.coalesce("next", "total")).alias("next"))

    def branches(self) -> DataFrame:
        """(pos, is_branch): the edge's node has several edges, or it is the first edge of a node that several edges enter."""
        out = self.edges.groupBy("node").agg(F.count("*").alias("n"))
        both = self.indegree().select("node", "indegree").join(out, "node")
        e = self.edges.select("pos", "node", "node_first").join(both, "node")
        return e.select("pos", ((F.col("n") > 1) | ((F.col("node_first") == 1) & (F.col("indegree") > 1))).alias("is_branch"))

    def stats(self) -> DataFrame:
        """One row: k, nodes, edges by kind, packed size and bits an edge."""
        count = lambda c: F.sum(c.cast("long"))
        of = lambda tag: count(F.col("tag") == tag)
        s = self.edges.agg(F.count("*").alias("n_edges"), count(F.col("node_first") == 1).alias("n_nodes"), of("standard").alias("n_standard"), of("in_dummy").alias("n_in_dummies"), of("out_dummy").alias("n_out_dummies"), count(F.col("end_first") == 0).alias("n_minus"))
        size = F.ceil(F.col("n_edges") / 12) * 8 + 48
        return s.select(F.lit(self.k).cast("long").alias("k"), "*", size.alias("packed_bytes"), F.round(size * 8 / F.col("n_edges"), 6).alias("bits_per_edge"))
