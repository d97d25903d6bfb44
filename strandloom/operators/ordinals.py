"""Global positions without a single partition.

Rows are bucketed by the first symbols of the reversed node, an order-preserving prefix that never splits a node. Each
bucket's totals (at most 5^prefix rows, whatever the size of the data) are summed up in a table that is small by
construction and broadcast; what is left is a window inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kmer as K

#: Symbols of a bucket's prefix, and rows beyond which a bucket gets a longer one.
PREFIX, ROWS = 5, 1 << 22


def with_bucket(edges: DataFrame, k: int, prefix: int = PREFIX, rows: int = ROWS) -> DataFrame:
    """Adds `bucket`, a prefix of the reversed node. Buckets of too many rows are cut by more symbols, so that a task's share is bounded as the data grows."""
    back, least = F.reverse("node"), min(prefix, k - 1)
    short = F.substring(back, 1, least)
    if least == k - 1:
        return edges.withColumn("bucket", short)
    counts = edges.groupBy(short.alias("_short")).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)  # at most 5^prefix rows
    more = F.ceil(F.log(F.col("_n") / rows) / F.log(F.lit(4.0))).cast("int") + 1
    lengths = counts.select("_short", F.least(F.lit(least) + more, F.lit(k - 1)).alias("_length"))
    found = edges.withColumn("_short", short).join(F.broadcast(lengths), "_short", "left")
    return found.withColumn("bucket", F.when(F.col("_length").isNull(), F.col("_short")).otherwise(F.substring(back, F.lit(1), F.col("_length")))).drop("_short", "_length")


def _offsets(totals: DataFrame, sums: list[str]) -> DataFrame:
    """What comes before each bucket: one row for each bucket, some 5^PREFIX and one for every ROWS / 16 edges at most."""
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("bucket", *(F.coalesce(F.sum(f"_total_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums), *([F.lag("_last").over(Window.orderBy("bucket")).alias("_prev_last")] if "_last" in totals.columns else []))


def running(edges: DataFrame, k: int, sums: dict[str, Column], prefix: int = PREFIX) -> DataFrame:
    """Adds to each row, for each name, the sum of its column over all rows before it and itself, in graph order."""
    b = with_bucket(edges, k, prefix).withColumns({f"_{n}": c.cast("long") for n, c in sums.items()})
    offsets = _offsets(b.groupBy("bucket").agg(*(F.sum(f"_{n}").alias(f"_total_{n}") for n in sums)), list(sums))
    within = Window.partitionBy("bucket").orderBy(F.reverse("node"), "w").rowsBetween(Window.unboundedPreceding, 0)
    out = b.join(F.broadcast(offsets), "bucket").withColumns({n: F.sum(f"_{n}").over(within) + F.col(f"_before_{n}") for n in sums})
    return out.drop(*(f"_{n}" for n in sums), *(f"_before_{n}" for n in sums), "bucket")


def carried(edges: DataFrame, k: int, value: Column, forward: bool, prefix: int = PREFIX) -> Column | DataFrame:
    """Adds `carried`: the last non-null value among the rows up to this one, or with forward the first from it on."""
    b = with_bucket(edges, k, prefix).withColumn("_v", value)
    pick = F.min if forward else F.max
    # values are positions, so the nearest one is the least from here on or the greatest up to here
    tiny = b.groupBy("bucket").agg(pick("_v").alias("_of"))
    span = (1, Window.unboundedFollowing) if forward else (Window.unboundedPreceding, -1)
    tiny = tiny.select("bucket", pick("_of").over(Window.orderBy("bucket").rowsBetween(*span)).alias("_else"))
    span = (0, Window.unboundedFollowing) if forward else (Window.unboundedPreceding, 0)
    within = Window.partitionBy("bucket").orderBy(F.reverse("node"), "w").rowsBetween(*span)
    return b.join(F.broadcast(tiny), "bucket").withColumn("carried", F.coalesce(pick("_v").over(within), "_else")).drop("bucket", "_v", "_else")


def index(edges: DataFrame, k: int, prefix: int = PREFIX, compact: bool = False) -> DataFrame:
    """Adds f, pos, node_id, end_node and lcs to an edge table: one aggregation of buckets and one sort of each. Compact: nodes are dealt out with two bits a symbol, which takes less disk and more time."""
    b = with_bucket(edges, k, prefix).withColumn("_back", F.reverse("node"))
    totals = b.groupBy("bucket").agg(F.count("*").alias("_total_pos"), F.sum("node_first").alias("_total_node_id"), F.max("_back").alias("_last"))
    at, back = b.drop("node"), ["_back"]
    if compact:
        plain, back = F.locate(K.DUMMY, F.col("_back")) - 1, ["_packed", "_plain"]  # the order of _back: a padded label comes before those that it begins
        at = at.withColumns({"_packed": K.packed("_back", k - 1), "_plain": F.when(plain >= 0, plain).otherwise(k - 1)}).drop("_back").repartition("bucket")
        at = at.withColumn("_back", F.rpad(F.substring(K.label("_packed", k - 1), F.lit(1), F.col("_plain")), k - 1, K.DUMMY))
    order = Window.partitionBy("bucket").orderBy(*back, "w")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumns({"pos": F.row_number().over(order), "node_id": F.sum("node_first").over(so_far), "_prev": F.lag("_back").over(order)})
    at = at.join(F.broadcast(_offsets(totals, ["pos", "node_id"])), "bucket")
    at = at.withColumns({"pos": F.col("pos") + F.col("_before_pos") - 1, "node_id": F.col("node_id") + F.col("_before_node_id") - 1, "_prev": F.coalesce("_prev", "_prev_last"), "node": F.reverse("_back")})
    lcs = F.when(F.col("_prev").isNull(), 0).when(F.col("_prev") == F.col("_back"), k - 1).otherwise(K.common_prefix("_back", "_prev", k - 1)).cast("long")
    at = at.withColumns({"f": K.symbol_code(F.substring("_back", 1, 1)), "end_node": F.when(F.col("w") != K.DUMMY, F.concat(F.substring("node", 2, k), "w")), "lcs": lcs})
    return at.select(*edges.columns, "pos", "node_id", "f", "end_node", "lcs")
