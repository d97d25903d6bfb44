"""A repeatable workload on a graph and the time that each operation takes for it.

Operations here answer for a table of nodes at once, so the time of one is that of the table divided by its rows.
"""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import varorder
from .graph import Graph

log = logging.getLogger("strandloom")


def drawn(g: Graph, n: int = 50_000, seed: int = 0) -> DataFrame:
    """(node_id, node, x, order): n nodes at most, with the least hashes for this seed, a symbol and an order each."""
    h = lambda salt: F.xxhash64("node", F.lit(seed), F.lit(salt))
    nodes = g.starts().select("node_id", "node").orderBy(h(0), "node").limit(n)
    return nodes.select("node_id", "node", F.substring(F.lit("acgt"), (F.pmod(h(1), F.lit(4)) + 1).cast("int"), F.lit(1)).alias("x"), (F.pmod(h(2), F.lit(max(1, g.k - 2))) + 1).cast("int").alias("order"))


def timed(g: Graph, n: int = 50_000, seed: int = 0, order: int | None = None) -> dict[str, dict]:
    """Rows, seconds and nanoseconds a row of each operation over the drawn nodes."""
    from .lineage import cut

    asked = cut(drawn(g, n, seed), "workload")
    order = order or max(1, (g.k - 1) // 2)
    to = min(g.k - 1, order + 1)
    of_key = asked.select(varorder.hyper_key("node", order).alias("hkey"), "x").distinct()
    at = g.edges.join(asked.select("node_id"), "node_id", "left_semi").select("pos")
    runs = {
        "forward": lambda: g.forward().join(at, "pos", "left_semi"),
        "backward": lambda: g.backward().join(at, "pos", "left_semi"),
        "lastchar": lambda: g.labels().join(at, "pos", "left_semi").select("pos", "lastchar"),
        "outgoing": lambda: g.outgoing().join(asked.select("node_id", "x"), ["node_id", "x"], "left_semi"),
        "shorter": lambda: varorder.shorter(g, order).join(of_key, "hkey", "left_semi"),
        "longer": lambda: varorder.longer(g, order, to).join(of_key, "hkey", "left_semi"),
        "maxlen": lambda: varorder.maxlen(g, order).join(of_key, "hkey", "left_semi"),
        "maxlen_symbol": lambda: varorder.maxlen_symbol(g, order).join(of_key, ["hkey", "x"], "left_semi"),
        "hyper_lastchar": lambda: varorder.lastchar(g, order).join(of_key, "hkey", "left_semi"),
    }
    out = {}
    for name, run in runs.items():
        began = time.perf_counter()
        rows = run().count()
        took = time.perf_counter() - began
        out[name] = {"rows": rows, "seconds": round(took, 4), "ns_per_row": round(took * 1e9 / max(rows, 1))}
        log.debug("%s: %s", name, out[name])
    return out
