"""Queries of navigation at full order."""

from .base import graph, graph_sql

QUERIES = {
    "symbol_ranks": lambda s, d: graph(s, d).symbol_ranks(),
    "next_edge": lambda s, d: graph(s, d).next_edge(),
    "node_ranges": lambda s, d: graph(s, d).nodes(),
    "edge_forward": lambda s, d: graph(s, d).forward(),
    "edge_backward": lambda s, d: graph(s, d).backward(),
    "outdegree": lambda s, d: graph(s, d).outdegree(),
    "indegree": lambda s, d: graph(s, d).indegree(),
    "outgoing_by_symbol": lambda s, d: graph(s, d).outgoing(),
    "incoming_by_symbol": lambda s, d: graph(s, d).incoming(),
    "all_predecessors": lambda s, d: graph(s, d).predecessors().select("node_id", "pred_id", "first", "last"),
    "node_edge_labels": lambda s, d: graph(s, d).labels(),
    "branch_edges": lambda s, d: graph(s, d).branches(),
}

_N = "n AS (SELECT node_id, node, min(pos) AS first, max(pos) AS last FROM g GROUP BY node_id, node)"


def _sql(what: str) -> str:
    return f"WITH {graph_sql()}, {_N} {what}"


SQL = {
    "symbol_ranks": _sql("SELECT pos, code * 2 + 1 - end_first AS code, row_number() OVER (PARTITION BY code * 2 + 1 - end_first ORDER BY pos) AS ord FROM g"),
    "next_edge": _sql("SELECT pos, CASE WHEN pos = t - 1 THEN pos ELSE coalesce(nxt, t) END AS next FROM (SELECT pos, count(*) OVER () AS t, min(CASE WHEN end_first = 1 THEN pos END) OVER (PARTITION BY w ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM g)"),
    "node_ranges": _sql("SELECT * FROM n"),
    "edge_forward": _sql("SELECT g.pos, n.first AS to FROM g LEFT JOIN n ON n.node = g.end_node"),
    "edge_backward": _sql("SELECT g.pos, coalesce(b.pos, 0) AS back FROM g LEFT JOIN g b ON b.end_node = g.node AND b.end_first = 1"),
    "outdegree": _sql("SELECT node_id, node, count(*) FILTER (w <> '$') AS outdegree FROM g GROUP BY node_id, node"),
    "indegree": _sql("SELECT n.node_id, n.node, count(g.pos) AS indegree FROM n LEFT JOIN g ON g.end_node = n.node GROUP BY n.node_id, n.node"),
    "outgoing_by_symbol": _sql("SELECT n.node_id, x, t.node_id AS target_id FROM (SELECT *, unnest(['a', 'c', 'g', 't']) AS x FROM n) n LEFT JOIN g ON g.node = n.node AND g.w = x LEFT JOIN n t ON t.node = g.end_node"),
    "incoming_by_symbol": _sql("SELECT n.node_id, x, g.node_id AS pred_id FROM (SELECT *, unnest(['$', 'a', 'c', 'g', 't']) AS x FROM n) n LEFT JOIN g ON g.end_node = n.node AND left(g.node, 1) = x"),
    "all_predecessors": _sql("SELECT n.node_id, p.node_id AS pred_id, p.first, p.last FROM n JOIN g ON g.end_node = n.node JOIN n p ON p.node_id = g.node_id"),
    "node_edge_labels": _sql("SELECT pos, upper(node) AS node_label, upper(node || w) AS edge_label, f AS lastchar FROM g"),
    "branch_edges": _sql(", i AS (SELECT end_node AS node, count(*) AS c FROM g WHERE end_node IS NOT NULL GROUP BY end_node) SELECT g.pos, (n.last > n.first OR (g.node_first = 1 AND coalesce(i.c, 0) > 1)) AS is_branch FROM g JOIN n USING (node_id) LEFT JOIN i ON i.node = g.node"),
}
