"""Queries of navigation at shorter orders."""

from ..operators import varorder as V
from .base import SHORT, graph, graph_sql, hkey_sql

_K, _LOW, _HIGH, _LEVELS, _LEAST, _AT_MOST = SHORT, 3, 5, [1, 3, 5], 4, 3

QUERIES = {
    "lcs_quantized": lambda s, d: graph(s, d).edges.select("pos", V.quantized("lcs", _LEVELS).alias("lcs_q")),
    "lcs_threshold": lambda s, d: graph(s, d).edges.select("pos", V.thresholded("lcs", _LEAST).alias("lcs_t")),
    "lcs_prev_next_lte": lambda s, d: V.nearest_at_most(graph(s, d), _AT_MOST),
    "lcs_range_lte": lambda s, d: graph(s, d).edges.where(f"lcs <= {_AT_MOST} and pos between 100 and 5000").select("pos", "lcs"),
    "hyper_shorter": lambda s, d: V.shorter(graph(s, d), _HIGH),
    "hyper_longer": lambda s, d: V.longer(graph(s, d), _LOW, _HIGH),
    "hyper_maxlen": lambda s, d: V.maxlen(graph(s, d), _HIGH),
    "hyper_maxlen_symbol": lambda s, d: V.maxlen_symbol(graph(s, d), _HIGH),
    "hyper_outgoing": lambda s, d: V.outgoing(graph(s, d), _HIGH),
    "hyper_lastchar": lambda s, d: V.lastchar(graph(s, d), _HIGH),
    "hyper_backward": lambda s, d: V.backward(graph(s, d), _HIGH),
}


def _sql(what: str) -> str:
    return f"WITH {graph_sql()}, h AS (SELECT *, {hkey_sql(_LOW)} AS low, {hkey_sql(_HIGH)} AS hkey FROM g) {what}"


_X = "x AS (SELECT hkey, w AS x, pos, node FROM h WHERE w <> '$' QUALIFY row_number() OVER (PARTITION BY hkey, w ORDER BY end_first DESC, pos DESC) = 1)"
SQL = {
    "lcs_quantized": _sql(f"SELECT pos, CAST(coalesce(list_max(list_filter({_LEVELS}, lambda l: l <= lcs)), 0) AS BIGINT) AS lcs_q FROM g"),
    "lcs_threshold": _sql(f"SELECT pos, CAST(CASE WHEN lcs < {_LEAST} THEN 0 ELSE lcs END AS BIGINT) AS lcs_t FROM g"),
    "lcs_prev_next_lte": _sql(f"SELECT pos, coalesce(max(CASE WHEN lcs <= {_AT_MOST} THEN pos + 1 END) OVER (ORDER BY pos), 0) AS prev_lte, coalesce(min(CASE WHEN lcs <= {_AT_MOST} THEN pos + 1 END) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), count(*) OVER () + 1) AS next_lte FROM g"),
    "lcs_range_lte": _sql(f"SELECT pos, lcs FROM g WHERE lcs <= {_AT_MOST} AND pos BETWEEN 100 AND 5000"),
    "hyper_shorter": _sql("SELECT hkey, min(pos) AS first, max(pos) AS last FROM h GROUP BY hkey"),
    "hyper_longer": _sql("SELECT low AS hkey, hkey AS inner, min(pos) AS first, max(pos) AS last FROM h GROUP BY low, hkey"),
    "hyper_maxlen": _sql("SELECT hkey, node, (SELECT min(pos) FROM g WHERE g.node = m.node) AS first, (SELECT max(pos) FROM g WHERE g.node = m.node) AS last FROM (SELECT hkey, arg_min(node, pos) AS node FROM h GROUP BY hkey) m"),
    "hyper_maxlen_symbol": _sql(f", {_X} SELECT * FROM x"),
    "hyper_outgoing": _sql(f", {_X} SELECT hkey, x, {hkey_sql(_HIGH, '(substr(node, 2) || x)')} AS target FROM x"),
    "hyper_lastchar": _sql("SELECT hkey, instr('$acgt', right(hkey, 1)) - 1 AS lastchar FROM h GROUP BY hkey"),
    "hyper_backward": _sql(f"SELECT DISTINCT right(node, {_HIGH - 1}) || w AS hkey, hkey AS pred FROM h WHERE w <> '$' AND instr(right(node, {_HIGH - 1}), '$') = 0 AND right(node, {_HIGH - 1}) || w IN (SELECT hkey FROM h)"),
}
