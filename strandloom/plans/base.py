"""What the registered queries share: their tables, their k, and the SQL of reads, edges and the indexed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import reads
from ..operators.graph import Graph

#: k of most queries, and of those that need many dummies and chains.
SHORT, LONG = 8, 12


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def distinct(spark: SparkSession, sf_dir: str, k: int = SHORT) -> DataFrame:
    return reads.distinct_kmers(reads.reads(docs(spark, sf_dir)), k)


def graph(spark: SparkSession, sf_dir: str, k: int = SHORT) -> Graph:
    return Graph.of_text(docs(spark, sf_dir), k)


def kmers_sql(k: int = SHORT) -> str:
    return f"""reads AS (SELECT regexp_replace(translate(text, 'ACGT', 'acgt'), '[^acgt]', '', 'g') AS s FROM documents),
occ AS (SELECT substr(s, i, {k}) AS kmer FROM (SELECT s, unnest(generate_series(1, length(s) - {k - 1})) AS i FROM reads WHERE length(s) >= {k})),
km AS (SELECT DISTINCT kmer FROM occ)"""


def edges_sql(k: int = SHORT, all_dummies: bool = True) -> str:
    return kmers_sql(k) + f""",
e AS (SELECT kmer FROM km UNION SELECT translate(reverse(kmer), 'acgt', 'tgca') FROM km),
src AS (SELECT substr(kmer, 1, {k - 1}) AS n FROM e EXCEPT SELECT substr(kmer, 2, {k - 1}) FROM e),
snk AS (SELECT substr(kmer, 2, {k - 1}) AS n FROM e EXCEPT SELECT substr(kmer, 1, {k - 1}) FROM e),
ind AS (SELECT DISTINCT lpad(substr(n, 1, l - 1), {k - 1}, '$') AS node, substr(n, l, 1) AS w FROM (SELECT n, unnest({f"range(1, {k})" if all_dummies else f"[{k - 1}]"}) AS l FROM src)),
allrows AS (SELECT 'standard' AS tag, substr(kmer, 1, {k - 1}) AS node, substr(kmer, {k}, 1) AS w FROM e
  UNION ALL SELECT 'out_dummy', n, '$' FROM snk UNION ALL SELECT 'in_dummy', node, w FROM ind),
edges AS (SELECT *, CAST(row_number() OVER (PARTITION BY node ORDER BY w) = 1 AS INTEGER) AS node_first,
  CAST(w = '$' OR row_number() OVER (PARTITION BY substr(node, 2), w ORDER BY reverse(node)) = 1 AS INTEGER) AS end_first FROM allrows)"""


def graph_sql(k: int = SHORT) -> str:
    return edges_sql(k) + f""",
idx AS (SELECT *, row_number() OVER o - 1 AS pos, CAST(sum(node_first) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS node_id,
  instr('$acgt', right(node, 1)) - 1 AS f, instr('$acgt', w) - 1 AS code, CASE WHEN w <> '$' THEN substr(node, 2) || w END AS end_node, lag(node) OVER o AS prev
  FROM edges WINDOW o AS (ORDER BY reverse(node), w)),
g AS (SELECT * EXCLUDE (prev), CAST(CASE WHEN prev IS NULL THEN 0 WHEN prev = node THEN {k - 1}
  ELSE len(list_filter(range(1, {k}), lambda i: right(node, i) = right(prev, i) AND instr(right(node, i), '$') = 0)) END AS BIGINT) AS lcs FROM idx)"""


def hkey_sql(order: int, node: str = "node") -> str:
    return f"(CASE WHEN instr(right({node}, {order}), '$') > 0 THEN {node} ELSE right({node}, {order}) END)"
