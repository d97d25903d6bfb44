"""Queries of the k-mer functions."""

from pyspark.sql import functions as F

from ..functions import kmer as K
from ..operators import reads
from .base import SHORT, distinct, docs, kmers_sql

_K = SHORT


def _over(columns):
    return lambda s, d: distinct(s, d).select("kmer", *columns())


QUERIES = {
    "kmer_extract": lambda s, d: reads.kmers(reads.reads(docs(s, d)), _K).groupBy("kmer").agg(F.count("*").alias("occurrences")),
    "kmer_count_distinct": lambda s, d: distinct(s, d).agg(F.count("*").alias("n_distinct")),
    "kmer_revcomp": _over(lambda: [K.revcomp("kmer").alias("rc"), K.colex_key("kmer").alias("reversed")]),
    "kmer_canonical": _over(lambda: [K.canonical("kmer").alias("canonical")]),
    "kmer_palindromes": lambda s, d: distinct(s, d).where(K.is_palindrome("kmer")),
    "kmer_follow_edge": _over(lambda: [*(K.follow("kmer", F.lit(c), _K).alias(f"to_{c}") for c in K.SYMBOLS)]),
    "kmer_set_nt": _over(lambda: [K.symbol_from_end("kmer", 2, _K).alias("third_last"), K.set_symbol("kmer", 2, "t", _K).alias("with_t"), K.clear_symbol("kmer", 0, _K).alias("cleared"), K.symbol_range("kmer", 1, 4, _K).alias("middle")]),
    "kmer_start_end_nodes": _over(lambda: [K.start_node("kmer", _K).alias("start_node"), K.end_node("kmer", _K).alias("end_node"), K.start_node_suffix("kmer", _K).alias("suffix"), K.edge_symbol("kmer", _K).alias("symbol")]),
    "dna_code_swap": _over(lambda: [K.swap_gt("kmer").alias("swapped")]),
    "kmer_padded_label": _over(lambda: [K.padded(K.start_node_suffix("kmer", _K), _K).alias("label")]),
    "kmer_symbol_codes": _over(lambda: [K.symbol_code(K.edge_symbol("kmer", _K)).alias("code"), K.label_symbol(K.symbol_code(K.edge_symbol("kmer", _K))).alias("letter")]),
    "kmer_common_suffix": _over(lambda: [K.common_suffix("kmer", K.revcomp("kmer"), _K).alias("lcs"), K.common_suffix(K.start_node("kmer", _K), K.end_node("kmer", _K), _K - 1).alias("node_lcs")]),
}


def _sql(what: str) -> str:
    return f"WITH {kmers_sql()} SELECT {what}"


_RC = "translate(reverse(kmer), 'acgt', 'tgca')"
SQL = {
    "kmer_extract": _sql("kmer, count(*) AS occurrences FROM occ GROUP BY kmer"),
    "kmer_count_distinct": _sql("count(*) AS n_distinct FROM km"),
    "kmer_revcomp": _sql(f"kmer, {_RC} AS rc, reverse(kmer) AS reversed FROM km"),
    "kmer_canonical": _sql(f"kmer, CASE WHEN reverse(kmer) <= reverse({_RC}) THEN kmer ELSE {_RC} END AS canonical FROM km"),
    "kmer_palindromes": _sql(f"kmer FROM km WHERE kmer = {_RC}"),
    "kmer_follow_edge": _sql("kmer, " + ", ".join(f"substr(kmer, 2) || '{c}' AS to_{c}" for c in "acgt") + " FROM km"),
    "kmer_set_nt": _sql(f"kmer, substr(kmer, {_K - 2}, 1) AS third_last, substr(kmer, 1, {_K - 3}) || 't' || substr(kmer, {_K - 1}) AS with_t, substr(kmer, 1, {_K - 1}) || 'a' AS cleared, substr(kmer, {_K - 3}, 3) AS middle FROM km"),
    "kmer_start_end_nodes": _sql(f"kmer, substr(kmer, 1, {_K - 1}) AS start_node, substr(kmer, 2) AS end_node, substr(kmer, 2, {_K - 2}) AS suffix, right(kmer, 1) AS symbol FROM km"),
    "dna_code_swap": _sql("kmer, translate(kmer, 'gt', 'tg') AS swapped FROM km"),
    "kmer_padded_label": _sql(f"kmer, lpad(substr(kmer, 2, {_K - 2}), {_K}, '$') AS label FROM km"),
    "kmer_symbol_codes": _sql("kmer, instr('$acgt', right(kmer, 1)) - 1 AS code, upper(right(kmer, 1)) AS letter FROM km"),
    "kmer_common_suffix": _sql(f"kmer, len(list_filter(range(1, {_K + 1}), lambda i: right(kmer, i) = right({_RC}, i))) AS lcs, len(list_filter(range(1, {_K}), lambda i: right(substr(kmer, 1, {_K - 1}), i) = right(kmer, i))) AS node_lcs FROM km"),
}
