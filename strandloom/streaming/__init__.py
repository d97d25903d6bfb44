"""Counting k-mers of text that keeps arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import reads


def kmer_counts(stream: DataFrame, k: int, text: str = "text") -> DataFrame:
    """Running (kmer, count) of a streaming table of texts, for update or complete mode; state is one row for each distinct k-mer."""
    return reads.kmer_counts(reads.reads(stream, text), k)
