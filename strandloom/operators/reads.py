"""From text to reads to k-mers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 512


def read_of(text: Column | str) -> Column:
    """The acgt letters of a text, lower-cased; everything else goes."""
    return F.regexp_replace(F.translate(F.col(text) if isinstance(text, str) else text, "ACGT", "acgt"), "[^acgt]", "")


def _spread(df: DataFrame) -> DataFrame:
    """Deals out rows of an input of fewer partitions than there are cores; larger inputs stay as they are scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def reads(docs: DataFrame, text: str = "text") -> DataFrame:
    return _spread(docs.select(text)).select(read_of(text).alias("read"))


def kmers(reads: DataFrame, k: int) -> DataFrame:
    """Every k-mer occurrence. Null reads and reads shorter than k give none.

    Reads are cut as bytes, where a substring's cost doesn't grow with its place, into overlapping pieces first and those into
    k-mers, so that no list of a long read's places is made.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    last = F.floor((F.length("read") - k) / PIECE).cast("int")
    pieces = reads.where(F.length("read") >= k).select(F.col("read").cast("binary").alias("read"), F.explode(F.sequence(F.lit(0), last)).alias("j"))
    pieces = pieces.select(F.substring(F.col("read"), F.col("j") * PIECE + 1, F.lit(PIECE + k - 1)).alias("piece"))
    return pieces.select("piece", F.explode(F.sequence(F.lit(1), F.length("piece") - k + 1)).alias("i")).select(F.substring(F.col("piece"), F.col("i"), F.lit(k)).cast("string").alias("kmer"))


def distinct_kmers(reads: DataFrame, k: int) -> DataFrame:
    return kmers(reads, k).distinct()


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    return kmers(reads, k).groupBy("kmer").agg(F.count("*").alias("count"))
