"""Sequence files in text form: FASTA and FASTQ reads in, unitigs out as FASTA. Records are cut by Spark's text reader, so files of any size are split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of each record; a sequence may take several lines. A record begins with `>` at a line's begin."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")
    name = F.regexp_replace(F.substring_index("value", "\n", 1), "\r$", "")
    rest = F.when(F.contains("value", F.lit("\n")), F.expr("substring(value, instr(value, '\n') + 1)")).otherwise("")
    return records.select(name.alias("name"), F.regexp_replace(rest, r"\s+", "").alias("text"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, text, quality) of each record of four lines. A quality line that begins with `@` can't be told from a record's begin and raises an error."""
    records = spark.read.option("lineSep", "\n@").text(path).select(F.split(F.regexp_replace(F.regexp_replace("value", "^@", ""), r"\r|\n+$", ""), "\n").alias("l"))
    whole = (F.size("l") == 4) & F.col("l")[2].startswith("+") & (F.length(F.col("l")[1]) == F.length(F.col("l")[3]))
    checked = records.where(F.array_join("l", "") != "").select(F.when(whole, F.col("l")).otherwise(F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.col("l")[0]))).alias("l"))
    return checked.select(F.col("l")[0].alias("name"), F.col("l")[1].alias("text"), F.col("l")[3].alias("quality"))


def write_fasta(unitigs: DataFrame, path: str) -> None:
    """A record for each row (unitig_id, n_edges, label, is_cycle)."""
    head = F.concat(F.lit(">"), "unitig_id", F.lit(" edges="), F.col("n_edges").cast("string"), F.when(F.col("is_cycle"), " cycle").otherwise(""))
    unitigs.select(F.concat(head, F.lit("\n"), "label").alias("value")).write.text(path)


def write_kmers(kmers: DataFrame, path: str, k: int) -> None:
    """K-mers or shorter labels as lines, padded with `$` to k symbols."""
    from ..functions import kmer as K

    kmers.select(K.padded("kmer", k).alias("value")).write.text(path)
