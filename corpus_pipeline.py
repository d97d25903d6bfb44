"""The corpus pipeline: quality, repeated lines, near copies, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import jaccard_join, line_dedup, packing, quality
from strandloom.llm.common import free_name, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are neither of low quality nor toxic. Null and empty texts are scored as empty ones; repeated rows are treated alike."""
    low, toxic, keep = (free_name(docs, x) for x in ("p_low", "p_toxic", "keep"))
    rated = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), docs.columns, names=(low, toxic, keep))
    return rated.where(F.col(keep)).drop(low, toxic, keep)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; n_chars follows. Null texts pass, of ties the first document and line stays (see line_dedup)."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more), the document with the least id, of equal ids that of the least text hash.

    Rows of one id and one text are one document, of which the first row stays. Rows of one id and different texts are documents of their own.
    Rows without id, without text or without words stay.
    """
    joined = jaccard_join.jaccard_join(docs, words=5, percent=80, counted=False).where("group_id is not null and doc_id is not null")
    rows = written(joined.groupBy("group_id", "doc_id", "text_key").agg(F.count("*").alias("n")), "members")
    first = written(rows.groupBy("group_id").agg(F.count("*").alias("c"), F.min("doc_id").alias("least")).where("c > 1"), "groups")
    of_least = rows.join(first, "group_id").where("doc_id = least").groupBy("group_id").agg(F.min("text_key").alias("least_text"))
    others = rows.join(first, "group_id").join(of_least, "group_id").where("doc_id <> least or text_key <> least_text").select("doc_id", "text_key", F.lit(0).cast("long").alias("n"))
    marked = written(others.union(rows.where("n > 1").join(others, ["doc_id", "text_key"], "left_anti").select("doc_id", "text_key", "n")), "copies")
    doc, key, n = (free_name(docs, x) for x in ("of_doc", "text_key", "n"))
    marked_as = marked.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("n").alias(n))
    keyed = docs.withColumn(key, F.xxhash64("text")).withColumn(doc, F.col("doc_id").cast("long"))
    both = keyed.join(marked_as, [doc, key], "left")
    out = both.where(F.col(n).isNull()).select(*(F.col(f"`{c}`") for c in docs.columns))
    if marked.where("n > 0").isEmpty():
        return out
    again = both.where(F.col(n) > 0).dropDuplicates([doc, key])
    return out.union(again.select(*(F.col(f"`{c}`") for c in docs.columns)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document (see packing for nulls, empty texts, ties and repeated rows)."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", quality_classifier), ("line dedup", dedup_lines), ("n-gram Jaccard join", near_copies), ("best-fit packing", best_fit_packing)]

#: Neither the classifier nor the edit distance of lines can be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
