"""Command line: python -m strandloom pack | build | benchmark | quantize INPUT [-o OUTPUT].

Without -o, an output is named as its input, without its folder, and the extension of its kind.
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession

from .operators import reads, unitig, varorder, workload
from .operators.graph import Graph
from .sources import dsk, fasta, packed_file, register

log = logging.getLogger("strandloom")


def kmers_of(spark: SparkSession, path: str, k: int | None) -> tuple[DataFrame, int]:
    """Distinct k-mers of a counter's file, of FASTA or FASTQ reads, or of a Parquet table with a column `text`, by the name's extension."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("fa", "fasta", "fna", "fq", "fastq", "parquet"):
        if not k:
            raise SystemExit("-k is needed for reads")
        read = {"fq": fasta.read_fastq, "fastq": fasta.read_fastq, "parquet": lambda s, p: s.read.parquet(p)}.get(kind, fasta.read_fasta)
        return reads.distinct_kmers(reads.reads(read(spark, path)), k), k
    found = {dsk.header(p)[1] for p in dsk.files(path)}
    if len(found) != 1:
        raise SystemExit(f"files of different k: {sorted(found)}")
    return spark.read.format("dsk").load(path).select("kmer").distinct(), found.pop()


def output(given: str | None, path: str, extension: str) -> str:
    return (given or os.path.basename(path.rstrip("/"))) + extension


def placed(path: str) -> str:
    """A path that means the same in every process; one with a scheme does already."""
    return path if "://" in path else os.path.abspath(path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandloom")
    p.add_argument("--verbose", action="store_true")
    what = p.add_subparsers(dest="what", required=True)
    add = lambda name, text: what.add_parser(name, help=text)
    packing, build, bench, quant, contigs = add("pack", "k-mers or reads to a packed graph"), add("build", "a packed graph to an indexed one"), add("benchmark", "time of operations on a graph"), add("quantize", "common suffixes held to given levels"), add("unitigs", "k-mers or reads to unitigs as FASTA")
    for x in (packing, build, bench, quant, contigs):
        x.add_argument("input")
        x.add_argument("-o", "--output", help="prefix of the outputs")
    for x in (packing, contigs):
        x.add_argument("-k", type=int, help="for reads; a counter's file knows its own")
    packing.add_argument("--no-revcomps", action="store_true")
    packing.add_argument("--short-dummies", action="store_true", help="only the last edge of each padding path")
    packing.add_argument("--variable-order", action="store_true", help="write common suffix lengths, too")
    bench.add_argument("-n", type=int, default=50_000)
    bench.add_argument("--seed", type=int, default=0)
    quant.add_argument("levels", type=int, nargs="+")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str | dict:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING)
    spark = spark or SparkSession.builder.appName("strandloom").getOrCreate()
    register(spark)
    named, args.input = args.input, placed(args.input)
    out = lambda extension: placed(output(args.output, named, extension))
    if args.what == "pack":
        kmers, k = kmers_of(spark, args.input, args.k)
        g = Graph.of_kmers(kmers, k, not args.no_revcomps, not args.short_dummies)
        path = out(".packed")
        packed_file.write_packed(g, path)
        if args.variable_order:
            packed_file.write_lcs(g, path + ".lcs")
        log.debug("%s", g.stats().first())
        return path
    if args.what == "unitigs":
        kmers, k = kmers_of(spark, args.input, args.k)
        fasta.write_fasta(unitig.unitigs(kmers, k), path := out(".unitigs.fa"))
        return path
    g = Graph.load(spark, args.input) if os.path.isdir(args.input) else Graph.of_packed(spark, args.input)
    if args.what == "build":
        g.save(path := out(".graph"))
        return path
    if args.what == "quantize":
        g.edges.select("pos", varorder.quantized("lcs", args.levels).alias("lcs_q")).write.mode("overwrite").parquet(path := out(".qzd"))
        return path
    return workload.timed(g, args.n, args.seed)


if __name__ == "__main__":
    print(json.dumps(main()))
