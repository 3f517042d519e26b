"""Command lines: count, annotate, cohort and plots."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from . import __version__
from .operators.selection import SelectionError
from .plans import annotation, cohort_study, genotype, plots
from .sources.text import InputError, read_summary


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="repeatloom", description="Tandem-repeat regions from aligned reads, and cohort statistics.")
    top.add_argument("--version", action="version", version=__version__)
    commands = top.add_subparsers(dest="command", required=True)

    c = commands.add_parser("count", help="count reads over regions and predict copies")
    c.add_argument("--default", action="store_true", help="all regions of the default list")
    c.add_argument("--gene", nargs="+", help="regions of the default list with these genes")
    c.add_argument("--vntr", nargs="+", help="regions of the default list with these names")
    c.add_argument("-r", "--regions", help="a BED file of regions")
    c.add_argument("--chrom", nargs="+", help="only regions on these chromosomes")
    c.add_argument("-i", "--input", nargs="+", required=True, help="SAM or BAM files, or Parquet files of reads")
    c.add_argument("-g", "--gtf", default=genotype.DEFAULT_GENES, help="genes (GTF, plain or gzip)")
    c.add_argument("--no-gtf", action="store_true", help="raw read counts")
    c.add_argument("-o", "--output", default="read_counts.csv")
    c.add_argument("--psl", default=genotype.DEFAULT_ALIGNMENTS, help="block alignments of alternate contigs")
    c.add_argument("--no-alt-contigs", action="store_true", help="backgrounds on primary chromosomes only")
    c.add_argument("--norm-gene-types", nargs="+", default=["protein_coding"], help="types of genes that count as nearest; 'any' for all")
    c.add_argument("--norm-method", choices=["gene", "local"], default="gene")
    c.add_argument("--norm-window", type=int, default=5000, help="bases of each flank in local mode")
    c.add_argument("--verbose", action="store_true")

    a = commands.add_parser("annotate", help="annotate a region list with genes and alternate contigs")
    a.add_argument("--vntr-list", required=True)
    a.add_argument("--gtf", required=True)
    a.add_argument("--reference", required=True, help="name of the reference in the header")
    a.add_argument("--out", required=True, help="folder of the annotation")
    a.add_argument("--psl")
    a.add_argument("--no-alt-contigs", action="store_true")

    s = commands.add_parser("cohort", help="statistics and exports of a population")
    s.add_argument("--vcf", required=True)
    s.add_argument("--tsv", required=True, help="catalogue of regions")
    s.add_argument("--out", required=True)
    s.add_argument("--sheets", action="store_true", help="write the summaries as XLSX too")

    p = commands.add_parser("plots", help="limits and fits of the plots of copy numbers")
    p.add_argument("--summary", required=True, help="XLSX or CSV with header, or Parquet")
    p.add_argument("--out", required=True)
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command == "count":
        genotype.count(
            spark, args.input, default=args.default, gene=args.gene, vntr=args.vntr, regions=args.regions, chrom=args.chrom,
            gtf=None if args.no_gtf or args.norm_method == "local" else args.gtf, psl=args.psl, no_alt_contigs=args.no_alt_contigs,
            norm_gene_types=args.norm_gene_types, norm_method=args.norm_method, norm_window=args.norm_window, output_csv=args.output,
        )
    elif args.command == "annotate":
        if not args.no_alt_contigs and not args.psl:
            raise InputError("--psl is needed unless --no-alt-contigs is given")
        found = annotation.build(spark, args.vntr_list, args.gtf, args.reference, args.out, None if args.no_alt_contigs else args.psl)
        annotation.summary(found).show(truncate=False)
        annotation.alternate_counts(found).show()
    elif args.command == "cohort":
        cohort_study.run(spark, args.vcf, args.tsv, args.out, args.sheets)
    else:
        table = plots.with_products(read_summary(spark, args.summary, plots.NUMBERS)).cache()
        plots.matrix(table).write.option("header", True).csv(args.out)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if getattr(args, "verbose", False) else logging.WARNING, format="%(levelname)s: %(message)s")
    spark = SparkSession.builder.appName("repeatloom").getOrCreate()
    try:
        run(spark, args)
    except (SelectionError, InputError) as error:
        print(f"ERROR: {error}", file=sys.stderr)
        return 1
    return 0
