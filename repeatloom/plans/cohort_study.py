"""A cohort study: catalogue and population genotypes to counts, statistics, histograms and exports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort, stats
from ..sources.sheets import write_sheet
from ..sources.text import CATALOGUE, lines, parse_sites, read_catalogue, sample_names
from .haplotype_export import STATISTICS, csv_lines, variable_sites, with_catalogue, with_statistics

CONTEXTS = ["bio_context_1", "bio_context_2", "bio_context_3"]
REPORTED = [c for c in [*CATALOGUE, *STATISTICS] if c != "motifs"]  # columns of the summaries, in order
SHEETS = ["summary", "copy_variable"]
LENGTHS = (7, 100, 50)  # limits and number of bins of consensus lengths


def length_histograms(table: DataFrame) -> DataFrame:
    """(chrom, bin, n) of consensus lengths of each chromosome present; values outside the limits are dropped."""
    low, high, bins = LENGTHS
    bin_ = F.least(F.width_bucket("cons_len", F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins)).cast("long")
    counts = table.where(F.col("cons_len").between(low, high)).groupBy("chrom", bin_.alias("bin")).agg(F.count("*").alias("n"))
    every = table.select("chrom").distinct().withColumn("bin", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(bins).cast("long"))))
    return every.join(counts, ["chrom", "bin"], "left").select("chrom", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def summary(sites: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Variable sites with the catalogue's columns, their calls and STATISTICS: a row for each site in the genotype file."""
    wanted = catalogue.withColumnRenamed("start", "pos")
    named = with_catalogue(with_statistics(sites), wanted.select("ord", "chrom", "pos", *CATALOGUE[2:]))
    return named.withColumnRenamed("pos", "start")


def tables(spark: SparkSession, vcf: str, tsv: str) -> dict[str, DataFrame]:
    """All results by name, each a lazy plan over the two files."""
    sites, catalogue = parse_sites(lines(spark, vcf)), read_catalogue(spark, tsv)
    numbered = catalogue.withColumn("cons_len", F.col("cons_len").try_cast("double"))
    standard = numbered.where(F.col("chrom").isin(cohort.CHROMOSOMES))
    kept = cohort.filtered_catalogue(catalogue)
    known = cohort.with_variability(kept, sites)
    variable = known.where("is_variable")
    full = summary(sites, catalogue.join(variable.select("chrom", "start").distinct(), ["chrom", "start"], "left_semi"))
    copies = variable_sites(full)
    return {
        "site_counts": cohort.chromosome_counts(sites), "lengths_before": stats.describe(standard, "cons_len"), "lengths_after": stats.describe(kept, "cons_len"),
        "kept_counts": cohort.chromosome_counts(kept), "contexts": cohort.context_counts(kept, CONTEXTS), "variability": cohort.variability_counts(known),
        "variable_counts": cohort.chromosome_counts(variable), "length_histograms": length_histograms(kept), "variable_length_histograms": length_histograms(variable),
        "summary": full.select("ord", *REPORTED), "copy_variable": copies.select("ord", *REPORTED),
        "copy_variable_length_histograms": length_histograms(copies.withColumn("cons_len", F.col("cons_len").try_cast("double"))),
        "haplotypes": csv_lines(full, CATALOGUE),
    }


def header(spark: SparkSession, vcf: str) -> str:
    """The header line of the haplotype export."""
    return ",".join([*CATALOGUE, *(f"{s}_hap{h}" for s in sample_names(spark, vcf) for h in (1, 2)), *STATISTICS])


def run(spark: SparkSession, vcf: str, tsv: str, out: str, sheets: bool = False) -> None:
    """Write every table to a folder of its own under ``out``: CSV with a header, the haplotype export as lines after its own.

    With ``sheets``, SHEETS are written as workbooks too, in file order; ``out`` is a local folder then.
    """
    for name, table in tables(spark, vcf, tsv).items():
        folder = os.path.join(out, name)
        if name == "haplotypes":
            top = spark.createDataFrame([(0, header(spark, vcf))], "part int, line string").withColumn("ord", F.lit(None).cast(table.schema["ord"].dataType))
            top.unionByName(table.withColumn("part", F.lit(1))).orderBy("part", "ord").select(F.col("line").alias("value")).write.text(folder)
        else:
            flat = table.select([c for c, kind in table.dtypes if not kind.startswith(("struct", "array"))])
            flat.write.option("header", True).csv(folder)
            if sheets and name in SHEETS:
                write_sheet(table.orderBy("ord").select(*REPORTED), f"{folder}.xlsx")
