"""Region list, genes and alignments to an annotation of regions, written as BED."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import ALT, PRIMARY
from ..operators.liftover import lift
from ..operators.overlap import most_overlap
from ..sources.text import lines, parse_alignments, parse_genes, read_region_list


def builder_genes(spark: SparkSession, path: str) -> DataFrame:
    """Gene records of a GTF file on primary chromosomes, repeated names kept."""
    genes = parse_genes(lines(spark, path)).where(F.col("chrom").rlike(PRIMARY))
    return genes.select("chrom", "start", "end", "gene_name", (F.col("gene_type") == "protein_coding").alias("is_coding"))


def annotate(regions: DataFrame, genes: DataFrame, alignments: DataFrame | None = None) -> DataFrame:
    """Regions (ord, chrom, start, end, period) with name, gene, n_genes and alt_regions by contig name.

    Without alignments alt_regions is null.
    """
    keyed = regions.withColumn("key", F.col("ord"))
    out = keyed.join(most_overlap(keyed, genes), "key", "left")
    if alignments is None:
        out = out.withColumn("alt_regions", F.lit(None).cast(ALT))
    else:
        spans = lift(keyed, alignments)
        alts = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("alt_name").alias("chrom"), "start", "end"))).alias("alt_regions"))
        out = out.join(alts, "key", "left").withColumn("alt_regions", F.coalesce("alt_regions", F.array().cast(ALT)))
    name = F.concat("chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    return out.select("ord", "chrom", "start", "end", name.alias("name"), F.col("gene_name").alias("gene"), "n_genes", "period", "alt_regions")


def bed_line(with_alts: bool = True) -> Column:
    """The tab-separated line of an annotated region; '.' stands for no gene and no period."""
    text = [F.col("chrom"), F.col("start").cast("string"), F.col("end").cast("string"), F.col("name"), F.coalesce("gene", F.lit(".")), F.coalesce(F.col("period").cast("string"), F.lit("."))]
    if with_alts:
        fields = F.transform("alt_regions", lambda a: F.concat_ws("\t", a["chrom"], a["start"].cast("string"), a["end"].cast("string")))
        text.append(F.when(F.size("alt_regions") > 0, F.array_join(fields, "\t")))
    return F.concat_ws("\t", *text)


def write_bed(annotated: DataFrame, path: str, header: list[str], with_alts: bool = True) -> None:
    """Write a folder of text parts in the order of the region list, after the header's lines (a '#' goes before each)."""
    spark = annotated.sparkSession
    rows = annotated.select(F.lit(1).alias("part"), F.lit(0).alias("seq"), "ord", bed_line(with_alts).alias("value"))
    top = spark.createDataFrame([(i, f"# {h}".rstrip()) for i, h in enumerate(header)], "seq int, value string")
    top = top.select(F.lit(0).alias("part"), "seq", F.lit(None).cast(annotated.schema["ord"].dataType).alias("ord"), "value")
    top.unionByName(rows).orderBy("part", "seq", "ord").select("value").write.text(path)


def summary(annotated: DataFrame) -> DataFrame:
    """One row of counts: regions, with a period, with no, one or several genes, with and without alternates."""
    n_alts = F.size("alt_regions")
    return annotated.agg(
        F.count("*").alias("n_regions"), F.count("period").alias("n_with_period"),
        F.count_if(F.col("n_genes") == 0).alias("n_no_gene"), F.count_if(F.col("n_genes") == 1).alias("n_one_gene"), F.count_if(F.col("n_genes") > 1).alias("n_many_genes"),
        F.count_if(F.col("alt_regions").isNotNull() & (n_alts > 0)).alias("n_with_alt"), F.count_if(F.col("alt_regions").isNotNull() & (n_alts == 0)).alias("n_without_alt"),
    )


def alternate_counts(annotated: DataFrame) -> DataFrame:
    """(n_alternates, n): how many regions have one, two ... alternate contigs."""
    sizes = annotated.where("alt_regions is not null").select(F.size("alt_regions").alias("n_alternates")).where("n_alternates > 0")
    return sizes.groupBy("n_alternates").agg(F.count("*").alias("n")).orderBy("n_alternates")


def bed_header(label: str, source: str, with_alts: bool) -> list[str]:
    """The comment lines of an annotation file, without the '#'. Fixed wording, as readers of such files know it."""
    alternates = [
        "Alternate contig columns (7-9, 10-12, ...) list equivalent regions on",
        "alternate reference sequences. Reads from all contigs are unioned before counting.",
    ]
    return [
        f"Copy-number-variable VNTR regions - {label}",
        f"Source: {source}",
        "Format: chrom\tstart\tend\tname\tgene_name\tperiod\t[alt_chrom\talt_start\talt_end ...]",
        "BED coordinates are 0-based half-open [start, end)",
        "",
        "gene_name (column 5): gene with greatest bp overlap with the VNTR.",
        "  Priority: 1) most bp overlap  2) protein_coding  3) alphabetical name",
        "  '.' = no overlapping gene found on primary chromosome.",
        "",
        "period (column 6): repeat unit length in bp ('.' if unknown).",
        "  Used to convert density ratios to predicted copy numbers:",
        "  predicted_copies = density_ratio * 2 * (VNTR_length / period)",
        "",
        *(alternates if with_alts else ["Alternate contig columns not included (--no-alt-contigs)."]),
    ]


def build(spark: SparkSession, region_list: str, genes: str, label: str, out: str, alignments: str | None = None) -> DataFrame:
    """Annotate a region list with genes and alternate contigs and write it to the folder ``out``; returns the annotation."""
    regions = read_region_list(spark, region_list)
    psl = parse_alignments(lines(spark, alignments)) if alignments else None
    found = annotate(regions, builder_genes(spark, genes), psl)
    write_bed(found, out, bed_header(label, region_list, psl is not None), psl is not None)
    return found
