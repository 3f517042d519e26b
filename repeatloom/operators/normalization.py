"""Backgrounds of regions: eligible genes, coordinate literals, lookup and alternate intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import ALT
from .liftover import lift
from .overlap import nearest_gene

CODING = "protein_coding"


def eligible(genes: DataFrame, types: list[str]) -> DataFrame:
    """Genes (gene_name, chrom, start, end, gene_type) of the given types, or of all with 'any'; is_coding is added."""
    kept = genes if "any" in types else genes.where(F.col("gene_type").isin(list(types)))
    return kept.withColumn("is_coding", F.coalesce(F.col("gene_type") == CODING, F.lit(False)))


def literal(text: Column) -> Column:
    """The interval that a text like chr5:100-200 names (taken as it stands), or null."""
    name, places = F.substring_index(text, ":", 1), F.split(F.element_at(F.split(text, ":"), -1), "-")
    start, end = F.get(places, F.lit(0)), F.get(places, F.lit(1))
    is_one = (F.size(F.split(text, ":")) == 2) & name.startswith("chr") & (F.length(name) > 3) & ~name.rlike(r"\s") & (F.size(places) == 2) & start.rlike("^[0-9]+$") & end.rlike("^[0-9]+$")
    return F.when(is_one, F.struct(name.alias("chrom"), start.try_cast("long").alias("start"), end.try_cast("long").alias("end")))


def assign_genes(regions: DataFrame, genes: DataFrame, types: list[str]) -> DataFrame:
    """Regions with norm_key: their own gene, else the nearest eligible one, null if the chromosome has none."""
    bare = regions.where("gene is null").select("key", "chrom", "start", "end")
    found = nearest_gene(bare, eligible(genes, types)).select("key", F.col("gene_name").alias("found"), "distance", "n_ties")
    return regions.join(found, "key", "left").withColumn("norm_key", F.coalesce("gene", "found")).drop("found")


def targets_of(regions: DataFrame, genes: DataFrame) -> DataFrame:
    """(norm_key, chrom, start, end) of the regions' keys: a coordinate literal, or the gene of that name; null where neither."""
    keys = regions.where("norm_key is not null").select("norm_key").distinct().withColumn("place", literal(F.col("norm_key")))
    named = genes.select(F.col("gene_name").alias("norm_key"), F.struct("chrom", "start", "end").alias("gene"))
    both = keys.join(named, "norm_key", "left").withColumn("at", F.coalesce("place", "gene"))
    return both.select("norm_key", "at.chrom", "at.start", "at.end")


def with_alternates(norms: DataFrame, alignments: DataFrame) -> DataFrame:
    """Backgrounds with alt_regions: their intervals on alternate contigs, by contig name."""
    spans = lift(norms.withColumnRenamed("norm_key", "key"), alignments)
    alts = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("alt_name").alias("chrom"), "start", "end"))).cast(ALT).alias("alt_regions"))
    return norms.join(alts.withColumnRenamed("key", "norm_key"), "norm_key", "left")
