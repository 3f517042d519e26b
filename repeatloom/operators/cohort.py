"""Cohort statistics: alleles, copy numbers, heterozygosity, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHROMOSOMES = [f"chr{c}" for c in (*range(1, 23), "X", "Y", "M")]


def is_variable(genotypes: Column) -> Column:
    """True with two or more known alleles, false with one, null with none."""
    n = F.size(F.array_distinct(F.filter(F.flatten(F.transform(genotypes, lambda g: F.split(g, "/"))), lambda a: a != ".")))
    return F.when(n > 1, True).when(n == 1, False)


def sample_variance(x: Column) -> Column:
    """Variance (n - 1) of whole numbers, from exact sums; null for fewer than two."""
    n, total, squares = F.count(x), F.sum(x.cast("long")), F.sum(x.cast("long") * x.cast("long"))
    return F.when(n > 1, (n * squares - total * total).cast("double") / (n * (n - 1)).cast("double"))


def haplotype_stats(calls: DataFrame) -> DataFrame:
    """Per site: means, variances, and expected and observed heterozygosity.

    calls: site, cn1, cn2 (null if missing), hap1, hap2.
    """
    both = F.col("cn1").isNotNull() & F.col("cn2").isNotNull()
    total = F.when(both, F.col("hap1") + F.col("hap2"))
    stats = calls.groupBy("site").agg(
        F.avg("hap1").alias("mean_hap1"), F.avg("hap2").alias("mean_hap2"), F.avg(total).alias("mean_combined"),
        sample_variance(F.col("hap1")).alias("var_hap1"), sample_variance(F.col("hap2")).alias("var_hap2"), sample_variance(total).alias("var_combined"),
        F.try_divide(F.count_if(both & (F.col("cn1") != F.col("cn2"))).cast("double"), F.count_if(both).cast("double")).alias("h_obs"),
    )
    alleles = calls.select("site", F.explode(F.array("cn1", "cn2")).alias("cn")).where("cn is not null")
    counts = alleles.groupBy("site", "cn").agg(F.count("*").alias("c"))
    expected = counts.groupBy("site").agg((F.lit(1.0) - F.sum(F.col("c") * F.col("c")).cast("double") / (F.sum("c") * F.sum("c")).cast("double")).alias("h_exp"))
    return stats.join(expected, "site", "left")


def chromosome_counts(sites: DataFrame) -> DataFrame:
    """(ord, chrom, n_sites): standard chromosomes in order, then others by name, then the total."""
    ord_ = F.array_position(F.array(*map(F.lit, CHROMOSOMES)), F.col("chrom"))
    per = sites.groupBy("chrom").agg(F.count("*").alias("n_sites")).withColumn("ord", F.when(ord_ > 0, ord_).otherwise(99).cast("int"))
    total = sites.agg(F.count("*").alias("n_sites")).select(F.lit("total").alias("chrom"), "n_sites", F.lit(100).alias("ord"))
    return per.unionByName(total)


def filtered_catalogue(catalogue: DataFrame, least: int = 6) -> DataFrame:
    """Catalogue rows on standard chromosomes with a consensus longer than ``least``; cons_len is a number, chrom_ord the order."""
    place = F.array_position(F.array(*map(F.lit, CHROMOSOMES)), F.col("chrom"))
    numbered = catalogue.withColumn("cons_len", F.col("cons_len").try_cast("double")).withColumn("chrom_ord", place.cast("int"))
    return numbered.where((F.col("chrom_ord") > 0) & (F.col("cons_len") > least))


def with_variability(catalogue: DataFrame, sites: DataFrame) -> DataFrame:
    """Catalogue rows (chrom, start as text) with is_variable of the site there, of repeated sites the last; null without one."""
    wanted = sites.join(catalogue.select("chrom", F.col("start").alias("pos")).distinct(), ["chrom", "pos"], "left_semi")
    last = wanted.groupBy("chrom", F.col("pos").alias("start")).agg(F.max_by(is_variable(F.col("genotypes")), "ord").alias("is_variable"))
    return catalogue.join(last, ["chrom", "start"], "left")


def variability_counts(catalogue: DataFrame) -> DataFrame:
    """(chrom, n_variable, n_invariant, n_unresolved) by chromosome in order, and overall as chrom 'total'."""
    known = F.col("is_variable")
    counts = [F.count_if(known).alias("n_variable"), F.count_if(~known).alias("n_invariant"), F.count_if(known.isNull()).alias("n_unresolved")]
    per = catalogue.rollup("chrom").agg(*counts, F.grouping("chrom").alias("total"))
    return per.select(F.when(F.col("total") == 1, "total").otherwise(F.col("chrom")).alias("chrom"), "n_variable", "n_invariant", "n_unresolved")


def context_counts(table: DataFrame, columns: list[str]) -> DataFrame:
    """(context, value, n): how often each known value of these columns occurs."""
    pairs = F.array(*(F.struct(F.lit(c).alias("context"), F.col(c).cast("string").alias("value")) for c in columns))
    return table.select(F.inline(pairs)).where("value is not null").groupBy("context", "value").agg(F.count("*").alias("n"))
