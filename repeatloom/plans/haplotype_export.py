"""Population genotypes to copy numbers of both haplotypes and statistics of each site.

A site's genotypes are one array, so all of it is computed within the row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import allele_copies, genotype_copies, haplotypes
from ..functions.rounding import plain_number, round_half_even

# Fixed names: the columns of the export.
STATISTICS = ["mean_hap1", "mean_hap2", "var_hap1", "var_hap2", "mean_combined", "var_combined", "h_exp", "h_obs"]


def _known(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)


def _mean(values: Column) -> Column:
    return F.try_divide(_total(values).cast("double"), F.size(values).cast("double"))


def _variance(values: Column) -> Column:
    n, total = F.size(values).cast("long"), _total(values)
    squares = _total(F.transform(values, lambda v: v.cast("long") * v))
    return F.try_divide((n * squares - total * total).cast("double"), (n * (n - 1)).cast("double"))


def with_statistics(sites: DataFrame) -> DataFrame:
    """Sites (altanno, genotypes) with calls (cn1, cn2, hap1, hap2 of each sample) and STATISTICS, to four decimals."""
    copies = sites.withColumn("copies", F.coalesce(allele_copies(F.col("altanno")), F.array().cast("array<int>")))

    def call(genotype: Column) -> Column:
        a, b = genotype_copies(genotype, F.col("copies"))
        first, second = haplotypes(a, b)
        return F.struct(a.alias("cn1"), b.alias("cn2"), first.alias("hap1"), second.alias("hap2"))

    df = copies.withColumn("calls", F.transform("genotypes", call)).drop("copies")
    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  # value is computed once

    def moments(values: Column) -> tuple[Column, Column]:
        return once(values, _mean), once(values, _variance)

    def expected(alleles: Column) -> Column:
        n = F.size(alleles).cast("double")
        shares = F.transform(F.array_distinct(alleles), lambda d: F.size(F.filter(alleles, lambda x: x == d)).cast("double") / n)
        return F.when(n > 0, F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, p: a + p * p))

    def observed(whole: Column) -> Column:
        return F.try_divide(F.size(F.filter(whole, lambda c: c["cn1"] != c["cn2"])).cast("double"), F.size(whole).cast("double"))

    def statistics(calls: Column) -> Column:
        whole = F.filter(calls, lambda c: c["hap2"].isNotNull())
        first, second = moments(_known(F.transform(calls, lambda c: c["hap1"]))), moments(_known(F.transform(calls, lambda c: c["hap2"])))
        both = moments(F.transform(whole, lambda c: c["hap1"] + c["hap2"]))
        alleles = _known(F.flatten(F.transform(calls, lambda c: F.array(c["cn1"], c["cn2"]))))
        values = [first[0], second[0], first[1], second[1], both[0], both[1], once(alleles, expected), once(whole, observed)]
        return F.struct(*(round_half_even(v, 4).alias(name) for name, v in zip(STATISTICS, values)))

    found = df.withColumn("__statistics", once(F.col("calls"), statistics))
    return found.select(*(F.col(f"`{c}`") for c in df.columns), *(F.col(f"__statistics.{s}").alias(s) for s in STATISTICS))


def with_catalogue(sites: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Sites joined with the catalogue's row of the same chrom and pos (text); of repeated catalogue rows (ord) the last."""
    rest = [c for c in catalogue.columns if c not in ("ord", "chrom", "pos")]
    last = catalogue.groupBy("chrom", "pos").agg(F.max_by(F.struct(*rest), "ord").alias("c"))
    return sites.join(last.select("chrom", "pos", *(F.col(f"c.{c}").alias(c) for c in rest)), ["chrom", "pos"])


def _quoted(value: Column) -> Column:
    return F.when(value.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(value, F.lit("")))


def csv_lines(summarised: DataFrame, metadata: list[str]) -> DataFrame:
    """(ord, line): metadata, then hap1 and hap2 of each sample side by side, then STATISTICS; nulls are empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    samples = F.array_join(F.transform("calls", lambda c: F.concat_ws(",", text(c["hap1"]), text(c["hap2"]))), ",")
    samples = F.when(F.size("calls") > 0, samples)
    numbers = [F.coalesce(plain_number(F.col(s), 4), F.lit("")) for s in STATISTICS]
    return summarised.select("ord", F.concat_ws(",", *(_quoted(F.col(m)) for m in metadata), samples, *numbers).alias("line"))


def variable_sites(summarised: DataFrame) -> DataFrame:
    """Sites whose rounded variance on either haplotype is above 0."""
    return summarised.where((F.coalesce("var_hap1", F.lit(0.0)) > 0) | (F.coalesce("var_hap2", F.lit(0.0)) > 0))
