"""Formulas for densities, copies, overlaps and genotypes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: names of primary chromosomes.
PRIMARY = r"^chr([0-9]+|[XYM])$"

#: Type of a region's alternate intervals.
ALT = "array<struct<chrom:string,start:bigint,end:bigint>>"


def overlap_bp(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Shared bases of two half-open intervals; negative is their distance."""
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def density_ratio(reads: Column, length: Column, background: Column, background_length: Column) -> Column:
    """(reads * background length) / (background reads * length); null where a divisor or length is 0."""
    top, bottom = (reads * background_length).cast("double"), (background * length).cast("double")
    return F.when((length != 0) & (background_length != 0), F.try_divide(top, bottom))


def predicted_copies(ratio: Column, length: Column, period: Column) -> Column:
    """ratio * 2 * (length / period); null without a ratio or a period."""
    return ratio * F.lit(2.0) * F.try_divide(length.cast("double"), period.cast("double"))


def window(start: Column, end: Column, width: int) -> tuple[Column, Column]:
    """An interval widened on both sides, never below 0."""
    return F.greatest(F.lit(0).cast("long"), start - width), end + width


def period(text: Column) -> Column:
    """A repeat period: the whole part of a positive number, else null."""
    x = text.try_cast("double")
    return F.when((x >= 1) & (x < 2147483648.0), F.floor(x).cast("int"))


def gtf_attribute(attributes: Column, key: str) -> Column:
    """The first quoted value of an attribute whose name begins with key; null if empty."""
    items = F.transform(F.split(attributes, ";"), lambda t: F.trim(t))  # a bare F.trim would take the index as its second argument
    named = F.filter(items, lambda t: t.startswith(key) & (F.size(F.split(t, '"')) >= 2))
    return F.nullif(F.get(F.split(F.get(named, F.lit(0)), '"'), F.lit(1)), F.lit(""))


def allele_copies(altanno: Column) -> Column:
    """Copies of each allele: motifs joined by '-' in each entry of a comma list."""
    return F.transform(F.split(altanno, ","), lambda x: F.size(F.split(x, "-")))


def genotype_copies(genotype: Column, copies: Column) -> tuple[Column, Column]:
    """Copies of both alleles of a/b; missing, malformed or unknown alleles are null."""
    parts = F.split(genotype, "/")

    def one(i: int) -> Column:
        allele = F.get(parts, F.lit(i)).try_cast("int")
        return F.when((F.size(parts) == 2) & (allele >= 0), F.get(copies, allele))

    return one(0), one(1)


def haplotypes(a: Column, b: Column) -> tuple[Column, Column]:
    """The larger and the smaller of two copy numbers; a single one is the first."""
    return F.greatest(a, b), F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))
