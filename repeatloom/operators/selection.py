"""Choosing, merging and naming regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SelectionError(ValueError):
    """No regions, or selectors that exclude each other."""


def select_regions(regions: DataFrame, genes: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Regions of any of the genes or with any of the names; all of them if neither is given.

    An empty list is given, and matches nothing.
    """
    given = [F.col(column).isin(list(values)) for column, values in (("gene", genes), ("name", names)) if values is not None]
    return regions.where(reduce(Column.__or__, given)) if given else regions


def unmatched(regions: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """The wanted values that no region has in ``column``, sorted: for warnings."""
    asked = regions.sparkSession.createDataFrame([(w,) for w in sorted(set(wanted))], f"{column} string")
    return asked.join(regions.select(column), column, "left_anti").orderBy(column)


def on_chromosomes(regions: DataFrame, chromosomes: list[str]) -> DataFrame:
    """Regions on any of the chromosomes."""
    return regions.where(F.col("chrom").isin(list(chromosomes)))


def merge_regions(default: DataFrame, custom: DataFrame) -> DataFrame:
    """Default regions, then custom ones; a custom name that a default has gets a suffix."""
    taken = default.select("name").distinct().withColumn("taken", F.lit(True))
    renamed = custom.join(taken, "name", "left").withColumn("name", F.when(F.col("taken"), F.concat("name", F.lit("_UserSupplied"))).otherwise(F.col("name"))).drop("taken")
    return default.withColumn("source", F.lit(0)).unionByName(renamed.withColumn("source", F.lit(1)))


def check_selection(default: bool, genes, names, regions) -> None:
    """At least one selector; the whole default list excludes genes and names."""
    if not (default or genes is not None or names is not None or regions):
        raise SelectionError("choose regions by default, gene, name or file")
    if default and (genes is not None or names is not None):
        raise SelectionError("default takes all regions; leave out gene and name")
