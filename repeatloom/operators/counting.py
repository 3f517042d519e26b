"""Distinct reads per target, backgrounds and effective lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import density_ratio, overlap_bp, predicted_copies, window
from .overlap import overlap_join


def targets(regions: DataFrame, *more: str) -> DataFrame:
    """A row for the primary interval and each alternate interval of a region, under the region's key and with the columns ``more``."""
    own = F.array(F.struct("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    every = F.concat(own, F.coalesce("alt_regions", F.array().cast("array<struct<chrom:string,start:bigint,end:bigint>>")))
    return regions.select("key", *more, F.inline(every))


def background_targets(norms: DataFrame) -> DataFrame:
    """targets() of backgrounds, which may come without alternate intervals; each with its primary interval as home."""
    named = norms.withColumnRenamed("norm_key", "key").withColumn("home", F.struct("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    return targets(named, "home") if "alt_regions" in norms.columns else named.select("key", "home", "chrom", "start", "end")


def _mapped(reads: DataFrame) -> DataFrame:
    return reads.where("not is_unmapped").select("sample", "qname", "chrom", "start", "end")


def hits(reads: DataFrame, intervals: DataFrame) -> DataFrame:
    """Distinct (sample, key, qname): mapped reads overlapping an interval of a key."""
    return overlap_join(_mapped(reads), intervals).select("l.sample", "r.key", "l.qname").distinct()


def read_counts(found: DataFrame, samples: DataFrame, regions: DataFrame) -> DataFrame:
    """(sample, key, n_reads) for every sample and region, 0 where none was found."""
    counts = found.groupBy("sample", "key").agg(F.count("*").alias("n"))
    names = [F.lit(r[0]) for r in samples.select("sample").distinct().orderBy("sample").collect()]  # one per input file
    cells = regions.select("key", F.explode(F.array(*names) if names else F.array().cast("array<string>")).alias("sample"))
    return cells.join(counts, ["sample", "key"], "left").select("sample", "key", F.coalesce("n", F.lit(0)).alias("n_reads"))


def _stretches(own: DataFrame, regions: DataFrame) -> DataFrame:
    """(sample, qname, chrom, from, to): the primary intervals of the regions that a read was found in, merged where they touch."""
    spans = own.join(regions.where("start < end").select("key", "chrom", "start", "end"), "key").drop("key")
    by_place = Window.partitionBy("sample", "qname", "chrom").orderBy("start", "end")
    reach = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    first = spans.withColumn("first", F.when(F.col("start") <= reach, 0).otherwise(1))
    numbered = first.withColumn("number", F.sum("first").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("sample", "qname", "chrom", "number").agg(F.min("start").alias("from"), F.max("end").alias("to")).drop("number")


def background(reads: DataFrame, norms: DataFrame, own: DataFrame, regions: DataFrame) -> DataFrame:
    """(sample, norm_key, n_background): distinct reads of a background, less those found in a region that overlaps it.

    own: sample, key, qname of reads found in regions; a region overlaps a background by
    their primary intervals. A read is left out by the merged stretches of its regions, one
    or two as a rule, so it is never paired with each background of each of its regions.
    """
    pairs = overlap_join(_mapped(reads), background_targets(norms))
    found = pairs.select("l.sample", "l.qname", F.col("r.key").alias("norm_key"), "r.home.chrom", F.col("r.home.start").alias("start"), F.col("r.home.end").alias("end"))
    overlap = (F.col("f.start") < F.col("s.to")) & (F.col("s.from") < F.col("f.end")) & (F.col("f.start") < F.col("f.end"))
    same = [F.col(f"f.{c}") == F.col(f"s.{c}") for c in ("sample", "qname", "chrom")]
    rest = found.alias("f").join(_stretches(own, regions).alias("s"), [*same, overlap], "left_anti")
    # chrom comes with norm_key, so that the join's partitions do for finding distinct reads too.
    distinct = rest.groupBy("sample", "qname", "chrom", "norm_key").agg(F.lit(1).alias("one"))
    return distinct.groupBy("sample", "norm_key").agg(F.count("*").alias("n_background"))


def overlapping_regions(norms: DataFrame, regions: DataFrame) -> DataFrame:
    """(norm_key, key, bp) of regions that overlap a background interval."""
    pairs = overlap_join(norms, regions)
    bp = overlap_bp(F.col("l.start"), F.col("l.end"), F.col("r.start"), F.col("r.end"))
    return pairs.select(F.col("l.norm_key").alias("norm_key"), F.col("r.key").alias("key"), bp.alias("bp"))


def effective_lengths(norms: DataFrame, links: DataFrame) -> DataFrame:
    """Length of each background less the summed (not merged) overlaps, at least 1."""
    lost = links.groupBy("norm_key").agg(F.sum("bp").alias("lost"))
    length = F.greatest(F.col("end") - F.col("start") - F.coalesce("lost", F.lit(0)), F.lit(1))
    return norms.join(lost, "norm_key", "left").select("norm_key", length.cast("long").alias("effective_length"))


def gene_mode(reads: DataFrame, samples: DataFrame, regions: DataFrame, norms: DataFrame) -> DataFrame:
    """Density ratios and predicted copies by host gene.

    regions: key, chrom, start, end, period, norm_key, alt_regions; norms: norm_key, chrom,
    start, end and, if reads there count too, alt_regions. Returns sample, key, n_reads, n_background, density_ratio, predicted_copies.
    """
    own = hits(reads, targets(regions))
    links = overlapping_regions(norms, regions.select("key", "chrom", "start", "end"))
    back, lengths = background(reads, norms, own, regions), effective_lengths(norms, links)
    size = F.col("end") - F.col("start")
    cells = read_counts(own, samples, regions).join(regions.select("key", "norm_key", "period", size.alias("length")), "key")
    full = cells.join(lengths, "norm_key", "left").join(back, ["sample", "norm_key"], "left")
    ratio = density_ratio(F.col("n_reads"), F.col("length"), F.coalesce("n_background", F.lit(0)), F.col("effective_length"))
    full = full.withColumn("density_ratio", ratio)
    return full.select(
        "sample", "key", "n_reads", F.coalesce("n_background", F.lit(0)).alias("n_background"), "density_ratio",
        predicted_copies(F.col("density_ratio"), F.col("length"), F.col("period")).alias("predicted_copies"),
    )


def local_mode(reads: DataFrame, samples: DataFrame, regions: DataFrame, width: int, alternates: bool = True) -> DataFrame:
    """Density ratios and predicted copies by the flanks: a window of ``width`` on both sides, its regions left out.

    Alternate intervals are widened too; without ``alternates`` only the primary one is.
    """
    start, end = window(F.col("start"), F.col("end"), width)

    def widened(a):
        lo, hi = window(a["start"], a["end"], width)
        return F.struct(a["chrom"].alias("chrom"), lo.alias("start"), hi.alias("end"))

    windows = regions.select(F.col("key").alias("norm_key"), "chrom", start.alias("start"), end.alias("end"), *([F.transform("alt_regions", widened).alias("alt_regions")] if alternates else []))
    plain = regions.select("key", "chrom", "start", "end")
    links = overlapping_regions(windows, plain)
    own = hits(reads, targets(regions))
    back = background(reads, windows, own, regions)
    others = links.where("norm_key <> key").groupBy("norm_key").agg(F.sum("bp").alias("lost"))
    cells = read_counts(own, samples, regions).join(regions.select("key", "period", (F.col("end") - F.col("start")).alias("length")), "key")
    full = cells.withColumn("norm_key", F.col("key")).join(back, ["sample", "norm_key"], "left").join(others, "norm_key", "left")
    length = F.greatest(F.lit(2 * width) - F.coalesce("lost", F.lit(0)), F.lit(1))
    n_back = F.coalesce("n_background", F.lit(0))
    full = full.withColumn("density_ratio", density_ratio(F.col("n_reads"), F.col("length"), n_back, length))
    copies = predicted_copies(F.col("density_ratio"), F.col("length"), F.col("period"))
    return full.select("sample", "key", "n_reads", n_back.alias("n_background"), "density_ratio", copies.alias("predicted_copies"))
