"""Joins of intervals: overlap by bins, nearest with ties, most overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import overlap_bp

#: Widths of bins, as powers of two.
LEAST_BIN, MOST_BIN = 64, 1 << 20


def bin_width(intervals: DataFrame) -> int:
    """A power of two of about twice the mean length of the intervals: most of them lie in one or two bins."""
    mean = intervals.agg(F.avg(F.col("end") - F.col("start"))).first()[0] or 1.0
    return max(LEAST_BIN, min(MOST_BIN, 1 << int(2 * mean).bit_length()))


def _binned(df: DataFrame, side: str, bin_size: int) -> DataFrame:
    """Rows with the bins they touch, also those below 0."""
    lo = F.floor(F.col(f"{side}.start") / bin_size)
    hi = F.floor((F.col(f"{side}.end") - 1) / bin_size)
    rows = df.select(F.struct(*df.columns).alias(side)).where(f"{side}.start < {side}.end")
    return rows.withColumn("bin", F.explode(F.sequence(lo, hi))).withColumn("chrom", F.col(f"{side}.chrom"))


def overlap_join(left: DataFrame, right: DataFrame, bin_size: int | None = None) -> DataFrame:
    """(l, r) structs of rows whose half-open intervals (chrom, start, end) share a base, each pair once.

    An equi-join on (chrom, bin): a pair is emitted only in the bin where the later of the
    two begins, so nothing is de-duplicated afterwards. Intervals without width match
    nothing. The width of bins follows the lengths of ``right``, the targets, unless given;
    the join strategy is Spark's choice by size, and adaptive execution splits deep bins.
    """
    width = bin_size or bin_width(right)
    pairs = _binned(left, "l", width).join(_binned(right, "r", width), ["chrom", "bin"])
    own = F.floor(F.greatest("l.start", "r.start") / width)
    return pairs.where((F.col("l.start") < F.col("r.end")) & (F.col("r.start") < F.col("l.end")) & (F.col("bin") == own)).select("l", "r")


def most_overlap(regions: DataFrame, genes: DataFrame) -> DataFrame:
    """Each region (key) with the gene sharing most bases: key, gene_name, n_genes; coding first, then by name."""
    found = overlap_join(regions, genes)
    shared = overlap_bp(F.col("l.start"), F.col("l.end"), F.col("r.start"), F.col("r.end"))
    best = F.min(F.struct((-shared).alias("o"), (~F.col("r.is_coding")).alias("c"), F.col("r.gene_name").alias("gene_name")))
    top = found.groupBy(F.col("l.key").alias("key")).agg(best.alias("b"), F.count("*").alias("n"))
    return regions.select("key").join(top, "key", "left").select("key", F.col("b.gene_name").alias("gene_name"), F.coalesce("n", F.lit(0)).alias("n_genes"))


def _nearest_beyond(asked: DataFrame, known: DataFrame, ahead: bool, bucket: int) -> DataFrame:
    """``asked`` (chrom, pos, ...) with g: the nearest ``known`` (chrom, g) at or after pos, or else at or before it.

    Extremes run within buckets of positions; what earlier buckets carry over comes from a
    table of one row for each bucket, so no task holds a whole chromosome.
    """
    none = F.lit(None).cast("long")
    rest = [c for c in asked.columns if c not in ("chrom", "pos")]
    marks = asked.withColumn("g", none).withColumn("tag", F.lit(0)).unionByName(
        known.select("chrom", F.col("g").alias("pos"), "g", F.lit(1).alias("tag"), *(F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in rest))
    )
    marks = marks.withColumn("bucket", F.floor(F.col("pos") / bucket))
    best, order = (F.min, [F.desc("pos"), F.desc("tag")]) if ahead else (F.max, [F.asc("pos"), F.desc("tag")])
    # Frames that begin at the partition's start, as one with an open end is computed anew for each row.
    inside = Window.partitionBy("chrom", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("chrom").orderBy(F.desc("bucket") if ahead else F.asc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.groupBy("chrom", "bucket").agg(best("g").alias("edge")).withColumn("carried", best("edge").over(before)).drop("edge")
    found = marks.withColumn("own", best("g").over(inside)).where("tag = 0").join(carried, ["chrom", "bucket"])
    return found.select("chrom", "pos", *rest, F.coalesce("own", "carried").alias("g"))


def nearest_gene(regions: DataFrame, genes: DataFrame) -> DataFrame:
    """Each region (key) with the gene of least (distance, -overlap, not coding, name).

    Returns key, gene_name, distance, n_ties (genes equal in the first three). Candidates
    are the overlapping genes and, by running extremes over positions, the genes that begin
    nearest to the right and end nearest to the left. Which genes are eligible is the
    caller's choice, see ``normalization.eligible``.
    """
    r = regions.select("key", "chrom", "start", "end")
    g = genes.select("chrom", F.col("start").alias("g_start"), F.col("end").alias("g_end"), "gene_name", "is_coding")
    width = bin_width(genes)
    over = overlap_join(r, g.select("chrom", F.col("g_start").alias("start"), F.col("g_end").alias("end"), "gene_name", "is_coding"), width)
    inside = over.select("l.key", "l.start", "l.end", F.col("r.start").alias("g_start"), F.col("r.end").alias("g_end"), "r.gene_name", "r.is_coding")

    asked = lambda at: r.select("chrom", F.col(at).alias("pos"), "key", "start", "end")
    known = lambda at: g.select("chrom", F.col(at).cast("long").alias("g"))
    right = _nearest_beyond(asked("end"), known("g_start"), True, 64 * width).where("g is not null").withColumnRenamed("g", "g_start").join(g, ["chrom", "g_start"])
    left = _nearest_beyond(asked("start"), known("g_end"), False, 64 * width).where("g is not null").withColumnRenamed("g", "g_end").join(g, ["chrom", "g_end"])

    columns = ["key", "start", "end", "g_start", "g_end", "gene_name", "is_coding"]
    found = inside.select(columns).unionByName(right.select(columns)).unionByName(left.select(columns))
    bp = overlap_bp(F.col("start"), F.col("end"), F.col("g_start"), F.col("g_end"))
    ranked = found.select("key", F.struct(F.greatest(F.lit(0), -bp).alias("d"), (-F.greatest(F.lit(0), bp)).alias("o"), (~F.col("is_coding")).alias("c")).alias("rank"), "gene_name")
    # Only what ties for a region's first place is shuffled: Spark limits the groups of a rank before it deals them.
    first = ranked.withColumn("place", F.rank().over(Window.partitionBy("key").orderBy("rank"))).where("place = 1")
    best = first.groupBy("key").agg(F.min("gene_name").alias("gene_name"), F.min("rank.d").alias("distance"), F.count_distinct("gene_name").alias("n_ties"))
    return r.select("key").join(best, "key", "left").select("key", "gene_name", "distance", "n_ties")
