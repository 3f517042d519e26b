"""Coordinates on alternate contigs through aligned blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_span(start: Column, end: Column, blocks: Column, q_size: Column, strand: Column) -> Column:
    """Struct (start, end) of a target interval on the query, or null.

    Blocks (t, q, size) that overlap map base by base. Where two blocks follow each other
    without a gap on the target, what the query has between them counts as well, if their
    junction lies in the interval, ends included. On '-' the span is mirrored.
    """
    hit = F.filter(blocks, lambda b: (b["t"] < end) & (b["t"] + b["size"] > start))
    mapped = F.transform(
        hit,
        lambda b: F.struct(
            (b["q"] + F.greatest(start, b["t"]) - b["t"]).alias("s"),
            (b["q"] + F.least(end, b["t"] + b["size"]) - b["t"]).alias("e"),
        ),
    )
    pairs = F.zip_with(
        F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0))),
        F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))),
        lambda a, b: F.struct((a["t"] + a["size"]).alias("t"), (b["t"] == a["t"] + a["size"]).alias("adjacent"), (a["q"] + a["size"]).alias("s"), b["q"].alias("e")),
    )
    inserted = F.transform(
        F.filter(pairs, lambda p: p["adjacent"] & (p["e"] > p["s"]) & (p["t"] >= start) & (p["t"] <= end)),
        lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e")),
    )
    spans = F.concat(mapped, inserted)
    low, high = F.array_min(F.transform(spans, lambda x: x["s"])), F.array_max(F.transform(spans, lambda x: x["e"]))
    plus, minus = F.struct(low.alias("start"), high.alias("end")), F.struct((q_size - high).alias("start"), (q_size - low).alias("end"))
    return F.when(F.size(spans) > 0, F.when(strand == "-", minus).otherwise(plus))


def lift(regions: DataFrame, alignments: DataFrame) -> DataFrame:
    """(key, alt_name, start, end): the union of a region's spans on each alternate contig.

    alignments: chrom, t_start, t_end, alt_name, q_size, strand, blocks.
    """
    from .overlap import overlap_join

    pairs = overlap_join(regions.select("key", "chrom", "start", "end"), alignments.withColumnRenamed("t_start", "start").withColumnRenamed("t_end", "end"))
    span = block_span(F.col("l.start"), F.col("l.end"), F.col("r.blocks"), F.col("r.q_size"), F.col("r.strand"))
    spans = pairs.select("l.key", "r.alt_name", span.alias("x")).where("x is not null")
    return spans.groupBy("key", "alt_name").agg(F.min("x.start").alias("start"), F.max("x.end").alias("end"))
