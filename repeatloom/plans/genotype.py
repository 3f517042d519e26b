"""Reads to region counts and copies: from tables, or from files as one run."""

from __future__ import annotations

import logging
import os
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import selection
from ..operators.counting import gene_mode, hits, local_mode, read_counts, targets
from ..operators.normalization import assign_genes, targets_of, with_alternates
from ..sources.text import InputError, lines, parse_alignments, read_alignments, read_genes, read_regions

log = logging.getLogger("repeatloom")

#: Folder of the default lists, which are not part of the package, and their names there.
DATA_FOLDER = os.path.join(os.path.dirname(os.path.dirname(__file__)), "data")
DEFAULT_REGIONS, DEFAULT_GENES, DEFAULT_ALIGNMENTS = (os.path.join(DATA_FOLDER, name) for name in ("regions.bed", "genes.gtf.gz", "alignments.psl.gz"))


def count_regions(reads: DataFrame, samples: DataFrame, regions: DataFrame, *, norm_method: str = "gene", norms: DataFrame | None = None, norm_window: int = 5000, alternates: bool = True) -> DataFrame:
    """(sample, key, metric, value) for every sample and region.

    Without ``norms`` in gene mode the metric is read_count. If any region has a period, the
    metric is predicted_copies for all, else density_ratio.
    """
    if norm_method not in ("gene", "local"):
        raise ValueError(f"norm_method is gene or local, not {norm_method}")
    if norm_method == "gene" and norms is None:
        counts = read_counts(hits(reads, targets(regions)), samples, regions)
        return counts.select("sample", "key", F.lit("read_count").alias("metric"), F.col("n_reads").cast("double").alias("value"))
    full = gene_mode(reads, samples, regions, norms) if norm_method == "gene" else local_mode(reads, samples, regions, norm_window, alternates)
    copies = not regions.where("period is not null").isEmpty()
    metric = "predicted_copies" if copies else "density_ratio"
    return full.select("sample", "key", F.lit(metric).alias("metric"), F.col(metric).alias("value"))


def choose_regions(spark: SparkSession, *, default: bool = False, gene=None, vntr=None, regions: str | None = None, chrom=None) -> DataFrame:
    """The regions of a run, numbered in order in ``key``; raises if there are none.

    Genes and names select from the default list, a file adds its own. Values that match
    nothing are logged as warnings.
    """
    selection.check_selection(default, gene, vntr, regions)
    found = None
    if default or gene or vntr:
        if not os.path.exists(DEFAULT_REGIONS):
            raise InputError(f"the default list {DEFAULT_REGIONS} is missing; give a file of regions")
        listed = read_regions(spark, DEFAULT_REGIONS)
        for column, wanted in (("gene", gene), ("name", vntr)):
            for row in selection.unmatched(listed, column, wanted).collect() if wanted else []:
                log.warning("%s %r matches no region of the default list", column, row[0])
        found = selection.select_regions(listed, gene or None, vntr or None)
    if regions:
        own = read_regions(spark, regions)
        found = selection.merge_regions(found, own) if found is not None else own.withColumn("source", F.lit(1))
    if found is None or found.isEmpty():
        raise selection.SelectionError("no regions were selected")
    if "source" not in found.columns:
        found = found.withColumn("source", F.lit(0))
    if chrom is not None:
        wanted = [chrom] if isinstance(chrom, str) else list(chrom)
        for row in selection.unmatched(found, "chrom", wanted).collect():
            log.warning("no regions on %s", row[0])
        found = selection.on_chromosomes(found, wanted)
        if found.isEmpty():
            raise selection.SelectionError(f"no regions on {sorted(wanted)}")
    # A list of regions is small next to reads: it is numbered in one task.
    return found.withColumn("key", F.row_number().over(Window.orderBy("source", "ord")).cast("long")).cache()


def backgrounds(spark: SparkSession, regions: DataFrame, genes_path: str, types, alignments_path: str | None) -> tuple[DataFrame, DataFrame]:
    """Regions with norm_key, and their backgrounds (norm_key, chrom, start, end, alt_regions)."""
    genes = read_genes(spark, genes_path).cache()
    assigned = assign_genes(regions, genes, types).cache()  # as small as the list of regions, and used many times
    for row in assigned.where("norm_key is null").select("name", "chrom").collect():
        log.warning("%s: no eligible gene on %s; its values will be empty", row.name, row.chrom)
    for row in assigned.where("n_ties > 1").select("name", "norm_key").collect():
        log.warning("%s: several genes are equally near, %s is taken", row.name, row.norm_key)
    places = targets_of(assigned, genes)
    for row in places.where("chrom is null").select("norm_key").collect():
        log.warning("%s is neither a gene nor an interval; its regions' values will be empty", row.norm_key)
    norms = places.where("chrom is not null")
    if alignments_path and os.path.exists(alignments_path):
        norms = with_alternates(norms, parse_alignments(lines(spark, alignments_path)))
    elif alignments_path:
        log.warning("%s doesn't exist; backgrounds go without alternate contigs", alignments_path)
    norms = norms.cache()
    # A key without a place has no background, hence no value.
    return assigned.join(norms.select(F.col("norm_key").alias("known")), F.col("norm_key") == F.col("known"), "left").withColumn("norm_key", F.col("known")).drop("known", "distance", "n_ties"), norms


def sample_of(path: str) -> str:
    """The file's name less one alignment suffix."""
    return re.sub(r"\.(cram|bam|sam)$", "", os.path.basename(path), flags=re.I)


def count(
    spark: SparkSession, input_files, *, default: bool = False, gene=None, vntr=None, regions: str | None = None, chrom=None,
    gtf: str | None = DEFAULT_GENES, psl: str | None = DEFAULT_ALIGNMENTS, no_alt_contigs: bool = False,
    norm_gene_types=("protein_coding",), norm_method: str = "gene", norm_window: int = 5000, output_csv: str | None = None,
) -> DataFrame:
    """Count reads over regions in alignment files: (input_ord, sample, metric, region_ord, name, value), a row for each file and region.

    Without ``gtf`` in gene mode values are read counts; local mode needs none. The value is
    null where a background is missing or empty. ``output_csv`` is written wide, a line for
    each file in order and a column for each region in order.
    """
    if norm_method not in ("gene", "local"):
        raise ValueError(f"norm_method is gene or local, not {norm_method}")
    files = [input_files] if isinstance(input_files, str) else list(input_files)
    chosen = choose_regions(spark, default=default, gene=gene, vntr=vntr, regions=regions, chrom=chrom)
    reads = None
    for i, path in enumerate(files):
        one = read_alignments(spark, path, str(i))
        reads = one if reads is None else reads.unionByName(one)
    if reads is None:
        raise ValueError("no input files")
    samples = spark.createDataFrame([(str(i), i, sample_of(p)) for i, p in enumerate(files)], "sample string, input_ord int, name string")
    norms = None
    if norm_method == "gene" and gtf is not None:
        chosen, norms = backgrounds(spark, chosen, gtf, list(norm_gene_types), None if no_alt_contigs else psl)
    values = count_regions(reads, samples, chosen, norm_method=norm_method, norms=norms, norm_window=norm_window, alternates=not no_alt_contigs)
    named = values.join(F.broadcast(samples.select("sample", "input_ord", F.col("name").alias("file"))), "sample").join(chosen.select("key", "name"), "key")
    out = named.select("input_ord", F.col("file").alias("sample"), "metric", F.col("key").alias("region_ord"), "name", "value")
    if output_csv is not None:
        write_wide(out, output_csv)
    return out


def _field(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if re.search('[",\r\n]', text) else text


def write_wide(values: DataFrame, path: str) -> None:
    """One CSV file with a header: sample, metric and a column for each region; rows come one at a time."""
    names = [r.name for r in values.select("region_ord", "name").distinct().orderBy("region_ord").collect()]
    cells = F.array_sort(F.collect_list(F.struct("region_ord", "value"))).alias("cells")
    rows = values.groupBy("input_ord", "sample", "metric").agg(cells).orderBy("input_ord")
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write(",".join(map(_field, ["sample", "metric", *names])) + "\n")
        for row in rows.toLocalIterator():
            number = (lambda v: str(int(v))) if row.metric == "read_count" else repr
            out.write(",".join([_field(row.sample), row.metric, *("" if c.value is None else number(c.value) for c in row.cells)]) + "\n")
