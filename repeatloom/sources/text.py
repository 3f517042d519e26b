"""Readers of interval, gene, alignment and genotype text files (plain or gzip)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import ALT, PRIMARY, gtf_attribute, period
from . import InputError
from .sheets import read_sheet


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line): lines without comments and blanks, in file order, outer white space removed."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    text = spark.read.text(path).select(place.alias("ord"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"))
    return text.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def _fields(df: DataFrame) -> DataFrame:
    return df.withColumn("f", F.split("line", "\t"))


def _int(c: Column) -> Column:
    return F.trim(c).try_cast("long")


def alternate_triplets(fields: Column, first: Column) -> Column:
    """(chrom, start, end) triplets from the field numbered ``first`` (from 0), up to the first that isn't one."""
    n = F.floor((F.size(fields) - first) / 3).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    every = F.transform(
        at,
        lambda i: F.struct(
            F.regexp_replace(F.get(fields, (first + i * 3).cast("int")), r"^\s+|\s+$", "").alias("chrom"),
            _int(F.get(fields, (first + i * 3 + 1).cast("int"))).alias("start"),
            _int(F.get(fields, (first + i * 3 + 2).cast("int"))).alias("end"),
        ),
    )
    bad = F.array_position(F.transform(every, lambda t: t["start"].isNull() | t["end"].isNull()), True).cast("int")
    return F.when(bad > 0, F.slice(every, F.lit(1), bad - 1)).otherwise(every).cast(ALT)


def parse_regions(rows: DataFrame, legacy_period_dot: bool = True) -> DataFrame:
    """Regions from (ord, line): key, chrom, start, end, name, gene, period, alt_regions.

    Column 6 is a period if it is a positive whole number, and alternates follow it;
    otherwise alternates begin there. With ``legacy_period_dot`` a '.' there hides the
    alternates after it, as it does in files written that way.
    """
    f = F.col("f")
    size = _int(F.get(f, F.lit(5))).cast("int")
    has = F.coalesce(size > 0, F.lit(False))
    dot = F.lit(not legacy_period_dot) & (F.trim(F.get(f, F.lit(5))) == ".")
    first = F.when(has | F.coalesce(dot, F.lit(False)), F.lit(6)).otherwise(F.lit(5))
    gene = F.trim(F.get(f, F.lit(4)))
    out = _fields(rows).select(
        "ord", F.get(f, F.lit(0)).alias("chrom"), _int(F.get(f, F.lit(1))).alias("start"), _int(F.get(f, F.lit(2))).alias("end"),
        F.get(f, F.lit(3)).alias("given"), F.when(~gene.isin("", ".", "NA"), gene).alias("gene"),
        F.when(has, size).alias("period"), alternate_triplets(f, first).alias("alt_regions"),
    )
    name = F.coalesce("given", F.concat("chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))
    return out.select("ord", name.alias("name"), "chrom", "start", "end", "gene", "period", "alt_regions")


def read_regions(spark: SparkSession, path: str, legacy_period_dot: bool = True) -> DataFrame:
    """Regions of a BED file; a row without three usable columns, or a file without rows, is an error."""
    found = parse_regions(lines(spark, path), legacy_period_dot)
    total, bad = found.agg(F.count("*"), F.count_if(F.col("start").isNull() | F.col("end").isNull())).first()
    if bad or not total:
        raise InputError(f"{path}: {'no regions' if not total else f'{bad} rows without chrom, start and end'}")
    return found


def parse_genes(rows: DataFrame) -> DataFrame:
    """Gene records of (ord, line): ord, gene_name, chrom, start (from 0), end, gene_type."""
    f, a = F.col("f"), F.get(F.col("f"), F.lit(8))
    genes = _fields(rows).where((F.size("f") >= 9) & (F.get(f, F.lit(2)) == "gene"))
    named = genes.select(
        "ord", F.coalesce(gtf_attribute(a, "gene_name"), gtf_attribute(a, "gene_id")).alias("gene_name"), F.get(f, F.lit(0)).alias("chrom"),
        (_int(F.get(f, F.lit(3))) - 1).alias("start"), _int(F.get(f, F.lit(4))).alias("end"),
        F.coalesce(gtf_attribute(a, "gene_type"), gtf_attribute(a, "gene_biotype"), F.lit("unknown")).alias("gene_type"),
    )
    return named.where("gene_name is not null")


def one_record_per_gene(genes: DataFrame) -> DataFrame:
    """The first record of each name; the first on a primary chromosome goes before others."""
    rank = F.struct((~F.col("chrom").rlike(PRIMARY)).alias("other"), "ord")
    best = genes.groupBy("gene_name").agg(F.min_by(F.struct("chrom", "start", "end", "gene_type"), rank).alias("g"))
    return best.select("gene_name", "g.*")


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """Genes of a GTF file, unique by name."""
    found = one_record_per_gene(parse_genes(lines(spark, path)))
    if found.isEmpty():
        raise InputError(f"{path}: no genes")
    return found


def parse_alignments(rows: DataFrame) -> DataFrame:
    """Block alignments (22 columns) onto primary chromosomes: chrom, t_start, t_end, alt_name, q_size, strand, blocks."""
    f = F.col("f")
    col = lambda i: F.get(f, F.lit(i))
    numbers = lambda i: F.transform(F.filter(F.split(col(i), ","), lambda x: x != ""), lambda x: x.try_cast("long"))
    sizes, q, t = numbers(19), numbers(20), numbers(21)
    n = F.least(F.size(sizes), F.size(q), F.size(t))
    blocks = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.get(t, i).alias("t"), F.get(q, i).alias("q"), F.get(sizes, i).alias("size")))
    found = _fields(rows).where((F.size("f") >= 22) & col(14).rlike(PRIMARY)).select(
        col(14).alias("chrom"), _int(col(16)).alias("t_start"), _int(col(17)).alias("t_end"), col(10).alias("alt_name"),
        _int(col(11)).alias("q_size"), col(9).alias("strand"), blocks.alias("blocks"),
    )
    return found.where("t_start is not null and t_end is not null and q_size is not null and not exists(blocks, b -> b.t is null or b.q is null or b.size is null)")


def parse_sam(rows: DataFrame, sample: str) -> DataFrame:
    """Reads of SAM lines: sample, qname, chrom, start, end (by the CIGAR), is_unmapped."""
    f = F.col("f")
    flag, pos = _int(F.get(f, F.lit(1))), _int(F.get(f, F.lit(3))) - 1
    steps = F.regexp_extract_all(F.get(f, F.lit(5)), F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    span = F.aggregate(F.transform(steps, lambda s: s.cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    found = _fields(rows.where(~F.col("line").startswith("@"))).where(F.size("f") >= 11)
    return found.select(F.lit(sample).alias("sample"), F.get(f, F.lit(0)).alias("qname"), F.get(f, F.lit(2)).alias("chrom"), pos.alias("start"), (pos + F.greatest(span, F.lit(1))).alias("end"), (flag.bitwiseAND(F.lit(4)) != 0).alias("is_unmapped"))


def read_alignments(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """Reads of a file by its suffix: SAM text (plain or .gz), BAM, or Parquet with these columns; CRAM can't be read."""
    low = path.lower()
    if low.endswith(".cram"):
        raise InputError(f"{path}: CRAM can't be decoded; convert it to BAM or SAM")
    if low.endswith(".bam"):
        from .bam import read_bam

        return read_bam(spark, path, sample)
    if low.endswith(".parquet"):
        return spark.read.parquet(path).select(F.lit(sample).alias("sample"), "qname", "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "is_unmapped")
    return parse_sam(spark.read.text(path).withColumnRenamed("value", "line"), sample)


def sample_name(path: Column) -> Column:
    """The file's name less one alignment suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.(cram|bam|sam)$", "")


def parse_sites(rows: DataFrame) -> DataFrame:
    """Sites of a population VCF: ord, chrom, pos (text), altanno, genotypes."""
    f = F.col("f")
    info = F.filter(F.split(F.get(f, F.lit(7)), ";"), lambda p: p.startswith("ALTANNO="))
    return _fields(rows).where(F.size("f") > 9).select(
        "ord", F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).alias("pos"),
        F.substring(F.get(info, F.lit(0)), 9, 1 << 30).alias("altanno"), F.slice(f, F.lit(10), F.size(f)).alias("genotypes"),
    )


def sample_names(spark: SparkSession, path: str) -> list[str]:
    """Samples of a population VCF: the fields after the ninth of the #CHROM line."""
    first = spark.read.text(path).where(F.col("value").startswith("#CHROM")).limit(1).collect()
    return first[0][0].split("\t")[9:] if first else []


def region_list(rows: DataFrame) -> DataFrame:
    """A headerless list of intervals (ord, line), without periods: short rows and rows without whole numbers are dropped."""
    f = F.col("f")
    found = _fields(rows).where(F.size("f") >= 3).select("ord", F.get(f, F.lit(0)).alias("chrom"), _int(F.get(f, F.lit(1))).alias("start"), _int(F.get(f, F.lit(2))).alias("end"), F.lit(None).cast("int").alias("period"))
    return found.where("start is not null and end is not null")


def _places(header: list[str], path: str, first_period: bool) -> tuple[str, str, str, str | None]:
    """The names of the columns of chromosome, start, end and period, whatever their case."""
    by = {h.lower(): h for h in header}
    chrom = by.get("chrom") or by.get("chr")
    if not (chrom and "start" in by and "end" in by):
        raise InputError(f"{path}: columns chrom (or chr), start and end are needed, found {header}")
    periods = [h for h in header if h.lower() in ("cons_len", "period")]
    period_ = (periods[0] if periods else None) if first_period else by.get("cons_len") or by.get("period")
    return chrom, by["start"], by["end"], period_


def read_region_list(spark: SparkSession, path: str) -> DataFrame:
    """(ord, chrom, start, end, period) of a list: XLSX or CSV with a header, or tab-separated with or without one.

    A tab-separated file has no header if its second field is a whole number. With a header,
    rows too short are dropped and others must hold whole numbers; without one, both are
    dropped. Of several columns for the period, XLSX and CSV prefer cons_len, a tab-separated
    file takes the first.
    """
    low = path.lower()
    # Only fixed names, as a column may be called like anything.
    col = lambda c: F.col(f"`{c}`")
    length = lambda size: (period(col(size)) if size else F.lit(None).cast("int")).alias("period")
    if low.endswith(".xls"):
        raise InputError(f"{path}: the old spreadsheet format can't be read; save the list as XLSX or CSV")
    if low.endswith(".xlsx"):
        table = read_sheet(spark, path, "__ord")
        chrom, start, end, size = _places(table.columns[1:], path, False)
        whole = lambda c: col(c).cast("double").cast("long")  # noqa: E731  # a sheet may keep 12 as 1.2E1
        return table.select(F.col("__ord").alias("ord"), col(chrom).alias("chrom"), whole(start).alias("start"), whole(end).alias("end"), length(size))
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    if low.endswith((".csv", ".csv.gz")):
        table = spark.read.option("header", True).csv(path)
        chrom, start, end, size = _places(table.columns, path, False)
        return table.select(place.alias("ord"), col(chrom).alias("chrom"), col(start).cast("long").alias("start"), col(end).cast("long").alias("end"), length(size))
    text = spark.read.text(path).select(place.alias("ord"), F.col("value").alias("line")).where(~F.col("line").startswith("#"))
    first = text.orderBy("ord").limit(1).collect()
    if not first:
        raise InputError(f"{path}: no rows")
    header = first[0].line.split("\t")
    if len(header) > 1 and header[1].lstrip("-").isdigit():
        return region_list(text)
    chrom, start, end, size = (header.index(h) if h is not None else None for h in _places(header, path, True))
    f = F.col("f")
    rows = _fields(text.where(F.col("line") != first[0].line)).where(F.size("f") > max(chrom, start, end))
    at = lambda i: F.get(f, F.lit(i))
    return rows.select("ord", at(chrom).alias("chrom"), at(start).cast("long").alias("start"), at(end).cast("long").alias("end"), (period(at(size)) if size is not None else F.lit(None).cast("int")).alias("period"))


# Fixed names: the columns of a catalogue file, in order.
CATALOGUE = [
    "chrom", "start", "end", "motifs", "cluster_type", "vntr_type", "cons_len", "cons_seq", "col_8", "col_9", "col_10", "col_11",
    "genomic_context", "bio_context_1", "bio_context_2", "bio_context_3",
]


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """ord and the CATALOGUE columns, as text, of a tab-separated file without a header."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    fields = F.split("value", "\t")
    return spark.read.text(path).where("value <> ''").select(place.alias("ord"), *(F.get(fields, F.lit(i)).alias(c) for i, c in enumerate(CATALOGUE)))


def read_summary(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A summary table (XLSX or CSV with header, or Parquet) with ``numbers`` as doubles, null where they aren't numbers."""
    if path.lower().endswith(".xlsx"):
        table = read_sheet(spark, path)
    else:
        table = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)
    return table.withColumns({c: F.col(c).try_cast("double") for c in numbers})


def wide_rows(values: DataFrame) -> DataFrame:
    """(ord, line) of a sample by region table from (input_ord, sample, metric, region_ord, value): one text line a sample, nulls empty."""
    cells = F.array_sort(F.collect_list(F.struct("region_ord", F.coalesce(F.col("value").cast("string"), F.lit("")).alias("v"))))
    by = values.groupBy("input_ord", "sample", "metric").agg(cells.alias("cells"))
    return by.select(F.col("input_ord").alias("ord"), F.concat_ws(",", "sample", "metric", F.array_join(F.col("cells.v"), ",")).alias("line"))
