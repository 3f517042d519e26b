import random

from pyspark.sql import functions as F

from repeatloom.functions.rounding import plain_number, round_half_even
from repeatloom.plans import annotation, haplotype_export


def test_rounding_equals_python(spark):
    rng = random.Random(5)
    values = [0.0, 0.5, 2.5, 0.00005, 0.00015, 2.67495, 1.00005, -0.00025, -1.5, 1e-9, 3.14159265, *(rng.randrange(10**7) / 10**5 + 5e-5 for _ in range(3000)), *(rng.random() * 50 for _ in range(2000))]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select("x", round_half_even(F.col("x"), 4).alias("y"), plain_number(round_half_even(F.col("x"), 4), 4).alias("t")).collect()
    assert [(r.x, r.y) for r in rows if r.y != round(r.x, 4)] == []
    assert all(float(r.t) == r.y and "E" not in r.t for r in rows)


def test_site_statistics_and_lines(spark):
    rows = [(1, "chr1", "10", "0-1,0-1-1,0", ["0/1", "1/1", "./.", "2/.", "0/2"]), (2, "chr1", "20", None, ["./.", "./.", "./.", "./.", "./."])]
    sites = spark.createDataFrame(rows, "ord int, chrom string, pos string, altanno string, genotypes array<string>")
    catalogue = spark.createDataFrame([(1, "chr1", "10", "old"), (2, "chr1", "10", 'a,"b"'), (3, "chr1", "20", None), (4, "chr9", "1", "x")], "ord int, chrom string, pos string, motif string")
    full = haplotype_export.with_catalogue(haplotype_export.with_statistics(sites), catalogue)
    got = {r.ord: r for r in full.collect()}
    assert [got[1][s] for s in haplotype_export.STATISTICS] == [2.25, 2.0, 0.9167, 1.0, 4.6667, 2.3333, 0.6531, 0.6667]
    assert [got[2][s] for s in haplotype_export.STATISTICS] == [None] * 8
    lines = {r.ord: r.line for r in haplotype_export.csv_lines(full, ["chrom", "pos", "motif"]).collect()}
    assert lines[1] == 'chr1,10,"a,""b""",3,2,3,3,,,1,,2,1,2.25,2.0,0.9167,1.0,4.6667,2.3333,0.6531,0.6667'
    assert lines[2] == "chr1,20,," + "," * 10 + ",,,,,,,"
    assert [r.ord for r in haplotype_export.variable_sites(full).collect()] == [1]


def test_annotation(spark, tmp_path):
    regions = spark.createDataFrame([(1, "chr1", 110, 130, 7), (2, "chr1", 900, 950, None)], "ord int, chrom string, start long, end long, period int")
    genes = spark.createDataFrame([("chr1", 0, 120, "N", False), ("chr1", 120, 200, "C", True)], "chrom string, start long, end long, gene_name string, is_coding boolean")
    blocks = [(100, 10, 20), (120, 45, 30)]
    alignments = spark.createDataFrame([("chr1", 100, 150, "z_alt", 200, "+", blocks), ("chr1", 100, 150, "a_alt", 200, "-", blocks)], "chrom string, t_start long, t_end long, alt_name string, q_size long, strand string, blocks array<struct<t:bigint,q:bigint,size:bigint>>")
    found = annotation.annotate(regions, genes, alignments)
    annotation.write_bed(found, str(tmp_path / "out"), ["Regions", ""])
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines == ["# Regions", "#", "chr1\t110\t130\tchr1:110-130\tC\t7\ta_alt\t145\t180\tz_alt\t20\t55", "chr1\t900\t950\tchr1:900-950\t.\t."]
    assert tuple(annotation.summary(found).first()) == (2, 1, 1, 0, 1, 1, 1)
    plain = annotation.annotate(regions, genes)
    assert [r.line for r in plain.orderBy("ord").select(annotation.bed_line(False).alias("line")).collect()][0] == "chr1\t110\t130\tchr1:110-130\tC\t7"
    assert tuple(annotation.summary(plain).first())[-2:] == (0, 0)
