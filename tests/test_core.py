import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from repeatloom.functions import metrics
from repeatloom.operators import cohort, counting, overlap, stats
from repeatloom.sources import text

REGION = "key long, chrom string, start long, end long, period int, norm_key string, alt_regions array<struct<chrom:string,start:bigint,end:bigint>>"
READS = [("s", q, "chr5", a, b, u) for q, a, b, u in [("r1", 90, 101, False), ("r2", 200, 210, False), ("r3", 195, 199, False), ("r3", 500, 550, False), ("r4", 500, 600, False), ("r6", 150, 151, True), ("r7", 60, 80, False)]]


@pytest.fixture(scope="module")
def tables(spark):
    regions = spark.createDataFrame([(1, "chr5", 100, 200, 10, "G", []), (2, "chr5", 180, 220, None, "G", [])], REGION)
    reads = spark.createDataFrame(READS, "sample string, qname string, chrom string, start long, end long, is_unmapped boolean")
    return reads, reads.select("sample").distinct(), regions


def test_gene_mode(spark, tables):
    norms = spark.createDataFrame([("G", "chr5", 0, 1000)], "norm_key string, chrom string, start long, end long")
    rows = {r.key: r for r in counting.gene_mode(*tables, norms).collect()}
    assert [(rows[k].n_reads, rows[k].n_background) for k in (1, 2)] == [(2, 2), (2, 2)]
    assert [rows[k].density_ratio for k in (1, 2)] == [8.6, 21.5]
    assert [rows[k].predicted_copies for k in (1, 2)] == [172.0, None]


def test_local_mode(tables):
    rows = {r.key: r for r in counting.local_mode(*tables, 50).collect()}
    assert (rows[1].n_background, rows[1].density_ratio, rows[1].predicted_copies) == (1, 1.2, 24.0)
    assert rows[2].density_ratio is None


def test_published_ratios(spark):
    """20 reads a region, 60 background reads, 50,449 background bases."""
    df = spark.createDataFrame([(404, 41.624587), (182, 92.397436), (132, 127.396465), (1031, 16.310702), (449, 37.452858)], "n long, want double")
    ratio = metrics.density_ratio(F.lit(20), F.col("n"), F.lit(60), F.lit(50449))
    assert df.where(F.round(ratio, 6) != F.col("want")).isEmpty()


def test_overlap_and_nearest_equal_brute_force(spark):
    rng = random.Random(3)
    iv = lambda n, top: [(i, rng.choice("ab"), s := rng.randrange(top), s + rng.randrange(1, 60)) for i in range(n)]
    left, right = iv(120, 900), iv(60, 900)
    schema = "key long, chrom string, start long, end long"
    pairs = overlap.overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 16).select("l.key", F.col("r.key").alias("k2")).collect()
    want = [(a, b) for a, c, s, e in left for b, c2, s2, e2 in right if c == c2 and s < e2 and s2 < e]
    assert sorted(map(tuple, pairs)) == sorted(want)
    genes = [(c, s, e, f"g{i % 50}", i % 3 == 0) for i, c, s, e in right]
    got = {r.key: r for r in overlap.nearest_gene(spark.createDataFrame(left, schema), spark.createDataFrame(genes, "chrom string, start long, end long, gene_name string, is_coding boolean")).collect()}
    for key, c, s, e in left:
        ranks = sorted((max(0, s2 - e, s - e2), -max(0, min(e, e2) - max(s, s2)), not k, n) for c2, s2, e2, n, k in genes if c2 == c)
        assert got[key].gene_name == ranks[0][3]
        assert got[key].n_ties == len({r[3] for r in ranks if r[:3] == ranks[0][:3]})


@pytest.mark.parametrize("tail, period, alts", [("g\t40\tA\t1\t2\tB\t3\tx\tC\t5\t6", 40, 1), ("g\t.\tA\t1\t2", None, 0), ("g\tA\t1\t2", None, 1), ("g\t0\tA\t1\t2", None, 0), ("g\t40\tA\t1", 40, 0), ("g", None, 0)])
def test_ragged_regions(spark, tail, period, alts):
    row = text.parse_regions(spark.createDataFrame([(1, f"chr1\t5\t9\tn\t{tail}")], "ord int, line string")).first()
    assert (row.period, len(row.alt_regions)) == (period, alts)


def test_genotypes(spark):
    calls = spark.createDataFrame([(g,) for g in ("0/1", "1/1", "./.", "2/.", "0/2")], "g string").withColumn("c", metrics.allele_copies(F.lit("0-1,0-1-1,0")))
    a, b = metrics.genotype_copies(F.col("g"), F.col("c"))
    calls = calls.select(F.lit(1).alias("site"), a.alias("cn1"), b.alias("cn2"))
    h1, h2 = metrics.haplotypes(F.col("cn1"), F.col("cn2"))
    r = cohort.haplotype_stats(calls.withColumns({"hap1": h1, "hap2": h2})).first()
    want = {"mean_hap1": 2.25, "var_hap1": 0.9167, "mean_hap2": 2.0, "var_hap2": 1.0, "mean_combined": 4.6667, "var_combined": 2.3333, "h_exp": 0.6531, "h_obs": 0.6667}
    assert {k: round(r[k], 4) for k in want} == want


def test_histogram_and_p_value(spark):
    df = spark.createDataFrame([(x,) for x in (6, 7, 100, 101)], "x int")
    assert {r.bin: r.n for r in stats.histogram(df, "x", 7, 100, 50).collect() if r.n} == {1: 1, 50: 1}
    assert stats.p_value(0.5, 10) == pytest.approx(0.141113, abs=1e-6)


def test_backgrounds_take_alternates(spark):
    """A read in an alternate's flank, and one in a background's alternate, count as background."""
    regions = spark.createDataFrame([(1, "chr5", 100, 200, 10, "G", [("alt", 30, 60)]), (2, "chr6", 100, 200, 10, "H", None)], REGION)
    rows = [("s", "a", "chr5", 110, 120, False), ("s", "b", "alt", 0, 5, False), ("s", "c", "alt", 100, 105, False), ("s", "d", "alt", 40, 50, False), ("s", "e", "alt", 115, 120, False), ("s", "f", "chr5", 60, 70, False)]
    reads = spark.createDataFrame(rows, "sample string, qname string, chrom string, start long, end long, is_unmapped boolean")
    samples = reads.select("sample").distinct()
    assert {r.key: (r.n_reads, r.n_background) for r in counting.local_mode(reads, samples, regions, 50).collect()} == {1: (2, 3), 2: (0, 0)}
    assert {r.key: r.n_background for r in counting.local_mode(reads, samples, regions, 50, alternates=False).collect()} == {1: 1, 2: 0}
    norms = spark.createDataFrame([("G", "chr5", 0, 1000, [("alt", 90, 130)]), ("H", "chr6", 0, 1000, None)], "norm_key string, chrom string, start long, end long, alt_regions array<struct<chrom:string,start:bigint,end:bigint>>")
    assert {r.key: r.n_background for r in counting.gene_mode(reads, samples, regions, norms).collect()} == {1: 3, 2: 0}


def test_backgrounds_equal_brute_force(spark):
    """Regions that touch, nest or have no width, alternates, and names with several reads."""
    draw = random.Random(7)
    chroms = ["chr1", "chr2", "alt"]

    def place(most):
        at = draw.randrange(400)
        return draw.choice(chroms), at, at + draw.randrange(most)

    regions = [(k, *place(40), 3, str(k % 4), [place(30) for _ in range(k % 3)]) for k in range(60)]
    regions += [(60, "chr1", 100, 120, 3, "0", []), (61, "chr1", 120, 140, 3, "1", []), (62, "chr1", 110, 110, 3, "2", None)]
    reads = [(draw.choice("st"), f"q{draw.randrange(150)}", *place(25), draw.random() < 0.1) for _ in range(400)]
    norms = [(str(n), *place(300), [place(100)] if n % 2 else None) for n in range(4)]

    def meet(a, b):
        return a[0] == b[0] and max(a[1], b[1]) < min(a[2], b[2])

    def found(places):
        return {(r[0], r[1]) for r in reads if not r[5] and any(meet(r[2:5], p) for p in places)}

    own = {r[0]: found([r[1:4], *(r[6] or [])]) for r in regions}

    def want(home, alternates):
        left_out = set().union(*(own[r[0]] for r in regions if meet(home, r[1:4])))
        return found([home, *alternates]) - left_out

    table = spark.createDataFrame(reads, "sample string, qname string, chrom string, start long, end long, is_unmapped boolean")
    asked = spark.createDataFrame(regions, REGION)
    samples = table.select("sample").distinct()
    back = spark.createDataFrame(norms, "norm_key string, chrom string, start long, end long, alt_regions array<struct<chrom:string,start:bigint,end:bigint>>")
    by_gene = {n[0]: want(n[1:4], n[4] or []) for n in norms}
    key = {r[0]: r[5] for r in regions}
    for row in counting.gene_mode(table, samples, asked, back).collect():
        assert row.n_background == sum(s == row.sample for s, _ in by_gene[key[row.key]])
    wide = lambda p: (p[0], max(0, p[1] - 20), p[2] + 20)
    by_region = {r[0]: want(wide(r[1:4]), [wide(p) for p in r[6] or []]) for r in regions}
    for row in counting.local_mode(table, samples, asked, 20).collect():
        assert row.n_background == sum(s == row.sample for s, _ in by_region[row.key])


@pytest.mark.parametrize("values", [[], [5.0], [1.0, 2.0], list(range(400)), [7.0] * 300 + list(range(100)), [float(i * i % 97) for i in range(500)], [-0.5] * 5 + [None] * 9 + [1e300, -1e300]])
def test_percentiles_equal_numpy(spark, monkeypatch, values):
    """Narrowed down to a few values, with ties at either side of a border."""
    monkeypatch.setattr(stats, "HELD", 5)
    monkeypatch.setattr(stats, "PIECES", 4)
    shares, known = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0], [v for v in values if v is not None]
    got = stats.percentiles(spark.createDataFrame([(v if v is None else float(v),) for v in values], "x double"), "x", shares)
    assert got == (pytest.approx(np.percentile(known, [100 * s for s in shares]).tolist()) if known else [None] * 7)
