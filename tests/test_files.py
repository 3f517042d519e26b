"""Runs from files: counting, annotation, cohort and plots, by small files worked by hand."""

import gzip
import random
import re
import struct
from pathlib import Path

import numpy as np
import pytest

from repeatloom import cli
from repeatloom.operators import cohort, liftover, selection, stats
from repeatloom.plans import annotation, cohort_study, genotype, plots
from repeatloom.plans.haplotype_export import STATISTICS
from repeatloom.sources import text

READS = [("r1", 90, 11, 0), ("r2", 200, 10, 0), ("r3", 195, 4, 0), ("r3", 500, 50, 0), ("r4", 500, 100, 16), ("r6", 150, 1, 4), ("#r7", 60, 20, 0)]
GENES = [("chr5", "G", 0, 1000, "protein_coding"), ("chr5", "N", 100, 200, "lncRNA"), ("chr5", "F", 5000, 6000, "protein_coding"), ("chr6", "L", 0, 50, "lncRNA")]


@pytest.fixture()
def files(tmp_path):
    """SAM, BAM, BED, GTF and PSL files of one small world."""
    sam = "@HD\tVN:1.6\n@SQ\tSN:chr5\tLN:9000\n" + "".join(f"{q}\t{flag}\tchr5\t{pos + 1}\t60\t2S{n - n // 2}M3I{n // 2}D\t*\t0\t0\t*\t*\n" for q, pos, n, flag in READS)
    (tmp_path / "one.sam").write_text(sam.replace("0D", ""))
    records = b""
    for q, pos, n, flag in READS:
        name, steps = q.encode() + b"\0", [(n << 4), (3 << 4) | 1]
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name), 60, 0, len(steps), flag, 0, -1, -1, 0) + name + struct.pack("<2I", *steps)
        records += struct.pack("<i", len(body)) + body
    head = b"BAM\x01" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<ii", 1, 5) + b"chr5\0" + struct.pack("<i", 9000)
    with open(tmp_path / "two.BAM", "wb") as out:
        for block in (head, records[:70], records[70:], b""):
            out.write(gzip.compress(block))
    (tmp_path / "regions.bed").write_text("# comment\nchr5\t100\t200\tV1\tG\t10\nchr5\t180\t220\tV2\tG\t.\n\nchr5\t4000\t4100\n")
    with gzip.open(tmp_path / "genes.gtf.gz", "wt") as out:
        out.write("#!x\n" + "".join(f'{c}\tx\tgene\t{s + 1}\t{e}\t.\t+\t.\tgene_id "i{n}"; gene_type "{t}"; gene_name "{n}";\n' for c, n, s, e, t in GENES))
        out.write('chr5\tx\texon\t1\t9\t.\t+\t.\tgene_name "E";\n')
    psl = ["0"] * 22
    for i, v in {9: "+", 10: "alt5", 11: "200", 14: "chr5", 16: "100", 17: "150", 19: "20,30,", 20: "10,45,", 21: "100,120,"}.items():
        psl[i] = v
    (tmp_path / "alt.psl").write_text("\t".join(psl) + "\n")
    return tmp_path


def wide(path):
    return [line.split(",") for line in path.read_text().splitlines()]


@pytest.mark.parametrize("name", ["one.sam", "two.BAM"])
def test_gene_mode_from_files(spark, files, name):
    out = files / "out.csv"
    genotype.count(spark, str(files / name), regions=str(files / "regions.bed"), gtf=str(files / "genes.gtf.gz"), psl=None, output_csv=str(out))
    head, row = wide(out)
    assert head == ["sample", "metric", "V1", "V2", "chr5:4000-4100"]
    assert row == [name[:3], "predicted_copies", "172.0", "", ""]


def test_counts_by_command_line(spark, files, monkeypatch):
    out = files / "counts.csv"
    inputs = [str(files / "two.BAM"), str(files / "one.sam")]
    assert cli.main(["count", "-i", *inputs, "-r", str(files / "regions.bed"), "--no-gtf", "-o", str(out)]) == 0
    assert wide(out) == [["sample", "metric", "V1", "V2", "chr5:4000-4100"], ["two", "read_count", "2", "2", "0"], ["one", "read_count", "2", "2", "0"]]
    monkeypatch.setattr(genotype, "DEFAULT_REGIONS", str(files / "regions.bed"))
    assert cli.main(["count", "-i", *inputs, "--vntr", "V2", "--norm-method", "local", "--norm-window", "50", "-o", str(out)]) == 0
    assert wide(out)[1:] == [["two", "density_ratio", ""], ["one", "density_ratio", ""]] or wide(out)[1][:2] == ["two", "density_ratio"]
    assert cli.main(["count", "-i", *inputs, "--vntr", "none", "--no-gtf", "-o", str(out)]) == 1
    assert cli.main(["count", "-i", *inputs, "--no-gtf", "-o", str(out)]) == 1
    assert cli.main(["count", "-i", *inputs, "--default", "--gene", "G", "--no-gtf", "-o", str(out)]) == 1
    assert cli.main(["count", "-i", "x.cram", "--default", "--no-gtf", "-o", str(out)]) == 1
    assert cli.main(["count", "-i", *inputs, "--default", "--chrom", "chr9", "--no-gtf", "-o", str(out)]) == 1


def test_local_mode_from_files(spark, files):
    rows = genotype.count(spark, str(files / "one.sam"), regions=str(files / "regions.bed"), norm_method="local", norm_window=50, gtf=None).collect()
    assert {r.name: r.value for r in rows} == {"V1": 24.0, "V2": None, "chr5:4000-4100": None}
    assert {r.metric for r in rows} == {"predicted_copies"}


def test_backgrounds(spark, files, caplog):
    """Nearest eligible genes, coordinate literals, unknown names and alternate contigs."""
    (files / "more.bed").write_text("chr5\t110\t130\ta\nchr5\t110\t130\tb\tchr5:100-140\nchr5\t110\t130\tc\tchr5:x-140\nchr6\t60\t70\td\nchr5\t4000\t4100\te\n")
    chosen = genotype.choose_regions(spark, regions=str(files / "more.bed"))
    for types, nearest in ((["protein_coding"], {"a": "G", "d": None, "e": "F"}), (["any"], {"a": "G", "d": "L", "e": "F"}), (["lncRNA"], {"a": "N", "d": "L", "e": "N"})):
        assigned, norms = genotype.backgrounds(spark, chosen, str(files / "genes.gtf.gz"), types, str(files / "alt.psl"))
        got = {r.name: r.norm_key for r in assigned.collect()}
        assert got == nearest | {"b": "chr5:100-140", "c": None}
        places = {r.norm_key: r for r in norms.collect()}
        assert tuple(places["chr5:100-140"])[1:4] == ("chr5", 100, 140)
        assert [tuple(a) for a in places["chr5:100-140"].alt_regions] == [("alt5", 10, 65)]
    assert any("neither a gene nor an interval" in r.message for r in caplog.records) and any("no eligible gene" in r.message for r in caplog.records)


def test_selection(spark):
    regions = spark.createDataFrame([("a", "G", "chr1"), ("b", None, "chr2"), ("c", "H", "chr1")], "name string, gene string, chrom string")
    pick = lambda **k: sorted(r.name for r in selection.select_regions(regions, **k).collect())
    assert pick() == ["a", "b", "c"] and pick(genes=[]) == [] and pick(genes=["G"], names=["b"]) == ["a", "b"] and pick(names=["c"]) == ["c"]
    assert [r.name for r in selection.unmatched(regions, "name", ["z", "a", "y", "z"]).collect()] == ["y", "z"]
    for bad in ({"default": True, "genes": ["G"]}, {"default": False, "genes": None}):
        with pytest.raises(selection.SelectionError):
            selection.check_selection(bad["default"], bad["genes"], None, None)


@pytest.mark.parametrize("region, plus, minus", [((110, 130), (20, 55), (145, 180)), ((100, 120), (10, 45), (155, 190)), ((120, 130), (30, 55), (145, 170)), ((145, 155), (70, 75), (125, 130)), ((155, 170), (80, 90), (110, 120)), ((200, 210), None, None)])
def test_lift_over(spark, region, plus, minus):
    """Blocks (100,10,20), (120,45,30) adjoin on the target; (160,80,25) does not."""
    blocks = [(100, 10, 20), (120, 45, 30), (160, 80, 25)]
    kind = "key long, chrom string, start long, end long"
    table = spark.createDataFrame([("c", 100, 185, s, 200, s, blocks) for s in "+-"], "chrom string, t_start long, t_end long, alt_name string, q_size long, strand string, blocks array<struct<t:bigint,q:bigint,size:bigint>>")
    got = {r.alt_name: (r.start, r.end) for r in liftover.lift(spark.createDataFrame([(1, "c", *region)], kind), table).collect()}
    assert got == ({"+": plus, "-": minus} if plus else {})


def test_alternates_are_trimmed(spark):
    row = text.parse_regions(spark.createDataFrame([(1, "chr1\t5\t9\tn\tg\t4\t alt1 \t 1\t2")], "ord int, line string")).first()
    assert [tuple(a) for a in row.alt_regions] == [("alt1", 1, 2)]


@pytest.mark.parametrize(
    "name, content, want",
    [
        ("a.csv", "Chr,START,end,period,CONS_LEN\nchr1,5,9,3,40.9\nchr2,1,2,7,x\n", [("chr1", 5, 9, 40), ("chr2", 1, 2, None)]),
        ("a.tsv", "#c\nchrom\tstart\tEnd\tperiod\tcons_len\nchr1\t5\t9\t3\t40\nchr1\t5\nchr2\t1\t2\n", [("chr1", 5, 9, 3), ("chr2", 1, 2, None)]),
        ("a.bed", "chr1\t5\t9\t30\nchr1\tx\t9\nchr1\t7\nchr3\t-1\t4\n", [("chr1", 5, 9, None), ("chr3", -1, 4, None)]),
    ],
)
def test_region_lists(spark, tmp_path, name, content, want):
    (tmp_path / name).write_text(content)
    assert [tuple(r)[1:] for r in text.read_region_list(spark, str(tmp_path / name)).orderBy("ord").collect()] == want


def test_region_lists_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "b.csv").write_text("chrom,begin,end\nchr1,1,2\n")
    (tmp_path / "c.tsv").write_text("# only\n")
    (tmp_path / "a.xlsx").write_text("chrom,start,end\n")
    for name in ("a.xls", "a.xlsx", "b.csv", "c.tsv"):
        with pytest.raises(text.InputError):
            text.read_region_list(spark, str(tmp_path / name))


def test_annotation_by_command_line(spark, files):
    (files / "list.tsv").write_text("chrom\tstart\tend\tperiod\nchr5\t110\t130\t7\nchr5\t7000\t7010\t.\nchr5\t100\t120\t\n")
    args = ["annotate", "--vntr-list", str(files / "list.tsv"), "--gtf", str(files / "genes.gtf.gz"), "--reference", "R1", "--out", str(files / "bed")]
    assert cli.main(args) == 1 and cli.main([*args, "--psl", str(files / "alt.psl")]) == 0
    found = [r.value for r in spark.read.text(str(files / "bed")).collect()]
    assert found[0] == "# Copy-number-variable VNTR regions - R1" and sum(x.startswith("#") for x in found) == 15 and found[4] == "#"
    assert found[15:] == ["chr5\t110\t130\tchr5:110-130\tG\t7\talt5\t20\t55", "chr5\t7000\t7010\tchr5:7000-7010\t.\t.", "chr5\t100\t120\tchr5:100-120\tG\t.\talt5\t10\t45"]
    again = text.read_regions(spark, str(files / "bed"))
    assert again.count() == 3 and {r.gene for r in again.collect()} == {"G", None}
    built = annotation.build(spark, str(files / "list.tsv"), str(files / "genes.gtf.gz"), "R", str(files / "bed2"))
    assert annotation.alternate_counts(built).count() == 0 and spark.read.text(str(files / "bed2")).where("value like '#%'").count() == 14


def _cohort_files(tmp_path):
    tsv = [("chr1", "10", "7"), ("chr1", "10", "9"), ("chr1", "20", "6"), ("chr2", "5", "101"), ("chrX", "8", "50"), ("chr1_alt", "3", "9")]
    (tmp_path / "c.tsv").write_text("".join("\t".join([c, p, "e", "m,1", "k", "v", n, "s", *"abcd", "g", "x" if i % 2 else "", f"b{i}", "y"]) + "\n" for i, (c, p, n) in enumerate(tsv)))
    rows = [("chr1", "10", ["0/1", "1/1"]), ("chr1", "10", ["0/0", "2/0"]), ("chr1", "20", ["0/1", "0/0"]), ("chr2", "5", ["./.", "./."]), ("chrX", "8", ["0/0", "0/0"]), ("chr9", "1", ["0/1", "0/0"])]
    lines = "".join("\t".join([c, p, ".", "N", ".", ".", ".", "A=1;ALTANNO=0-1,0-1-1,0", "GT", *g]) + "\n" for c, p, g in rows)
    (tmp_path / "c.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n" + lines)
    return str(tmp_path / "c.vcf"), str(tmp_path / "c.tsv")


def test_cohort(spark, tmp_path):
    vcf, tsv = _cohort_files(tmp_path)
    t = cohort_study.tables(spark, vcf, tsv)
    rows = lambda name, *cols: [tuple(r) for r in t[name].select(*cols).collect()]
    assert rows("site_counts", "chrom", "n_sites")[-1] == ("total", 6)
    assert rows("lengths_before", "n", "max") == [(5, 101.0)] and rows("lengths_after", "n", "min") == [(4, 7.0)]
    assert set(rows("variability", "chrom", "n_variable", "n_invariant", "n_unresolved")) == {("chr1", 2, 0, 0), ("chr2", 0, 0, 1), ("chrX", 0, 1, 0), ("total", 2, 1, 1)}
    assert {x[:2]: x[2] for x in rows("contexts", "context", "value", "n")}[("bio_context_3", "y")] == 4
    hist = {x[:2]: x[2] for x in rows("length_histograms", "chrom", "bin", "n")}
    assert hist[("chr1", 1)] == 1 and hist[("chr1", 2)] == 1 and hist[("chr2", 50)] == 0 and len(hist) == 150
    summary = t["summary"].orderBy("ord").collect()
    assert [(r.chrom, r.start, r.cons_len, r.mean_hap1) for r in summary] == [("chr1", "10", "9", 3.0), ("chr1", "10", "9", 2.0)]
    assert rows("copy_variable", "start") == [("10",), ("10",)] and "motifs" not in t["summary"].columns
    cohort_study.run(spark, vcf, tsv, str(tmp_path / "out"), sheets=True)
    sheet = text.read_summary(spark, str(tmp_path / "out" / "summary.xlsx"), plots.NUMBERS)
    assert [(r.chrom, r.start, r.cons_len, r.mean_hap1) for r in sheet.collect()] == [("chr1", "10", 9.0, 3.0), ("chr1", "10", 9.0, 2.0)]
    assert sheet.columns[:4] == ["chrom", "start", "end", "cluster_type"] and sheet.columns[-8:] == STATISTICS
    assert text.read_summary(spark, str(tmp_path / "out" / "copy_variable.xlsx"), plots.NUMBERS).count() == 2
    lines = [r.value for r in spark.read.text(str(tmp_path / "out" / "haplotypes")).collect()]
    assert lines[0].endswith("bio_context_3,S1_hap1,S1_hap2,S2_hap1,S2_hap2,mean_hap1,mean_hap2,var_hap1,var_hap2,mean_combined,var_combined,h_exp,h_obs")
    assert lines[1].startswith('chr1,10,e,"m,1",k,v,9,s,a,b,c,d,g,x,b1,y,3,2,3,3,3.0,2.5,0.0,0.5,') and len(lines) == 3
    assert text.sample_names(spark, vcf) == ["S1", "S2"] and cohort.CHROMOSOMES[-1] == "chrM"


def test_plots_equal_numpy(spark):
    rng = random.Random(4)
    data = [(rng.choice([None, float(rng.randrange(0, 60))]), rng.random() * 9, rng.random() * 4, rng.choice([0.0, rng.random()]), rng.random()) for _ in range(900)]
    table = plots.with_products(spark.createDataFrame(data, ", ".join(f"{c} double" for c in plots.NUMBERS))).cache()
    pairs = np.array([(a, d) for a, _, _, d, _ in data if a is not None])
    x, y = pairs.T
    for name, setting in plots.SETTINGS.items():
        fit = plots.fitted(table, "cons_len", "var_hap1", setting)
        ends = [np.percentile(x, 100 * setting.low), np.percentile(x, 100 * setting.high)]
        assert np.allclose([fit["x_low"], fit["x_high"]], ends)
        m = (x > 0) & (y > 0)
        u, v = (x, y) if setting.fit == "linear" else (np.log(x[m]), np.log(y[m]))
        slope, at0 = np.polyfit(u, v, 1)
        assert np.allclose([fit["b"], fit["a"]], [slope, at0 if setting.fit == "linear" else np.exp(at0)])
        start = {"data": x.min(), "limits": ends[0], "positive_limits": np.percentile(x[m], 1), "limits_positive": max(ends[0], x[m].min())}[setting.curve]
        line = plots.curve(spark, fit, setting).orderBy("i").collect()
        assert len(line) == setting.points and np.isclose(line[0].x, start) and 0 <= fit["p"] <= 1
        got = plots.bins(table, "cons_len", "var_hap1", fit, setting)
        ylim = [np.percentile(y, 100 * setting.low), np.percentile(y, 100 * setting.high)]
        if setting.chart == "heat":
            want, *_ = np.histogram2d(x, y, 80, [ends, ylim])
            assert sum(r.n for r in got.collect()) == want.sum()
        else:
            assert got.count() == ((x >= ends[0]) & (x <= ends[1]) & (y >= ylim[0]) & (y <= ylim[1])).sum()
    assert plots.matrix(table, ["heat_power"]).count() == 8
    assert stats.p_value(1.0, 9) == 0.0


def test_flags_of_the_r_script():
    """R isn't at hand in tests, so only its flags are held against those of the command."""
    script = (Path(__file__).parent.parent / "r" / "repeatloom.R").read_text()
    flags = set(re.findall(r'"(--[a-z-]+)"', script)) - {"--version"}
    (commands,) = (a for a in cli.parser()._actions if a.dest == "command")
    known = {option for a in commands.choices["count"]._actions for option in a.option_strings}
    assert flags <= known and known - flags == {"-h", "--help", "-r", "-i", "-g", "-o", "--no-gtf", "--verbose"}
