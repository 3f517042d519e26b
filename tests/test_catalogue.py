"""The catalogue's queries over tables with far keys against brute force."""

import datetime
import random

import pytest

from repeatloom.plans import catalogue


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(8)
    d = str(tmp_path_factory.mktemp("whole"))
    parts = [(k, rng.randrange(1, 51), rng.choice(["Brand#11", "Brand#22", "Brand#33"]), f"n{k}") for k in sorted({7, *rng.sample(range(1, 250), 30), *rng.sample(range(1000, 1300), 50)})]
    orders = [(k, rng.randrange(1, 500), rng.choice("OF")) for k in rng.sample(range(1, 1500), 80)]
    lines = [(rng.choice("ANR"), rng.randrange(1, 200), rng.randrange(1, 60), rng.randrange(1, 51), rng.choice("FFFO"), datetime.date(1995, 1, 1) + datetime.timedelta(rng.choice([rng.randrange(0, 300), rng.randrange(950, 1350)]))) for _ in range(900)]
    for name, rows, schema in (
        ("part", parts, "p_partkey long, p_size int, p_brand string, p_name string"),
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string"),
        ("lineitem", lines, "l_returnflag string, l_orderkey long, l_suppkey long, l_quantity int, l_linestatus string, l_shipdate date"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    reads = [(f, str(o), str(s % 5), a, a + q) for f, o, s, q, status, day in lines if status == "F" for a in [(day - datetime.date(1995, 1, 1)).days]]
    regions = {k: (str(k % 5), k, k + size, [(str((k + 1) % 5), k + 30, k + 40)] if k % 10 == 0 else []) for k, size, _, _ in parts}
    genes = [(str(c % 5), k % 20000, k % 20000 + c % 90 + 1, f"g{k}", status == "O") for k, c, status in orders]
    return d, parts, reads, regions, genes


def names(reads, sample, intervals):
    return {q for f, q, c, a, b in reads if f == sample for c2, s, e in intervals if c == c2 and a < e and s < b}


def run(spark, world, name):
    return catalogue.QUERIES[name](spark, world[0]).collect()


def test_counts_of_all_regions(spark, world):
    _, parts, reads, regions, _ = world
    got = {(r.sample, r.key): r.n_reads for r in run(spark, world, "overlap_read_count")}
    assert got == {(f, k): len(names(reads, f, [(c, s, e), *alts])) for f in "ANR" for k, (c, s, e, alts) in regions.items()}
    assert sum(n > 0 for (_, k), n in got.items() if k > 1000) > 20


def shared(s, e, s2, e2):
    return min(e, e2) - max(s, s2)


def test_gene_background_of_all_regions(spark, world):
    _, parts, reads, regions, _ = world
    got = {(r.sample, r.key): r.n_background for r in run(spark, world, "density_ratio_gene")}
    want, lengths = {}, {}
    for k in regions:
        n = k // 100
        c, s, e = str(n % 5), n * 100, n * 100 + 150
        inside = [x for x, (c2, s2, e2, _) in regions.items() if c2 == c and s < e2 and s2 < e]
        lengths[n] = max(150 - sum(shared(s, e, *regions[x][1:3]) for x in inside), 1)
        alts = [(str((n + 1) % 5), s + 30, s + 60)] if n % 3 == 0 else []
        for f in "ANR":
            gone = set().union(*(names(reads, f, [regions[x][:3], *regions[x][3]]) for x in inside))
            want[f, k] = len(names(reads, f, [(c, s, e), *alts]) - gone)
    assert got == want
    assert {r.norm_key: r.effective_length for r in run(spark, world, "gene_eff_len")} == lengths


def test_genes_of_all_regions(spark, world):
    _, _, _, regions, genes = world
    near = {r.key: r for r in run(spark, world, "nearest_gene")}
    most = {r.key: r for r in run(spark, world, "max_overlap_gene")}
    assert set(near) == set(most) == set(regions)
    for k, (c, s, e, _) in regions.items():
        ranks = sorted((max(0, -shared(s, e, s2, e2)), -max(0, shared(s, e, s2, e2)), not coding, g) for c2, s2, e2, g, coding in genes if c2 == c)
        assert (near[k].gene_name, near[k].distance, near[k].n_ties) == (ranks[0][3], ranks[0][0], sum(r[:3] == ranks[0][:3] for r in ranks))
        over = sorted((-shared(s, e, s2, e2), not coding, g) for c2, s2, e2, g, coding in genes if c2 == c and shared(s, e, s2, e2) > 0)
        assert (most[k].gene_name, most[k].n_genes) == (over[0][2] if over else None, len(over))


def test_selection_from_all_regions(spark, world):
    want = {k for k, _, brand, _ in world[1] if brand in ("Brand#11", "Brand#22") or k in (7, 1234)}
    assert {r.key for r in run(spark, world, "region_select_or")} == want and max(want) > 1000
