"""Queries over the driver's tables, which stand in for genomic ones, with their equivalents in SQL.

Reads are lineitem rows, regions parts, genes orders, all on one axis of days and keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import cohort, counting, liftover, normalization, overlap, selection, stats

WINDOW = 50


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def reads(spark, d):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    return _t(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("sample"), F.col("l_orderkey").cast("string").alias("qname"), (F.col("l_suppkey") % 5).cast("string").alias("chrom"),
        day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end"), (F.col("l_linestatus") != "F").alias("is_unmapped"),
    )


def samples(spark, d):
    return _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("sample")).distinct()


def regions(spark, d):
    """Parts as regions; each tenth has an alternate interval."""
    p = _t(spark, d, "part")
    alt = F.array(F.struct(((F.col("p_partkey") + 1) % 5).cast("string").alias("chrom"), (F.col("p_partkey") + 30).alias("start"), (F.col("p_partkey") + 40).alias("end")))
    return p.select(
        F.col("p_partkey").alias("key"), (F.col("p_partkey") % 5).cast("string").alias("chrom"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size")).alias("end"),
        F.when(F.col("p_size") % 3 > 0, F.col("p_size") % 3).alias("period"), F.when(F.col("p_partkey") % 10 == 0, alt).alias("alt_regions"),
        F.floor(F.col("p_partkey") / 100).cast("long").alias("norm_key"), F.col("p_brand").alias("gene"), F.concat(F.lit("TR"), F.col("p_partkey").cast("string")).alias("name"),
    )


def norms(spark, d):
    """The backgrounds of all regions, each third with an alternate interval."""
    n = regions(spark, d).select("norm_key").distinct()
    start = F.col("norm_key") * 100
    alt = F.array(F.struct(((F.col("norm_key") + 1) % 5).cast("string").alias("chrom"), (start + 30).alias("start"), (start + 60).alias("end")))
    return n.select("norm_key", (F.col("norm_key") % 5).cast("string").alias("chrom"), start.alias("start"), (start + 150).alias("end"), F.when(F.col("norm_key") % 3 == 0, alt).alias("alt_regions"))


def genes(spark, d):
    o = _t(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "O", "protein_coding").when(F.col("o_orderstatus") == "P", "lncRNA").otherwise("unknown")
    return o.select((F.col("o_custkey") % 5).cast("string").alias("chrom"), (F.col("o_orderkey") % 20000).alias("start"), (F.col("o_orderkey") % 20000 + F.col("o_custkey") % 90 + 1).alias("end"), F.concat(F.lit("g"), F.col("o_orderkey").cast("string")).alias("gene_name"), (F.col("o_orderstatus") == "O").alias("is_coding"), kind.alias("gene_type"))


def calls(spark, d):
    """Genotype calls: a site per order, alleles from line numbers, missing where returned as N."""
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("site"), F.col("l_linenumber").cast("int").alias("a"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f"))
    cn1 = F.when(F.col("f") != "N", F.col("a") % 4 + 1)
    cn2 = F.when(F.col("f") != "R", (F.col("s") % 3 + 1).cast("int"))
    h1, h2 = metrics.haplotypes(F.col("cn1"), F.col("cn2"))
    return rows.select("site", cn1.alias("cn1"), cn2.alias("cn2")).select("site", "cn1", "cn2", h1.alias("hap1"), h2.alias("hap2"))


SQL_READS = "reads as (select l_returnflag sample, l_orderkey::varchar qname, (l_suppkey % 5)::varchar chrom, date_diff('day', date '1995-01-01', l_shipdate::date) s, date_diff('day', date '1995-01-01', l_shipdate::date) + l_quantity::bigint e from lineitem where l_linestatus = 'F')"
SQL_REGIONS = "regions as (select p_partkey k, (p_partkey % 5)::varchar chrom, p_partkey s, p_partkey + p_size e, nullif(p_size % 3, 0) period, p_partkey // 100 nk, p_brand gene, 'TR' || p_partkey nm from part)"
SQL_TARGETS = "targets as (select k, chrom, s, e from regions union all select k, ((k + 1) % 5)::varchar, k + 30, k + 40 from regions where k % 10 = 0)"
SQL_OWN = "own as (select distinct sample, k, qname from reads r join targets t on r.chrom = t.chrom and r.s < t.e and t.s < r.e)"
SQL_NORMS = "norms as (select distinct nk, (nk % 5)::varchar chrom, nk * 100 s, nk * 100 + 150 e from regions), places as (select nk, chrom, s, e from norms union all select nk, ((nk + 1) % 5)::varchar, s + 30, s + 60 from norms where nk % 3 = 0)"
SQL_LINKS = "links as (select n.nk, g.k, least(n.e, g.e) - greatest(n.s, g.s) bp from norms n join regions g on n.chrom = g.chrom and n.s < g.e and g.s < n.e)"
SQL_WINDOWS = f"norms as (select k nk, chrom, greatest(0, s - {WINDOW}) s, e + {WINDOW} e from regions), places as (select nk, chrom, s, e from norms union all select k, ((k + 1) % 5)::varchar, greatest(0, k + 30 - {WINDOW}), k + 40 + {WINDOW} from regions where k % 10 = 0)"
SQL_WIDE = "wide as (select distinct sample, nk, qname from reads r join places t on r.chrom = t.chrom and r.s < t.e and t.s < r.e)"
SQL_OUT = "gone as (select distinct sample, nk, qname from own join links using (k))"
SQL_BACK = "back as (select sample, nk, count(*) n_back from (select * from wide except select * from gone) group by all)"
SQL_COUNTS = "counts as (select s.sample, g.k, count(o.qname) n_reads from (select distinct l_returnflag sample from lineitem) s cross join regions g left join own o on o.sample = s.sample and o.k = g.k group by all)"
SQL_GENES = "genes as (select (o_custkey % 5)::varchar chrom, o_orderkey % 20000 s, o_orderkey % 20000 + o_custkey % 90 + 1 e, 'g' || o_orderkey gene, o_orderstatus = 'O' coding, o_orderstatus st from orders)"
SQL_CALLS = "calls as (select site, cn1, cn2, greatest(cn1, cn2) hap1, case when cn1 is not null and cn2 is not null then least(cn1, cn2) end hap2 from (select l_orderkey site, case when l_returnflag <> 'N' then l_linenumber % 4 + 1 end cn1, case when l_returnflag <> 'R' then l_suppkey % 3 + 1 end cn2 from lineitem))"

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"with {SQL_READS}, {SQL_REGIONS}, {SQL_TARGETS}, {SQL_OWN}, {SQL_COUNTS} select sample, k as key, n_reads from counts")
def overlap_read_count(spark, d):
    r = regions(spark, d)
    return counting.read_counts(counting.hits(reads(spark, d), counting.targets(r)), samples(spark, d), r)


_GENE = f"with {SQL_READS}, {SQL_REGIONS}, {SQL_TARGETS}, {SQL_OWN}, {SQL_COUNTS}, {SQL_NORMS}, {SQL_LINKS}, {SQL_WIDE}, {SQL_OUT}, {SQL_BACK}, lens as (select nk, greatest(max(n.e - n.s) - coalesce(sum(bp), 0), 1) el from norms n left join links using (nk) group by nk), "
_RATIO = "select sample, k as key, n_reads, coalesce(n_back, 0)::bigint n_background, ratio density_ratio, ratio * 2.0 * ((e - s)::double / period) predicted_copies from (select *, (n_reads * el)::double / nullif(n_back * (e - s), 0) ratio from full_)"


@query(_GENE + "full_ as (select c.sample, c.k, n_reads, g.s, g.e, period, el, n_back from counts c join regions g using (k) left join lens using (nk) left join back b on b.sample = c.sample and b.nk = g.nk) " + _RATIO)
def density_ratio_gene(spark, d):
    return counting.gene_mode(reads(spark, d), samples(spark, d), regions(spark, d), norms(spark, d))


@query(
    f"with {SQL_READS}, {SQL_REGIONS}, {SQL_TARGETS}, {SQL_OWN}, {SQL_COUNTS}, {SQL_WINDOWS}, {SQL_LINKS}, {SQL_WIDE}, {SQL_OUT}, {SQL_BACK}, lens as (select n.nk, greatest({2 * WINDOW} - coalesce(sum(bp) filter (where k <> n.nk), 0), 1) el from norms n left join links l on l.nk = n.nk group by n.nk), "
    "full_ as (select c.sample, c.k, n_reads, g.s, g.e, period, el, n_back from counts c join regions g using (k) left join lens on lens.nk = c.k left join back b on b.sample = c.sample and b.nk = c.k) " + _RATIO
)
def density_ratio_local(spark, d):
    return counting.local_mode(reads(spark, d), samples(spark, d), regions(spark, d), WINDOW)


@query(_GENE.rstrip(", ") + " select nk as norm_key, el::bigint as effective_length from lens")
def gene_eff_len(spark, d):
    n = norms(spark, d)
    return counting.effective_lengths(n, counting.overlapping_regions(n, regions(spark, d).select("key", "chrom", "start", "end")))


_BP = "greatest(0, least(r.e, g.e) - greatest(r.s, g.s))"
_DIST = "greatest(0, greatest(g.s - r.e, r.s - g.e))"


@query(
    f"with {SQL_REGIONS}, {SQL_GENES}, all_ as (select r.k, g.gene, {_DIST} dist, -{_BP} o, not coding c from regions r join genes g on r.chrom = g.chrom), best as (select *, rank() over (partition by k order by dist, o, c) rk from all_) "
    "select r.k as key, min(b.gene) gene_name, min(dist) distance, nullif(count(distinct b.gene), 0) n_ties from regions r left join best b on b.k = r.k and rk = 1 group by r.k"
)
def nearest_gene(spark, d):
    return overlap.nearest_gene(regions(spark, d), genes(spark, d))


@query(
    f"with {SQL_REGIONS}, {SQL_GENES}, over_ as (select r.k, g.gene, row_number() over (partition by r.k order by {_BP} desc, not coding, g.gene) rn, count(*) over (partition by r.k) n from regions r join genes g on r.chrom = g.chrom and r.s < g.e and g.s < r.e) "
    "select r.k as key, o.gene as gene_name, coalesce(n, 0) as n_genes from regions r left join over_ o on o.k = r.k and rn = 1"
)
def max_overlap_gene(spark, d):
    return overlap.most_overlap(regions(spark, d), genes(spark, d))


@query("select p_partkey as key, 'TR' || p_partkey as name, p_brand as gene from part where p_brand in ('Brand#11', 'Brand#22') or p_partkey in (7, 1234)")
def region_select_or(spark, d):
    return selection.select_regions(regions(spark, d), ["Brand#11", "Brand#22"], ["TR7", "TR1234"]).select("key", "name", "gene")


@query("select 'name' as selector, 'TR-2' as value union all select 'gene', 'Brand#99'")
def region_select_unmatched(spark, d):
    r = regions(spark, d)
    by = lambda column, wanted: selection.unmatched(r, column, wanted).select(F.lit(column).alias("selector"), F.col(column).alias("value"))
    return by("name", ["TR7", "TR-2", "TR1"]).unionByName(by("gene", ["Brand#99", "Brand#11"]))


@query("select p_partkey as key, (p_partkey % 5)::varchar as chrom from part where p_partkey % 5 in (1, 3)")
def chromosome_filter(spark, d):
    return selection.on_chromosomes(regions(spark, d), ["1", "3", "7"]).select("key", "chrom")


_KEYS = "keys as (select k, case when k % 3 = 0 then 'chr' || k % 5 || ':' || k || '-' || k + 200 when k % 3 = 1 then 'g' || k else 'chr' || k || ':x-1' end nk from regions)"


@query(
    f"with {SQL_REGIONS}, {SQL_GENES}, {_KEYS} select nk as norm_key, any_value(case when k % 3 = 0 then 'chr' || k % 5 when k % 3 = 1 then g.chrom end) as chrom, "
    'any_value(case when k % 3 = 0 then k when k % 3 = 1 then g.s end) as "start", any_value(case when k % 3 = 0 then k + 200 when k % 3 = 1 then g.e end) as "end" from keys left join genes g on g.gene = nk group by nk'
)
def norm_target_lookup(spark, d):
    k = F.col("key")
    place = F.concat(F.lit("chr"), (k % 5).cast("string"), F.lit(":"), k.cast("string"), F.lit("-"), (k + 200).cast("string"))
    key = F.when(k % 3 == 0, place).when(k % 3 == 1, F.concat(F.lit("g"), k.cast("string"))).otherwise(F.concat(F.lit("chr"), k.cast("string"), F.lit(":x-1")))
    return normalization.targets_of(regions(spark, d).withColumn("norm_key", key), genes(spark, d))


@query(
    f"with {SQL_REGIONS}, {SQL_GENES}, all_ as (select r.k, g.gene, {_DIST} dist, -{_BP} o, not coding c from regions r join genes g on r.chrom = g.chrom where r.k % 2 = 0 and g.st in ('O', 'P')), best as (select *, rank() over (partition by k order by dist, o, c) rk from all_) "
    "select r.k as key, coalesce(case when r.k % 2 = 1 then any_value(r.gene) end, min(b.gene)) norm_key from regions r left join best b on b.k = r.k and rk = 1 group by r.k"
)
def norm_gene_eligible(spark, d):
    r = regions(spark, d).drop("norm_key").withColumn("gene", F.when(F.col("key") % 2 == 1, F.col("gene")))
    return normalization.assign_genes(r, genes(spark, d), ["protein_coding", "lncRNA"]).select("key", "norm_key")


@query("select n_name as name, 0 as source from nation union all select case when n_name in (select n_name from nation) then n_name || '_UserSupplied' else n_name end, 1 from (select n_name from nation where n_nationkey < 5 union all select r_name || '*' from region)")
def merge_rename(spark, d):
    n = _t(spark, d, "nation")
    custom = n.where("n_nationkey < 5").select(F.col("n_name").alias("name")).union(_t(spark, d, "region").select(F.concat("r_name", F.lit("*"))))
    return selection.merge_regions(n.select(F.col("n_name").alias("name")), custom).select("name", "source")


_BLOCKS = "blocks as (select t, q, z from (values (100, 10, 20), (120, 45, 30), (160, 80, 25)) b(t, q, z))"
_LIFT = (
    f"with {_BLOCKS}, regions as (select p_partkey k, 80 + p_partkey % 110 s, 80 + p_partkey % 110 + p_size e, case when p_partkey % 2 = 0 then '+' else '-' end st from part), "
    "spans as (select k, st, q + greatest(s, t) - t lo, q + least(e, t + z) - t hi from regions, blocks where t < e and t + z > s union all select k, st, a, b from regions, (values (120, 30, 45)) j(t, a, b) where t between s and e), "
    "u as (select k, st, min(lo) lo, max(hi) hi from spans group by all) select k as key, 'alt1' as alt_name, case when st = '+' then lo else 200 - hi end as \"start\", case when st = '+' then hi else 200 - lo end as \"end\" from u"
)


@query(_LIFT)
def block_liftover(spark, d):
    p = _t(spark, d, "part")
    r = p.select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("chrom"), (F.lit(80) + F.col("p_partkey") % 110).alias("start"), (F.lit(80) + F.col("p_partkey") % 110 + F.col("p_size")).alias("end"))
    block = "array(named_struct('t', 100L, 'q', 10L, 'size', 20L), named_struct('t', 120L, 'q', 45L, 'size', 30L), named_struct('t', 160L, 'q', 80L, 'size', 25L))"
    a = spark.sql(f"select st as chrom, 0L as t_start, 400L as t_end, 'alt1' as alt_name, 200L as q_size, st as strand, {block} as blocks from values ('+'), ('-') as t(st)")
    return liftover.lift(r, a)


@query(
    f"with {SQL_CALLS}, al as (select site, cn, count(*) c from (select site, cn1 cn from calls union all select site, cn2 from calls) where cn is not null group by all), ex as (select site, 1.0 - sum(c * c)::double / (sum(c) * sum(c))::double h_exp from al group by site) "
    "select c.site, avg(hap1) mean_hap1, avg(hap2) mean_hap2, avg(case when hap2 is not null then hap1 + hap2 end) mean_combined, round(var_samp(hap1), 6) var_hap1, round(var_samp(hap2), 6) var_hap2, round(var_samp(case when hap2 is not null then hap1 + hap2 end), 6) var_combined, "
    "count(*) filter (where cn1 <> cn2)::double / nullif(count(*) filter (where hap2 is not null), 0) h_obs, round(any_value(h_exp), 6) h_exp from calls c left join ex using (site) group by c.site"
)
def hap_stats(spark, d):
    s = cohort.haplotype_stats(calls(spark, d))
    return s.select("site", "mean_hap1", "mean_hap2", "mean_combined", *(F.round(c, 6).alias(c) for c in ("var_hap1", "var_hap2", "var_combined")), "h_obs", F.round("h_exp", 6).alias("h_exp"))


@query("select o_orderkey as site, case when n > 1 then true when n = 1 then false end as is_variable from orders o left join (select l_orderkey, count(distinct a) n from (select l_orderkey, case when l_returnflag <> 'N' then l_linenumber % 3 end a from lineitem) where a is not null group by 1) x on x.l_orderkey = o_orderkey where o_orderkey in (select l_orderkey from lineitem)")
def allele_variability(spark, d):
    g = F.concat(F.when(F.col("l_returnflag") != "N", (F.col("l_linenumber") % 3).cast("string")).otherwise("."), F.lit("/."))
    per = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("site")).agg(F.collect_list(g).alias("g"))
    return per.join(_t(spark, d, "orders").select(F.col("o_orderkey").alias("site")), "site", "left_semi").select("site", cohort.is_variable(F.col("g")).alias("is_variable"))


@query("select chrom, n_sites, coalesce(case when chrom = 'total' then 100 when chrom between 'chr1' and 'chr9' and length(chrom) < 6 then try_cast(substr(chrom, 4) as int) end, 99) as ord from (select 'chr' || (p_size - 1) as chrom, count(*) n_sites from part where p_size between 2 and 23 group by 1 union all select 'total', count(*) from part where p_size between 2 and 23)")
def chrom_counts_total(spark, d):
    p = _t(spark, d, "part").where("p_size between 2 and 23")
    return cohort.chromosome_counts(p.select(F.concat(F.lit("chr"), (F.col("p_size") - 1).cast("string")).alias("chrom")))


@query("select count(p_size) n, avg(p_size) mean, quantile_cont(p_size::double, 0.5) median, round(stddev_samp(p_size), 6) sd, min(p_size) \"min\", max(p_size) \"max\", quantile_cont(p_size::double, 0.25) q1, quantile_cont(p_size::double, 0.75) q3 from part")
def descr_stats(spark, d):
    return stats.describe(_t(spark, d, "part"), "p_size").withColumn("sd", F.round("sd", 6))


@query("select 'brand' as context, p_brand as value, count(*) n from part where p_brand is not null group by all union all select 'type', p_type, count(*) from part where p_type is not null group by all")
def context_counts(spark, d):
    long = _t(spark, d, "part").select(F.expr("stack(2, 'brand', p_brand, 'type', p_type) as (context, value)")).where("value is not null")
    return long.groupBy("context", "value").agg(F.count("*").alias("n"))


@query("select b as bin, count(p_size) n from range(1, 51) x(b) left join part on p_size between 7 and 100 and least(floor((p_size - 7) / (93.0 / 50)) + 1, 50) = b group by b")
def hist_1d(spark, d):
    return stats.histogram(_t(spark, d, "part"), "p_size", 7, 100, 50)


@query("select least(floor((l_quantity - 1) / (49.0 / 8)) + 1, 8)::bigint x_bin, least(floor((l_linenumber - 1) / (6.0 / 8)) + 1, 8)::bigint y_bin, count(*) n from lineitem where l_quantity between 1 and 50 and l_linenumber between 1 and 7 group by all")
def hist_2d(spark, d):
    return stats.histogram_2d(_t(spark, d, "lineitem"), "l_quantity", "l_linenumber", (1, 50, 1, 7), 8)


@query("select count(*) n, round(regr_slope(l_extendedprice, l_quantity), 4) slope, round(regr_intercept(l_extendedprice, l_quantity), 4) intercept, round(corr(l_quantity, l_extendedprice), 6) r from lineitem")
def linreg(spark, d):
    return stats.regression(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select("n", *(F.round(c, k).alias(c) for c, k in (("slope", 4), ("intercept", 4), ("r", 6))))


@query("select count(*) n, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) exponent, round(exp(regr_intercept(ln(l_extendedprice), ln(l_quantity))), 3) factor, round(corr(ln(l_quantity), ln(l_extendedprice)), 6) r from lineitem where l_quantity > 0 and l_extendedprice > 0")
def powerlaw_fit(spark, d):
    return stats.power_law(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select("n", *(F.round(c, k).alias(c) for c, k in (("exponent", 6), ("factor", 3), ("r", 6))))


@query("select quantile_cont(o_totalprice, 0.01) low, quantile_cont(o_totalprice, 0.99) high from orders")
def percentile_limits(spark, d):
    return stats.percentile_limits(_t(spark, d, "orders"), "o_totalprice", 0.01, 0.99)
