"""Queries that write lines of text from the driver's tables and read them again with the readers.

The SQL beside each says what the lines must be read as.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import cohort
from ..sources import text
from . import annotation, haplotype_export, plots
from .catalogue import SQL_GENES, SQL_REGIONS, _t, genes, query, regions


def _s(column):
    return column.cast("string")


@query(
    "select p_partkey as ord, case when p_partkey % 6 = 5 then 'chr' || p_partkey % 5 || ':' || p_partkey || '-' || p_partkey + p_size else 'n' || p_partkey end as name, "
    "'chr' || p_partkey % 5 as chrom, p_partkey as \"start\", p_partkey + p_size as \"end\", case when p_partkey % 6 < 3 then 'g' end as gene, "
    "case p_partkey % 6 when 0 then 40 when 4 then p_size end as period, case when p_partkey % 6 in (0, 2, 4) then 1 else 0 end as n_alts, "
    "case when p_partkey % 6 in (0, 2) then 'A' when p_partkey % 6 = 4 then 'alt' || p_partkey % 3 end as alt_chrom, "
    "case when p_partkey % 6 in (0, 2) then 1 when p_partkey % 6 = 4 then p_partkey end as alt_start from part"
)
def bed_regions(spark, d):
    """Ragged rows: with and without names, genes, periods and alternates, whole and broken."""
    k, z = F.col("p_partkey"), F.col("p_size")
    base = F.concat_ws("\t", F.concat(F.lit("chr"), _s(k % 5)), _s(k), _s(k + z))
    name = F.concat(F.lit("\tn"), _s(k))
    tails = ["\tg\t40\tA\t1\t2\tB\t3\tx\tC\t5\t6", "\tg\t.\tA\t1\t2", "\tg\tA\t1\t2", "\tNA\t0\tA\t1\t2"]
    line = F.when(k % 6 == 5, base).when(k % 6 == 4, F.concat(base, name, F.lit("\t \t"), F.concat_ws("\t", _s(z), F.concat(F.lit(" alt"), _s(k % 3), F.lit(" ")), _s(k), _s(k + 5))))
    for i, tail in enumerate(tails):
        line = line.when(k % 6 == i, F.concat(base, name, F.lit(tail)))
    found = text.parse_regions(_t(spark, d, "part").select(k.alias("ord"), line.alias("line")))
    first = F.get("alt_regions", F.lit(0))
    return found.select("ord", "name", "chrom", "start", "end", "gene", "period", F.size("alt_regions").alias("n_alts"), first["chrom"].alias("alt_chrom"), first["start"].alias("alt_start"))


@query(
    "with g as (select o_orderkey k, case when o_orderkey % 5 < 2 then 'i' else 'n' end || o_custkey % 400 as nm, case o_orderkey % 3 when 0 then 'chr6_alt' when 1 then 'chr' || o_orderkey % 7 + 1 else 'chrX' end c, "
    "case o_orderkey % 4 when 0 then 'unknown' when 1 then 'b' else 'protein_coding' end t from orders where o_orderkey % 7 <> 0), r as (select *, row_number() over (partition by nm order by c = 'chr6_alt', k) n from g) "
    'select nm as gene_name, c as chrom, k as "start", k + 50 as "end", t as gene_type from r where n = 1'
)
def gtf_genes(spark, d):
    """Names and types with their fallbacks; of repeated names the first on a primary chromosome."""
    k, c = F.col("o_orderkey"), _s(F.col("o_custkey") % 400)
    quoted = lambda key, value: F.concat(F.lit(f'{key} "'), value, F.lit('"; '))
    none = F.lit("")
    attributes = F.concat(
        F.when(k % 5 == 1, quoted("gene_name", none)).otherwise(none), quoted("gene_id", F.concat(F.lit("i"), c)), F.when(k % 5 > 1, quoted("gene_name", F.concat(F.lit("n"), c))).otherwise(none),
        F.when(k % 4 == 1, quoted("gene_biotype", F.lit("b"))).when(k % 4 > 1, quoted("gene_type", F.lit("protein_coding"))).otherwise(none),
    )
    chrom = F.when(k % 3 == 0, "chr6_alt").when(k % 3 == 1, F.concat(F.lit("chr"), _s(k % 7 + 1))).otherwise("chrX")
    line = F.concat_ws("\t", chrom, F.lit("x"), F.when(k % 7 == 0, "exon").otherwise("gene"), _s(k + 1), _s(k + 50), F.lit("."), F.lit("+"), F.lit("."), attributes)
    return text.one_record_per_gene(text.parse_genes(_t(spark, d, "orders").select(k.alias("ord"), line.alias("line"))))


@query(
    "select 'chr' || p_partkey % 5 + 1 as chrom, p_partkey as t_start, p_partkey + 60 as t_end, 'alt' || p_partkey as alt_name, (500 + p_size)::bigint as q_size, case when p_size % 2 = 0 then '+' else '-' end as strand, "
    "2 as n_blocks, p_partkey + 30 as last_t, p_partkey + 25 as last_q, 30::bigint as last_size from part where p_partkey % 4 <> 0 and p_partkey % 9 <> 0"
)
def psl_alignments(spark, d):
    """Block lists of unequal length, rows on other contigs and rows too short."""
    k, z = F.col("p_partkey"), F.col("p_size")
    fields = [F.lit("0")] * 22
    fields[9], fields[10], fields[11] = F.when(z % 2 == 0, "+").otherwise("-"), F.concat(F.lit("alt"), _s(k)), _s(500 + z)
    fields[14], fields[16], fields[17] = F.when(k % 4 == 0, "chr1_alt").otherwise(F.concat(F.lit("chr"), _s(k % 5 + 1))), _s(k), _s(k + 60)
    fields[19], fields[20] = F.lit("20,30,"), F.concat_ws(",", _s(k), _s(k + 25), F.lit(""))
    fields[21] = F.concat_ws(",", _s(k), _s(k + 30), F.when(k % 3 == 0, F.lit("999")), F.lit(""))
    line = F.when(k % 9 == 0, F.concat_ws("\t", *fields[:21])).otherwise(F.concat_ws("\t", *fields))
    found = text.parse_alignments(_t(spark, d, "part").select(k.alias("ord"), line.alias("line")))
    last = F.element_at("blocks", -1)
    return found.select("chrom", "t_start", "t_end", "alt_name", "q_size", "strand", F.size("blocks").alias("n_blocks"), last["t"].alias("last_t"), last["q"].alias("last_q"), last["size"].alias("last_size"))


_CALLS = "calls as (select o_orderkey site, i, (o_orderkey + i * (o_custkey % 5)) % 4 a, (o_custkey + i) % 4 b from orders, range(5) r(i)), c as (select site, case a when 0 then 2 when 1 then 3 when 2 then 1 end x, case b when 0 then 2 when 1 then 3 when 2 then 1 end y from calls)"


@query(
    f"with {_CALLS}, h as (select site, x, y, greatest(x, y) h1, case when x is not null and y is not null then least(x, y) end h2, x + y s from c), n as (select site, v, count(*) m from (select site, x v from c union all select site, y from c) where v is not null group by all), "
    "e as (select site, 1 - sum((m / t) * (m / t)) h from (select site, m, sum(m) over (partition by site) t from n) group by site) "
    "select h.site, round_even(avg(h1), 4) mean_hap1, round_even(avg(h2), 4) mean_hap2, round_even(var_samp(h1), 4) var_hap1, round_even(var_samp(h2), 4) var_hap2, round_even(avg(s), 4) mean_combined, round_even(var_samp(s), 4) var_combined, "
    "round_even(any_value(e.h), 4) h_exp, round_even(count(*) filter (where x <> y) / nullif(count(s), 0), 4) h_obs from h left join e using (site) group by h.site"
)
def vcf_statistics(spark, d):
    """Lines of five genotypes to copies, haplotypes and rounded statistics."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    allele = lambda n: F.when(n == 3, ".").otherwise(_s(n))
    calls = [F.concat_ws("/", allele((k + i * (c % 5)) % 4), allele((c + i) % 4)) for i in range(5)]
    line = F.concat_ws("\t", F.lit("chr1"), _s(k), *[F.lit(".")] * 5, F.lit("END=1;ALTANNO=0-1,0-1-1,0"), F.lit("GT"), *calls)
    sites = text.parse_sites(_t(spark, d, "orders").select(k.alias("ord"), line.alias("line")))
    return haplotype_export.with_statistics(sites).select(F.col("ord").alias("site"), *haplotype_export.STATISTICS)


@query(
    "with cat as (select 'chr' || p_partkey % 27 chrom, (p_partkey % 700)::varchar s from part where p_size > 6 and p_partkey % 27 between 1 and 22), si as (select o_orderkey k, 'chr' || o_custkey % 24 chrom, (o_orderkey % 700)::varchar s, "
    "case when o_custkey % 3 = 2 then null else o_custkey % 3 = 1 end v from orders), la as (select chrom, s, arg_max(coalesce(v::int, -1), k) v from si group by all), j as (select cat.chrom, nullif(v, -1) v from cat left join la using (chrom, s)) "
    "select coalesce(chrom, 'total') as chrom, count(*) filter (where v = 1) n_variable, count(*) filter (where v = 0) n_invariant, count(*) filter (where v is null) n_unresolved from j group by rollup(chrom)"
)
def site_variability(spark, d):
    """Catalogue rows filtered, joined with their sites by place, and counted by chromosome."""
    k, c = F.col("p_partkey"), F.col("o_custkey")
    rows = _t(spark, d, "part").select(k.alias("ord"), F.concat(F.lit("chr"), _s(k % 27)).alias("chrom"), _s(k % 700).alias("start"), _s(F.col("p_size")).alias("cons_len"))
    calls = F.when(c % 3 == 2, F.array(F.lit("./."))).when(c % 3 == 1, F.array(F.lit("0/0"), F.lit("./1"))).otherwise(F.array(F.lit("0/."), F.lit("0/0")))
    sites = _t(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("chr"), _s(c % 24)).alias("chrom"), _s(F.col("o_orderkey") % 700).alias("pos"), calls.alias("genotypes"))
    return cohort.variability_counts(cohort.with_variability(cohort.filtered_catalogue(rows), sites))


@query("select p_partkey as key, case p_partkey % 6 when 0 then 40 when 3 then p_size when 4 then p_size end as period from part")
def repeat_periods(spark, d):
    k, z = F.col("p_partkey"), _s(F.col("p_size"))
    value = F.when(k % 6 == 0, "40.9").when(k % 6 == 1, "x").when(k % 6 == 2, "-3").when(k % 6 == 3, z).when(k % 6 == 4, F.concat(z, F.lit(".0"))).otherwise("nan")
    return _t(spark, d, "part").select(k.alias("key"), metrics.period(value).alias("period"))


@query("select n_nationkey as key, n_name || case n_nationkey % 4 when 0 then '' when 1 then '.bam' when 2 then '.txt' else '.sam' end as sample from nation")
def sample_names(spark, d):
    k = F.col("n_nationkey")
    path = F.concat(F.lit("/data/x.bam/"), F.col("n_name"), F.when(k % 4 == 0, ".CRAM").when(k % 4 == 1, ".bam.Bam").when(k % 4 == 2, ".txt").otherwise(".sam.sam"))
    return _t(spark, d, "nation").select(k.alias("key"), text.sample_name(path).alias("sample"))


_OVER = "o as (select r.k, count(g.gene) n from regions r left join genes g on r.chrom = g.chrom and r.s < g.e and g.s < r.e group by r.k)"


@query(
    f"with {SQL_REGIONS}, {SQL_GENES}, {_OVER} select count(*) n_regions, count(period) n_with_period, count(*) filter (where n = 0) n_no_gene, count(*) filter (where n = 1) n_one_gene, count(*) filter (where n > 1) n_many_genes, "
    "count(*) filter (where k % 10 = 0 and false) n_with_alt, 0::bigint n_without_alt from regions join o using (k)"
)
def annotation_summary(spark, d):
    rows = regions(spark, d).select(F.col("key").alias("ord"), "chrom", "start", "end", "period")
    return annotation.summary(annotation.annotate(rows, genes(spark, d)))


def _points(spark, d):
    return _t(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))


_LIMITS = "lim as (select quantile_cont(l_quantity, {0}) x0, quantile_cont(l_quantity, {1}) x1, quantile_cont(l_extendedprice, {0}) y0, quantile_cont(l_extendedprice, {1}) y1 from lineitem)"


@query(
    f"with {_LIMITS.format(0.25, 0.75)} select least(floor(80 * (l_quantity - x0) / (x1 - x0)) + 1, 80)::bigint x_bin, least(floor(80 * (l_extendedprice - y0) / (y1 - y0)) + 1, 80)::bigint y_bin, count(*) n "
    "from lineitem, lim where l_quantity between x0 and x1 and l_extendedprice between y0 and y1 group by all"
)
def heat_map(spark, d):
    """80 by 80 bins within the quartiles."""
    setting, points = plots.SETTINGS["heat_linear_iqr"], _points(spark, d)
    return plots.bins(points, "x", "y", plots.fitted(points, "x", "y", setting), setting)


@query(
    f"with {_LIMITS.format(0.25, 0.75)}, f as (select exp(regr_intercept(ln(l_extendedprice), ln(l_quantity))) a, regr_slope(ln(l_extendedprice), ln(l_quantity)) b, min(l_quantity) least_x from lineitem where l_quantity > 0 and l_extendedprice > 0) "
    "select i, round(greatest(x0, least_x) + i * (x1 - greatest(x0, least_x)) / 299.0, 6) x, round(a * pow(greatest(x0, least_x) + i * (x1 - greatest(x0, least_x)) / 299.0, b), 3) y from lim, f, range(300) r(i)"
)
def fit_curve(spark, d):
    """A power law over the visible positive range, at 300 points."""
    setting, points = plots.SETTINGS["heat_power_iqr"], _points(spark, d)
    line = plots.curve(spark, plots.fitted(points, "x", "y", setting), setting)
    return line.select("i", F.round("x", 6).alias("x"), F.round("y", 3).alias("y"))
