"""Queries over statistics, effects, encodings and set aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import statistics as S
from loomspan.operators.joins import to_ids
from loomspan.plans.common import collector, read

QUERIES, ORACLE_SQL, query = collector()


@query("""select 'l_returnflag' as "column", l_returnflag as value, count(*) as n from lineitem group by 2 union all select 'l_linestatus', l_linestatus, count(*) from lineitem group by 2""")
def counts_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.counts(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


_PART = ("p_brand", "p_type", "p_size")


@query("\nunion all\n".join(
    f"""select '{c}' as "column", '{t}' as type, count(distinct {c}) as n_unique, count(*) filter ({c} is null)::bigint as n_missing,
(select string_agg(v || '=' || n, ';' order by k) from (select v, n, row_number() over (order by n desc, v) as k from (select {c}::varchar as v, count(*) as n from part where {c} is not null group by 1)) where k <= 10) as top from part"""
    for c, t in zip(_PART, ("string", "string", "int"))
))
def summarize_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.summarize(read(spark, sf_dir, "part").select(*_PART))


@query("""select b as bin, count(*) as n from (select least(floor((l_quantity - lo) / ((hi - lo) / 9)), 8)::int as b from lineitem, (select min(l_quantity) as lo, max(l_quantity) as hi from lineitem)) group by 1""")
def summarize_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem")
    low, high = df.agg(F.min("l_quantity"), F.max("l_quantity")).first()
    return S.bins(df, "l_quantity", 9, low, high).select("bin", "n")


@query("""with j as (select d.doc_id, d.lang, l.quality, l.toxic from documents d left join labels l using (doc_id))
select 'doc_id' as "column", count(*) filter (doc_id is null) as n_missing, count(*) as n_rows from j union all select 'lang', count(*) filter (lang is null), count(*) from j
union all select 'quality', count(*) filter (quality is null), count(*) from j union all select 'toxic', count(*) filter (toxic is null), count(*) from j""")
def missing_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.missing(read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic"))


@query("select round(corr(l_extendedprice, l_quantity), 6) as price_quantity, round(corr(l_discount, l_tax), 6) as discount_tax from lineitem")
def corr_price_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem")
    a, b = S.correlation(df, "l_extendedprice", "l_quantity"), S.correlation(df, "l_discount", "l_tax")
    return a.select(F.round("effect", 6).alias("price_quantity")).crossJoin(b.select(F.round("effect", 6).alias("discount_tax")))  # two rows of one number


@query("""with r as (select l_returnflag as c, l_quantity as v from lineitem), vs as (select distinct v from r), cs as (select c, count(*) as n_in, (select count(*) from r) - count(*) as n_out from r group by c),
f as (select cs.c, cs.n_in, cs.n_out, vs.v, (select count(*) from r where r.c = cs.c and r.v <= vs.v) / n_in as fi, (select count(*) from r where r.c <> cs.c and r.v <= vs.v) / n_out as fo from cs, vs)
select c as category, round(max(abs(fi - fo)), 9) as ks, round(least(1.0, 2 * exp(-2 * pow(max(abs(fi - fo)), 2) / abs(1 / n_in::double + 1 / n_out::double))), 9) as p from f group by c, n_in, n_out""")
def ks_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    ks = S.ks_by_category(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")
    return ks.select("category", F.round("ks", 9).alias("ks"), F.round(S.ks_p_value(F.col("ks"), F.col("n_in"), F.col("n_out")), 9).alias("p"))


def _variation(own: str, other: str) -> str:
    return f"""select '{own}' as "column", a.{own} as value, round(sum(abs(coalesce(j.n, 0) / a.n - (b.n - coalesce(j.n, 0)) / (t.n - a.n))) / 2, 9) as effect
from (select {own}, count(*) as n from lineitem group by 1) a cross join (select {other}, count(*) as n from lineitem group by 1) b cross join (select count(*) as n from lineitem) t
left join (select {own}, {other}, count(*) as n from lineitem group by all) j on j.{own} = a.{own} and j.{other} = b.{other} group by 2"""


@query(f"{_variation('l_returnflag', 'l_linestatus')} union all {_variation('l_linestatus', 'l_returnflag')}")
def cat_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.category_effect(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").withColumn("effect", F.round("effect", 9))


@query(None)
def effects_on_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.effects(read(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal", "c_nationkey"), "c_mktsegment")


@query("""with s as (select count(*) as n, min(value) as lo, max(value) as hi, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr from events),
k as (select lo, hi, case when iqr > 0 then greatest(1, ceil((hi - lo) / (2 * iqr / pow(n, 1 / 3::double)))) else 1 end as nb from s)
select least(floor((value - lo) / ((hi - lo) / nb)), nb - 1)::int as bin, count(*) as n from events, k group by 1""")
def fd_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fd_histogram(read(spark, sf_dir, "events"), "value").select("bin", "n")


@query("select l_quantity as value, count(*) as n, round(sum(count(*)) over (order by l_quantity) / (select count(*) from lineitem), 9) as share from lineitem group by 1")
def ecdf_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ecdf(read(spark, sf_dir, "lineitem"), "l_quantity").withColumn("share", F.round("share", 9))


@query("select round(quantile_cont(o_totalprice, 0.1), 6) as p10, round(quantile_cont(o_totalprice, 0.5), 6) as p50, round(quantile_cont(o_totalprice, 0.99), 6) as p99 from orders")
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([tuple(round(x, 6) for x in S.quantiles(read(spark, sf_dir, "orders"), "o_totalprice", (0.1, 0.5, 0.99)))], "p10 double, p50 double, p99 double")


@query("""select 'c_mktsegment' as field, c_mktsegment as value, count(*) as n, null::double as low, null::double as high from customer group by 2
union all select 'c_acctbal', null, count(c_acctbal), min(c_acctbal), max(c_acctbal) from customer""")
def label_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.label_stats(read(spark, sf_dir, "customer"), ["c_mktsegment"], ["c_acctbal"])


_VERTEX = "\n union all ".join(f"select '{n}' as seg, {[round(float(x), 12) for x in v]}::double[] as v" for n, v in zip(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), S.simplex(5)))


@query(f"""with v as ({_VERTEX}), s as (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer)
select c_custkey, array_to_string([printf('%.6f', x + 1) for x in list_concat([(c_acctbal - lo) / (hi - lo)], v.v)], ',') as vector from customer join v on seg = c_mktsegment, s""")
def matrix_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    vector = S.NumericEncoding(df.drop("c_custkey")).to_real()
    return df.select("c_custkey", F.array_join(F.transform(vector, lambda x: F.format_string("%.6f", x + 1)), ",").alias("vector"))


@query("""select c_custkey, c_mktsegment, round(c_acctbal, 4) as c_acctbal from customer""")
def matrix_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    encoding = S.NumericEncoding(df.drop("c_custkey"))
    back = df.select("c_custkey", encoding.to_real().alias("v"))
    return back.select("c_custkey", *encoding.from_real(F.col("v"))).withColumn("c_acctbal", F.round("c_acctbal", 4))


@query("select p_type as value, row_number() over (order by strlen(p_type), p_type) as id from (select distinct p_type from part)")
def unique_len_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_ids(read(spark, sf_dir, "part"), "p_type")


@query("""with d as (select b, row_number() over (order by strlen(b), b) as id from (select distinct p_brand as b from part where p_size <= 25))
select p_partkey, coalesce(id, 0) as id from part left join d on b = p_brand""")
def to_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return to_ids(part.select("p_partkey", "p_brand"), S.first_ids(part.where("p_size <= 25"), "p_brand"), "p_brand").select("p_partkey", "id")


_W = f"greatest(l_discount, {S.LEAST_WEIGHT!r})"


@query(f"select o_orderkey as l_orderkey, round(coalesce(sum({_W} * l_quantity) / sum({_W}), 0), 6) as mean from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def set_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return S.weighted_set_mean(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", "l_discount", parents).withColumn("mean", F.round("mean", 6))


_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(f"""select l_orderkey, l_linenumber, l_extendedprice, round(sum({_W} * l_quantity) over w / sum({_W}) over w, 6) as suffix_mean from lineitem
window w as (partition by l_orderkey order by {_ORDER} rows between current row and unbounded following)""")
def suffix_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.suffix_mean(read(spark, sf_dir, "lineitem"), "l_orderkey", _ORDER.split(", "), "l_quantity", "l_discount")
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", F.round("suffix_mean", 6).alias("suffix_mean"))


@query(None)
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "embeddings")
    _, directions = S.pca(df, "embedding", 64, 4)
    return df.select("vec_id", S.project("embedding", directions).alias("scores"))
