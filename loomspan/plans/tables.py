"""Queries over the ordered table layer: selection, mutation, reshaping, merging, whole-table operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.joins import merge_on_column, pairwise_in_set
from loomspan.operators.table import POS, Table
from loomspan.plans.common import collector, read

QUERIES, ORACLE_SQL, query = collector()


def shown(t: Table) -> DataFrame:
    """The rows with their dense positions as ``pos``."""
    return t.df.withColumnRenamed(POS, "pos")


@query("select o_orderpriority, o_orderstatus, row_number() over (order by min(o_orderkey)) - 1 as pos from orders where o_totalprice > 100000 group by all")
def filter_project_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(read(spark, sf_dir, "orders"), "o_orderkey")
    return shown(t.where(F.col("o_totalprice") > 100000).select("o_orderpriority", "o_orderstatus").unique())


@query("""select c_custkey, c_acctbal, case when c_custkey % 3 = 0 then null else c_mktsegment end as seg from customer
where (case when c_custkey % 3 = 0 then null else c_mktsegment end) is not distinct from null or (case when c_custkey % 3 = 0 then null else c_mktsegment end) in ('BUILDING', 'MACHINERY')""")
def eq_null_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("seg"))
    t = Table(df.withColumn(POS, F.col("c_custkey")), numbered=True, dense=False)
    return t.where(t.equals("seg", None) | t.equals("seg", {"BUILDING", "MACHINERY"})).ordered()


@query("select c_custkey, c_mktsegment not in ('BUILDING', 'MACHINERY') as other, c_mktsegment is distinct from 'BUILDING' as differs, floor(c_acctbal / 7)::bigint as floored from customer where c_acctbal >= 1000")
def set_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(read(spark, sf_dir, "customer").withColumn(POS, F.col("c_custkey")), numbered=True, dense=False)
    rows = t.where(F.col("c_acctbal") >= 1000)._raw
    return rows.select("c_custkey", t.differs("c_mktsegment", {"BUILDING", "MACHINERY"}).alias("other"), t.differs("c_mktsegment", "BUILDING").alias("differs"), t.floor_divide(F.col("c_acctbal"), F.lit(7)).alias("floored"))


@query("select n_nationkey, n_name, n_regionkey, (20 - n_nationkey) // 3 as pos from nation where n_nationkey between 3 and 20 and (20 - n_nationkey) % 3 = 0")
def row_slice_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(Table(read(spark, sf_dir, "nation"), "n_nationkey").slice(20, 2, -3))


@query("select n_name, n_nationkey, k as pos from (select unnest([3, 3, 0, 24, 7]) as id, unnest([0, 1, 2, 3, 4]) as k) join nation on n_nationkey = id")
def gather_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(Table(read(spark, sf_dir, "nation"), "n_nationkey").gather([3, 3, 0, -1, 7]).select("n_name", 0))


@query("select n_nationkey, n_name, n_regionkey, n_nationkey - (n_nationkey > 4)::int as pos from nation where n_nationkey <> 4 union all select 99, 'ATLANTIS', null, 10 order by pos".replace("n_nationkey - (n_nationkey > 4)::int as pos", "n_nationkey - (n_nationkey > 4)::int + (n_nationkey - (n_nationkey > 4)::int >= 10)::int as pos"))
def insert_and_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(Table(read(spark, sf_dir, "nation"), "n_nationkey").pop_row(4).append([99, "ATLANTIS", None], at=10))


@query("select trunc(s_acctbal)::int as balance, s_suppkey, case when s_nationkey < 5 then 'home' else s_name end as s_name, s_suppkey * 2.5::double as weight from supplier")
def mutate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(read(spark, sf_dir, "supplier").withColumn(POS, F.col("s_suppkey")), numbered=True, dense=False)
    t = t.assign("s_name", "home", F.col("s_nationkey") < 5).with_column("weight", F.col("s_suppkey") * 2.5, 0)
    return t.retype({"s_acctbal": "int"}).rename({"s_acctbal": "balance"}).reorder(["balance", "s_suppkey"]).pop_column("s_nationkey").ordered()


@query("""with c as (select c_nationkey as nation, count(*) as n, sum(c_acctbal) as total from customer where c_nationkey < 18 group by 1),
s as (select s_nationkey as nation, count(*) as n, sum(s_acctbal) as total from supplier where s_nationkey > 3 group by 1)
select coalesce(c.nation, s.nation) as nation, c.n as n_customers, round(c.total, 2) as total_customers, s.n as n_suppliers, round(s.total, 2) as total_suppliers from c full join s on c.nation = s.nation""")
def merge_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    def totals(table: str, mark: str, keep) -> DataFrame:
        of = read(spark, sf_dir, table).where(keep(F.col(f"{mark}_nationkey")))
        return of.groupBy(F.col(f"{mark}_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(f"{mark}_acctbal"), 2).alias("total"))

    return merge_on_column(totals("customer", "c", lambda n: n < 18), totals("supplier", "s", lambda n: n > 3), "nation", "customers", "suppliers")


@query("select r_regionkey, r_name, upper(r_name) || '!' as shout, r_regionkey as pos from region")
def zip_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = read(spark, sf_dir, "region")
    right = Table(region.select(F.concat(F.upper("r_name"), F.lit("!")).alias("shout"), F.col("r_regionkey").alias("k")), "k").pop_column("k")
    return shown(Table(region, "r_regionkey").extend(right))


@query("""select c_custkey as id, c_name as name, c_acctbal as balance, c_custkey - 1 as pos from customer
union all select s_suppkey, s_name, null, (select count(*) from customer) + row_number() over (order by s_suppkey) - 1 from supplier""".replace("c_custkey - 1 as pos", "row_number() over (order by c_custkey) - 1 as pos"))
def union_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Table(read(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_name as name", "c_acctbal as balance"), "id")
    b = Table(read(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "s_name as name"), "id")
    return shown(a.extend(b))


_STACKED = "select o_custkey, list(o_orderkey order by o_orderkey) as o_orderkey, list(o_clerk order by o_orderkey) as o_clerk, min(o_orderkey) as first from (select o_custkey, o_orderkey, nullif(o_orderstatus, 'F') as o_clerk from orders) group by o_custkey"


def _stacked(spark: SparkSession, sf_dir: str) -> Table:
    df = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.expr("nullif(o_orderstatus, 'F')").alias("o_clerk"))
    return Table(df.withColumn(POS, F.col("o_orderkey")), numbered=True, dense=False).stack(["o_orderkey", "o_clerk"])


@query(f"select o_custkey, array_to_string(o_orderkey, ',') as keys, array_to_string([coalesce(x, '-') for x in o_clerk], '') as marks, row_number() over (order by first) - 1 as pos from ({_STACKED})")
def stack_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stacked(spark, sf_dir).df.select("o_custkey", F.array_join(F.col("o_orderkey").cast("array<string>"), ",").alias("keys"), F.array_join("o_clerk", "", "-").alias("marks"), F.col(POS).alias("pos"))


@query("select o_custkey, o_orderkey, nullif(o_orderstatus, 'F') as o_clerk from orders")
def unstack_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stacked(spark, sf_dir).unstack(["o_orderkey", "o_clerk"]).ordered()


@query("select r_regionkey, array_to_string(list(n_name order by n_nationkey), ',') as names from region left join nation on n_regionkey = r_regionkey group by 1")
def collect_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = Table(read(spark, sf_dir, "region").select("r_regionkey"), "r_regionkey")
    nations = Table(read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_name", "n_nationkey"), "n_nationkey").pop_column("n_nationkey")
    return regions.collect(nations).ordered().select("r_regionkey", F.array_join("n_name", ",").alias("names"))


@query("""select l_orderkey, array_to_string(list(l_quantity::int order by l_linenumber, l_quantity), ',') as quantities, count(*)::int as width from lineitem group by 1""")
def unpack_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: x.l_quantity.cast("int")).alias("q"))
    t = Table(lists.withColumn(POS, F.col("l_orderkey")), numbered=True, dense=False)
    back = Table(t._raw, numbered=True).unpack("q").pack("q")
    return back._raw.select("l_orderkey", F.array_join(F.col("q").cast("array<string>"), ",").alias("quantities"), F.size("q").alias("width"))


@query("select p_partkey, p_brand, p_size, row_number() over (order by p_brand, p_size, p_partkey) - 1 as pos from part")
def sort_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size").withColumn(POS, F.col("p_partkey")), numbered=True, dense=False)
    return shown(t.sort("p_brand", "p_size"))


@query("select p_partkey, p_brand, row_number() over (order by length(p_brand) + p_size, p_partkey) - 1 as pos from part")
def sort_by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size").withColumn(POS, F.col("p_partkey")), numbered=True, dense=False)
    return shown(t.sort(key=lambda r: float(len(r[1]) + r[2])).select("p_partkey", "p_brand"))


@query("select n_nationkey as row from nation where n_regionkey = 2 and n_name is not null")
def row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of rows equal to a pattern in which a null matches anything."""
    return Table(read(spark, sf_dir, "nation"), "n_nationkey").positions_of([None, None, 2]).withColumnRenamed(POS, "row")


@query("""with p as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as pos from orders), s as (select o_orderkey, row_number() over (order by md5(pos || ':1'), pos) - 1 as place, (select count(*) from orders) as n from p)
select o_orderkey, list_sum([(place >= floor(0.5 + b * n / 11))::int for b in range(1, 11)])::int as fold from s""")
def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Table(read(spark, sf_dir, "orders").select("o_orderkey").withColumn(POS, F.col("o_orderkey")), numbered=True, dense=False)
    return t.k_fold(11, seed=1).select("o_orderkey", "fold")


@query("""select a.l_orderkey, a.l_linenumber as p1, b.l_linenumber as p2, case when a.l_linenumber = b.l_linenumber then a.l_quantity else a.l_quantity - b.l_quantity end as l_quantity
from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey""")
def pairwise_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_in_set(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity")
