"""Queries over the rest of the inventory: selection, order, fitting, sketches, files, index and designs."""

from __future__ import annotations

import operator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import designs as G
from loomspan.functions import patterns as P
from loomspan.functions import scalars as X
from loomspan.functions import sketches as K
from loomspan.operators import approximation as A
from loomspan.operators import joins as J
from loomspan.operators import search as R
from loomspan.operators import statistics as S
from loomspan.operators.balltree import BallTree
from loomspan.operators.table import POS, Table
from loomspan.plans.common import collector, read
from loomspan.sources import files

QUERIES, ORACLE_SQL, query = collector()


def _nation(spark: SparkSession, sf_dir: str) -> Table:
    return Table(read(spark, sf_dir, "nation"), "n_nationkey")


def _rows(t: Table) -> DataFrame:
    return t.df.withColumnRenamed(POS, "pos")


# -- tables -------------------------------------------------------------------


@query("select n_name, n_regionkey, n_name as n_name_2, n_nationkey, n_name as n_name_3, n_nationkey as pos from nation")
def project_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _nation(spark, sf_dir)
    mask = [c == "n_nationkey" for c in t.columns]
    return _rows(t.select("n_name", "n_regionkey", t.columns.index("n_name"), mask, slice(t.columns.index("n_name"), t.columns.index("n_name") + 1)))


@query("select n_nationkey, n_name, n_regionkey from nation where n_nationkey in (24, 3)")
def point_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _nation(spark, sf_dir)
    return spark.createDataFrame([t.row(-1), t.row(3)], ", ".join(f"{c} {k}" for c, k in zip(t.columns, t.types)))


@query("select n_nationkey * 10 as n_nationkey, n_regionkey * 7 as n_regionkey, n_nationkey as pos from nation")
def rowwise_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_nation(spark, sf_dir).select("n_nationkey", "n_regionkey").rowwise(operator.mul, [10, 7]))


@query("select r_regionkey as pos, r_name = ['AFRICA', 'ASIA', 'ASIA', 'EUROPE', null][r_regionkey::int + 1] is true as same from region")
def equals_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(read(spark, sf_dir, "region"), "r_regionkey").equals_each("r_name", ["AFRICA", "ASIA", "ASIA", "EUROPE", None]).withColumnRenamed(POS, "pos")


@query("select n_nationkey, case n_nationkey when 3 then 'first' when 24 then 'last' when 5 then null else n_name end as n_name, n_nationkey as pos from nation")
def assign_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_nation(spark, sf_dir).select("n_nationkey", "n_name").assign_each("n_name", ["first", "last", None], [3, -1, 5]))


@query("select length(n_name)::bigint as size, n_name || '!' as name, n_nationkey as pos from nation")
def map_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _nation(spark, sf_dir).map_column(len, "n_name", "bigint", "size").map_column(lambda x: x + "!", "n_name", "string", "name")
    return _rows(t.select("size", "name"))


@query("select row_number() over (order by n_regionkey, n_nationkey) - 1 as rank, n_nationkey as position from nation")
def argsort_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation(spark, sf_dir).argsort("n_regionkey")


@query("select n_name, min(n_nationkey) as position, true as found, false as missing from nation where n_name = 'CHINA' or (select count(*) from nation where n_name = 'CHINA') = 0 and n_nationkey = 7 group by n_name")
def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _nation(spark, sf_dir)
    name = "CHINA" if t.has_value("n_name", "CHINA") else t.cell(7, "n_name")
    key = [name if c == "n_name" else None for c in t.columns]
    return spark.createDataFrame([(name, t.index(key), t.contains(key), t.has_value("n_name", "nowhere"))], "n_name string, position bigint, found boolean, missing boolean")


@query("select n_nationkey, n_name, n_regionkey, n_nationkey as pos from nation union all select n_nationkey, n_name, n_regionkey, 25 + row_number() over (order by n_nationkey) - 1 from nation where n_regionkey = 2")
def union_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _nation(spark, sf_dir)
    other = Table(read(spark, sf_dir, "nation").where("n_regionkey = 2").select("n_name", "n_regionkey", "n_nationkey"), "n_nationkey")
    return _rows(t + other)


_FOLD = "row_number() over (order by md5(pos || ':3'), pos) - 1"


@query(f"with p as (select c_custkey, row_number() over (order by c_custkey) - 1 as pos from customer), s as (select c_custkey, {_FOLD} as place, (select count(*) from customer) as n from p) select c_custkey, list_sum([(place >= floor(0.5 + b * n / 5))::int for b in range(1, 5)])::int as fold from s")
def kfold_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(read(spark, sf_dir, "customer"), "c_custkey").k_fold(5, seed=3).select("c_custkey", F.col("fold").cast("int").alias("fold"))


# -- statistics ---------------------------------------------------------------


@query("select round(list_sort(list(o_totalprice))[100], 4) as k99, round(list_sort(list(o_totalprice))[count(*)], 4) as last from orders")
def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders")
    last = df.count() - 1
    return spark.createDataFrame([(round(S.order_statistic(df, "o_totalprice", 99), 4), round(S.order_statistic(df, "o_totalprice", last), 4))], "k99 double, last double")


@query("select distinct p_size as value from part order by 1")
def sorted_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sorted_unique(read(spark, sf_dir, "part"), "p_size")


@query("""select n_regionkey, array_to_string(list_sort(list_append(list(n_nationkey), 12)), ',') as added, array_to_string(list_sort(list_distinct(list_append(list(n_nationkey), 12))), ',') as once from nation group by 1""")
def insert_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("x"))
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    value = F.lit(12).cast("bigint")
    return grouped.select("n_regionkey", text(S.insert_sorted(F.col("x"), value)).alias("added"), text(S.insert_sorted(F.col("x"), value, unique=True)).alias("once"))


@query("""with b as (select min(s_acctbal) as lo, max(s_acctbal) as hi from supplier)
select 's_acctbal' as "column", k::bigint as k, round(lo + k * (hi - lo) / 9, 6) as low, round(lo + (k + 1) * (hi - lo) / 9, 6) as high, null::varchar as value, count(*) as n from (select least(floor((s_acctbal - lo) / ((hi - lo) / 9)), 8) as k, lo, hi from supplier, b) group by k, lo, hi
union all select * from (select 'region', row_number() over (order by s_nationkey % 5) - 1, null, null, (s_nationkey % 5)::varchar, count(*) from supplier group by s_nationkey % 5)
union all select * from (select 'initial', row_number() over (order by count(*) desc, substr(s_name, 18, 1)) - 1 as k, null, null, substr(s_name, 18, 1), count(*) from supplier group by substr(s_name, 18, 1)) where k < 10""")
def summarize_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "supplier").select("s_acctbal", (F.col("s_nationkey") % 5).alias("region"), F.substring("s_name", 18, 1).alias("initial"))
    return S.summarize_values(df).withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


def _density(side: str) -> str:
    return f"""{side} as (select c, v, lag(v) over w as low, (sum(n) over w - n) as was, sum(n) over w as upto, sum(n) over (partition by c) as total, first_value(n) over w as first from (select * from raw_{side}) window w as (partition by c order by v)),
s{side} as (select c, low, v as high, (upto - was)::double / (total - first) / (v - low) as d from {side} where low is not null)"""


@query(f"""with r as (select l_returnflag as c, l_quantity::double as v, count(*) as n from lineitem group by all), raw_a as (select * from r), raw_b as (select cs.c, vs.v, vs.n - coalesce(r.n, 0) as n from (select distinct c from r) cs cross join (select v, sum(n) as n from r group by v) vs left join r on r.c = cs.c and r.v = vs.v where vs.n > coalesce(r.n, 0)),
{_density('a')}, {_density('b')}
select cs.c as category, round(1 - coalesce(sum((least(sa.high, sb.high) - greatest(sa.low, sb.low)) * least(sa.d, sb.d)), 0), 9) as difference from (select distinct c from r) cs left join sa on sa.c = cs.c left join sb on sb.c = cs.c and sa.low < sb.high and sb.low < sa.high group by 1""")
def epdf_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.epdf_difference(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity").withColumn("difference", F.round("difference", 9))


def _ks(value: str) -> str:
    return f"""(with r as (select c_mktsegment as c, {value}::double as v from customer), vs as (select distinct v from r), cs as (select c, count(*) as n_in, (select count(*) from r) - count(*) as n_out from r group by c),
own as (select c, v, count(*) as n from r group by all), every as (select v, sum(n) as n from own group by v),
f as (select cs.c, n_in, n_out, vs.v, coalesce(sum(own.n) over w, 0) / n_in as fi, (sum(every.n) over w - coalesce(sum(own.n) over w, 0)) / n_out as fo from cs cross join vs join every on every.v = vs.v left join own on own.c = cs.c and own.v = vs.v window w as (partition by cs.c order by vs.v)),
k as (select c, n_in, n_out, max(abs(fi - fo)) as ks from f group by all) select avg(1 - least(1.0, 2 * exp(-2 * ks * ks / abs(1 / n_in::double + 1 / n_out::double)))) from k)"""


@query(f"""select 'c_acctbal' as "column", round({_ks('c_acctbal')}, 6) as effect union all select 'c_nationkey', round({_ks('c_nationkey')}, 6)""")
def effects_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal", "c_nationkey")
    return S.effects(df, "c_mktsegment").withColumn("effect", F.round("effect", 6))


@query(S.pca_sql("(select embedding[1:8] as embedding from embeddings)", "embedding", 8))
def gram_of_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "embeddings").select(F.slice("embedding", 1, 8).alias("embedding"))
    return S.centred_gram(df, "embedding", 8).withColumn("g", F.round("g", 4) + 0.0)


@query("select 'l_quantity' as name, round(regr_slope(l_extendedprice, l_quantity), 4) as weight from lineitem union all select '1', round(regr_intercept(l_extendedprice, l_quantity), 4) from lineitem")
def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.least_squares(read(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice").withColumn("weight", F.round("weight", 4))


# -- sketches -----------------------------------------------------------------


@query("select distinct event_type, true as within from events")
def hll_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates within four standard errors of the exact count."""
    ev = read(spark, sf_dir, "events")
    exact = ev.groupBy("event_type").agg(F.count_distinct("user_id").alias("n"))
    parts = K.hll(ev, "user_id", "event_type", "event_id", precision=14).drop("event_id")
    made = K.hll_merge(parts, "event_type").select("event_type", K.hll_estimate().alias("e"))
    return made.join(exact, "event_type").select("event_type", (F.abs(F.col("e") - F.col("n")) <= 4 * 1.04 / 128 * F.col("n") + 1).alias("within"))


@query("select share::double as share, true as within from (values (0.25), (0.5), (0.75), (0.99)) t(share)")
def kll_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact rank of each quantile, within the sketch's error."""
    ev = read(spark, sf_dir, "events").where("value is not null")
    sketch = K.kll_merge(K.kll(ev, "value", "event_type"))
    shares = (0.25, 0.5, 0.75, 0.99)
    q = sketch.select("n", *[K.kll_quantile(s).alias(f"q{i}") for i, s in enumerate(shares)]).first()
    below = ev.agg(*[F.count_if(F.col("value") <= F.lit(q[f"q{i}"])).alias(f"r{i}") for i in range(len(shares))]).first()
    return spark.createDataFrame([(s, abs(below[f"r{i}"] / q["n"] - s) <= 0.052) for i, s in enumerate(shares)], "share double, within boolean")


@query("select true as never_missed, true as few_false, true as bytes_kept")
def bloom_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No added value is missed; of values never added about one in a hundred seems to be there."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("v"))
    n = orders.count()
    bloom = K.Bloom(n, 0.01)
    words = bloom.build(orders, "v")
    kept = K.Bloom.from_bytes(K.Bloom.to_bytes(words))
    other = spark.range(n).select((-1 - F.col("id")).alias("v"))
    seen = bloom.probe(orders, "v", kept).agg(F.bool_and("seen").alias("never_missed"))
    false = bloom.probe(other, "v", words).agg((F.avg(F.col("seen").cast("double")) <= 0.015).alias("few_false"))
    same = words.exceptAll(kept).union(kept.exceptAll(words)).agg((F.count(F.lit(1)) == 0).alias("bytes_kept"))
    return seen.crossJoin(false).crossJoin(same)  # three rows of one value


@query("""select event_type as field, v, c, n, low, high from (select event_type, (user_id % 3)::varchar as v, count(*) as c from events group by all)
join (select event_type, count(value) as n, min(value) as low, max(value) as high from events group by 1) using (event_type)""")
def merge_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events").withColumn("part", F.pmod("event_id", F.lit(4))).withColumn("v", (F.col("user_id") % 3).cast("string"))
    values = ev.groupBy("part", F.col("event_type").alias("field"), "v").count().groupBy("part", "field").agg(F.map_from_entries(F.collect_list(F.struct("v", "count"))).alias("values"))
    rest = ev.groupBy("part", F.col("event_type").alias("field")).agg(F.hll_sketch_agg("user_id", 12).alias("sketch"), F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    merged = R.merge_summaries(rest.join(values, ["part", "field"]).drop("part"))
    return merged.select("field", F.explode("values").alias("v", "c"), "n", "low", "high")


# -- text and files -----------------------------------------------------------


@query("""select c_custkey, case when c_custkey % 4 = 0 then 'int' when c_custkey % 4 = 1 then 'float' when c_custkey % 4 = 2 then 'str' end as kind, c_custkey % 4 in (0, 1) as numeric from customer""")
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey").cast("string")).when(F.col("c_custkey") % 4 == 1, F.format_string("%.3f", F.col("c_acctbal"))).when(F.col("c_custkey") % 4 == 2, F.col("c_name")).otherwise(F.lit(""))
    return read(spark, sf_dir, "customer").select("c_custkey", X.infer(text).alias("kind"), F.coalesce(X.is_numeric(F.nullif(text, F.lit(""))), F.lit(False)).alias("numeric"))


@query("select c_custkey, c_name || ',x,' as bare, c_name || ';a,b;x;' as parts from customer")
def quoted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat("c_name", F.lit(',"a,b",x,'))
    bare = X.without_quotes(F.concat("c_name", F.lit('"a,b",x,')))
    return read(spark, sf_dir, "customer").select("c_custkey", bare.alias("bare"), F.array_join(X.split_quoted(line), ";").alias("parts"))


@query("""select doc_id, count(*) as n, sum(strlen(p) + 0)::bigint as upto from (select doc_id, unnest(string_split(text, 'the ')[:-2]) as p from documents where contains(text, 'the ')) group by 1""")
def match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match: how many, and the bytes between them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").where(F.contains("text", F.lit("the ")))
    found = P.all_matches(docs, "text", "the ").select("doc_id", "start", "end")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), (F.max("start") - 4 * (F.count(F.lit(1)) - 1)).cast("bigint").alias("upto"))


@query("select c_custkey, c_custkey || ' ' || c_nationkey as text from customer")
def detokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("  ", F.col("c_custkey").cast("string"), F.lit("none"), F.col("c_nationkey").cast("string"))
    return read(spark, sf_dir, "customer").select("c_custkey", R.detokenize(R.integer_tokens(text)).alias("text"))


@query("select p_partkey, coalesce(case when p_partkey % 2 = 0 then p_size::varchar end, 'None') as size, case when p_size > 25 then 'True' else 'False' end as large from part")
def python_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", X.python_text(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")), "int").alias("size"), X.python_text(F.col("p_size") > 25, "boolean").alias("large"))


@query("select count(*) as rows, count(distinct (p_brand, p_type, p_size)) as hashes from part")
def row_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(X.stable_hash("p_brand", "p_type", "p_size")).alias("hashes"))


@query("select n_regionkey, array_to_string(list_sort(list(n_nationkey)), ',') as flat from nation group by 1")
def flatten_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.array(F.array("n_nationkey"), F.lit(None).cast("array<bigint>"))).alias("x"))
    return nested.select("n_regionkey", F.array_join(F.array_sort(X.flatten_column(F.col("x"), 3)).cast("array<string>"), ",").alias("flat"))


@query("select p_partkey, round(p_size * p_size - 3.0::double * p_size + 2, 6) as newton, round(p_size * p_size - 3.0::double * p_size + 2, 6) as local from part")
def polynomial_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = [0, 1, 3, 7, 20]
    y = [v * v - 3 * v + 2 for v in x]
    return read(spark, sf_dir, "part").select("p_partkey", F.round(X.newton_value(F.col("p_size"), *X.newton(x, y)), 6).alias("newton"), F.round(X.horner(F.col("p_size"), X.local_polynomial(x, y, 2)), 6).alias("local"))


@query("select p_partkey, round((0.5::double * p_size - 1) * p_size + 4, 4) as value from part")
def spline_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = [0.0, 10.0, 25.0, 50.0]
    knots, pieces = X.fit_spline(x, [(0.5 * v - 1) * v + 4 for v in x])
    return read(spark, sf_dir, "part").select("p_partkey", F.round(X.spline(F.col("p_size"), knots, pieces), 4).alias("value"))


@query("select doc_id, quality, lang || '-name' as lang_name from labels join documents using (doc_id) where lang is not null")
def denormalised_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang").where("lang is not null")
    names = S.first_ids(docs, "lang")
    ids = J.to_ids(docs, names, "lang").select("doc_id", F.col("id").alias("lang"))
    rows = R.denormalised(read(spark, sf_dir, "labels").select("doc_id", "quality"), ids, names.select(F.concat("value", F.lit("-name")).alias("value"), "id"), "doc_id", "lang")
    return rows.select("doc_id", "quality", "lang_name")


@query("select 'lang' as field, lang as value, min(doc_id) as id from documents where lang is not null group by lang")
def merged_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where("lang is not null")
    ids = docs.groupBy(F.col("lang").alias("value")).agg(F.min("doc_id").alias("id"))
    maps = docs.select(F.pmod("doc_id", F.lit(3)), F.col("lang").alias("value")).distinct().join(ids, "value").select(F.lit("lang").alias("field"), "value", "id")
    return R.merge_categories(maps)


@query("select row_number() over (order by part, doc_id) as doc_id, source from (select doc_id % 3 as part, doc_id, source from documents)")
def consolidated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return files.consolidated([docs.where(F.col("doc_id") % 3 == k) for k in range(3)])


@query("select doc_id, coalesce(text, '') as content from documents")
def undo_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.coalesce("text", F.lit("")).alias("content"))
    later = docs.where("doc_id % 3 <> 0").withColumn("content", F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return files.undo(later, files.diff_snapshots(files.snapshot(docs), files.snapshot(later)), docs).select("doc_id", "content")


# -- index and search ---------------------------------------------------------

_D = "list_sum([pow(x[1]::double - x[2]::double, 2) for x in list_zip(a.embedding, b.embedding)])"


@query(f"""select query, point, round(distance, 6) as distance, rank from (select a.vec_id as query, b.vec_id as point, sqrt({_D}) as distance, row_number() over (partition by a.vec_id order by {_D}, b.vec_id) as rank from embeddings a, embeddings b where a.vec_id % 20 = 0) where rank <= 5""")
def ball_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set (ids divisible by 20) against all rows, exactly, through the tree."""
    e = read(spark, sf_dir, "embeddings")
    tree = BallTree(e, "vec_id", "embedding", leaf_rows=64)
    return tree.nearest(e.where("vec_id % 20 = 0"), 5, "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


@query("select count(*) as rows, true as recalled from embeddings")
def ball_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the search that looks at three quarters of the rows at most: 0.9 or more."""
    e = read(spark, sf_dir, "embeddings")
    tree = BallTree(e, "vec_id", "embedding", leaf_rows=16)
    asked = e.where("vec_id % 20 = 0")
    exact = tree.nearest(asked, 10, "vec_id", "embedding").select("query", "point")
    near = tree.nearest(asked, 10, "vec_id", "embedding", budget=e.count() * 3 // 4).select("query", "point", F.lit(True).alias("hit"))
    recall = exact.join(near, ["query", "point"], "left").agg(F.avg(F.coalesce(F.col("hit").cast("int"), F.lit(0))).alias("r")).first().r
    return tree.rows.agg(F.count(F.lit(1)).alias("rows")).withColumn("recalled", F.lit(recall >= 0.9))


@query(None)
def ball_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = BallTree(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", leaf_rows=64)
    parts = [tree.prune(3, method, 0.5).select(F.lit(method).alias("method"), "id") for method in ("root", "top", "inner", "outer", "distance")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


@query("select doc_id, source, lang, quality from documents join labels using (doc_id) where lang in ('en', 'fr') and quality between 1 and 1")
def descend_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return R.descend_filtered(rows, "source", {"lang": ["en", "fr"]}, {"quality": (1, 1)}).select("doc_id", "source", "lang", "quality")


@query("select doc_id from documents where lang in ('de') and n_chars between 100 and 900 order by doc_id limit 25")
def parsed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = R.parse_query('{"label_include": {"lang": ["de"]}, "numeric_range": {"n_chars": [100, 900]}, "top_k": 25}')
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return R.search(docs, docs, "doc_id", "embedding", spec).select("doc_id")


@query(None)
def bin_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return R.bin_pack(docs, 8, "doc_id", "n_chars").join(docs, "doc_id").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("size"))


@query(None)
def subword_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "part").select("p_name")
    known = words.where(F.length("p_name") % 2 == 0).distinct().select(F.col("p_name").alias("word"), F.array(F.length("p_name").cast("double"), F.lit(1.0)).alias("vector"))
    pieces = spark.range(1000).select("id", F.array(F.col("id").cast("double"), F.lit(0.5)).alias("vector"))
    return R.word_vectors(words, "p_name", known, pieces, 1000)


# -- fitting ------------------------------------------------------------------


@query("select p_partkey, round(2.0::double * p_size - 0.01::double * p_retailprice + 3, 4) as predicted from part")
def delaunay_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane is interpolated exactly, on any triangulation whose hull holds the rows."""
    import numpy as np

    rng = np.random.default_rng(3)
    points = np.vstack([[[0, 0], [0, 5000], [100, 0], [100, 5000]], rng.random((60, 2)) * [100, 5000]])
    model = A.Delaunay(points)
    df = read(spark, sf_dir, "part").withColumn("q", F.array(F.col("p_size").cast("double"), "p_retailprice"))
    made = model.predict(df, 2 * points[:, 0] - 0.01 * points[:, 1] + 3, "q")
    return made.select("p_partkey", F.round(F.get("predicted", F.lit(0)), 4).alias("predicted"))


@query("select p_partkey, round(case when p_size <= 1 then 10 when p_size < 20 then 10 + (p_size - 1) * 90 / 19::double when p_size < 50 then 100 - (p_size - 20) * 2 else 40 end::double, 6) as predicted from part")
def delaunay_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    df = read(spark, sf_dir, "part").withColumn("q", F.array(F.col("p_size").cast("double")))
    made = A.Delaunay(np.array([[1.0], [20.0], [50.0]])).predict(df, np.array([10.0, 100.0, 40.0]), "q")
    return made.select("p_partkey", F.round(F.get("predicted", F.lit(0)), 6).alias("predicted"))


@query("select count(*) as rows, true as better from orders")
def set_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals from their sets of line items: the error is under a quarter of the variance."""
    import numpy as np

    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.array(F.col("l_quantity").cast("double"), (F.col("l_extendedprice") / 1000).cast("double"))).alias("members"), F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("mean"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    sample = rows.orderBy(F.md5(F.col("o_orderkey").cast("string")), "o_orderkey").limit(1500).collect()  # the fit's bound
    model = A.SetRegressor(width=16, set_width=8, steps=400).fit(np.array([[r.n] for r in sample], float), [r["mean"] for r in sample], [np.array(r.members or np.zeros((0, 2)), float).reshape(-1, 2) for r in sample])
    made = model.predict(rows, ["n"], "o_orderkey", sets="members").select(F.col("id").alias("o_orderkey"), F.get("predicted", F.lit(0)).alias("p"))
    return rows.join(made, "o_orderkey").agg(F.count(F.lit(1)).alias("rows"), (F.avg((F.col("p") - F.col("mean")) * (F.col("p") - F.col("mean"))) < F.var_pop("mean") / 4).alias("better"))


_IDS = """ids as (select 'p_brand' as "column", p_brand as value, row_number() over (order by strlen(p_brand), p_brand) as id from (select distinct p_brand from part)
union all select 'p_type', p_type, (select count(distinct p_brand) from part) + row_number() over (order by strlen(p_type), p_type) from (select distinct p_type from part))"""


@query(f"""with {_IDS} select p_partkey, b.id as p_brand, t.id as p_type, 0::bigint as one from part join ids b on b."column" = 'p_brand' and b.value = p_brand join ids t on t."column" = 'p_type' and t.value = p_type""")
def category_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.lit("same").alias("one"))
    return A.encode_ids(part, A.column_ids(part, "p_brand", "p_type", "one"), "p_brand", "p_type", "one")


# -- designs ------------------------------------------------------------------


@query("select range * 3 + 10 as value from range(0, 2000)")
def random_range_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.random_range(spark, 10, 6010, 3, seed=4).select("value")


@query("select 500 as n, 500 as different, 499 as last, true as inside, true as shuffled")
def random_range_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = G.random_range(spark, 0, 100_000, count=500, seed=9)
    return r.agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_distinct("value").cast("int").alias("different"), F.max("k").cast("int").alias("last"), (F.min("value") >= 0).alias("inside"), (F.abs(F.corr("k", "value")) < 0.3).alias("shuffled"))


@query("with recursive s as (select 0::bigint as k, (1103515245::hugeint * 7 + 12345) % 2147483648 as x union all select k + 1, (1103515245::hugeint * x + 12345) % 2147483648 from s where k < 999) select k, round(x / 2147483648::double, 12) as value from s")
def lcg_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.lcg(spark, 1000, seed=7).withColumn("value", F.round("value", 12))


@query("select d::int as dim, s as slot, 1::bigint as n from range(0, 3) t(d), range(0, 200) u(s)")
def latin_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = G.well_spaced_box(spark, 200, 3, seed=5)
    return points.select(F.posexplode("point").alias("dim", "x")).groupBy("dim", F.floor(F.col("x") * 200).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


@query("select kind, 300::bigint as n, true as inside from (values ('box'), ('ball'), ('sphere'), ('spaced ball'), ('spaced sphere')) t(kind)")
def design_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = F.sqrt(F.aggregate("point", F.lit(0.0), lambda s, v: s + v * v))
    on = F.abs(norm - 1) < 1e-9
    kinds = {"box": (G.box, F.forall("point", lambda v: (v >= 0) & (v < 1))), "ball": (G.ball, norm <= 1), "sphere": (G.sphere, on), "spaced ball": (G.well_spaced_ball, norm <= 1), "spaced sphere": (G.well_spaced_sphere, on)}
    parts = [make(spark, 300, 4, 2).agg(F.count(F.lit(1)).alias("n"), F.bool_and(good).alias("inside")).select(F.lit(kind).alias("kind"), "n", "inside") for kind, (make, good) in kinds.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


@query("select i, j from range(0, 40) a(i), range(0, 40) b(j) where i > j")
def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pairs(spark, 40)


@query("select (a || ',' || b || ',' || c) as point from (values (2), (5), (9)) x(a), (values (2), (5), (9)) y(b), (values (2), (5), (9)) z(c)")
def mesh_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.mesh(spark, [2, 5, 9], 3).select(F.array_join(F.col("point").cast("array<string>"), ",").alias("point"))


@query("select o_orderkey, o_totalprice from orders order by md5(o_orderkey || ':7'), o_orderkey limit 1000")
def reservoir_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hash_sample(read(spark, sf_dir, "orders"), 1000, "o_orderkey", seed=7).select("o_orderkey", "o_totalprice")
