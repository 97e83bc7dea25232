"""Queries over documents, vectors, sketches, files, patterns and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import designs
from loomspan.functions import patterns as P
from loomspan.functions import scalars as X
from loomspan.functions import sketches as K
from loomspan.operators import index as N
from loomspan.operators import joins as J
from loomspan.operators import search as R
from loomspan.plans.common import collector, read
from loomspan.sources import files
from loomspan.streaming import events

QUERIES, ORACLE_SQL, query = collector()
_D = "list_sum([pow(x[1]::double - x[2]::double, 2) for x in list_zip(a.embedding, b.embedding)])"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings")


@query(f"""with d as (select a.vec_id as query, b.vec_id as point, sqrt({_D}) as distance from embeddings a, embeddings b)
select query, point, round(distance, 6) as distance, rank from (select *, row_number() over (partition by query order by distance, point) as rank from d) where rank <= 5""")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return N.knn_join(e, e, 5, "vec_id", "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


@query(f"""select a.vec_id as query, b.vec_id as point, round(sqrt({_D}), 6) as distance from embeddings a, embeddings b where a.label = 3 and b.label = 3 and sqrt({_D}) <= 0.9""")
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir).where("label = 3")
    return J.within_radius(e, e, 0.9, "vec_id", "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


@query(f"""select a.vec_id as query, b.vec_id as point, round(sqrt({_D}), 6) as distance from embeddings a, embeddings b where sqrt({_D}) <= 0.9""")
def radius_join_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``radius_join`` over the whole table, within and across labels."""
    e = _vectors(spark, sf_dir)
    return N.radius_join(e, e, 0.9, "vec_id", "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


_DOT = "list_sum([x[1]::double * x[2]::double for x in list_zip(a.embedding, b.embedding)])"


@query(f"""with n as (select *, sqrt(list_sum([x::double * x::double for x in embedding])) as norm from embeddings)
select a.vec_id as a, b.vec_id as b, round({_DOT} / (a.norm * b.norm), 6) as similarity from n a, n b where a.vec_id < b.vec_id and {_DOT} / (a.norm * b.norm) >= 0.5""")
def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.similar_pairs(_vectors(spark, sf_dir), 0.5, "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))


_MEANS = "select label, list(m order by k) as embedding from (select label, k, avg(embedding[k]::double) as m from embeddings, range(1, 65) t(k) group by all) group by label"


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _vectors(spark, sf_dir).select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return one.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s.x).alias("embedding"))


@query(f"""with c as ({_MEANS}), d as (select a.vec_id, b.label, sqrt({_D}) as d from embeddings a, c b)
select vec_id, arg_min(label, (d, label)) as centroid, round(min(d), 6) as distance from d group by vec_id""")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = J.nearest_centroid(_vectors(spark, sf_dir), _means(spark, sf_dir).withColumnRenamed("label", "c"), "vec_id", "embedding", "c")
    return near.select(F.col("doc").alias("vec_id"), "centroid", F.round("distance", 6).alias("distance"))


@query(f"""select query, label as predicted from (select a.vec_id as query, b.label, row_number() over (partition by a.vec_id order by {_D}, b.vec_id) as rank from embeddings a, embeddings b where a.vec_id <> b.vec_id and b.vec_id % 2 = 0 and a.vec_id % 2 = 1) where rank = 1""")
def nn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    near = N.knn_join(e.where("vec_id % 2 = 1"), e.where("vec_id % 2 = 0"), 1, "vec_id", "vec_id", "embedding")
    return near.join(e.select(F.col("vec_id").alias("point"), "label"), "point").select("query", F.col("label").alias("predicted"))


@query(f"""select query, label as predicted from (select a.vec_id as query, b.label, row_number() over (partition by a.vec_id order by {_D}, b.vec_id) as rank from embeddings a, embeddings b where a.vec_id <> b.vec_id) where rank = 1""")
def nn_predict_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's label from all other rows."""
    e = _vectors(spark, sf_dir)
    others = N.knn_join(e, e, 2, "vec_id", "vec_id", "embedding").where("query <> point")
    near = others.groupBy("query").agg(F.min_by("point", "rank").alias("point"))
    return near.join(e.select(F.col("vec_id").alias("point"), "label"), "point").select("query", F.col("label").alias("predicted"))


@query(f"""select point, count(*) as n from (select b.vec_id as point, row_number() over (partition by a.vec_id order by {_D}, b.vec_id) as rank from embeddings a, embeddings b) where rank <= 5 group by 1""")
def neighbour_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_exact(spark, sf_dir).groupBy("point").agg(F.count(F.lit(1)).alias("n"))


@query(f"select a.vec_id, round({_D}, 6) as distance from embeddings a, (select embedding from embeddings where vec_id = (select min(vec_id) from embeddings)) b order by {_D}, a.vec_id limit 10")
def rank_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    wanted = e.orderBy("vec_id").select("embedding").first()[0]
    return R.rank(e, "embedding", wanted, 10, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"""select a.label as doc, round(0.0::double - sqrt(min({_D})), 6) as score from embeddings a, (select embedding from embeddings where vec_id = (select min(vec_id) from embeddings)) b where a.label in (1, 2, 3, 5, 8) group by 1 order by min({_D}), 1 limit 3""")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, then rank documents (here: labels) by their best window (here: vectors)."""
    e = _vectors(spark, sf_dir).withColumnRenamed("label", "doc")
    docs = e.select("doc").distinct().withColumn("name", F.concat(F.lit("k"), F.col("doc").cast("string")))
    wanted = e.orderBy("vec_id").select("embedding").first()[0]
    spec = {"embeddings": [wanted], "label_include": {"name": ["k1", "k2", "k3", "k5", "k8"]}, "top_k": 3}
    return R.search(docs, e, "doc", "embedding", spec).select("doc", F.round("score", 6).alias("score"))


@query(f"""select query, point, round(distance, 6) as distance, rank from (select a.vec_id as query, b.vec_id as point, sqrt({_D}) as distance, row_number() over (partition by a.vec_id order by {_D}, b.vec_id) as rank from embeddings a, embeddings b) where rank <= 10""")
def rank_top_k_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    return N.knn_join(e, e, 10, "vec_id", "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


@query(f"""select query, doc, round(0.0::double - sqrt(d), 6) as score, rank from (select *, row_number() over (partition by query order by d, doc) as rank from (select a.vec_id as query, b.label as doc, min({_D}) as d from embeddings a, embeddings b group by 1, 2)) where rank <= 3""")
def search_documents_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row a query over all labels, each with its own first three."""
    e = _vectors(spark, sf_dir)
    return N.search_join(e, e, 3, "vec_id", "label", "embedding").select("query", "doc", F.round(0 - F.col("distance"), 6).alias("score"), "rank")


@query("select d.doc_id, d.lang, d.n_chars, l.quality from documents d join labels l using (doc_id) where d.lang in ('en', 'de') and l.quality between 1 and 1 and d.n_chars between 200 and 5000")
def label_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return df.where(R.filters(df, {"lang": ["en", "de"]}, {"quality": (1, 1), "n_chars": (200, 5000)}))


_WORDS = r"regexp_extract_all(text, '[^ \t\n\r\x0B\x0C]+')"


@query(rf"""with n as (select doc_id, len({_WORDS})::int as n from documents), s(w) as (values (32), (128), (512), (1024)),
x as (select doc_id, n, w, unnest(list_distinct(list_concat(range(0, n - w + 1, greatest(1, w // 2)), [n - w]))) as st from n, s where n >= w)
select doc_id, w as "window", st::int as start, (st + w)::int as "end" from x union all select doc_id, 32, 0, n from n where n > 0 and n < 32""")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "documents").select("doc_id", F.size(R.word_tokens(F.coalesce("text", F.lit("")))).alias("n"))
    return R.windows(n, "n").select("doc_id", "window", "start", "end")


@query(rf"""with w as (select {_WORDS} as ws from documents where text is not null)
select n, count(distinct array_to_string(ws[i:i + n - 1], ' ')) as n_distinct from (select ws, n, unnest(range(1, len(ws) - n + 2)) as i from w, range(1, 4) r(n)) group by n""")
def ngram_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where("text is not null")
    at_most = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return R.distinct_ngrams(docs.select(R.word_tokens(F.col("text")).alias("ws")), "ws", at_most=at_most // 2 + 1).withColumn("n", F.col("n").cast("bigint"))


@query(rf"""with w as (select doc_id, {_WORDS} as ws from documents where text is not null), p as (select doc_id, min(i) - 1 as start from (select doc_id, ws, unnest(range(1, len(ws))) as i from w) where ws[i] = 'of' and ws[i + 1] = 'the' group by 1)
select doc_id, start::int as start, (start + 2)::int as "end" from p""")
def token_sequence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", R.word_tokens(F.col("text")).alias("tokens"))
    return R.find_sequence(df, "tokens", ["of", "the"]).select("doc_id", "start", "end")


@query("select conv_id, turn, coalesce(strlen(text), 0)::int as n_bytes from conversations")
def byte_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes"))


@query("""select event_id, 'k' as path, json_extract_string(props, '$.k') as value from events where props is not null""")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.flat_json(read(spark, sf_dir, "events").select("event_id", "props"), "props")


@query(None)
def hll_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = K.hll(read(spark, sf_dir, "events"), "user_id", "event_type", precision=14)
    return per.select("event_type", K.hll_estimate().alias("n_users"))


@query(None)
def kll_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = K.kll_merge(K.kll(read(spark, sf_dir, "events"), "value", "event_type"))
    return merged.select("n", "low", "high", *[K.kll_quantile(q).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75, 0.99)])


@query("select event_id, user_id from events where user_id in (select o_custkey from orders)")
def bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Bloom filter thins the large side before an exact semi-join."""
    orders, ev = read(spark, sf_dir, "orders").select("o_custkey"), read(spark, sf_dir, "events").select("event_id", "user_id")
    bloom = K.Bloom(max(1, orders.count()), 0.01)
    maybe = bloom.probe(ev, "user_id", bloom.build(orders, "o_custkey")).where("seen").drop("seen")
    return maybe.join(orders, maybe.user_id == orders.o_custkey, "left_semi")


@query("""select doc_id::varchar as path, case when doc_id % 3 = 0 then 'delete' when doc_id % 5 = 0 then 'modify' end as change from documents where doc_id % 3 = 0 or doc_id % 5 = 0""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.coalesce("text", F.lit("")).alias("content"))
    later = docs.where("doc_id % 3 <> 0").withColumn("content", F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return files.diff_snapshots(files.snapshot(docs), files.snapshot(later))


@query("select p_partkey, round(((0.5::double * p_size - 2) * p_size + 1) * p_size + 3, 6) as value, round((1.5::double * p_size - 4) * p_size + 1, 6) as slope from part")
def poly_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [0.5, -2.0, 1.0, 3.0]
    return read(spark, sf_dir, "part").select("p_partkey", F.round(X.horner(F.col("p_size"), c), 6).alias("value"), F.round(X.horner(F.col("p_size"), X.derivative(c)), 6).alias("slope"))


@query("select p_partkey, case when p_size <= 1 then 10 when p_size < 20 then 10 + (p_size - 1) * 90 / 19::double when p_size < 50 then 100 - (p_size - 20) * 2 else 40 end::double as value from part")
def interpolate_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", X.interpolate_1d(F.col("p_size").cast("double"), [(1, 10), (20, 100), (50, 40)]).alias("value"))


@query("select a.n_nationkey as i, b.n_nationkey as j, (a.n_nationkey * (a.n_nationkey - 1) // 2 + b.n_nationkey)::bigint as pair, a.n_nationkey::bigint as i2, b.n_nationkey::bigint as j2 from nation a join nation b on a.n_nationkey > b.n_nationkey")
def triangular_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("i"))
    rows = n.join(n.withColumnRenamed("i", "j"), F.col("i") > F.col("j")).withColumn("pair", X.pair_to_index(F.col("i"), F.col("j")))
    i, j = X.index_to_pair(F.col("pair"))
    return rows.select("i", "j", "pair", i.cast("bigint").alias("i2"), j.cast("bigint").alias("j2"))


@query("select r.r_regionkey as x, s.r_regionkey as y, t.r_regionkey as z from region r, region s, region t")
def mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = [r[0] for r in read(spark, sf_dir, "region").select("r_regionkey").orderBy("r_regionkey").collect()]  # the grid's lines
    return designs.mesh(spark, nodes, 3).select(*[F.get("point", F.lit(k)).alias(c) for k, c in enumerate("xyz")])


@query("""select doc_id, strlen(split_part(text, ' the ', 1))::int as start, (strlen(split_part(text, ' the ', 1)) + 5)::int as "end" from documents where contains(text, ' the ')""")
def regex_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_match(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", ".* the ").drop("text").where("start is not null")


@query(r"""select url as path, len(regexp_extract_all(html, '(?i)<p[ >]'))::int as n from pages where len(regexp_extract_all(html, '(?i)<p[ >]')) > 0 and (strlen(html) < 100 or length(regexp_replace(html, '[^\x00-\x7F]', '', 'g')) / strlen(html) >= 0.7)""")
def regex_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.grep(read(spark, sf_dir, "pages"), "html", "url", "<p[ >]", case_sensitive=False).withColumnRenamed("url", "path")


@query(r"""select doc_id, (i - 1)::int as "index", c as "char" from (select doc_id, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as i from documents where regexp_matches(text, '[^\x00-\x7F]')) where unicode(c) > 127""")
def nonascii_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents").select("doc_id", F.explode(X.non_ascii(F.col("text"))).alias("x"))
    return df.select("doc_id", "x.index", "x.char")


@query(r"""select conv_id, turn, case when regexp_matches(text, '```[^\n]*\n[\s\S]*?```') then regexp_extract(text, '```[^\n]*\n([\s\S]*?)```', 1) else text end as code from conversations""")
def code_block_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", X.first_code_block(F.col("text")).alias("code"))


@query("""select c_custkey, (list_sum([('0x' || substr(h, 2 * k + 1, 2))::hugeint * (256::hugeint ** k)::hugeint for k in range(0, 8)]))::varchar as id from (select c_custkey, sha256(c_mktsegment) as h from customer)""")
def category_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", R.category_hash(F.col("c_mktsegment")).cast("string").alias("id"))


@query("select c_custkey, round(sqrt(c_acctbal * c_acctbal + c_nationkey * c_nationkey), 6) as norm from customer")
def vector_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.array(F.col("c_acctbal"), F.col("c_nationkey").cast("double"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(F.sqrt(J.dot(v, v)), 6).alias("norm"))


@query(None)
def reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hash_sample(read(spark, sf_dir, "lineitem"), 1000, "l_orderkey", seed=7).select("l_orderkey", "l_linenumber")


@query(None)
def kmeans_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    centroids, _ = N.kmeans(e, "embedding", "vec_id", 10, seed=3)
    return N.assign(e.select("vec_id", "embedding"), "embedding", centroids).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("squared"), 6).alias("mean_squared"))


@query(f"""select query, point, round(distance, 6) as distance, rank from (select a.vec_id as query, b.vec_id as point, sqrt({_D}) as distance, row_number() over (partition by a.vec_id order by {_D}, b.vec_id) as rank from embeddings a, embeddings b) where rank <= 10""")
def tree_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every row, by an exact descent."""
    e = _vectors(spark, sf_dir)
    rows, _ = N.build_tree(e, "embedding", "vec_id", fanout=8, leaf_rows=64)
    return N.probe_join(e, rows, 10, "vec_id", "vec_id", "embedding").select("query", "point", F.round("distance", 6).alias("distance"), "rank")


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the streaming plan, here over the batch table (the watermark is without effect)."""
    return events.windowed_counts(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "1 day", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))
