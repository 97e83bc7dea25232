"""Joins: merging on a column, neighbours within vectors, set alignment, dictionary look-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; it is counted first and shuffled beyond that.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, by a count that stops there."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def merge_on_column(left: DataFrame, right: DataFrame, column: str, left_name: str = "left", right_name: str = "right") -> DataFrame:
    """Full outer join on one column (nulls match), key first; equal names get a suffix unless it is empty."""
    clash = {c for c in left.columns if c in right.columns and c != column}
    name = lambda c, tag: f"{c}_{tag}" if c in clash and tag else c
    a = left.select(F.col(column).alias("__a"), *[F.col(c).alias(f"__l_{c}") for c in left.columns if c != column])
    b = right.select(F.col(column).alias("__b"), *[F.col(c).alias(f"__r_{c}") for c in right.columns if c != column])
    both = a.join(b, a["__a"].eqNullSafe(b["__b"]), "fullouter")
    return both.select(
        F.coalesce("__a", "__b").alias(column),
        *[F.col(f"__l_{c}").alias(name(c, left_name)) for c in left.columns if c != column],
        *[F.col(f"__r_{c}").alias(name(c, right_name)) for c in right.columns if c != column],
    ).orderBy(F.col(column).asc_nulls_first())


def squared_distance(a: Column | str, b: Column | str) -> Column:
    """Sum of squared differences of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def nearest(queries: DataFrame, points: DataFrame, k: int, query_id: str, point_id: str, vector: str = "vector") -> DataFrame:
    """(query, point, distance, rank): the k nearest points of every query, ties by id.

    The smaller, counted side is broadcast; a rank limit per query keeps k rows a partition before the shuffle.
    """
    q = queries.select(F.col(query_id).alias("query"), F.col(vector).alias("__q"))
    p = points.select(F.col(point_id).alias("point"), F.col(vector).alias("__p"))
    pairs = p.crossJoin(small(q)).select("query", "point", squared_distance("__q", "__p").alias("__d"))
    best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("__d", "point"))).where(F.col("rank") <= k)
    return best.select("query", "point", F.sqrt("__d").alias("distance"), "rank")


def within_radius(queries: DataFrame, points: DataFrame, radius: float, query_id: str, point_id: str, vector: str = "vector") -> DataFrame:
    """(query, point, distance) at distance at most ``radius``, by blocks of rows and matrix products."""
    from loomspan.operators.index import radius_join

    return radius_join(queries, points, radius, query_id, point_id, vector)


def similar_pairs(points: DataFrame, least: float, point_id: str, vector: str = "vector") -> DataFrame:
    """(a, b, similarity), a < b, of cosine similarity at least ``least``.

    Vectors of length 1 are as similar as they are near: the pairs come from a radius join in blocks.
    """
    norm = F.sqrt(dot(vector, vector))
    unit = points.where(norm > 0).select(F.col(point_id).alias("id"), F.transform(F.col(vector), lambda x: x.cast("double") / norm).alias("v"))
    near = within_radius(unit, unit, max(0.0, 2 - 2 * least) ** 0.5 + 1e-9, "id", "id", "v").where("query < point")
    return near.select(F.col("query").alias("a"), F.col("point").alias("b"), (1 - F.col("distance") * F.col("distance") / 2).alias("similarity")).where(F.col("similarity") >= least - 1e-12)


def nearest_centroid(windows: DataFrame, centroids: DataFrame, doc: str, vector: str, centroid: str) -> DataFrame:
    """(doc, centroid, distance): the centroid with the least mean distance over a document's vectors."""
    c = centroids.select(F.col(centroid).alias("centroid"), F.col(vector).alias("__c"))
    pairs = windows.select(F.col(doc).alias("doc"), F.col(vector).alias("__w")).crossJoin(small(c))
    mean = pairs.groupBy("doc", "centroid").agg(F.avg(F.sqrt(squared_distance("__w", "__c"))).alias("distance"))
    return mean.groupBy("doc").agg(F.min(F.struct("distance", "centroid")).alias("m")).select("doc", "m.centroid", "m.distance")


def to_ids(values: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    """``values`` with ``id`` from a (value, id) dictionary, 0 if unknown."""
    d = dictionary.select(F.col("value").alias("__v"), F.col("id"))
    return values.join(small(d), F.col(column) == F.col("__v"), "left").withColumn("id", F.coalesce("id", F.lit(0))).drop("__v")


def pairwise_in_set(children: DataFrame, set_id: str, pos: str, *features: str) -> DataFrame:
    """All ordered pairs of a set's members: feature differences, a member's own features with itself."""
    a = children.select(F.col(set_id).alias(set_id), F.col(pos).alias("p1"), *[F.col(f).alias(f"__a_{f}") for f in features])
    b = children.select(F.col(set_id).alias("__set"), F.col(pos).alias("p2"), *[F.col(f).alias(f"__b_{f}") for f in features])
    out = [F.when(F.col("p1") == F.col("p2"), F.col(f"__a_{f}")).otherwise(F.col(f"__a_{f}") - F.col(f"__b_{f}")).alias(f) for f in features]
    return a.join(b, a[set_id] == b["__set"]).select(set_id, "p1", "p2", *out)
