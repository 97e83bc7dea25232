"""Counts, summaries, distributions, effects between columns, numeric encodings, set aggregates.

Distinct values are grouped before anything is ordered, and running totals over them are
range-partitioned with one offset a partition, so that no window holds a whole table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.joins import small
from loomspan.session import settle

#: Weights of set members are at least this (the fourth root of a 32-bit float's precision).
LEAST_WEIGHT = float(np.finfo(np.float32).eps) ** 0.25


def cells(df: DataFrame, *columns: str) -> DataFrame:
    """(column, value): every cell as text, in one pass over the table."""
    names = columns or tuple(df.columns)
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names])))


def counts(df: DataFrame, *columns: str) -> DataFrame:
    """(column, value, n) of the named columns (default: all)."""
    return cells(df, *columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def missing(df: DataFrame) -> DataFrame:
    """(column, n_missing, n_rows), by one aggregation over all rows."""
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing"), F.col("__n").alias("n_rows")) for c in df.columns])))


def running_total(df: DataFrame, order: str, value: str, name: str = "upto") -> DataFrame:
    """Adds the sum of ``value`` up to and with each row; rows are range-partitioned by ``order``, whose values are distinct."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = settle(df.repartitionByRange(n, order).withColumn("__part", F.spark_partition_id()))
    before = marked.groupBy("__part").agg(F.sum(value).alias("__s")).withColumn("__before", F.coalesce(F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn(name, F.sum(value).over(inner) + F.col("__before")).drop("__part", "__before")


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share): share of the rows at or below each distinct value."""
    grouped = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    upto = running_total(grouped, "value", "n")
    return upto.crossJoin(F.broadcast(grouped.agg(F.sum("n").alias("__all")))).select("value", "n", (F.col("upto") / F.col("__all")).alias("share"))


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Exact quantiles with linear interpolation, from the running counts of distinct values."""
    grouped = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_total(grouped, "v", "n")
    total = ranked.agg(F.max("upto")).first()[0]
    if not total:
        return [math.nan] * len(shares)
    places = [s * (total - 1) for s in shares]
    wanted = sorted({k for p in places for k in (math.floor(p), math.ceil(p))})
    at = ranked.select(*[F.min(F.when(F.col("upto") > k, F.col("v"))).alias(f"k{k}") for k in wanted]).first()
    return [at[f"k{math.floor(p)}"] + (p - math.floor(p)) * (at[f"k{math.ceil(p)}"] - at[f"k{math.floor(p)}"]) for p in places]


def bins(df: DataFrame, column: str, n_bins: int, low: float, high: float) -> DataFrame:
    """(bin, low, high, n) of equal-width bins from ``low`` to ``high``, the last one closed."""
    width = (high - low) / n_bins if high > low else 1.0
    x = F.col(column).cast("double")
    k = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(n_bins - 1)).cast("int")
    inside = df.where((x >= low) & (x <= high))
    return inside.groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select("bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "n")


def fd_histogram(df: DataFrame, column: str) -> DataFrame:
    """Freedman-Diaconis bins; one bin if the quartiles are equal."""
    low, q1, q3, high = quantiles(df, column, (0, 0.25, 0.75, 1))
    n = df.where(F.col(column).isNotNull()).count()
    if not n:
        return bins(df, column, 1, 0.0, 0.0).limit(0)
    width = 2 * (q3 - q1) / n ** (1 / 3)
    return bins(df, column, max(1, math.ceil((high - low) / width)) if width > 0 else 1, low, high)


def summarize(df: DataFrame, max_display: int = 10) -> DataFrame:
    """(column, type, n_unique, n_missing) and the most frequent values of each column, ties by value."""
    per = counts(df)
    ranked = per.where(F.col("value").isNotNull()).withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("k") <= max_display)
    top = ranked.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("k", "value", "n"))).alias("t")).select("column", F.array_join(F.transform("t", lambda x: F.concat(x.value, F.lit("="), x.n.cast("string"))), ";").alias("top"))
    whole = per.groupBy("column").agg(F.count("value").alias("n_unique"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"))
    kinds = df.sparkSession.createDataFrame(df.dtypes, "column string, type string")
    return F.broadcast(kinds).join(whole, "column").join(top, "column", "left")


def order_statistic(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th smallest value (from 0), exact; None beyond the rows."""
    grouped = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return running_total(grouped, "v", "n").where(F.col("upto") > k).agg(F.min("v")).first()[0]


def sorted_unique(df: DataFrame, column: str) -> DataFrame:
    """(value): distinct values in order, nulls last."""
    return df.select(F.col(column).alias("value")).distinct().orderBy(F.col("value").asc_nulls_last())


def insert_sorted(values: Column, value: Column, unique: bool = False) -> Column:
    """A sorted array with a value in its place; with ``unique``, only if it isn't there."""
    added = F.array_sort(F.concat(values, F.array(value)))
    return F.when(F.array_contains(values, value), values).otherwise(added) if unique else added


def summarize_values(df: DataFrame, max_display: int = 10) -> DataFrame:
    """(column, k, low, high, value, n): what a summary shows of each column.

    A numeric column of over ``max_display`` distinct values: ``max_display - 1`` bins of equal
    width, the last closed; of fewer: its values in order. Other columns: the most frequent
    values, ties by value. Nulls aren't shown.
    """
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "float", "double", "smallint", "tinyint") or t.startswith("decimal")]
    per = settle(counts(df).where("value is not null"))
    sizes = {r.column: r.n for r in per.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a column
    parts = []
    for c in df.columns:
        own = per.where(F.col("column") == c)
        if c in numeric and sizes.get(c, 0) > max_display:
            low, high = df.agg(F.min(F.col(c).cast("double")), F.max(F.col(c).cast("double"))).first()
            shown = bins(df.select(F.col(c).cast("double").alias(c)), c, max_display - 1, low, high)
            parts.append(shown.select(F.lit(c).alias("column"), F.col("bin").cast("bigint").alias("k"), "low", "high", F.lit(None).cast("string").alias("value"), "n"))
        else:
            order = (F.col("value").cast("double"),) if c in numeric else (F.desc("n"), F.col("value"))
            top = own.orderBy(*order).limit(max_display).withColumn("k", (F.row_number().over(Window.partitionBy("column").orderBy(*order)) - 1).cast("bigint"))
            parts.append(top.select("column", "k", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), "value", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """(effect): Pearson's coefficient, null if a column is constant."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = df.where(x.isNotNull() & y.isNotNull())
    return both.agg((F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))).alias("effect"))


def ks_by_category(df: DataFrame, category: str, value: str) -> DataFrame:
    """(category, ks, n_in, n_out): Kolmogorov-Smirnov distance of a category's values from all others.

    Both step functions are only compared where the category's own one steps, before and
    after the step: in between the difference is monotone, so the maximum lies there.
    """
    rows = df.where(F.col(category).isNotNull() & F.col(value).isNotNull()).select(F.col(category).alias("category"), F.col(value).alias("v"))
    pairs = rows.groupBy("category", "v").agg(F.count(F.lit(1)).alias("n"))
    per_value = pairs.groupBy("v").agg(F.sum("n").alias("all"))
    upto = running_total(per_value, "v", "all")
    sizes = pairs.groupBy("category").agg(F.sum("n").alias("n_in"))
    total = sizes.agg(F.sum("n_in").alias("total"))
    joined = pairs.join(upto, "v").join(small(sizes), "category").crossJoin(F.broadcast(total)).where("total > n_in")
    own = F.sum("n").over(Window.partitionBy("category").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    steps = joined.withColumn("own", own).withColumn("n_out", F.col("total") - F.col("n_in"))
    after = F.col("own") / F.col("n_in") - (F.col("upto") - F.col("own")) / F.col("n_out")
    before = (F.col("upto") - F.col("all") - F.col("own") + F.col("n")) / F.col("n_out") - (F.col("own") - F.col("n")) / F.col("n_in")
    return steps.groupBy("category", "n_in", "n_out").agg(F.max(F.greatest(F.abs(after), F.abs(before))).alias("ks"))


def ks_p_value(ks: Column, n1: Column, n2: Column) -> Column:
    return F.least(F.lit(1.0), 2 * F.exp(-2 * ks * ks / F.abs(1 / n1 + 1 / n2)))


def epdf_difference(df: DataFrame, category: str, value: str) -> DataFrame:
    """(category, difference): 1 less the mass that a category's values and all others share.

    Each side's distribution function is linear between its distinct values, so its density
    is constant there; the shared mass is the sum over the steps of both of the lesser one.
    A side with a single value has no density and shares nothing.
    """
    rows = df.where(F.col(category).isNotNull() & F.col(value).isNotNull()).select(F.col(category).alias("category"), F.col(value).cast("double").alias("v"))
    pairs = settle(rows.groupBy("category", "v").agg(F.count(F.lit(1)).alias("n")))
    every = pairs.groupBy("v").agg(F.sum("n").alias("n"))
    names = pairs.select("category").distinct()
    both = every.crossJoin(small(names)).join(pairs.withColumnRenamed("n", "own"), ["category", "v"], "left").select("category", "v", F.nullif(F.coalesce("own", F.lit(0)), F.lit(0)).alias("a"), F.nullif(F.col("n") - F.coalesce("own", F.lit(0)), F.lit(0)).alias("b"))
    whole = Window.partitionBy("category")
    ahead = whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    behind = whole.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    # between two values of either side both densities are constant
    density = both.withColumn("end", F.lag("v").over(whole.orderBy(F.desc("v"))))
    for side in "ab":
        at = F.when(F.col(side).isNotNull(), F.col("v"))
        first = F.min(F.when(F.col(side).isNotNull(), F.struct("v", side))).over(whole)[side]
        since, until, mass = F.last(at, True).over(ahead), F.last(at, True).over(behind), F.last(side, True).over(behind)
        density = density.withColumn(f"d{side}", mass / F.nullif(F.sum(side).over(whole) - first, F.lit(0)) / (until - since))
    shared = density.groupBy("category").agg(F.sum((F.col("end") - F.col("v")) * F.coalesce(F.when(F.col("da") < F.col("db"), F.col("da")).otherwise(F.col("db")) + F.col("da") * 0, F.lit(0.0))).alias("shared"))
    return shared.select("category", (1 - F.coalesce("shared", F.lit(0.0))).alias("difference"))


def category_effect(df: DataFrame, a: str, b: str) -> DataFrame:
    """(column, value, effect): total variation between the other column's shares with and without the value, both ways."""
    joint = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(joint.agg(F.sum("n").alias("total")))

    def one(name: str, own: str, other: str) -> DataFrame:
        mine = joint.groupBy(own).agg(F.sum("n").alias("n_own"))
        theirs = joint.groupBy(other).agg(F.sum("n").alias("n_other"))
        rows = joint.join(small(mine), own).join(small(theirs), other).crossJoin(total).where("total > n_own")
        gap = F.abs(F.col("n") / F.col("n_own") - (F.col("n_other") - F.col("n")) / (F.col("total") - F.col("n_own")))
        seen = rows.groupBy(own, "n_own", "total").agg(F.sum(gap).alias("gap"), F.sum("n_other").alias("met"))
        unseen = (F.col("total") - F.col("met")) / (F.col("total") - F.col("n_own"))
        return seen.select(F.lit(name).alias("column"), F.col(own).alias("value"), ((F.col("gap") + unseen) / 2).alias("effect"))

    return one(a, "a", "b").union(one(b, "b", "a"))


def effects(df: DataFrame, compare_with: str | Sequence[str], method: str = "mean") -> DataFrame:
    """(column, effect) of every other column on one, by descending strength; for several columns (compared, column, effect).

    Two numbers: correlation; number and category: 1 - p of the KS test, combined over
    categories; two categories: total variation, combined over values.
    """
    from loomspan.errors import BadIndex

    if not isinstance(compare_with, str):
        each = [effects(df, c, method).select(F.lit(c).alias("compared"), "column", "effect") for c in compare_with]
        return reduce(DataFrame.union, each).orderBy(F.abs("effect").desc_nulls_last(), "compared", "column")
    if compare_with not in df.columns:
        raise BadIndex(f"no column {compare_with!r}")
    numeric = {c for c, t in df.dtypes if t in ("int", "bigint", "float", "double", "smallint") or t.startswith("decimal")}
    combine = {"max": F.max, "min": F.min, "mean": F.avg}[method]
    parts = []
    for c in df.columns:
        if c == compare_with:
            continue
        if {c, compare_with} <= numeric:
            part = correlation(df, c, compare_with)
        elif c in numeric or compare_with in numeric:
            cat, num = (compare_with, c) if c in numeric else (c, compare_with)
            part = ks_by_category(df, cat, num).agg(combine(1 - ks_p_value(F.col("ks"), F.col("n_in"), F.col("n_out"))).alias("effect"))
        else:
            part = category_effect(df, c, compare_with).agg(combine("effect").alias("effect"))
        parts.append(part.select(F.lit(c).alias("column"), "effect"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.orderBy(F.abs("effect").desc_nulls_last(), "column")


def label_stats(df: DataFrame, labels: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """(field, value, n, low, high): counts of label values, ranges of numbers."""
    a = counts(df, *labels).where(F.col("value").isNotNull()).select(F.col("column").alias("field"), "value", "n", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    one = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}_{c}") for c in numbers for k, f in (("n", F.count), ("l", F.min), ("h", F.max))])
    b = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.lit(None).cast("string").alias("value"), F.col(f"n_{c}").alias("n"), F.col(f"l_{c}").alias("low"), F.col(f"h_{c}").alias("high")) for c in numbers])))
    return a.union(b)


def first_ids(df: DataFrame, column: str, start: int = 1) -> DataFrame:
    """(value, id): distinct values as text, ids from ``start`` in the order of (bytes, value), dense."""
    from loomspan.operators.table import POS, number_rows

    distinct = df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct().withColumn("__size", F.octet_length("value"))
    return number_rows(distinct, "__size", "value").select("value", (F.col(POS) + start).alias("id"))


def simplex(d: int) -> np.ndarray:
    """d points in d - 1 dimensions, all at distance 1 from each other."""
    if d < 2:
        return np.zeros((max(d, 0), 0))
    centred = np.eye(d) - 1.0 / d
    basis = np.linalg.svd(centred)[2][: d - 1]
    return centred @ basis.T / math.sqrt(2)


class NumericEncoding:
    """How rows become vectors: numbers (missing ones by the mean), categories as simplex vertices, constants dropped.

    Categories past the ``most`` most frequent ones share the vertex "Data - other".
    """

    OTHER = "Data - other"

    def __init__(self, df: DataFrame, most: int = 50, scale: bool = True):
        self.parts: list[tuple] = []
        numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "float", "double", "smallint")]
        text = [c for c, t in df.dtypes if t == "string"]
        if numeric:
            row = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(numeric) for k, f in (("m", F.avg), ("a", F.min), ("b", F.max))]).first()
        for c in df.columns:
            if c in numeric:
                i = numeric.index(c)
                if row[f"a{i}"] is not None and row[f"a{i}"] < row[f"b{i}"]:
                    shift, width = (row[f"a{i}"], row[f"b{i}"] - row[f"a{i}"]) if scale else (0.0, 1.0)
                    self.parts.append((c, row[f"m{i}"], shift, width))
            elif c in text:
                top = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(most + 1).collect()  # bounded by ``most``
                names = sorted(r[0] for r in top[:most]) + ([self.OTHER] if len(top) > most else [])
                if len(names) > 1:
                    self.parts.append((c, names, simplex(len(names))))

    def to_real(self) -> Column:
        """The row as ``array<double>``; a missing category is the centre of its simplex."""
        out = []
        for p in self.parts:
            if len(p) == 4:
                out.append(F.array((F.coalesce(F.col(p[0]).cast("double"), F.lit(p[1])) - p[2]) / p[3]))
            else:
                c, names, points = p
                vertex = lambda v: F.array(*[F.lit(float(x)) for x in v])
                table = F.create_map(*[x for n, v in zip(names, points) for x in (F.lit(n), vertex(v))])
                unknown = table[self.OTHER] if self.OTHER in names else vertex(np.zeros(points.shape[1]))
                out.append(F.when(F.col(c).isNull(), vertex(np.zeros(points.shape[1]))).otherwise(F.coalesce(F.try_element_at(table, F.col(c)), unknown)))
        return F.concat(*out)

    def from_real(self, vector: Column) -> list[Column]:
        """The columns back: numbers unscaled, categories by the nearest vertex."""
        out, at = [], 1
        for p in self.parts:
            if len(p) == 4:
                out.append((F.element_at(vector, at) * p[3] + p[2]).alias(p[0]))
                at += 1
            else:
                c, names, points = p
                own = F.slice(vector, at, points.shape[1])
                far = lambda v: F.aggregate(F.zip_with(own, F.array(*[F.lit(float(x)) for x in v]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)  # noqa: E731, B023
                out.append(F.array_min(F.array(*[F.struct(far(v).alias("d"), F.lit(n).alias("n")) for n, v in zip(names, points)]))["n"].alias(c))
                at += points.shape[1]
        return out


# -- sets ---------------------------------------------------------------------


def weighted_set_mean(children: DataFrame, set_id: str, value: str, weight: str, parents: DataFrame | None = None) -> DataFrame:
    """(set, mean): mean by weights of at least LEAST_WEIGHT; with ``parents``, empty sets are 0."""
    w = F.greatest(F.col(weight).cast("double"), F.lit(LEAST_WEIGHT))
    mean = children.groupBy(set_id).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("mean"))
    return mean if parents is None else parents.select(set_id).join(mean, set_id, "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))


def suffix_mean(children: DataFrame, set_id: str, pos: Sequence[str], value: str, weight: str) -> DataFrame:
    """Adds the weighted mean over each member and those after it in its set; the last one is itself."""
    w = F.greatest(F.col(weight).cast("double"), F.lit(LEAST_WEIGHT))
    # from the end on: a frame that reaches forward without bound would be summed anew for every row
    rest = Window.partitionBy(set_id).orderBy(*[F.desc(c) for c in pos]).rowsBetween(Window.unboundedPreceding, 0)
    return children.withColumn("suffix_mean", F.sum(w * F.col(value)).over(rest) / F.sum(w).over(rest))


def gram(df: DataFrame, vector: str, d: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sum of outer products, sum, rows) of a vector column: partial d x d sums per batch, one small row each.

    A missing number counts as its place's mean over the rows that have it; a vector of another
    length is an error; a null vector is no row.
    """
    import pyarrow as pa

    from loomspan.errors import BadData

    odd = df.where(F.col(vector).isNotNull() & (F.size(vector) != d)).limit(1).count()
    if odd:
        raise BadData(f"a vector of {vector!r} hasn't {d} numbers")
    each = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("k", "x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    means = {r.k: r.m for r in each.groupBy("k").agg(F.avg("x").alias("m")).collect()}  # d rows
    usual = np.array([means.get(k, 0.0) for k in range(d)])

    def partial(source):
        total, mean, n = np.zeros((d, d)), np.zeros(d), 0
        for batch in source:
            x = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, d)
            x = np.where(np.isnan(x), usual, x)
            total += x.T @ x
            mean += x.sum(0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()]), pa.array([mean.tolist()]), pa.array([n])], names=["g", "s", "n"])

    parts = df.where(F.size(vector) == d).select(F.col(vector).cast("array<double>")).mapInArrow(partial, "g array<double>, s array<double>, n bigint")
    # summed by place: d * d rows reach the driver, however many partitions there are
    place = parts.select(F.posexplode(F.concat("g", "s", F.array(F.col("n").cast("double")))).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"))
    flat = np.zeros(d * d + d + 1)
    for row in place.collect():
        flat[row.k] = row.x
    return flat[: d * d].reshape(d, d), flat[d * d : -1], int(flat[-1])


def pca(df: DataFrame, vector: str, d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, k unit directions) of the centred rows; not divided by their number."""
    g, s, n = gram(df, vector, d)
    value, direction = np.linalg.eigh(g - np.outer(s, s) / max(n, 1))
    order = np.argsort(-value)[:k]
    return np.sqrt(np.maximum(value[order], 0)), direction[:, order].T


def pca_sql(table: str, vector: str, d: int) -> str:
    """The centred Gram matrix that ``pca`` decomposes, as (i, j, g) in DuckDB."""
    return f"""with numbered as (select row_number() over () as r, {vector} as vector from {table} as source), x as (select r, i, vector[i]::double as v from numbered, range(1, {d + 1}) t(i)), m as (select i, avg(v) as m from x group by i),
c as (select r, x.i, v - m as v from x join m using (i)) select (a.i - 1)::int as i, (b.i - 1)::int as j, round(sum(a.v * b.v), 4) as g from c a join c b on a.r = b.r group by all"""


def centred_gram(df: DataFrame, vector: str, d: int) -> DataFrame:
    """(i, j, g): the sums of products of centred places."""
    g, s, n = gram(df, vector, d)
    c = g - np.outer(s, s) / max(n, 1)
    return df.sparkSession.createDataFrame([(i, j, float(c[i, j])) for i in range(d) for j in range(d)], "i int, j int, g double")


def orthogonalize(columns: np.ndarray) -> tuple[np.ndarray, int]:
    """(orthonormal columns that span the same space, how many): Gram-Schmidt, the longest remaining column first."""
    left, done = np.array(columns, float), []
    limit = 1e-10 * max(np.sqrt((left**2).sum(0)).max(initial=0.0), 1e-300)
    while left.shape[1]:
        size = np.sqrt((left**2).sum(0))
        k = int(size.argmax())
        if size[k] <= limit:
            break
        q = left[:, k] / size[k]
        done.append(q)
        left = np.delete(left, k, 1)
        left -= np.outer(q, q @ left)
    return (np.stack(done, 1) if done else np.zeros((len(left), 0))), len(done)


def whitening(df: DataFrame, vector: str, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(shift, matrix): ``(x - shift) @ matrix`` has mean 0 and unit covariance in the directions that vary."""
    g, s, n = gram(df, vector, d)
    value, direction = np.linalg.eigh(g / max(n, 1) - np.outer(s, s) / max(n, 1) ** 2)
    keep = value > max(value.max(initial=0.0), 0.0) * 1e-10
    scale = np.where(keep, 1 / np.sqrt(np.where(keep, value, 1)), 0)
    return s / max(n, 1), direction * scale


def least_squares(df: DataFrame, features: Sequence[str], target: str, intercept: bool = True) -> DataFrame:
    """(name, weight): the weights of least squared error, from one aggregation of products; rows with a null are left out."""
    names = [*features, *(["1"] if intercept else []), target]
    rows = df.dropna(subset=[*features, target]).select(*[F.lit(1.0).alias("1") if c == "1" else F.col(c).cast("double").alias(c) for c in names])
    sums = rows.agg(*[F.sum(F.col(f"`{a}`") * F.col(f"`{b}`")).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    m = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(names))] for i in range(len(names))])
    w = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
    return df.sparkSession.createDataFrame([(c, float(x)) for c, x in zip(names, w)], "name string, weight double")


def category_ratio(point: Sequence[float], vertices: np.ndarray) -> np.ndarray:
    """The affine weights (sum 1) of a simplex's vertices that give a point."""
    a = np.vstack([vertices.T, np.ones(len(vertices))])
    return np.linalg.solve(a, np.append(np.asarray(point, float), 1.0))


def project(vector: str, directions: np.ndarray) -> Column:
    """Scores on the directions, without centring."""
    from loomspan.operators.joins import dot

    return F.array(*[dot(F.col(vector), F.array(*[F.lit(float(x)) for x in v])) for v in directions])
