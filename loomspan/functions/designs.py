"""Random ranges, designs and pairs as tables: every row is made where it lies, from its number and a seed."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.scalars import index_to_pair


def _feistel(x: Column, half: int, seed: int, rounds: int = 4) -> Column:
    """A permutation of the numbers below 2 ** (2 * half)."""
    mask = (1 << half) - 1
    left, right = F.shiftright(x, half), x.bitwiseAND(F.lit(mask))
    for r in range(rounds):
        left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(seed), F.lit(r)).bitwiseAND(F.lit(mask)))
    return F.shiftleft(left, half).bitwiseOR(right)


def random_range(spark: SparkSession, start: int, stop: int | None = None, step: int = 1, count: int | None = None, seed: int = 0) -> DataFrame:
    """(k, value): the numbers of a range in a random order, or the first ``count`` of them; none repeats.

    A keyed permutation gives each number its place, so that nothing is sorted or held;
    places beyond the range (under four for each number) are left out.
    """
    start, stop = (0, start) if stop is None else (start, stop)
    if not step:
        raise ValueError("the step can't be 0")
    n = max(0, math.ceil((stop - start) / step))
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    placed = spark.range(n).select(_feistel(F.col("id"), half, seed).alias("place"), (F.lit(start) + F.col("id") * step).alias("value"))
    if count is not None and count < n:
        # no more than ``count`` rows by the order of places: a bounded heap in every task
        placed = placed.orderBy("place").limit(count)
    from loomspan.operators.table import POS, number_rows

    return number_rows(placed, "place").select(F.col(POS).alias("k"), "value")


def lcg(spark: SparkSession, count: int, seed: int = 1, a: int = 1_103_515_245, c: int = 12_345, bits: int = 31) -> DataFrame:
    """(k, value): a linear congruential sequence of numbers in [0, 1); each is found from its own number by doubling."""
    m = 1 << bits
    mask = F.lit(m - 1)
    x, mul, add = F.lit(seed % m).cast("bigint"), a % m, c % m
    k = F.col("id") + 1
    for b in range(max(1, count.bit_length())):
        # the product of two numbers of 31 bits fits
        x = F.when(F.shiftright(k, b).bitwiseAND(F.lit(1)) == 1, (x * F.lit(mul) + F.lit(add)).bitwiseAND(mask)).otherwise(x)
        mul, add = mul * mul % m, (mul * add + add) % m
    return spark.range(count).select(F.col("id").alias("k"), (x.cast("double") / m).alias("value"))


def _uniform(seed: int, *parts: int) -> Column:
    """A number in [0, 1) from the row's ``id``."""
    h = F.xxhash64(F.col("id"), F.lit(seed), *[F.lit(p) for p in parts])
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def _normals(seed: int, dim: int) -> list[Column]:
    return [F.sqrt(-2 * F.ln(1 - _uniform(seed, d, 1))) * F.cos(2 * math.pi * _uniform(seed, d, 2)) for d in range(dim)]


def box(spark: SparkSession, count: int, dim: int, seed: int = 0) -> DataFrame:
    """(id, point): uniform in the unit box."""
    return spark.range(count).select("id", F.array(*[_uniform(seed, d) for d in range(dim)]).alias("point"))


def sphere(spark: SparkSession, count: int, dim: int, seed: int = 0) -> DataFrame:
    """(id, point): uniform on the unit sphere."""
    rows = spark.range(count).select("id", F.array(*_normals(seed, dim)).alias("z"))
    norm = F.sqrt(F.aggregate("z", F.lit(0.0), lambda s, v: s + v * v))
    return rows.select("id", F.transform("z", lambda v: v / F.greatest(norm, F.lit(1e-300))).alias("point"))


def ball(spark: SparkSession, count: int, dim: int, seed: int = 0) -> DataFrame:
    """(id, point): uniform in the unit ball."""
    radius = F.pow(_uniform(seed, -1), F.lit(1.0 / dim))
    return sphere(spark, count, dim, seed).select("id", F.transform("point", lambda v: v * radius).alias("point"))


def well_spaced_box(spark: SparkSession, count: int, dim: int, seed: int = 0) -> DataFrame:
    """(id, point): a latin hypercube: in every dimension each of ``count`` equal slots holds one point."""
    out = spark.range(count)
    for d in range(dim):
        slots = random_range(spark, count, seed=seed * 1009 + d + 1).select(F.col("k").alias("id"), F.col("value").alias(f"s{d}"))
        out = out.join(slots, "id")
    return out.select("id", F.array(*[(F.col(f"s{d}") + _uniform(seed, d)) / count for d in range(dim)]).alias("point"))


def well_spaced_sphere(spark: SparkSession, count: int, dim: int, seed: int = 0) -> DataFrame:
    """(id, point): directions of a latin hypercube's points, sent through the normal distribution's quantiles."""
    rows = well_spaced_box(spark, count, dim, seed)
    z = F.transform("point", lambda u: _quantile(u))
    norm = F.sqrt(F.aggregate("z", F.lit(0.0), lambda s, v: s + v * v))
    return rows.select("id", z.alias("z")).select("id", F.transform("z", lambda v: v / F.greatest(norm, F.lit(1e-300))).alias("point"))


def well_spaced_ball(spark: SparkSession, count: int, dim: int, seed: int = 0) -> DataFrame:
    """(id, point): the same with radii one in each of ``count`` shells of equal volume."""
    shells = random_range(spark, count, seed=seed * 1009 + 997).select(F.col("k").alias("id"), F.col("value").alias("shell"))
    rows = well_spaced_sphere(spark, count, dim, seed).join(shells, "id")
    radius = F.pow((F.col("shell") + _uniform(seed, -2)) / count, F.lit(1.0 / dim))
    return rows.select("id", F.transform("point", lambda v: v * radius).alias("point"))


def _quantile(u: Column) -> Column:
    """The normal distribution's quantile, to about 5e-4 (a rational function of the tail)."""
    p = F.least(F.greatest(F.least(u, 1 - u), F.lit(1e-12)), F.lit(0.5))
    t = F.sqrt(-2 * F.ln(p))
    x = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    return F.when(u < 0.5, -x).otherwise(x)


def pairs(spark: SparkSession, length: int, count: int | None = None, seed: int = 0) -> DataFrame:
    """(i, j), i > j >= 0: all pairs of ``length`` things, or ``count`` different ones at random."""
    n = length * (length - 1) // 2
    numbers = spark.range(n).select(F.col("id").alias("value")) if count is None or count >= n else random_range(spark, n, count=count, seed=seed).select("value")
    i, j = index_to_pair(F.col("value"))
    return numbers.select(i.cast("bigint").alias("i"), j.cast("bigint").alias("j"))


def mesh(spark: SparkSession, nodes: Sequence, dim: int, sample: int | None = None, seed: int = 0) -> DataFrame:
    """(point): every combination of ``dim`` nodes, or ``sample`` different ones at random; each is made from its number."""
    n = len(nodes) ** dim
    rows = spark.range(n).select(F.col("id").alias("value")) if sample is None or sample >= n else random_range(spark, n, count=sample, seed=seed).select("value")
    table = F.array(*[F.lit(x) for x in nodes])
    # the first place changes slowest
    digit = lambda d: (F.expr(f"value div {len(nodes) ** (dim - 1 - d)}") % len(nodes)).cast("int")
    return rows.select(F.array(*[F.get(table, digit(d)) for d in range(dim)]).alias("point"))
