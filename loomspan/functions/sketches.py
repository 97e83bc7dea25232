"""Mergeable sketches: distinct counts, quantiles, membership. All are partial aggregates, merged by Spark."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hll(df: DataFrame, value: str, *by: str, precision: int = 13) -> DataFrame:
    """A sketch of 2^precision cells a group; error about 1.04 / sqrt(2^precision)."""
    if not 4 <= precision <= 21:
        raise ValueError("precision must be 4 .. 21")
    return df.groupBy(*by).agg(F.hll_sketch_agg(value, precision).alias("sketch"))


def hll_merge(sketches: DataFrame, *by: str) -> DataFrame:
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch", True).alias("sketch"))


def hll_estimate(sketch: str = "sketch") -> Column:
    return F.hll_sketch_estimate(sketch)


def hll_bounds(estimate: Column, precision: int = 13, z: float = 1.96) -> tuple[Column, Column]:
    half = z * 1.04 / math.sqrt(1 << precision)
    return estimate * (1 - half), estimate * (1 + half)


def kll(df: DataFrame, value: str, *by: str, k: int = 267) -> DataFrame:
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"), F.count(value).alias("n"), F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))


def kll_merge(sketches: DataFrame, *by: str) -> DataFrame:
    """Extremes are merged beside the sketch, so that they are exact."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def kll_quantile(share: float, sketch: str = "sketch") -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))


def kll_rank(value: float, sketch: str = "sketch") -> Column:
    return F.kll_sketch_get_rank_double(sketch, F.lit(float(value)))


class Bloom:
    """A membership sketch: k of m bits a value, kept as 64-bit words (word, bits) in a DataFrame.

    All bits of a value lie in one segment of 4,096, so that a value is sent and looked up once, not once a bit.
    """

    WORDS = 64  # of a segment

    def __init__(self, capacity: int, fp_rate: float = 0.01):
        m = max(64, math.ceil(-capacity * math.log(fp_rate) / math.log(2) ** 2))
        self.k = max(1, round(m / capacity * math.log(2)))
        self.segments = -(-m // (64 * self.WORDS))
        self.m = 64 * self.WORDS * self.segments

    def _segment(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value, F.lit(0)), F.lit(self.segments))

    def _hashes(self, value: Column) -> list[Column]:
        return [F.xxhash64(value, F.lit(1 + i)) for i in range(-(-self.k // 5))]

    def _bits(self, hashes: list[Column]) -> list[Column]:
        """The value's k places in its segment, by twelve bits of a hash each."""
        return [F.shiftrightunsigned(hashes[i // 5], 12 * (i % 5)).bitwiseAND(F.lit(64 * self.WORDS - 1)) for i in range(self.k)]

    def build(self, df: DataFrame, value: str) -> DataFrame:
        """(word, bits); at most m / 64 rows. One small row a value is shuffled, by segment."""
        text = F.col(value).cast("string")
        sent = df.where(F.col(value).isNotNull()).select(self._segment(text).alias("segment"), *[h.alias(f"p{i}") for i, h in enumerate(self._hashes(text))])
        places = F.array(*self._bits([F.col(c) for c in sent.columns[1:]]))
        each = sent.repartition("segment").select("segment", F.explode(places).alias("p"))
        bit = F.expr("shiftleft(1L, cast(p % 64 as int))")
        return each.groupBy("segment", F.expr("p div 64").alias("w")).agg(F.bit_or(bit).alias("bits")).select((F.col("segment") * self.WORDS + F.col("w")).alias("word"), "bits")

    @staticmethod
    def merge(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.union(b).groupBy("word").agg(F.bit_or("bits").alias("bits"))

    @staticmethod
    def to_bytes(words: DataFrame) -> DataFrame:
        """(word, data): the words as eight bytes each, to be stored or sent."""
        return words.select("word", F.unhex(F.lpad(F.hex("bits"), 16, "0")).alias("data"))

    @staticmethod
    def from_bytes(data: DataFrame) -> DataFrame:
        half = lambda a: F.conv(F.substring(F.hex("data"), a, 8), 16, 10).cast("bigint")
        return data.select("word", F.shiftleft(half(1), 32).bitwiseOR(half(9)).alias("bits"))

    def probe(self, df: DataFrame, value: str, words: DataFrame, name: str = "seen") -> DataFrame:
        """Adds whether a value may have been added; never false for one that was.

        Segments are broadcast if the sketch has up to 2^24 bits; rows of ``df`` go to the segments of a larger one.
        """
        offset = F.struct((F.col("word") % self.WORDS).alias("w"), "bits")
        segments = words.groupBy(F.expr(f"word div {self.WORDS}").alias("__segment")).agg(F.map_from_entries(F.collect_list(offset)).alias("m"))
        dense = segments.select("__segment", F.transform(F.sequence(F.lit(0), F.lit(self.WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("bigint")), F.lit(0))).alias("__words"))
        text = F.col(value).cast("string")
        inside = F.col(value).isNotNull()
        for p in self._bits(self._hashes(text)):
            inside = inside & (F.getbit(F.get("__words", F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1)
        met = df.withColumn("__segment", self._segment(text)).join(F.broadcast(dense) if self.m <= 1 << 24 else dense.hint("shuffle_hash"), "__segment", "left")
        return met.withColumn(name, F.coalesce(inside, F.lit(False))).drop("__words", "__segment")
