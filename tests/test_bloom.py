"""The Bloom sketch beyond the size that is broadcast."""

from pyspark.sql import functions as F

from loomspan.functions import sketches as K


def test_a_value_is_sent_once(spark):
    """A sketch of over 2^24 bits was probed with seven rows a value, grouped again by row."""
    big = K.Bloom(2_000_000, 0.01)
    assert big.m > 1 << 24
    df = spark.range(3000).select(F.when(F.col("id") < 2990, F.col("id")).alias("v"))
    words = big.build(df.where("v % 2 = 0"), "v")
    got = big.probe(df, "v", words)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "monotonically" not in plan  # the one of the build
    seen = {r.v: r.seen for r in got.collect()}
    assert all(seen[i] for i in range(0, 2990, 2)) and not seen[None] and got.count() == 3000
    assert sum(seen[i] for i in range(1, 2990, 2)) < 10  # nearly empty


def test_false_share(spark):
    for n in (3_000, 200_000):  # one full segment of values and many
        bloom = K.Bloom(n, 0.01)
        words = bloom.build(spark.range(n), "id")
        assert bloom.probe(spark.range(n), "id", words).where("not seen").isEmpty()
        false = bloom.probe(spark.range(n, 2 * n), "id", words).where("seen").count() / n
        assert 0.002 < false < 0.014
