"""Distinct n-grams against sets of tuples."""

import numpy as np

from loomspan.operators import search as R


def test_distinct_ngrams(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [[f"w{k}" * (1 + int(k) % 40) for k in rng.integers(0, 60, rng.integers(0, 90))] for _ in range(300)]
    texts += [["a", "b c"], ["a b", "c"], ["a", "", "b"], ["", "a", "b"], ["ä"], None, [], ["x" * 4000 + "y"], ["x" * 4000 + "z"]]
    df = spark.createDataFrame([(t,) for t in texts], "ws array<string>")
    want = {n: len({tuple(t[i : i + n]) for t in texts if t for i in range(len(t) - n + 1)}) for n in (1, 2, 3, 4)}
    assert {r.n: r.n_distinct for r in R.distinct_ngrams(df, "ws", 4).collect()} == want
    monkeypatch.setattr(R, "GRAMS_OF_A_RANGE", 3000)
    monkeypatch.setattr(R, "GRAMS_AT_ONCE", 500)
    got = R.distinct_ngrams(df, "ws", 4)
    assert {r.n: r.n_distinct for r in got.collect()} == want
    # it exploded a row an n-gram, once for each n
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
