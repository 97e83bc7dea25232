"""Pairs of blocks: what is shuffled, what a task holds, and results at the edges of single precision."""

import numpy as np
import pytest

from loomspan.operators import blocks as B
from loomspan.operators.balltree import BallTree


def table(spark, x, kind="double"):
    return spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(x.tolist())], f"id long, doc long, v array<{kind}>")


def test_blocks_are_few(spark):
    """20,000 rows a side were 5 x 5 blocks of knn_join and 10 x 10 of radius_join, each side shuffled as often."""
    df = spark.range(20_000).selectExpr("id", "array_repeat(cast(id as float), 64) as v")
    cores = spark.sparkContext.defaultParallelism
    _, _, a, b = B.sides(df, df, "id", "id", "v")
    assert a * b <= 3 * cores + max(a, b) and max(a, b) <= 4 < 5
    assert B.BLOCK_BYTES // (8 * 64) > 100_000  # so many rows of 64 numbers before a table is split for memory's sake


@pytest.mark.parametrize("change", ["none", "copies", "far", "huge", "tiny", "outlier", "whole"])
def test_blocks_against_all_pairs(change):
    rng = np.random.default_rng(7)
    y, x = rng.normal(size=(3000, 8)).astype(np.float32), rng.normal(size=(40, 8)).astype(np.float32)
    if change == "copies":
        y[1500:], x = y[:1500], y[:40].copy()
    elif change == "far":
        x, y = x + np.float32(1000), y + np.float32(1000)
    elif change in ("huge", "tiny"):
        x, y = (a.astype(float) * (1e20 if change == "huge" else 1e-25) for a in (x, y))
    elif change == "outlier":
        y[0] = 1e6
    elif change == "whole":
        x, y = np.round(x), np.round(y)
    d = np.sqrt(((x[:, None].astype(float) - y[None].astype(float)) ** 2).sum(2))
    key, doc = rng.permutation(3000) + 5, rng.integers(0, 6, 3000)
    leaf = np.sort(rng.integers(0, 40, 3000))
    for given in (None, leaf):
        got = [sorted(zip(key[to[at == i]].tolist(), e[at == i].tolist())) for at, to, e in B.nearest(x, y, key, 5, leaf=given) for i in range(40)]
        assert got == [sorted((int(key[j]), d[i, j]) for j in np.lexsort((key, d[i]))[:5]) for i in range(40)]
    got = [list(zip(doc[to[at == i]].tolist(), e[at == i].tolist())) for at, to, e in B.nearest(x, y, doc, 4, grouped=True) for i in range(40)]
    least = np.array([[d[i, doc == c].min() for c in range(6)] for i in range(40)])
    assert got == [[(int(c), least[i, c]) for c in np.lexsort((range(6), least[i]))[:4]] for i in range(40)]
    radius = float(np.quantile(d, 0.02))
    assert {(int(i), int(j)) for at, to, _ in B.within(x, y, radius) for i, j in zip(at, to)} == {tuple(r) for r in np.argwhere(d <= radius).tolist()}


def test_ball_tree_of_several_tasks(spark, monkeypatch):
    """Nodes above a task's rows are split by the cluster, those below within a task; the searches are the same."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 4))
    df = table(spark, x)
    whole = BallTree(df, "id", "v", leaf_rows=16)
    monkeypatch.setattr(B, "BLOCK_BYTES", 16 * 4 * 300)
    parts = BallTree(df, "id", "v", leaf_rows=16)
    assert {r.path for r in whole.nodes.collect()} == {r.path for r in parts.nodes.collect()}
    assert {tuple(r) for r in whole.rows.select("id", "path").collect()} == {tuple(r) for r in parts.rows.select("id", "path").collect()}
    asked = df.where("id % 9 = 0")
    d = np.sqrt(((x[::9, None] - x[None]) ** 2).sum(2))
    assert {(r["query"], r["rank"]): r.point for r in parts.nearest(asked, 3, "id", "v").collect()} == {(9 * i, k + 1): int(j) for i in range(len(d)) for k, j in enumerate(np.argsort(d[i], kind="stable")[:3])}
    # a budget: the leaves of the closest means until they hold so many rows
    leaves = sorted((r.path, r.n, r["mean"]) for r in parts.nodes.where("leaf").collect())
    path = {r.id: r.path for r in parts.rows.collect()}
    got = {(r["query"], r["rank"]): r.point for r in parts.nearest(asked, 3, "id", "v", budget=200).collect()}
    for i in range(len(d)):
        order = np.argsort([((x[9 * i] - np.array(m)) ** 2).sum() for _, _, m in leaves], kind="stable")
        held = np.cumsum([leaves[j][1] for j in order])
        looked = {leaves[j][0] for j, h in zip(order, held) if h - leaves[j][1] < 200}
        near = [j for j in np.argsort(d[i], kind="stable") if path[int(j)] in looked][:3]
        assert [got[9 * i, k] for k in (1, 2, 3)] == near
