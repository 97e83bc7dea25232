"""Searches whose every row is a query."""

import numpy as np

from loomspan.plans import search

DATA = "/root/testdata/sf0.001"


def vectors(spark, name=DATA):
    rows = sorted(spark.read.parquet(f"{name}/embeddings.parquet").select("vec_id", "embedding").collect())
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)


def test_tree_probe_finds_the_nearest_of_every_row(spark):
    ids, x = vectors(spark)
    got: dict = {}
    for r in search.tree_probe(spark, DATA).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.point))
    assert sorted(got) == ids.tolist()
    for i, q in zip(ids.tolist(), x):
        d = np.sqrt(((x - q) ** 2).sum(1))
        assert [p for _, p in sorted(got[i])] == ids[np.lexsort((ids, d))[:10]].tolist()


def test_probe_join_over_several_blocks(spark):
    from loomspan.operators import index as N

    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows, _ = N.build_tree(e, "embedding", "vec_id", fanout=8, leaf_rows=64)
    got = {(r["query"], r["rank"]): r.point for r in N.probe_join(e, rows, 3, "vec_id", "vec_id", "embedding", block_rows=150).collect()}
    want = {(r["query"], r["rank"]): r.point for r in N.knn_join(e, e, 3, "vec_id", "vec_id", "embedding").collect()}
    assert got == want


def test_radius_join_over_all_labels(spark):
    from loomspan.operators import index as N

    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    ids, x = vectors(spark)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    radius = float(np.quantile(d, 0.05))
    at, to = np.nonzero(d <= radius)
    got = {(r["query"], r.point) for r in N.radius_join(e, e, radius, "vec_id", "vec_id", "embedding", block_rows=150).collect()}
    assert got == set(zip(ids[at].tolist(), ids[to].tolist())) and len(got) > len(ids)
    assert {r["query"] for r in search.radius_join_all(spark, DATA).collect()} == set(ids.tolist())


def test_every_row_is_predicted(spark):
    assert sorted(r["query"] for r in search.nn_predict_all(spark, DATA).collect()) == vectors(spark)[0].tolist()


def test_every_row_searches(spark):
    ids = set(vectors(spark)[0].tolist())
    assert {r["query"] for r in search.search_documents_all(spark, DATA).collect()} == ids
    assert {r["query"] for r in search.rank_top_k_all(spark, DATA).collect()} == ids
