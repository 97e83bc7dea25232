"""Clustering and the tree index over vectors: k-means, diverse previews, level-wise build, beam descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators import blocks
from loomspan.operators.joins import small
from loomspan.operators.search import hash_sample
from loomspan.session import settle

MOST_CENTROIDS = 4096


def seed_centroids(sample: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """k-means++: each next centroid is drawn with a chance by the squared distance to the ones so far."""
    rng = np.random.default_rng(seed)
    chosen = [sample[rng.integers(len(sample))]]
    gap = ((sample - chosen[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(sample)):
        total = gap.sum()
        pick = rng.choice(len(sample), p=gap / total) if total > 0 else rng.integers(len(sample))
        chosen.append(sample[pick])
        gap = np.minimum(gap, ((sample - sample[pick]) ** 2).sum(1))
    return np.array(chosen)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None], 0)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def assign(df: DataFrame, vector: str, centroids: np.ndarray, name: str = "cluster") -> DataFrame:
    """Adds the nearest centroid's number, ties to the smaller, and the squared distance."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(centroids, float))
    at = df.columns.index(vector)

    def label(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                x = np.asarray(batch.column(at).flatten(), float).reshape(batch.num_rows, -1)
                k, d = _nearest(x, shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k.astype(np.int32)), pa.array(d)], names=[*batch.schema.names, name, "squared"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(label, f"{schema}, `{name}` int, squared double")


def kmeans(df: DataFrame, vector: str, id_col: str, k: int, max_iter: int = 20, tol: float = 1e-4, seed: int = 0, init_rows: int = 4096) -> tuple[np.ndarray, float]:
    """(centroids, inertia) by Lloyd's rounds over all rows; one small row a cluster and round reaches the driver.

    Only the start is drawn from a bounded sample of ``init_rows``. An empty cluster moves to a row of that sample.
    """
    if not 0 < k <= MOST_CENTROIDS:
        raise ValueError(f"k must be 1 .. {MOST_CENTROIDS}")
    sample = np.array([r[0] for r in hash_sample(df.select(id_col, vector), init_rows, id_col, seed).select(vector).collect()], float)
    if not len(sample):
        return np.zeros((0, 0)), 0.0
    centroids, rng = seed_centroids(sample, k, seed), np.random.default_rng(seed + 1)
    shared_of = df.sparkSession.sparkContext.broadcast

    def sums(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        held = shared_of(c)

        def partial(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count, inertia = np.zeros_like(held.value), np.zeros(len(held.value)), 0.0
            for batch in source:
                if batch.num_rows:
                    x = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1)
                    at, d = _nearest(x, held.value)
                    np.add.at(total, at, x)
                    count += np.bincount(at, minlength=len(count))
                    inertia += float(d.sum())
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size + len(count) + 1), pa.int32()), pa.array(np.concatenate([total.ravel(), count, [inertia]]))], names=["k", "x"])

        rows = df.select(vector).mapInArrow(partial, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
        flat = np.zeros(c.size + len(c) + 1)
        for r in rows:
            flat[r.k] = r.x
        return flat[: c.size].reshape(c.shape), flat[c.size : -1], flat[-1]

    inertia = 0.0
    for _ in range(max_iter):
        total, count, inertia = sums(centroids)
        new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], sample[rng.integers(len(sample), size=len(centroids))])
        moved = float(np.sqrt(((new - centroids) ** 2).sum(1)).max())
        centroids = new
        if moved <= tol:
            break
    return centroids, inertia


def diverse(points: np.ndarray, k: int, seed: int = 0) -> list[int]:
    """Greedy farthest-point selection of k rows."""
    if not len(points):
        return []
    rng = np.random.default_rng(seed)
    picked = [int(rng.integers(len(points)))]
    gap = ((points - points[picked[0]]) ** 2).sum(1)
    while len(picked) < min(k, len(points)):
        nxt = int(gap.argmax())
        picked.append(nxt)
        gap = np.minimum(gap, ((points - points[nxt]) ** 2).sum(1))
    return picked


def build_tree(df: DataFrame, vector: str, id_col: str, fanout: int = 8, leaf_rows: int = 256, max_depth: int = 4, fit_rows: int = 4096, rounds: int = 8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows with ``node`` path, nodes (node, parent, depth, n, leaf, centroid)) of a hierarchical clustering.

    All nodes of a level are split in one pass: a bounded sample of each node (``fit_rows`` in all a node)
    gives its children's centroids, every row then moves to the nearest child of its node.
    """
    rows = settle(df.withColumn("node", F.lit("")))
    nodes = [df.sparkSession.createDataFrame([("", None, 0, df.count(), None)], "node string, parent string, depth int, n bigint, centroid array<double>")]
    done: list[DataFrame] = []
    for depth in range(1, max_depth + 1):
        sizes = rows.groupBy("node").count()
        open_ = settle(rows.join(F.broadcast(sizes.where(F.col("count") > leaf_rows).select("node")), "node"))
        done.append(rows.join(F.broadcast(sizes.where(F.col("count") <= leaf_rows).select("node")), "node"))
        if open_.isEmpty():
            rows = open_
            break
        share = F.least(F.lit(1.0), F.lit(float(fit_rows)) / F.col("count"))
        drawn = open_.join(F.broadcast(sizes), "node").where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed + depth)), F.lit(1 << 20)) < share * (1 << 20)).select("node", id_col, vector)

        def split(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(id_col)
            x = np.stack(part[vector].to_numpy()).astype(float)
            c = seed_centroids(x, fanout, seed)
            for _ in range(rounds):
                at, _d = _nearest(x, c)
                c = np.stack([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
            return pd.DataFrame({"node": part["node"].iloc[0], "child": np.arange(len(c)).astype("int32"), "centroid": list(c)})

        children = settle(drawn.groupBy("node").applyInPandas(split, "node string, child int, centroid array<double>"))
        table: dict[str, np.ndarray] = {}
        for r in children.orderBy("node", "child").collect():  # fanout rows an open node
            table.setdefault(r.node, []).append(r.centroid)
        held = df.sparkSession.sparkContext.broadcast({k: np.array(v) for k, v in table.items()})
        at_v, at_n = open_.columns.index(vector), open_.columns.index("node")

        def route(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                if batch.num_rows:
                    x = np.asarray(batch.column(at_v).flatten(), float).reshape(batch.num_rows, -1)
                    here = np.array(batch.column(at_n).to_pylist(), object)
                    out = here.copy()
                    for node in set(here):
                        own = here == node
                        out[own] = [f"{node}/{j}" for j in _nearest(x[own], held.value[node])[0]]
                    columns = list(batch.columns)
                    columns[at_n] = pa.array(out, pa.string())
                    yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        rows = settle(open_.mapInArrow(route, open_.schema))
        found = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        named = children.select(F.concat("node", F.lit("/"), F.col("child").cast("string")).alias("node"), F.col("node").alias("parent"), F.lit(depth).alias("depth"), "centroid")
        nodes.append(named.join(found, "node").select("node", "parent", "depth", "n", "centroid"))
    out = rows
    for d in done:
        out = out.unionByName(d)
    tree = nodes[0]
    for n in nodes[1:]:
        tree = tree.union(n)
    tree = settle(tree)
    inner = tree.select(F.col("parent").alias("__p")).distinct().where("__p is not null")
    return out, tree.join(inner, tree.node == F.col("__p"), "left").withColumn("leaf", F.col("__p").isNull()).drop("__p")


def descend(nodes: DataFrame, query: list[float], beam: int = 8, max_depth: int = 16) -> list[str]:
    """Paths of the leaves that a beam of the nearest children reaches; a few rows a level reach the driver."""
    from loomspan.operators.joins import squared_distance

    target = F.array(*[F.lit(float(x)) for x in query])
    level, leaves = [""], []
    root = nodes.where("parent is null").first()
    if root is None or root.leaf:
        return [""] if root else []
    for _ in range(max_depth):
        best = nodes.where(F.col("parent").isin(*level)).withColumn("d", squared_distance(F.col("centroid"), target)).orderBy("d", "node").limit(beam).collect()
        leaves += [r.node for r in best if r.leaf]
        level = [r.node for r in best if not r.leaf]
        if not level:
            break
    return leaves


def probe(rows: DataFrame, nodes: DataFrame, vector: str, id_col: str, query: list[float], k: int = 10, beam: int = 8) -> DataFrame:
    """The k nearest rows within the leaves that a descent reaches (approximate; the beam trades recall for rows read)."""
    from loomspan.operators.search import rank

    return rank(rows.where(F.col("node").isin(*descend(nodes, query, beam))), vector, query, k, id_col)


def _ranked(pairs: DataFrame, point: str, k: int) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", point))).where(F.col("rank") <= k)


def knn_join(queries: DataFrame, points: DataFrame, k: int, query_id: str, point_id: str, vector: str = "vector", block_rows: int | None = None) -> DataFrame:
    """(query, point, distance, rank), exact, for both sides large: blocks of queries meet blocks of points.

    A pair of blocks keeps k rows a query; block ranks are merged by one window. Rows without id or vector are left out.
    """
    q, p, n_q, n_p = blocks.sides(queries, points.select(point_id, vector), query_id, point_id, vector, block_rows)

    def best(ids, x, others, y, own, theirs):
        for at, to, d in blocks.nearest(x, y, others, k):
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(others[to]), pa.array(d)], names=["query", "point", "distance"])

    pairs = blocks.meet(q.withColumn("qb", blocks.block_of("id", n_q)), p.withColumn("pb", blocks.block_of("id", n_p)), n_q, n_p, best, "query bigint, point bigint, distance double")
    return _ranked(pairs, "point", k)


def leaf_table(rows: DataFrame, blocks_: int) -> DataFrame:
    """(leaf, node, n, pb, parts): the leaves of a tree's rows, numbered by path, and the blocks that they are packed into in turn.

    A leaf of more rows than a block is spread over ``parts`` of them. One small row a leaf goes through one task.
    """
    leaves = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    by = Window.orderBy("node")
    before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.greatest(F.ceil(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / blocks_), F.lit(1))
    return settle(leaves.select((F.row_number().over(by) - 1).alias("leaf"), "node", "n", F.floor(before / share).cast("int").alias("pb"), F.ceil(F.col("n") / share).cast("int").alias("parts")))


def probe_join(queries: DataFrame, rows: DataFrame, k: int, query_id: str, point_id: str, vector: str = "vector", block_rows: int | None = None, budget: int | None = None, means: DataFrame | None = None) -> DataFrame:
    """(query, point, node, distance, rank), exact: the k nearest of a tree's rows for every query, ties by id.

    Blocks of queries meet blocks of whole leaves. Leaves are passed over for the queries whose k-th distance
    so far is under their distance to its centroid less its radius. With a budget, a query looks only into the leaves
    of the closest ``means`` (node, mean), in turn until they hold that many rows; these are then sent to every executor.
    """
    rows = rows.where(F.col(point_id).isNotNull() & F.col(vector).isNotNull())
    q, p, n_q, n_p = blocks.sides(queries, rows.select(point_id, vector, "node"), query_id, point_id, vector, block_rows)
    leaves = leaf_table(rows, n_p)
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int")
    p = p.join(small(leaves), "node").select("id", "v", "leaf", F.least(F.col("pb") + part, F.lit(n_p - 1)).alias("pb"))
    q = q.withColumn("qb", blocks.block_of("id", n_q))
    if budget is None:
        q, more = q.withColumn("leaf", F.lit(None).cast("int")), "leaf"
    else:
        q = _affordable(q, leaves.join(means, "node"), max(budget, k), n_p)
        p, more = p.withColumn("mark", F.encode(F.col("leaf").cast("string"), "utf-8")), "mark"

    def best(ids, x, others, y, own, theirs):
        leaf = theirs.astype(np.int64)
        order = np.argsort(leaf, kind="stable")
        others, y, leaf = others[order], y[order], leaf[order]
        held = np.unique(leaf)

        def allowed(some: slice) -> np.ndarray:
            first = np.array([int.from_bytes(b[:4], "little") for b in own[some]])
            bits = np.unpackbits(np.stack([np.frombuffer(b[4:], np.uint8) for b in own[some]]), axis=1)
            return np.take_along_axis(bits, held[None] - first[:, None], 1).astype(bool)

        for at, to, d in blocks.nearest(x, y, others, k, leaf=leaf, allowed=None if budget is None else allowed):
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(others[to]), pa.array(leaf[to].astype(np.int32)), pa.array(d)], names=["query", "point", "leaf", "distance"])

    pairs = blocks.meet(q, p, n_q, n_p, best, "query bigint, point bigint, leaf int, distance double", more)
    return _ranked(pairs, "point", k).join(small(leaves.select("leaf", "node")), "leaf", "left").select("query", "point", "node", "distance", "rank")


def _affordable(q: DataFrame, leaves: DataFrame, budget: int, n_p: int) -> DataFrame:
    """``q`` once for each block, with ``mark``: the block's first leaf and a bit for each leaf from there, set if the query looks into it."""
    table = leaves.orderBy("leaf").select("n", "pb", "parts", "mean").toArrow()
    n, pb, parts = (table[c].to_numpy() for c in ("n", "pb", "parts"))
    mean = np.asarray(table["mean"].combine_chunks().flatten(), np.float64).reshape(len(n), -1)
    last = np.minimum(pb + parts - 1, n_p - 1)
    ranges = [np.flatnonzero((pb <= b) & (last >= b)) for b in range(n_p)]
    shared = q.sparkSession.sparkContext.broadcast((n, mean, [(int(r[0]), int(r[-1]) + 1) if len(r) else (0, 0) for r in ranges]))

    def mark(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, spans = shared.value
        square = (mean * mean).sum(1)
        for whole in source:
            for i in range(0, whole.num_rows, step := max(1, (1 << 22) // max(1, len(n)))):
                batch = whole.slice(i, step)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
                order = np.argsort(square[None] - 2 * x @ mean.T, axis=1, kind="stable")
                held = np.cumsum(n[order], axis=1)
                wanted = np.zeros(order.shape, bool)
                np.put_along_axis(wanted, order, held - n[order] < budget, 1)
                for b, (first, end) in enumerate(spans):
                    bits = np.packbits(wanted[:, first:end], axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.full(len(x), b, np.int32)), pa.array([first.to_bytes(4, "little") + r.tobytes() for r in bits], pa.binary())], names=["id", "v", "qb", "pb", "mark"])

    kind = dict(q.dtypes)["v"]
    return q.select("id", "v", "qb").mapInArrow(mark, f"id bigint, v {kind}, qb int, pb int, mark binary")


def radius_join(queries: DataFrame, points: DataFrame, radius: float, query_id: str, point_id: str, vector: str = "vector", block_rows: int | None = None) -> DataFrame:
    """(query, point, distance) at distance at most ``radius``, exact, for both sides large, by pairs of blocks."""
    q, p, n_q, n_p = blocks.sides(queries, points.select(point_id, vector), query_id, point_id, vector, block_rows)

    def near(ids, x, others, y, own, theirs):
        for at, to, d in blocks.within(x, y, radius):
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(others[to]), pa.array(d)], names=["query", "point", "distance"])

    return blocks.meet(q.withColumn("qb", blocks.block_of("id", n_q)), p.withColumn("pb", blocks.block_of("id", n_p)), n_q, n_p, near, "query bigint, point bigint, distance double")


def search_join(queries: DataFrame, windows: DataFrame, top_k: int, query_id: str, doc: str, vector: str = "vector", block_rows: int | None = None) -> DataFrame:
    """(query, doc, distance, rank), exact: the ``top_k`` documents of every query by their best window, ties by document.

    A pair of blocks gives its ``top_k`` documents a query; a document among the first is so in the block of its best window.
    """
    q, p, n_q, n_p = blocks.sides(queries, windows.select(doc, vector), query_id, doc, vector, block_rows)

    def best(ids, x, others, y, own, theirs):
        for at, to, d in blocks.nearest(x, y, others, top_k, grouped=True):
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(others[to]), pa.array(d)], names=["query", "doc", "distance"])

    pairs = blocks.meet(q.withColumn("qb", blocks.block_of("id", n_q)), p.withColumn("pb", blocks.block_of("v", n_p)), n_q, n_p, best, "query bigint, doc bigint, distance double")
    return _ranked(pairs.groupBy("query", "doc").agg(F.min("distance").alias("distance")), "doc", top_k)
