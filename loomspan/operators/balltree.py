"""A ball tree over a table of vectors: build, bounded nearest search, pruning, growth.

A node holds the rows of one path of 0s and 1s. Its root is the row farthest from the
node's first row; rows no farther from the root than the median go to child 0, the others
to child 1. All large nodes of a level are split in one pass of partial aggregates, the
others down to their leaves in a task each; what is kept is the rows with their path and
the nodes (root, radius, rows; of a leaf also the mean of its rows and their spread around it). A search passes over leaves by their least possible distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators import blocks
from loomspan.operators.joins import small, squared_distance
from loomspan.session import settle

_NODE = ["path", "depth", "n", "root_id", "root", "radius", "leaf", "mean", "spread"]
_GROWN = "id bigint, vector array<double>, path string, depth int, n bigint, root_id bigint, root array<double>, radius double, leaf boolean, mean array<double>, spread double"


class BallTree:
    """``rows`` (id, vector, path) and ``nodes`` (path, depth, n, root_id, root, radius) of every node, leaves included."""

    def __init__(self, df: DataFrame, id_col: str, vector: str, leaf_rows: int = 1024, max_depth: int = 30):
        self.leaf_rows, self.max_depth = leaf_rows, max_depth
        rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("id is not null and vector is not null")
        self.rows, self.nodes = self._split(rows.withColumn("path", F.lit("")))

    def _split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        todo, done, nodes = settle(rows), None, None
        wide = todo.agg(F.max(F.size("vector"))).first()[0] or 1
        grown = rows.sparkSession.createDataFrame([], _GROWN)
        for depth in range(self.max_depth + 1):
            # nodes that a task can hold are split to their leaves there
            little = settle(todo.groupBy("path").count().where(F.col("count") <= blocks.BLOCK_BYTES // (16 * wide)).select("path"))
            if not little.isEmpty():
                grown = grown.union(settle(todo.join(small(little), "path").groupBy("path").applyInArrow(self._grow(depth), _GROWN)))
                todo = todo.join(small(little), "path", "left_anti")
            if todo.isEmpty():
                break
            first = todo.groupBy("path").agg(F.min_by("vector", "id").alias("first"), F.count(F.lit(1)).alias("n"))
            far = todo.join(small(first), "path").withColumn("d", squared_distance("vector", "first"))
            # the farthest row, ties by the smaller id
            root = far.groupBy("path").agg(F.max(F.struct("d", (-F.col("id")).alias("minus"), "vector")).alias("r"), F.first("n").alias("n")).select("path", "n", (-F.col("r.minus")).alias("root_id"), F.col("r.vector").alias("root"))
            near = settle(todo.join(small(root), "path").withColumn("d", squared_distance("vector", "root")))
            cut = near.groupBy("path").agg(F.max("d").alias("most"), F.min("d").alias("least"), F.percentile_approx("d", 0.5, 10_000).alias("median"))
            level = settle(root.join(cut, "path").withColumn("open", (F.col("n") > self.leaf_rows) & (F.col("least") < F.col("most")) & F.lit(depth < self.max_depth)))
            known = level.select("path", F.lit(depth).alias("depth"), "n", "root_id", "root", F.sqrt("most").alias("radius"), (~F.col("open")).alias("leaf"))
            nodes = known if nodes is None else nodes.union(known)
            placed = near.select("id", "vector", "path", "d").join(small(level.select("path", "open", "median", "most")), "path")
            closed = placed.where("not open").select("id", "vector", "path")
            done = closed if done is None else done.union(closed)
            # equal distances could all be the median: the farthest row always goes to child 1
            side = F.when((F.col("d") <= F.col("median")) & (F.col("d") < F.col("most")), "0").otherwise("1")
            todo = settle(placed.where("open").select("id", "vector", F.concat("path", side).alias("path")))
        inside = grown.where("depth is null").select("id", "vector", "path")
        known = grown.where("depth is not null").select(*_NODE)
        if done is None:
            return inside, known
        done = settle(done)
        # a leaf's rows lie closer around their mean than around its root: searches use that ball
        each = done.select("path", F.posexplode("vector").alias("k", "x")).groupBy("path", "k").agg(F.avg("x").alias("x"))
        mean = each.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s.x).alias("mean"))
        spread = done.join(small(mean), "path").groupBy("path").agg(F.sqrt(F.max(squared_distance("vector", "mean"))).alias("spread"), F.first("mean").alias("mean"))
        return done.union(inside), settle(nodes.join(small(spread), "path", "left").select(*_NODE).union(known))

    def _grow(self, depth: int):
        """Splits the rows of one node at ``depth`` down to the leaves: rows (id, vector, path) and nodes (those with a depth) in one table."""
        leaf_rows, max_depth = self.leaf_rows, self.max_depth

        def grow(part: pa.Table) -> pa.Table:
            part = part.sort_by("id")
            ids, x = part["id"].to_numpy(), part["vector"].combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1)
            path, nodes = np.empty(len(ids), object), []
            open_ = [(np.arange(len(ids)), part["path"][0].as_py(), depth)]
            while open_:
                own, name, level = open_.pop()
                v = x[own]
                root = own[((v - v[0]) ** 2).sum(1).argmax()]  # ids ascend: ties by the smaller one
                d = ((v - x[root]) ** 2).sum(1)
                most = d.max()
                leaf = not (len(own) > leaf_rows and d.min() < most and level < max_depth)
                mean = v.mean(0) if leaf else None
                nodes.append((name, level, len(own), ids[root], x[root].tolist(), float(np.sqrt(most)), leaf, mean.tolist() if leaf else None, float(np.sqrt(((v - mean) ** 2).sum(1).max())) if leaf else None))
                if leaf:
                    path[own] = name
                else:
                    half = (len(own) + 1) // 2 - 1
                    # equal distances could all be the median: the farthest row always goes to child 1
                    near = (d <= np.partition(d, half)[half]) & (d < most)
                    open_ += [(own[near], name + "0", level + 1), (own[~near], name + "1", level + 1)]
            rows = pa.table({"id": part["id"], "vector": part["vector"], "path": pa.array(path, pa.string())})
            made = pa.table(dict(zip(_NODE, map(list, zip(*nodes)))))
            kinds = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float64())), ("path", pa.string()), ("depth", pa.int32()), ("n", pa.int64()), ("root_id", pa.int64()), ("root", pa.list_(pa.float64())), ("radius", pa.float64()), ("leaf", pa.bool_()), ("mean", pa.list_(pa.float64())), ("spread", pa.float64())])
            fit = lambda t: pa.table({f.name: t[f.name].cast(f.type) if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in kinds})
            return pa.concat_tables([fit(rows), fit(made)])

        return grow

    def nearest(self, queries: DataFrame, k: int, query_id: str, vector: str, budget: int | None = None) -> DataFrame:
        """(query, point, distance, rank): the k nearest rows of each query, ties by id.

        With a budget a query looks into the leaves of the closest means until they hold that many
        rows; without one, into all leaves that can hold one of its k nearest.
        """
        from loomspan.operators.index import probe_join

        rows = self.rows.select("id", "vector", F.col("path").alias("node"))
        asked = queries.select(F.col(query_id).alias("query"), F.col(vector).cast("array<double>").alias("vector"))
        means = self.nodes.where("leaf").select(F.col("path").alias("node"), "mean")
        return probe_join(asked, rows, k, "query", "id", "vector", budget=budget, means=means).select("query", "point", "distance", "rank")

    def add(self, df: DataFrame, id_col: str, vector: str) -> "BallTree":
        """A tree with more rows; it is built anew, as leaves and radii change."""
        more = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("id is not null and vector is not null")
        grown = BallTree.__new__(BallTree)
        grown.leaf_rows, grown.max_depth = self.leaf_rows, self.max_depth
        grown.rows, grown.nodes = grown._split(self.rows.select("id", "vector").union(more).withColumn("path", F.lit("")))
        return grown

    def ordered(self) -> DataFrame:
        """The rows by path and id, so that each leaf's rows lie together."""
        return self.rows.orderBy("path", "id")

    def prune(self, levels: int, method: str = "root", min_distance: float = 0.0) -> DataFrame:
        """(id, path): a few rows that stand for the others.

        ``root``: the roots of the nodes at depth ``levels - 1`` and of leaves above it; ``top``: the roots of all nodes
        down to there; ``inner`` and ``outer``: of each such node the row nearest to, or farthest from, its root
        (the root itself left out); ``distance``: roots of ``top`` that lie ``min_distance`` or more from all those kept above them.
        """
        deepest = self.nodes.where((F.col("depth") == levels - 1) | (F.col("leaf") & (F.col("depth") < levels)))
        if method == "root":
            return deepest.groupBy(F.col("root_id").alias("id")).agg(F.min("path").alias("path"))
        top = self.nodes.where(F.col("depth") < levels)
        if method == "top":
            return top.groupBy(F.col("root_id").alias("id")).agg(F.min("path").alias("path"))
        if method in ("inner", "outer"):
            own = self.rows.join(small(deepest.select(F.col("path").alias("node"), "root", "root_id")), F.col("path").startswith(F.col("node"))).where("id <> root_id")
            d = squared_distance("vector", "root")
            pick = F.min(F.struct(d, "id")) if method == "inner" else F.min(F.struct(-d, "id"))
            return own.groupBy("node").agg(pick.alias("m")).select("m.id", F.col("node").alias("path"))
        if method == "distance":
            roots = top.groupBy(F.col("root_id").alias("id")).agg(F.min(F.struct(F.length("path"), "path")).alias("p"), F.first("root").alias("v")).select("id", "p.path", "v").orderBy(F.length("path"), "path").limit(1 << min(levels, 16)).collect()  # at most 2 ** levels
            kept: list = []
            for r in roots:
                if all(np.linalg.norm(np.subtract(r.v, x.v)) >= min_distance for x in kept):
                    kept.append(r)
            return self.rows.sparkSession.createDataFrame([(r.id, r.path) for r in kept], "id bigint, path string")
        raise ValueError(f"no method {method!r}")
