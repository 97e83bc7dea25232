"""All pairs of two tables of vectors, block by block.

Every block of queries meets every block of points in a task of its own. Blocks are as
large as a fixed number of bytes allows, so that either side is shuffled a few times
only. Within a task some hundred queries at a time are multiplied with a thousand
points in single precision; what comes within the product's error of a bound is measured
again by differences in double precision, so that results are those of the plain formula.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.errors import BadData

#: Bytes (at eight a number) of the vectors of a block, one side of a pair that a task holds.
BLOCK_BYTES = 64 << 20
#: Queries and points of one matrix product (which stays in a core's cache), and pairs that are measured exactly at a time.
QUERIES_AT_ONCE, POINTS_AT_ONCE, EXACT_AT_ONCE = 256, 1024, 1 << 14
#: Found pairs that are handed on together.
PAIRS_AT_ONCE = 1 << 15
#: Rows that are worth a block of their own while there are cores without work.
LEAST_ROWS = 512


def sides(queries: DataFrame, points: DataFrame, query_id: str, point_id: str, vector: str, block_rows: int | None = None) -> tuple[DataFrame, DataFrame, int, int]:
    """(queries (id, v), points (id, v and their other columns), blocks of queries, blocks of points).

    Rows without id or vector are left out. Small tables are split beyond what memory
    asks for, until each core has some pairs of blocks.
    """
    kind = "array<float>" if dict(queries.dtypes)[vector] == dict(points.dtypes)[vector] == "array<float>" else "array<double>"
    one = lambda df, key, *more: df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast(kind).alias("v"), *more).where("id is not null and v is not null")
    q, p = one(queries, query_id), one(points, point_id, *[c for c in points.columns if c not in (point_id, vector)])
    (n_q, wide_q), (n_p, wide_p) = (d.agg(F.count(F.lit(1)), F.max(F.size("v"))).first() for d in (q, p))
    most = block_rows or max(1, BLOCK_BYTES // (8 * max(wide_q or 1, wide_p or 1)))
    a, b = max(1, -(-n_q // most)), max(1, -(-n_p // most))
    while a * b < 3 * q.sparkSession.sparkContext.defaultParallelism and max(n_q / a, n_p / b) > LEAST_ROWS:
        a, b = (a + 1, b) if n_q / a >= n_p / b else (a, b + 1)
    return q, p, a, b


def block_of(column: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def _matrix(column: pa.Array) -> np.ndarray:
    if pc.min_max(wide := pc.list_value_length(column))["min"] != pc.max(wide):
        raise BadData("vectors of several lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def meet(q: DataFrame, p: DataFrame, n_q: int, n_p: int, compare: Callable[..., Iterator[pa.RecordBatch]], schema: str, more: str | None = None) -> DataFrame:
    """The batches (of ``schema``) that ``compare(ids, x, ids, y, own, theirs)`` gives for every pair of blocks.

    ``q`` has (id, v, qb) and ``p`` (id, v, pb); ``own`` and ``theirs`` are their columns ``more``. Queries with a
    ``pb`` meet that block only.
    """
    extra = [F.col(more)] if more else []
    every = lambda df, name, n: df if name in df.columns else df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cell = (F.col("qb") * n_p + F.col("pb")).cast("int").alias("cell")
    both = every(q, "pb", n_p).select(cell, F.lit(True).alias("asks"), "id", "v", *extra).union(every(p, "qb", n_q).select(cell, F.lit(False), "id", "v", *extra))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple]] = {True: [], False: []}
        for batch in source:
            for asks, mine in held.items():
                some = batch.filter(batch.column(1) if asks else pc.invert(batch.column(1)))
                if some.num_rows:
                    mine.append((some.column(2).to_numpy(), _matrix(some.column(3)), some.column(4).to_numpy(zero_copy_only=False) if more else np.empty(0)))
        if held[True] and held[False]:
            (ids, x, own), (others, y, theirs) = ([np.concatenate(c) for c in zip(*held.pop(asks))] for asks in (True, False))
            if x.shape[1] != y.shape[1]:
                raise BadData("vectors of several lengths")
            yield from compare(ids, x, others, y, own, theirs)

    return both.repartitionById(n_q * n_p, F.col("cell")).mapInArrow(run, schema)


def exact(x: np.ndarray, y: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Distances of the pairs (x[at], y[to]), by differences."""
    out = np.empty(len(at))
    for i in range(0, len(at), EXACT_AT_ONCE):
        some = slice(i, i + EXACT_AT_ONCE)
        out[some] = np.sqrt(((x[at[some]].astype(float) - y[to[some]].astype(float)) ** 2).sum(1))
    return out


class Rough:
    """Squared distances to a block of points less the query's own squared length, by matrix products.

    All is taken around the points' mean. Two of these numbers of one query are in the wrong order by
    no more than its ``slack``. Where single precision can't tell enough pairs apart, double is used.
    """

    def __init__(self, y: np.ndarray):
        self.y, self.centre = y, y.mean(0, dtype=float)
        self.top = max(np.sqrt(((y[i : i + POINTS_AT_ONCE] - self.centre) ** 2).sum(1).max()) for i in range(0, len(y), POINTS_AT_ONCE))
        self._make(np.float32 if 1e-15 < self.top < 1e15 else np.float64)

    def _make(self, kind: type) -> None:
        self.kind = kind
        self.table = np.empty((self.y.shape[1] + 1, len(self.y)), kind)
        for i in range(0, len(self.y), POINTS_AT_ONCE):
            own = self.y[i : i + POINTS_AT_ONCE] - self.centre
            self.table[:-1, i : i + len(own)], self.table[-1, i : i + len(own)] = own.T, (own * own).sum(1)

    def ask(self, x: np.ndarray) -> None:
        """The queries that ``within`` and ``chunk`` are about."""
        own = x.astype(float) - self.centre
        self.square = (own * own).sum(1)
        if self.kind is np.float32 and len(own) and self.square.max() > 1e30:
            self._make(np.float64)
        self.left = np.hstack([-2 * own, np.ones((len(own), 1))]).astype(self.kind)
        size = self.top * (2 * np.sqrt(self.square) + self.top)
        self.slack = 4 * (x.shape[1] + 8) * np.finfo(self.kind).eps * size + np.finfo(self.kind).tiny * 64

    def limit(self, bound: np.ndarray) -> np.ndarray:
        """What a number has to reach for a squared distance within ``bound``."""
        return (bound - self.square + self.slack).astype(self.kind)

    def finer(self, n: int, of: int) -> bool:
        """Goes over to double precision if ``n`` of so many numbers are too close to the limit."""
        if self.kind is np.float32 and n > 1 << 12 and n > of // 16:
            self._make(np.float64)
            return True
        return False


def _spread(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flat = mask.reshape(-1)
    if flat.size % 8:
        found = np.flatnonzero(flat)
    else:  # most are False: eight are looked at together
        eights = np.flatnonzero(flat.view(np.uint64))
        found = (eights[:, None] * 8 + np.arange(8))[flat.reshape(-1, 8)[eights]]
    return np.divmod(found, mask.shape[1])


class Best:
    """The k nearest so far of some queries: points, or groups of points (``code``) by their nearest point; ties by code."""

    def __init__(self, n: int, k: int, code: np.ndarray, grouped: bool):
        self.k, self.code, self.grouped = k, code, grouped
        self.distance, self.point = np.full((n, k), np.inf), np.full((n, k), -1)

    def add(self, row: np.ndarray, point: np.ndarray, distance: np.ndarray) -> None:
        rows = np.unique(row)
        r = np.concatenate([row, np.repeat(rows, self.k)])
        p = np.concatenate([point, self.point[rows].reshape(-1)])
        d = np.concatenate([distance, self.distance[rows].reshape(-1)])
        r, p, d = (a[p >= 0] for a in (r, p, d))
        if self.grouped:
            order = np.lexsort((d, self.code[p], r))
            r, p, d = r[order], p[order], d[order]
            first = np.concatenate([[True], (r[1:] != r[:-1]) | (self.code[p[1:]] != self.code[p[:-1]])])
            r, p, d = r[first], p[first], d[first]
        order = np.lexsort((self.code[p], d, r))
        r, p, d = r[order], p[order], d[order]
        start = np.searchsorted(r, r)
        rank = np.arange(len(r)) - start
        r, p, d, rank = (a[rank < self.k] for a in (r, p, d, rank))
        self.distance[rows], self.point[rows] = np.inf, -1
        self.distance[r, rank], self.point[r, rank] = d, p


def _first(g: np.ndarray, k: int, slack: np.ndarray, code: np.ndarray, grouped: bool) -> np.ndarray:
    """Which numbers can belong to the k nearest of a chunk, without a bound from before."""
    if not grouped:
        kth = np.partition(g, min(k, g.shape[1]) - 1, axis=1)[:, min(k, g.shape[1]) - 1]
        return g <= (kth + slack)[:, None] if g.shape[1] > k else np.ones(g.shape, bool)
    order = np.argsort(code, kind="stable")
    start = np.flatnonzero(np.diff(code[order], prepend=-1))
    low = np.minimum.reduceat(g[:, order], start, axis=1)
    most = np.partition(low, k - 1, axis=1)[:, [k - 1]] if low.shape[1] >= k else np.inf
    limit = np.where(low <= most + slack[:, None], low + slack[:, None], -np.inf)
    out = np.empty(g.shape, bool)
    out[:, order] = g[:, order] <= np.repeat(limit, np.diff(start, append=len(code)), axis=1)
    return out


def nearest(x: np.ndarray, y: np.ndarray, key: np.ndarray, k: int, grouped: bool = False, leaf: np.ndarray | None = None, allowed: Callable[[slice], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, point, distance) of the k nearest points of every query, or of the k nearest groups of equal ``key``; ties by key.

    With ``leaf`` (a number for each point, ascending) points of one leaf lie in a ball around their mean, and those of
    balls beyond the k-th distance so far are passed over. ``allowed(queries)`` tells the leaves that queries may look into.
    """
    rough, found = Rough(y), []
    code = np.unique(key, return_inverse=True)[1]
    edges = [0, *range(POINTS_AT_ONCE, len(y), POINTS_AT_ONCE), len(y)]
    if leaf is not None:
        start = np.flatnonzero(np.diff(leaf, prepend=leaf[0] - 1))
        size = np.diff(start, append=len(leaf))
        mean = np.add.reduceat(y.astype(float), start, axis=0) / size[:, None]
        radius = np.concatenate([exact(y, mean, np.arange(a, min(a + EXACT_AT_ONCE, len(y))), np.repeat(np.arange(len(start)), size)[a : a + EXACT_AT_ONCE]) for a in range(0, len(y), EXACT_AT_ONCE)])
        radius = np.maximum.reduceat(radius, start)
        # whole leaves, a thousand points together; a leaf of more is a chunk of its own
        edges, cuts = [0], [0]
        for j, n in enumerate(size.tolist()):
            if start[j] + n - edges[-1] > POINTS_AT_ONCE and start[j] > edges[-1]:
                edges.append(int(start[j]))
                cuts.append(j)
        edges, cuts = [*edges, len(y)], [*cuts, len(start)]
    for i in range(0, len(x), QUERIES_AT_ONCE):
        own = x[i : i + QUERIES_AT_ONCE]
        best = Best(len(own), k, code, grouped)
        rough.ask(own)
        if leaf is not None:
            wide = own.astype(float)
            ends = (wide * wide).sum(1)[:, None] + (mean * mean).sum(1)
            gap = ends - 2 * wide @ mean.T - 1e-14 * (x.shape[1] + 8) * ends
            low = np.sqrt(np.maximum(gap, 0)) - radius * (1 + 1e-9)
            if allowed is not None:
                may = allowed(slice(i, i + len(own)))
                low[~may] = np.inf
        for j, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            rows = np.arange(len(own))
            if leaf is not None:
                rows = np.flatnonzero((low[:, cuts[j] : cuts[j + 1]] <= best.distance[:, [k - 1]]).any(1) & np.isfinite(low[:, cuts[j] : cuts[j + 1]]).any(1))
                if not len(rows):
                    continue
            for c in range(a, b, 2 * POINTS_AT_ONCE):  # one turn but for large leaves
                d = min(c + 2 * POINTS_AT_ONCE, b)
                while True:
                    g = rough.left[rows] @ rough.table[:, c:d]
                    if leaf is not None and allowed is not None:
                        g[~may[np.ix_(rows, np.searchsorted(start, np.arange(c, d), side="right") - 1)]] = np.inf
                    bound = best.distance[rows, k - 1]
                    free = ~np.isfinite(bound)
                    with np.errstate(invalid="ignore"):
                        mask = g <= rough.limit(best.distance[:, k - 1] ** 2)[rows, None] if not free.all() else np.zeros(g.shape, bool)
                    if free.any():
                        mask[free] = _first(g[free], k, rough.slack[rows[free]].astype(g.dtype), code[c:d], grouped) & np.isfinite(g[free])
                    at, to = _spread(mask)
                    if not rough.finer(len(at), mask.size):
                        break
                    rough.ask(own)
                if grouped and len(at):  # only a group's nearest
                    value, order = g[at, to], np.lexsort((g[at, to], code[c + to], at))
                    head = np.flatnonzero(np.concatenate([[True], (np.diff(at[order]) != 0) | (np.diff(code[c + to[order]]) != 0)]))
                    least = np.empty(len(at))
                    least[order] = np.repeat(value[order][head], np.diff(head, append=len(order)))
                    keep = value <= least + rough.slack[rows[at]]
                    at, to = at[keep], to[keep]
                if len(at):
                    best.add(rows[at], c + to, exact(own, y, rows[at], c + to))
        at, rank = np.nonzero(best.point >= 0)
        found.append((i + at, best.point[at, rank], best.distance[at, rank]))
        if len(found) * len(at) >= PAIRS_AT_ONCE:
            yield tuple(np.concatenate(f) for f in zip(*found))
            found.clear()
    if found:
        yield tuple(np.concatenate(f) for f in zip(*found))


def within(x: np.ndarray, y: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, point, distance) of all pairs at distance at most ``radius``."""
    rough, found, held = Rough(y), [], 0
    for i in range(0, len(x), QUERIES_AT_ONCE):
        own = x[i : i + QUERIES_AT_ONCE]
        rough.ask(own)
        for a in range(0, len(y), POINTS_AT_ONCE):
            while True:
                g = rough.left @ rough.table[:, a : a + POINTS_AT_ONCE]
                at, to = _spread(g <= rough.limit(np.full(len(own), radius * radius))[:, None])
                if not rough.finer(len(at), g.size):
                    break
                rough.ask(own)
            for c in range(0, len(at), EXACT_AT_ONCE):
                r, p = at[c : c + EXACT_AT_ONCE], a + to[c : c + EXACT_AT_ONCE]
                d = exact(own, y, r, p)
                found.append((i + r[d <= radius], p[d <= radius], d[d <= radius]))
                held += len(found[-1][0])
            if held >= PAIRS_AT_ONCE:
                yield tuple(np.concatenate(f) for f in zip(*found))
                found, held = [], 0
    if found:
        yield tuple(np.concatenate(f) for f in zip(*found))
