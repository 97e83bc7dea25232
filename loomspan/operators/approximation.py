"""Interpolation over scattered points (the containing Delaunay simplex) and regression over sets.

Both are fitted on the driver on rows of a stated bound and applied to a table of any size as Arrow maps.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.errors import BadData


def nearest_in_hull(points: np.ndarray, q: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Weights (>= 0, sum 1) of the points whose mean is nearest to q: an active-set search of least squared distance."""
    n = len(points)
    w = np.zeros(n)
    w[int(((points - q) ** 2).sum(1).argmin())] = 1.0
    for _ in range(rounds):
        at = w @ points
        gain = (points - at) @ (q - at)
        k = int(gain.argmax())
        if gain[k] <= 1e-12 * max(1.0, np.abs(points).max() ** 2):
            break
        active = np.flatnonzero((w > 0) | (np.arange(n) == k))
        while True:
            p = points[active]
            a = np.block([[p @ p.T, np.ones((len(active), 1))], [np.ones((1, len(active))), np.zeros((1, 1))]])
            new = np.linalg.lstsq(a, np.append(p @ q, 1.0), rcond=None)[0][:-1]
            if (new >= -1e-12).all():
                w = np.zeros(n)
                w[active] = np.maximum(new, 0)
                break
            old = w[active]
            falls = new < -1e-12
            step = (old[falls] / (old[falls] - new[falls])).min()
            mixed = old + step * (new - old)
            w = np.zeros(n)
            w[active] = np.where(mixed > 1e-12, mixed, 0)
            active = active[mixed > 1e-12]
    return w / w.sum()


class Delaunay:
    """Piecewise linear interpolation on the Delaunay triangulation of up to ``most`` points in any dimension.

    The simplex that holds q is the basis of a small linear program: of all convex
    combinations of points that give q, the one with the least mean squared length. A q
    outside the hull takes the weights of the nearest place in it. Equal points count once.
    Points on one empty sphere are told apart by lengths that are changed by a billionth, so
    that the triangulation is one and the same for every q. Simplices and hull faces that a q was
    found in are kept (up to ``KEPT`` of each); other places are tried in them, many at once.
    """

    KEPT = 1 << 14

    def __init__(self, points: np.ndarray, most: int = 100_000):
        points = np.asarray(points, float)
        if len(points) > most or not len(points):
            raise BadData(f"{len(points)} points; 1 to {most} can be held")
        self.points, first = np.unique(points, axis=0, return_index=True)
        self.first = first
        self.centre = self.points.mean(0)
        self.scale = max(np.abs(self.points - self.centre).max(), 1e-300)
        z = (self.points - self.centre) / self.scale
        self.z, self.lift = z, (z**2).sum(1) + 1e-9 * np.random.default_rng(0).random(len(z))
        self.cells: dict[tuple, np.ndarray] = {}
        self.faces: dict[tuple, np.ndarray] = {}

    def _program(self, q: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(points, weights) of the optimal basis by the revised simplex method, from a feasible basis of artificial ones."""
        d, n = self.z.shape[1], len(self.z)
        columns = np.vstack([self.z.T, np.ones(n)])
        right = np.append(q, 1.0)
        sign = np.where(right < 0, -1.0, 1.0)
        basis = list(range(n, n + d + 1))
        everything = np.hstack([columns, np.diag(sign)])
        for cost in (np.append(np.zeros(n), np.ones(d + 1)), np.append(self.lift, np.full(d + 1, 1e6))):
            for turn in range(50 * (d + 1) + 20 * n):
                b = everything[:, basis]
                x = np.linalg.solve(b, right)
                price = np.linalg.solve(b.T, cost[basis])
                reduced = cost[:n] - price @ columns
                reduced[[k for k in basis if k < n]] = 0
                low = np.flatnonzero(reduced < -1e-11)
                if not len(low):
                    break
                enter = int(low[reduced[low].argmin()] if turn < 20 * (d + 2) else low[0])  # the least index breaks cycles
                way = np.linalg.solve(b, everything[:, enter])
                up = np.flatnonzero(way > 1e-12)
                if not len(up):
                    break
                ratio = np.maximum(x[up], 0) / way[up]
                tied = up[ratio <= ratio.min() + 1e-14]
                leave = max(tied, key=lambda k: (basis[k] >= n, -basis[k]))
                basis[leave] = enter
        x = np.linalg.solve(everything[:, basis], right)
        real = [k for k, j in enumerate(basis) if j < n]
        return np.array([basis[k] for k in real]), np.maximum(x[real], 0)

    def weights(self, q: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        """(indices of the points given, weights) of a place; at most d + 1 of them, sum 1."""
        q = (np.asarray(q, float) - self.centre) / self.scale
        w = nearest_in_hull(self.z, q)
        at = w @ self.z
        index, weight = self._program(at, w)
        if not len(index) or np.abs(weight @ self.z[index] - at).max() > 1e-6 or abs(weight.sum() - 1) > 1e-6:
            index, weight = np.flatnonzero(w), w[np.flatnonzero(w)]
        keep = weight > 1e-12
        return self.first[index[keep]], weight[keep] / weight[keep].sum()

    @staticmethod
    def _inside(inverse: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether in the simplex, weights of its points) of places; a flat one is as exact in length, not in weight."""
        weight = np.hstack([z, np.ones((len(z), 1))]) @ inverse.T
        return (weight >= -np.maximum(1e-12, 1e-13 * np.abs(inverse).sum(1))).all(1), np.maximum(weight, 0)

    def _before(self, face: tuple, inverse: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether the nearest place in the hull is on the face, that place) of places."""
        p = self.z[list(face)]
        weight = (np.hstack([z @ p.T, np.ones((len(z), 1))]) @ inverse.T)[:, :-1]
        at = weight @ p
        gap = z - at
        most = (gap @ self.z.T).max(1) - (gap * at).sum(1)
        return (weight >= -1e-12).all(1) & (most <= 1e-12 * max(1.0, np.abs(self.z).max() ** 2)), at

    def _keep(self, known: dict, name: tuple, matrix: np.ndarray) -> np.ndarray | None:
        if np.linalg.cond(matrix) > 1e10:
            return None
        if len(known) >= self.KEPT:  # only spares work
            del known[next(iter(known))]
        known[name] = np.linalg.inv(matrix)
        return known[name]

    def many(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices, weights), d + 1 of each a row, of many places; weights of 0 fill up."""
        q, back = np.unique(np.asarray(q, float), axis=0, return_inverse=True)
        d = self.z.shape[1]
        at = (q - self.centre) / self.scale
        index, weight = np.zeros((len(q), d + 1), int), np.zeros((len(q), d + 1))
        todo, hull = np.arange(len(q)), np.zeros(len(q), bool)  # hull: known to be a place in the hull

        def take(cell: tuple, inverse: np.ndarray) -> None:
            nonlocal todo
            good, w = self._inside(inverse, at[todo])
            index[todo[good]], weight[todo[good]] = cell, w[good]
            todo = todo[~good]

        def move(face: tuple, inverse: np.ndarray) -> None:
            some = todo[~hull[todo]]
            good, place = self._before(face, inverse, at[some])
            at[some[good]], hull[some[good]] = place[good], True

        def again() -> None:
            for known in list(self.cells.items()):
                if len(todo):
                    take(*known)

        again()
        for known in list(self.faces.items()):
            if len(todo):
                move(*known)
        if hull.any():
            again()
        while len(todo):
            one = todo[0]
            if not hull[one]:
                w = nearest_in_hull(self.z, at[one])
                face = tuple(np.flatnonzero(w).tolist())
                place = w @ self.z
                if np.abs(place - at[one]).max() > 1e-9:
                    p = self.z[list(face)]
                    found = self._keep(self.faces, face, np.block([[p @ p.T, np.ones((len(p), 1))], [np.ones((1, len(p))), np.zeros((1, 1))]]))
                    if found is not None:
                        move(face, found)
                at[one], hull[one] = place, True
                again()  # places that have moved may be in simplices of before
                if not len(todo) or todo[0] != one:
                    continue
            for nudge in (0, 1e-9, 1e-7):  # on the hull's faces a basis is full only from within
                cell, _ = self._program(at[one] * (1 - nudge), None)
                if len(cell) == d + 1 and (name := tuple(cell.tolist())) not in self.cells:
                    found = self._keep(self.cells, name, np.vstack([self.z[cell].T, np.ones(d + 1)]))
                    if found is not None:
                        take(name, found)
                if not len(todo) or todo[0] != one:
                    break
            else:
                own, w = self.weights(at[one] * self.scale + self.centre)
                for k, j in enumerate(own[: d + 1]):
                    index[one, k], weight[one, k] = int(np.flatnonzero(self.first == j)[0]), w[k]
                todo = todo[1:]
        weight = np.where(weight > 1e-12, weight, 0)
        return self.first[index][back], (weight / weight.sum(1, keepdims=True))[back]

    def predict(self, df: DataFrame, values: np.ndarray, vector: str, name: str = "predicted") -> DataFrame:
        """Adds the interpolated value (array<double>) of each row's vector; vectors that are null or have a part that is no finite number have none."""
        values = np.asarray(values, float).reshape(len(values), -1)
        model = df.sparkSession.sparkContext.broadcast((self, values))

        @F.pandas_udf("array<double>")
        def interpolate(places: pd.Series) -> pd.Series:
            own, known = model.value
            out = np.empty(len(places), object)
            rows = [k for k, q in enumerate(places) if q is not None and np.isfinite(np.asarray(q, float)).all()]
            if rows:
                index, weight = own.many(np.stack([np.asarray(places.iloc[k], float) for k in rows]))
                out[rows] = [r.tolist() for r in np.einsum("rk,rkv->rv", weight, known[index])]
            return pd.Series(out)

        return df.withColumn(name, interpolate(F.col(vector)))


class SetRegressor:
    """A regression of rows, each with a number vector and a set of members: y = f(x, mean of g(member)).

    f and g are layers of ramps max(0, v), trained together by gradients with adaptive
    steps on at most ``fit_rows`` rows. Text categories are a sum of learned vectors, by
    the ``1``-based ids of ``categories``; 0, an unknown one, adds nothing. A target that is text is
    fitted as a simplex vertex and predicted as the nearest one.
    """

    def __init__(self, width: int = 32, set_width: int = 16, steps: int = 1500, seed: int = 0, fit_rows: int = 20_000, category_width: int = 4):
        self.width, self.set_width, self.steps, self.seed, self.fit_rows, self.category_width = width, set_width, steps, seed, fit_rows, category_width
        self.weights: dict[str, np.ndarray] = {}
        self.names: list[str] | None = None
        self.errors: list[float] = []

    def fit(self, x: np.ndarray, y: Sequence, sets: Sequence[np.ndarray] | None = None, categories: np.ndarray | None = None, weights: np.ndarray | None = None, callback=None) -> "SetRegressor":
        rng = np.random.default_rng(self.seed)
        x = np.asarray(x, float)
        x = x.reshape(len(x), -1)
        if len(x) > self.fit_rows:
            pick = np.sort(rng.choice(len(x), self.fit_rows, replace=False))
            x, y = x[pick], [y[i] for i in pick]
            sets = [sets[i] for i in pick] if sets is not None else None
            categories = categories[pick] if categories is not None else None
            weights = weights[pick] if weights is not None else None
        if any(isinstance(v, str) for v in y):
            from loomspan.operators.statistics import simplex

            self.names = sorted(set(y))
            self.vertices = simplex(len(self.names))
            y = self.vertices[[self.names.index(v) for v in y]]
        y = np.asarray(y, float).reshape(len(x), -1)
        shift = lambda a: (np.nanmean(a, 0) if len(a) else np.zeros(a.shape[1]), np.where((s := np.nanstd(a, 0)) > 0, s, 1) if len(a) else np.ones(a.shape[1]))
        flat, owner = self._flat(sets, len(x))
        n_category = int(categories.max(initial=0)) if categories is not None else 0
        w = {"x_mean": shift(x)[0], "x_scale": shift(x)[1], "y_mean": shift(y)[0], "y_scale": shift(y)[1], "s_mean": shift(flat)[0], "s_scale": shift(flat)[1]}
        extra = self.set_width * (sets is not None) + self.category_width * (categories is not None)
        layer = lambda a, b: rng.normal(size=(a, b)) * np.sqrt(2 / max(a, 1))
        train = {"a": layer(flat.shape[1], self.set_width), "ab": rng.uniform(-1, 1, self.set_width), "c": np.vstack([np.zeros(self.category_width), rng.normal(size=(n_category, self.category_width))]), "w1": layer(x.shape[1] + extra, self.width), "b1": rng.uniform(-1, 1, self.width), "w2": layer(self.width, self.width), "b2": np.zeros(self.width), "o": np.zeros((self.width, y.shape[1])), "ob": np.zeros(y.shape[1])}
        w |= train
        target = (y - w["y_mean"]) / w["y_scale"]
        share = np.ones(len(x)) if weights is None else np.asarray(weights, float)
        share = (share / share.sum())[:, None]
        first, second = ({k: np.zeros_like(v) for k, v in train.items()} for _ in range(2))
        for step in range(1, self.steps + 1):
            made, keep = self._forward(w, x, flat, owner, categories)
            gap = made - target
            self.errors.append(float((share * gap**2).sum()))
            grads = self._backward(w, 2 * share * gap, keep)
            rate = 0.01 * 0.5 * (1 + np.cos(np.pi * step / self.steps)) + 1e-5
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g**2 - second[k])
                w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            w["c"][0] = 0
            if callback is not None:
                callback(step, self.errors[-1])
        self.weights = w
        return self

    @staticmethod
    def _flat(sets: Sequence[np.ndarray] | None, n: int) -> tuple[np.ndarray, np.ndarray]:
        if sets is None:
            return np.zeros((0, 0)), np.zeros(0, int)
        parts = [np.asarray(s, float).reshape(len(s), -1) if len(s) else np.zeros((0, 0)) for s in sets]
        wide = max((p.shape[1] for p in parts if len(p)), default=0)
        return np.vstack([p if len(p) else np.zeros((0, wide)) for p in parts]) if parts else np.zeros((0, wide)), np.repeat(np.arange(n), [len(p) for p in parts])

    @staticmethod
    def _forward(w: dict, x: np.ndarray, flat: np.ndarray, owner: np.ndarray, categories: np.ndarray | None) -> tuple[np.ndarray, dict]:
        keep = {"owner": owner, "categories": categories}
        parts = [np.nan_to_num((x - w["x_mean"]) / w["x_scale"])]
        if flat.shape[1]:
            keep["flat"] = np.nan_to_num((flat - w["s_mean"]) / w["s_scale"])
            keep["member"] = np.maximum(keep["flat"] @ w["a"] + w["ab"], 0)
            keep["n"] = np.maximum(np.bincount(owner, minlength=len(x)), 1)[:, None]
            mean = np.zeros((len(x), w["a"].shape[1]))
            np.add.at(mean, owner, keep["member"])
            parts.append(mean / keep["n"])
        if categories is not None:
            known = np.where(categories < len(w["c"]), categories, 0)
            keep["categories"] = known
            parts.append(w["c"][known].mean(1))
        keep["in"] = np.hstack(parts)
        keep["h1"] = np.maximum(keep["in"] @ w["w1"] + w["b1"], 0)
        keep["h2"] = np.maximum(keep["h1"] @ w["w2"] + w["b2"], 0)
        return keep["h2"] @ w["o"] + w["ob"], keep

    @staticmethod
    def _backward(w: dict, gap: np.ndarray, keep: dict) -> dict[str, np.ndarray]:
        g = {"o": keep["h2"].T @ gap, "ob": gap.sum(0)}
        h2 = (gap @ w["o"].T) * (keep["h2"] > 0)
        g |= {"w2": keep["h1"].T @ h2, "b2": h2.sum(0)}
        h1 = (h2 @ w["w2"].T) * (keep["h1"] > 0)
        g |= {"w1": keep["in"].T @ h1, "b1": h1.sum(0)}
        back = h1 @ w["w1"].T
        at = len(w["x_mean"])
        if "flat" in keep:
            width = w["a"].shape[1]
            member = (back[:, at : at + width] / keep["n"])[keep["owner"]] * (keep["member"] > 0)
            g |= {"a": keep["flat"].T @ member, "ab": member.sum(0)}
            at += width
        if keep["categories"] is not None:
            g["c"] = np.zeros_like(w["c"])
            each = back[:, at:] / keep["categories"].shape[1]
            for j in range(keep["categories"].shape[1]):
                np.add.at(g["c"], keep["categories"][:, j], each)
        return g

    def values(self, x: np.ndarray, sets: Sequence[np.ndarray] | None = None, categories: np.ndarray | None = None, raw: bool = False):
        """Predictions for arrays: numbers, or names for a text target (its scores with ``raw``)."""
        if not self.weights:
            raise BadData("the model isn't fitted")
        x = np.asarray(x, float)
        x = x.reshape(len(x), -1)
        flat, owner = self._flat(sets, len(x))
        if sets is not None and not flat.shape[1]:
            flat = np.zeros((0, len(self.weights["s_mean"])))
        made = self._forward(self.weights, x, flat, owner, categories)[0] * self.weights["y_scale"] + self.weights["y_mean"]
        if self.names is None or raw:
            return made
        return [self.names[k] for k in ((made[:, None, :] - self.vertices[None]) ** 2).sum(2).argmin(1)]

    def predict(self, df: DataFrame, features: Sequence[str], id_col: str, sets: str | None = None, categories: Sequence[str] = ()) -> DataFrame:
        """(id, predicted) of every row: a map without a shuffle. ``sets`` is a column of arrays of number arrays."""
        model = df.sparkSession.sparkContext.broadcast(self)
        columns = [F.col(id_col), F.array(*[F.col(c).cast("double") for c in features]).alias("x"), (F.col(sets).cast("array<array<double>>") if sets else F.lit(None).cast("array<array<double>>")).alias("s"), F.array(*[F.col(c).cast("int") for c in categories]).cast("array<int>").alias("c")]
        text = self.names is not None

        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                if batch.num_rows:
                    x = np.array([[np.nan if v is None else v for v in r] for r in batch.column(1).to_pylist()], float).reshape(batch.num_rows, -1)
                    members = [np.array(s, float).reshape(len(s), -1) if s else np.zeros((0, 0)) for s in batch.column(2).to_pylist()] if sets else None
                    marks = np.array([[v or 0 for v in r] for r in batch.column(3).to_pylist()], int) if categories else None
                    made = model.value.values(x, members, marks)
                    out = pa.array(made, pa.string()) if text else pa.array(made.tolist(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["id", "predicted"])

        kind = dict(df.dtypes)[id_col]
        return df.select(*columns).mapInArrow(run, f"id {kind}, predicted {'string' if text else 'array<double>'}")

    def save(self, path: str) -> None:
        state = {"weights": {k: v.tolist() for k, v in self.weights.items()}, "shapes": {k: list(v.shape) for k, v in self.weights.items()}, "names": self.names, "options": [self.width, self.set_width, self.steps, self.seed, self.fit_rows, self.category_width]}
        with open(path, "w") as out:
            json.dump(state, out)

    @classmethod
    def load(cls, path: str) -> "SetRegressor":
        from loomspan.operators.statistics import simplex

        with open(path) as file:
            state = json.load(file)
        model = cls(*state["options"])
        model.weights = {k: np.array(v, float).reshape(state["shapes"][k]) for k, v in state["weights"].items()}
        model.names = state["names"]
        if model.names is not None:
            model.vertices = simplex(len(model.names))
        return model


def column_ids(df: DataFrame, *columns: str) -> DataFrame:
    """(column, value, id): ids of categories, counted on from column to column; a column of one value has none."""
    from loomspan.operators.statistics import first_ids

    out, start = None, 1
    for c in columns:
        part = first_ids(df, c, start)
        n = part.count()
        if n < 2:
            continue
        part = part.select(F.lit(c).alias("column"), "value", "id")
        out, start = part if out is None else out.union(part), start + n
    return out if out is not None else df.sparkSession.createDataFrame([], "column string, value string, id bigint")


def encode_ids(df: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the named columns replaced by their ids, 0 where there is none."""
    from loomspan.operators.joins import small

    for c in columns:
        own = ids.where(F.col("column") == c).select(F.col("value").alias("__v"), F.col("id").alias("__id"))
        df = df.join(small(own), F.col(c).cast("string") == F.col("__v"), "left").withColumn(c, F.coalesce("__id", F.lit(0)).cast("bigint")).drop("__v", "__id")
    return df
