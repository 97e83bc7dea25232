"""Interpolation of many places at once."""

import numpy as np
import pytest

from loomspan.operators import approximation as A


@pytest.mark.parametrize("d", [1, 2, 3])
def test_many_places_as_one_by_one(d):
    rng = np.random.default_rng(d)
    points = rng.random((30, d))
    values = rng.random(30)
    q = np.vstack([rng.random((200, d)) * 1.6 - 0.3, points, points[:10] / 2 + points[10:20] / 2])  # within, outside, at points
    index, weight = A.Delaunay(points).many(q)
    one = A.Delaunay(points)
    want = [w @ values[i] for i, w in map(one.weights, q)]
    assert np.allclose((weight * values[index]).sum(1), want, atol=1e-7)


def test_one_triangulation_for_all(monkeypatch):
    """The four corners of a square: the diagonal doesn't hang on which places come together."""
    square, values = np.array([[0.0, 0], [0, 1], [1, 0], [1, 1]]), np.array([0.0, 1, 1, 0])
    q = np.random.default_rng(0).random((50, 2))
    whole = A.Delaunay(square).many(q)
    value = (whole[1] * values[whole[0]]).sum(1)
    assert np.allclose([(w * values[i]).sum() for i, w in (A.Delaunay(square).many(q[[k]]) for k in range(50))], value)
    # a line of points on the hull, and places beyond it
    row = A.Delaunay(np.array([[0.0, 0], [1, 0], [2, 0], [3, 0], [1, 2]]))
    index, weight = row.many(np.array([[0.5, -1], [1.5, -1], [2.25, -7]]))
    assert np.allclose((weight * np.array([5.0, 1, 7, 3, 9])[index]).sum(1), [3, 4, 6])


def test_programs_are_few(monkeypatch):
    """10,000 places took 10,000 linear programs; now about one a simplex."""
    solved = []
    plain = A.Delaunay._program
    monkeypatch.setattr(A.Delaunay, "_program", lambda self, *a: (solved.append(1), plain(self, *a))[1])
    rng = np.random.default_rng(3)
    model = A.Delaunay(rng.random((30, 2)))
    model.many(rng.random((10_000, 2)) * 2 - 0.5)
    assert len(solved) < 200


def test_places_without_value(spark):
    df = spark.createDataFrame([(1, [0.5]), (2, [float("nan")]), (3, None), (4, [None])], "id int, q array<double>")
    got = A.Delaunay(np.array([[0.0], [1.0]])).predict(df, np.array([2.0, 4.0]), "q").orderBy("id").collect()
    assert [r.predicted for r in got] == [[3.0], None, None, None]
