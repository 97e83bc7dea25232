"""Ball tree, scattered interpolation, set regression, hooks and small functions against plain versions."""

import itertools
import operator

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan import errors as E
from loomspan.functions import designs as G
from loomspan.functions import scalars as X
from loomspan.operators import approximation as A
from loomspan.operators import search as R
from loomspan.operators import statistics as S
from loomspan.operators.balltree import BallTree
from loomspan.operators.table import Table
from loomspan.sources import files


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    points = np.vstack([rng.normal(size=(120, 3)), np.zeros((5, 3)), rng.normal(3, 0.2, size=(60, 3))])
    return points, spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>").cache()


def test_ball_tree(spark, vectors):
    points, df = vectors
    tree = BallTree(df, "id", "v", leaf_rows=12)
    nodes = tree.nodes.collect()
    assert tree.rows.count() == len(points) and max(r.n for r in nodes if r.leaf) <= 12 and {r.path for r in nodes if r.depth == 0} == {""}
    first = next(r for r in nodes if r.path == "")
    assert first.root_id == int(((points - points[0]) ** 2).sum(1).argmax())
    got = {(r.query, r.rank): r.point for r in tree.nearest(df.where("id % 9 = 0"), 4, "id", "v").collect()}
    for q in range(0, len(points), 9):
        d = ((points - points[q]) ** 2).sum(1)
        assert [got[q, k] for k in range(1, 5)] == sorted(range(len(points)), key=lambda i: (d[i], i))[:4]
    assert tree.nearest(df.where("id = 1"), 4, "id", "v", budget=10).count() == 4
    roots = {r.id for r in tree.prune(1).collect()}
    assert roots == {first.root_id} and {r.id for r in tree.prune(3, "top").collect()} >= roots
    far = [points[r.id] for r in tree.prune(6, "distance", 2.0).collect()]
    assert all(np.linalg.norm(a - b) >= 2 for a, b in itertools.combinations(far, 2))
    assert not {r.id for r in tree.prune(2, "inner").collect()} & {r.root_id for r in nodes if r.depth == 1}
    assert [r.path for r in tree.ordered().collect()] == sorted(r.path for r in tree.rows.collect())
    more = tree.add(spark.createDataFrame([(999, [50.0, 0.0, 0.0])], "id long, v array<double>"), "id", "v")
    assert more.rows.count() == len(points) + 1 and more.prune(1).first().id == 999
    same = BallTree(spark.createDataFrame([(i, [1.0, 1.0]) for i in range(40)], "id long, v array<double>"), "id", "v", leaf_rows=4)
    assert same.rows.count() == 40 and same.nodes.count() == 1  # equal points can't be told apart
    assert BallTree(df.limit(0), "id", "v").rows.count() == 0
    with pytest.raises(ValueError):
        tree.prune(2, "none")


def test_delaunay(spark):
    rng = np.random.default_rng(5)
    for d in (1, 2, 3):
        points = rng.random((25, d))
        model = A.Delaunay(points)
        for q in rng.random((20, d)) * 0.6 + 0.2:
            index, weight = model.weights(q)
            assert abs(weight.sum() - 1) < 1e-9 and (weight >= 0).all() and len(index) <= d + 1
            if np.abs(weight @ points[index] - q).max() < 1e-9 and len(index) == d + 1:
                # the empty sphere: no other point lies inside the one through the simplex
                a = 2 * (points[index[1:]] - points[index[0]])
                c = np.linalg.solve(a, (points[index[1:]] ** 2).sum(1) - (points[index[0]] ** 2).sum())
                r = np.linalg.norm(points[index[0]] - c)
                assert (np.linalg.norm(points - c, axis=1) >= r - 1e-7).all()
        outside, weight = model.weights(np.full(d, 9.0))
        assert (weight > 0).all() and abs(weight.sum() - 1) < 1e-9
    square = A.Delaunay(np.array([[0.0, 0], [0, 1], [1, 0], [1, 1], [1, 1]]))
    assert np.allclose(square.weights([2.0, 0.5])[1] @ square.points[[2, 3]][np.argsort(square.weights([2.0, 0.5])[0])], [1, 0.5])
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "id int, q array<double>")
    assert [r.predicted for r in square.predict(df, np.arange(5.0), "q").orderBy("id").collect()] == [[0.0], None]
    with pytest.raises(E.BadData):
        A.Delaunay(np.zeros((0, 2)))


def test_set_regression(spark, tmp_path):
    rng = np.random.default_rng(0)
    sets = [rng.normal(size=(rng.integers(0, 6), 2)) for _ in range(600)]
    x, marks = rng.normal(size=(600, 1)), rng.integers(1, 3, size=(600, 1))
    y = x[:, 0] + np.array([s[:, 0].mean() if len(s) else 0 for s in sets]) + 2.0 * (marks[:, 0] == 2)
    seen = []
    model = A.SetRegressor(width=24, steps=600, seed=1).fit(x, y, sets, marks, callback=lambda step, error: seen.append(error))
    made = model.values(x, sets, marks)[:, 0]
    assert np.mean((made - y) ** 2) < 0.15 * np.var(y) and len(seen) == 600 and seen[-1] < seen[0] / 3
    model.save(str(tmp_path / "m.json"))
    again = A.SetRegressor.load(str(tmp_path / "m.json"))
    df = spark.createDataFrame([(i, float(a), s.tolist(), int(m)) for i, (a, s, m) in enumerate(zip(x[:50, 0], sets, marks[:50, 0]))], "id long, x double, s array<array<double>>, m int")
    got = {r.id: r.predicted[0] for r in again.predict(df, ["x"], "id", sets="s", categories=["m"]).collect()}
    assert np.allclose([got[i] for i in range(50)], made[:50])
    assert np.isfinite(model.values(np.array([[np.nan]]), [np.zeros((0, 2))], np.array([[77]]))).all()
    names = ["low" if v < 0 else "high" for v in x[:, 0]]
    kind = A.SetRegressor(width=12, steps=300).fit(x, names, weights=np.ones(600))
    assert np.mean([a == b for a, b in zip(kind.values(x), names)]) > 0.95
    assert {r.predicted for r in kind.predict(df, ["x"], "id").collect()} <= {"low", "high"}
    with pytest.raises(E.BadData):
        A.SetRegressor().values(x)


def test_linear_helpers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) @ np.diag([1, 2, 3, 0.5]) + 5
    q, rank = S.orthogonalize(np.hstack([x[:, :3], x[:, :1] + x[:, 1:2]]))
    assert rank == 3 and np.allclose(q.T @ q, np.eye(3), atol=1e-8)
    v = S.simplex(4)
    assert np.allclose(S.category_ratio([0.1, 0.2, 0.3, 0.4] @ v, v), [0.1, 0.2, 0.3, 0.4])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    shift, matrix = S.whitening(df, "v", 4)
    assert np.allclose(np.cov(((x - shift) @ matrix).T, bias=True), np.eye(4), atol=1e-6)
    holes = spark.createDataFrame([([1.0, None],), ([3.0, 4.0],), ([5.0, float("nan")],), (None,)], "v array<double>")
    g, s, n = S.gram(holes, "v", 2)
    assert n == 3 and np.allclose(s, [9, 12]) and np.allclose(g, [[35, 36], [36, 48]])  # gaps are the mean, 4
    with pytest.raises(E.BadData):
        S.gram(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>"), "v", 2)


def test_table_additions(spark):
    t = Table.from_rows(spark, [[1, "a"], [2, None], [None, "c"]], ["n", "s"])
    assert [tuple(r) for r in t.equals_each("s", ["a", None, "x"]).orderBy("__pos").collect()] == [(0, True), (1, True), (2, False)]
    assert t.select("n", 0, [False, True], slice(0, 1)).columns == ["n", "n_2", "s", "n_3"]
    assert t.select("n").rowwise(operator.add, 2).rows() == [(3,), (4,), (None,)]
    assert t.assign_each("s", ["x", "y", None]).rows() == [(1, "x"), (2, "y"), (None, None)]
    assert t.has_value("s", None) and not t.has_value("n", 9)
    assert [r.position for r in t.argsort("n").orderBy("rank").collect()] == [0, 1, 2]
    for bad, kind in ((lambda: t.select([True]), E.BadIndex), (lambda: t.select(5), E.BadIndex), (lambda: t.equals_each("n", [1]), E.BadData), (lambda: t.assign_each("n", [1], [0, 1]), E.BadAssignment), (lambda: t.assign_each("n", [1], [7]), E.BadIndex), (lambda: t.rowwise(operator.add, [1]), E.BadElement)):
        with pytest.raises(kind):
            bad()


def test_hooks_and_queries(spark):
    df = spark.createDataFrame([(1, "a bb"), (2, None)], "id int, text string")
    tokens = R.tokenized(df, "text", lambda texts: [[len(w) for w in t.split()] for t in texts])
    assert [r.tokens for r in tokens.orderBy("id").collect()] == [[1, 2], None]
    made = R.embedded(tokens, "tokens", lambda rows: [[3.0 * len(r), 4.0 * len(r)] for r in rows])
    assert [r.embedding for r in made.orderBy("id").collect()] == [[0.6, 0.8], None]
    assert R.parse_query('{"top_k": 3, "numeric_range": {"n": [1, 2]}}') == {"top_k": 3, "numeric_range": {"n": (1.0, 2.0)}, "label_include": {}}
    for bad in ("[]", '{"x": 1}', '{"top_k": "3"}'):
        with pytest.raises(ValueError):
            R.parse_query(bad)
    sizes = [7, 7, 5, 4, 4, 3, 1, 1, 1]
    got = R.bin_pack(spark.createDataFrame([(f"p{i}", s) for i, s in enumerate(sizes)], "path string, num_bytes long"), 3).collect()
    load = [0, 0, 0]
    for s in sizes:
        load[load.index(min(load))] += s
    assert sorted(sum(sizes[int(r.path[1:])] for r in got if r.bin == b) for b in range(3)) == sorted(load)


def test_word_vectors(spark):
    words = spark.createDataFrame([("known",), ("new",), (None,), ("new",)], "w string")
    known = spark.createDataFrame([("known", [1.0, 2.0])], "word string, vector array<double>")
    pieces = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id long, vector array<double>")
    got = {r.word: r.vector for r in R.word_vectors(words, "w", known, pieces, 50).collect()}

    def fnv(text):
        h = 2166136261
        for c in text.encode():
            h = (h ^ c) * 16777619 % 2**32
        return h

    parts = ["<new>"[i : i + n] for n in range(3, 7) for i in range(max(0, 5 - n + 1))]
    assert got == {"known": [1.0, 2.0], "new": [pytest.approx(np.mean([fnv(p) % 50 for p in parts])), 1.0]}


def test_small_functions(spark, tmp_path):
    one = spark.range(1)
    items = one.select(X.edge_heavy_items(F.sequence(F.lit(0), F.lit(99)), 10).alias("a"), X.edge_heavy_items(F.sequence(F.lit(0), F.lit(3)), 10).alias("b")).first()
    assert items.a == X.edge_heavy(100, 10) and items.b == [0, 1, 2, 3]
    text = one.select(X.python_text(F.lit(1e16), "double").alias("a"), X.python_text(F.lit(None).cast("double"), "double").alias("b"), X.python_text(F.lit(2.0), "double").alias("c")).first()
    assert tuple(text) == (str(1e16), "None", "2.0")
    rows = [(1, None, [2.0]), ("x", 3)]
    for name in ("t.pkl", "t.pkl.gz"):
        files.save_pickle(rows, str(tmp_path / name))
        assert files.load_pickle(str(tmp_path / name)) == rows
    assert files.sample_rows(spark.range(100), 7, seed=1).distinct().count() == 7
    assert files.with_path_tags(spark.createDataFrame([("file:/r/a/b/c.txt",)], "path string"), "path", "/r").first().tags == ["a", "b"]
    files.save(spark.createDataFrame([(1, "a")], "id long, t string"), str(tmp_path / "more.csv"))
    assert sorted(map(tuple, files.load_onto(spark.createDataFrame([(2, "b")], "id long, t string"), str(tmp_path / "more.csv")).collect())) == [(1, "a"), (2, "b")]
    deep = '{"k":{"a":{"b":{"c":{"d":{"e":7, "f": [1.50, null, true, {"g": "x"}]}}}}},"z":1}'
    got = files.flat_json(spark.createDataFrame([(1, deep), (2, None), (3, "7")], "id int, j string"), "j").collect()
    assert sorted((r.id, r.path, r.value) for r in got if r.value) == [(1, "k.a.b.c.d.e", "7"), (1, "k.a.b.c.d.f", "1.50"), (1, "k.a.b.c.d.f", "true"), (1, "k.a.b.c.d.f.g", "x"), (1, "z", "1"), (3, "item", "7")]
    assert sum(r.value is None for r in got) == 1
    values = [r.value for r in G.random_range(spark, 1000, seed=2).orderBy("k").collect()]
    assert sorted(values) == list(range(1000)) and values != sorted(values) and abs(np.corrcoef(values, range(1000))[0, 1]) < 0.1
    assert G.random_range(spark, 5, 5).count() == 0 and [r.value for r in G.random_range(spark, 3, 0, -2).orderBy("value").collect()] == [1, 3]
    assert G.pairs(spark, 30, 50, seed=1).where("i > j and j >= 0 and i < 30").distinct().count() == 50
    assert G.mesh(spark, ["a", "b"], 3, sample=4).distinct().count() == 4


def test_file_matches(spark):
    from loomspan.functions import patterns as P

    df = spark.createDataFrame([(1, "one\ntwo ab three\nab"), (2, "é" * 60 + "ab"), (3, "é" * 30 + "ab" + "é" * 30 + "x" * 400), (4, None)], "id int, t string")
    rows = P.file_matches(df, "t", "ab", context=4).collect()
    assert sorted((r.id, r.start, r.line, r.around) for r in rows) == [(1, 8, 2, "two ab thr"), (1, 17, 3, "ree\nab"), (3, 60, 1, "ééabéé")]
