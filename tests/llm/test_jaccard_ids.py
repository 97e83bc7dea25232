"""One id under several texts, common lines in all texts, edited copies in large groups, odd columns."""

import random

import pytest
from pyspark.sql import functions as F

from loomspan.llm import jaccard
from tests.llm.test_operators import brute_classes


def text(*changed, n=60):
    return " ".join(f"other{k}" if k in changed else f"word{k}" for k in range(n))


def check(spark, rows, **options):
    got = {tuple(r) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    assert got == brute_classes(rows)
    return got


@pytest.mark.parametrize("options", [{}, {"tile": 2, "at_once": 100}])
def test_one_id_under_two_texts(spark, options):
    check(spark, [(1, text()), (1, text(30)), (1, text(30)), (2, text(45)), (3, text(30)), (4, text(n=55)), (4, "nothing like any of the others at all")], **options)
    assert check(spark, [(1, text()), (1, text(30))], **options) == set()  # no pair with itself
    x, y = text(), text().replace("word", "term")
    near = [(1, x), (1, y), (2, x.replace("word30", "a")), (3, y.replace("term9", "b"))]
    assert check(spark, near, **options) == {(1, 1, 2), (2, 1, 1), (3, 1, 1)}


def test_only_the_other_text_is_near(spark):
    rows = [(7, "a first text " + text(n=20)), (7, " ".join(f"late{k}" for k in range(40))), (9, " ".join(f"late{k}" for k in range(41)))]
    assert check(spark, rows) == {(7, 7, 1), (9, 7, 1)}
    assert {r.doc_id for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {7}


@pytest.mark.parametrize("options", [{}, {"most": 10}, {"most": 0}, {"tile": 4}])
def test_common_lines_and_edited_groups(spark, options):
    """A fifth to a half of each text's n-grams is in every text; a group of edited copies lies around the threshold."""
    rng = random.Random(3)
    common = " ".join(f"licence{k}" for k in range(40))
    rows = [(i, common + " " + " ".join(f"own{rng.randrange(10**6)}" for _ in range(rng.choice([20, 40, 120])))) for i in range(120)]
    base = [f"base{k}" for k in range(80)]
    for i in range(200, 260):
        words = list(base)
        for k in rng.sample(range(80), rng.randrange(0, 14)):
            words[k] = f"edit{rng.randrange(10**6)}"
        rows.append((i, common + " " + " ".join(words) if i % 3 else " ".join(words)))
    assert len(check(spark, rows, **options)) > 20


def test_map_columns_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, text()), (1, text()), (2, text(3)), (None, "x")], "doc_id long, text string")
    odd = rows.withColumns({"m": F.create_map(F.lit("a"), F.lit(1)), "gone": F.lit(1), "again": F.lit(2), "hi": F.lit(3), "tiles": F.lit(4), "class_id": F.lit(5), "count": F.lit(6)})
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0, r.hi) for r in kept.collect()) == [(0, 3), (1, 3)]
    assert {tuple(r) for r in jaccard.jaccard_join(odd).collect()} == {(1, 1, 1), (2, 1, 1)}


def test_chance_matches_are_no_candidates(spark, monkeypatch):
    """Unrelated texts that share n-grams by chance get no keys; what is near one of them is still found."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(90)}" for _ in range(200))) for i in range(300)]
    rows += [(1000 + i, " ".join(["edited", *t.split()[:190]])) for i, t in rows[:20]]
    pairs, meet = [], jaccard.candidates
    monkeypatch.setattr(jaccard, "candidates", lambda *a: pairs.append(meet(*a)) or pairs[0])
    assert len(check(spark, rows)) == 40
    assert pairs[0].count() < 60
