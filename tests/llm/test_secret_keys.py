"""Recall of the secret scan on generated keys of one case and of 16 characters on."""

import random
import string

import pytest

from loomspan.llm import secrets

UPPER, LOWER, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits


@pytest.mark.parametrize(
    "kind,prefix,alphabet,n",
    [("upper", "AKIA", UPPER + "234567", 16), ("upper", "AKIA", UPPER + DIGITS, 16), ("upper", "", UPPER + DIGITS, 16), ("lower", "", LOWER + DIGITS, 16), ("lower", "", LOWER + DIGITS, 25), ("alphanumeric", "", UPPER + LOWER + DIGITS, 17)],
)
def test_recall(spark, kind, prefix, alphabet, n):
    rng = random.Random(5)
    keys = [prefix + "".join(rng.choices(alphabet, k=n)) for _ in range(3000)]
    rows = [(i, f"key = {k};") for i, k in enumerate(keys) if set(k) & set(DIGITS) and not k.isdigit()]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    hits = {r.doc_id for r in secrets.secret_scan(df, classes=secrets.KEY_CLASSES).where(f"char_class = '{kind}'").select("doc_id").collect()}
    before = {r.doc_id for r in secrets.secret_scan(df).select("doc_id").collect()}
    print("recall", kind, prefix, len(alphabet), n, len(before) / len(keys), len(hits) / len(keys))
    assert len(hits) >= 0.995 * len(rows) and len(hits) > len(before)


def test_what_was_found_before_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, more = (found(secrets.secret_scan(docs, **o)) for o in ({}, {"classes": secrets.KEY_CLASSES}))
    assert one <= more and all(w in ("upper", "lower", "alphanumeric") for *_, w in more - one)


def found(df):
    return {(r.doc_id, r.char_start, r.n_chars, r.max_entropy, r.window_start, r.char_class) for r in df.collect()}
