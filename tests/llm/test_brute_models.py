"""Language ID and the quality statistics of whole tables against plain loops over each text."""

import re

import numpy as np
import pytest

from loomspan.llm import language, quality

DATA = "/root/testdata/sf0.001"
ODD = [(1, "words in no order"), (1, "words in no order"), (2, None), (3, ""), (4, "  \n"), (5, "123 456"), (6, "ab"), (7, "Ünïcödé tëxt"), (8, "same same same.\nsame same same.\n\nOTHER Line!"), (9, "x" * 3000 + " y" * 500), (None, "no id")]


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    return docs, docs.unionByName(spark.createDataFrame([(*r, "en") for r in ODD], docs.schema))


def brute_language(model, text):
    b = (text or "").encode()
    codes, letters = [], 0
    for i in range(len(b) - 2):
        c = sum(int(language._CODES[k][b[i + k]]) for k in range(3)) & 0xFFFFFFFF
        c ^= c >> 15
        codes.append(c * 0x2C1B3C6D & 0xFFFFFFFF)
        letters += any(chr(x).isascii() and chr(x).isalpha() or x >= 0x80 for x in b[i : i + 3])
    n = max(len(codes), 1)
    margin = {p: sum(int(w[c >> 32 - language.BITS]) for c in codes) / (n * language.FIXED) for p, w in zip(model.pairs, model.weights)}
    known = sum(bool(model.known[c >> 32 - language._KNOWN_BITS]) for c in codes) / n

    def elect(level, names):
        if len(names) < 2:
            return names[0], float("inf")
        votes = {x: [0, 0.0, float("inf")] for x in names}
        for (where, a, b_), m in margin.items():
            if where == level:
                for x, s in ((a, m), (b_, -m)):
                    votes[x] = [votes[x][0] + (s > 0), votes[x][1] + s, min(votes[x][2], s)]
        best = sorted(names, key=lambda x: (-votes[x][0], -votes[x][1], x))[0]
        return best, votes[best][2]

    if not letters or not model.families:
        return None, None, 0.0, round(known, 6), False
    family, sure = elect("", model.families)
    lang, inner = elect(family, model.languages[family])
    margin_ = round(min(sure, inner, 9.0), 6)
    return family, lang, margin_, round(known, 6), margin_ >= model.least and known >= language.LEAST_KNOWN


def test_language_of_every_text(spark, rows):
    docs, every = rows
    model = language.fit_languages(docs)
    got = sorted(((r.doc_id, r.family, r.predicted, r.margin, r.known, r.accepted) for r in language.language_id(every, model).collect()), key=str)
    want = sorted(((r.doc_id, *brute_language(model, r.text)) for r in every.collect()), key=str)
    assert len(got) == len(want) and any(not w[5] for w in want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=2e-6) and g[4] == pytest.approx(w[4], abs=2e-6), (g, w)
        assert g[5] == w[5] or abs(w[3] - model.least) < 2e-6 or abs(w[4] - language.LEAST_KNOWN) < 2e-6


def brute_statistics(text):
    b = (text or "").encode()
    words = re.findall(rb"[^ \t\n\r\x0b\x0c]+", b)
    lines = [x for x in b.split(b"\n") if x]
    n, solid = len(words), sum(map(len, words))
    letter = lambda x: 65 <= x <= 90 or 97 <= x <= 122 or x >= 0x80
    upper = lambda x: 65 <= x <= 90
    symbol = lambda x: 33 <= x < 127 and not chr(x).isalnum() and chr(x) not in ".,;:'\"!?-()"
    caps = [sum(map(upper, w)) for w in words]
    return [
        (solid + 50) / (n + 10), sum(map(symbol, b)) / (solid + 20), sum(map(upper, b)) / (solid + 40), (n - len(set(words))) / (n + 20),
        sum(x == y for x, y in zip(words, words[1:])) / (n + 10), sum(len(w) <= 2 for w in words) / (n + 20), sum(not any(map(letter, w)) for w in words) / (n + 10),
        (len(lines) - len(set(lines))) / (max(len(lines), 1) + n / 40 + 1), sum(c >= 2 and 2 * c >= len(w) for c, w in zip(caps, words)) / (n + 10),
    ], n == 0


def test_statistics_of_every_text(spark, rows):
    _, every = rows
    got = sorted(((r.doc_id, r.blank, r.stats) for r in quality.rule_statistics(every).collect()), key=lambda r: (str(r[0]), r[2]))
    want = sorted(((r.doc_id, blank, stats) for r in every.collect() for stats, blank in [brute_statistics(r.text)]), key=lambda r: (str(r[0]), r[2]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and np.allclose(g[2], w[2], rtol=1e-5, atol=1e-6), (g, w)
