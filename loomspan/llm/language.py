"""Operator 2, language ID: hierarchical discrimination with linear support vector machines.

A text is a bag of hashed byte trigrams (ASCII case folded). One-versus-one linear
machines decide the language family first; then those of that family's pairs of
languages separate close relatives. Every machine is a weight per trigram bucket,
so a text's margins are sums of table look-ups, done for whole batches. Weights are
fixed-point integers: sums are exact and don't depend on how rows are batched.

The machines are trained on a bounded sample of rows with a declared language.

Defined results
  null, empty or blank text, or one without a trigram that has a letter: rejected, no family, no language;
  texts whose smallest margin is under ``REJECT_BELOW`` of the fitted rows' median margin,
  or of whose trigrams fewer than half are known: rejected;
  null language: predicted, not fitted; one language or none to fit: it (or null) for all;
  null doc_id: kept as null; repeated rows: predicted once each; ties in votes: the larger
  summed margin, then the smaller name; an empty table: no rows; other columns: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm._text import batches, bound_batches, narrow, slices, text_buffer

#: Closely related languages; a language not named here is a family of its own.
FAMILIES = {"germanic": ("af", "da", "de", "en", "nl", "no", "sv"), "romance": ("ca", "es", "fr", "it", "pt", "ro"), "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sr", "uk")}
#: Rows of a language that are fitted at most (the classifier's sample bound).
FIT_ROWS = 400
#: Texts with a margin under this part of the fitted rows' median margin are rejected.
REJECT_BELOW = 0.02
LEAST_KNOWN = 0.5
BITS, SEED, FIXED = 14, 11, 1 << 20
_KNOWN_BITS = 20

_rng = np.random.default_rng(SEED)
_CODES = _rng.integers(0, 1 << 32, (3, 256), dtype=np.uint32)
_CODES[:, ord("A") : ord("Z") + 1] = _CODES[:, ord("a") : ord("z") + 1]
_CODES[:, list(b"\t\n\r\x0b\x0c")] = _CODES[:, [32]]
_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(0x80, 0x100))] = True


def trigrams(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit code of the trigram at each position, and whether it has a letter."""
    if len(buf) < 3:
        return np.empty(0, np.uint32), np.empty(0, bool)
    code = _CODES[0][buf[:-2]] + _CODES[1][buf[1:-1]] + _CODES[2][buf[2:]]
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    letter = _LETTER[buf]
    return code, letter[:-2] | letter[1:-1] | letter[2:]


def _inside(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last trigram position of each document."""
    return off[:-1], np.maximum(off[1:] - 2, off[:-1])


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 8.0, epochs: int = 12) -> np.ndarray:
    """Weights of an L2-loss linear support vector machine over sparse rows (buckets, values), by dual coordinate descent."""
    rng, alpha, w = np.random.default_rng(SEED), np.zeros(len(rows)), np.zeros(1 << BITS)
    square = np.array([v @ v for _, v in rows]) + 1 / (2 * cost)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            gradient = y[i] * (w[at] @ v) - 1 + alpha[i] / (2 * cost)
            new = max(alpha[i] - gradient / square[i], 0.0)
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
    return w


class Hierarchy:
    """Families, their languages, a weight vector per pair, known trigrams and the least margin to accept."""

    def __init__(self, texts: list[str], langs: list[str], families: dict[str, tuple[str, ...]] | None = None):
        families = families or FAMILIES
        home = {lang: next((f for f, members in families.items() if lang in members), lang) for lang in set(langs)}
        self.families = sorted(set(home.values()))
        self.languages = {f: sorted(x for x in home if home[x] == f) for f in self.families}
        self.known = np.zeros(1 << _KNOWN_BITS, bool)
        rows = []
        for text in texts:
            code, _ = trigrams(np.frombuffer(text.encode(), np.uint8))
            at, n = np.unique(code >> np.uint32(32 - BITS), return_counts=True)
            rows.append((at.astype(np.int64), n / max(np.sqrt((n * n).sum()), 1e-9)))
            self.known[code >> np.uint32(32 - _KNOWN_BITS)] = True
        own = np.array([home[x] for x in langs], object)
        lang = np.array(langs, object)
        self.pairs, weights = [], []
        for level, mark, names in [("", own, self.families), *((f, lang, self.languages[f]) for f in self.families)]:
            for a, b in combinations(names, 2):
                use = np.flatnonzero((mark == a) | (mark == b))
                self.pairs.append((level, a, b))
                weights.append(np.rint(fit_svm([rows[i] for i in use], np.where(mark[use] == a, 1.0, -1.0)) * FIXED).astype(np.int32))
        self.weights = np.stack(weights) if weights else np.zeros((0, 1 << BITS), np.int32)
        self.least = 0.0
        if self.pairs and texts:
            buf, off = text_buffer(pa.array(texts))
            _, got, margin, _ = self.predict(buf, off)
            self.least = float(np.median(margin[got == lang])) * REJECT_BELOW if (got == lang).any() else 0.0

    def predict(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(family, language, smallest margin of the winner, share of known trigrams) per document; None without evidence."""
        n = len(off) - 1
        code, letter = trigrams(buf)
        bucket = code >> np.uint32(32 - BITS)
        first, last = _inside(off)
        sums = lambda x, kind=np.int64: (c := np.concatenate([[0], np.cumsum(x, dtype=kind)]))[np.minimum(last, len(x))] - c[np.minimum(first, len(x))]
        count = np.maximum(last - first, 1)
        margins = {p: sums(w[bucket]) / (count * FIXED) for p, w in zip(self.pairs, self.weights)}
        known = sums(self.known[code >> np.uint32(32 - _KNOWN_BITS)]) / count
        evidence = sums(letter) > 0

        def elect(level: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
            if len(names) < 2:
                return np.zeros(n, int), np.full(n, np.inf)
            votes, total, least = (np.zeros((len(names), n)) for _ in range(3))
            least += np.inf
            for (where, a, b), m in margins.items():
                if where == level:
                    for name, sign in ((a, 1), (b, -1)):
                        k = names.index(name)
                        votes[k] += sign * m > 0
                        total[k] += sign * m
                        least[k] = np.minimum(least[k], sign * m)
            best = np.lexsort((-total, -votes), axis=0)[0]
            return best, least[best, np.arange(n)]

        family, language, margin = np.full(n, None, object), np.full(n, None, object), np.zeros(n)
        if self.families:
            pick, sure = elect("", self.families)
            for k, f in enumerate(self.families):
                at = np.flatnonzero((pick == k) & evidence)
                inner, inner_sure = elect(f, self.languages[f])
                family[at] = f
                language[at] = np.array(self.languages[f], object)[inner[at]]
                margin[at] = np.minimum(sure, inner_sure)[at]
        return family, language, np.round(np.minimum(margin, 9.0), 6), np.round(known, 6)


def fit_languages(docs: DataFrame, fit_rows: int = FIT_ROWS, families: dict[str, tuple[str, ...]] | None = None) -> Hierarchy:
    """The machines, trained on at most ``fit_rows`` rows of each declared language, the first by a hash of the id."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and lang <> '' and doc_id is not null")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Hierarchy([], [], families)
    order = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000))
    wanted = None
    for lang, n in counts.items():
        share = min(1.0, (1.3 * fit_rows + 50) / n)
        one = (F.col("lang") == lang) & (order < int(share * 1_000_000) + 1)
        wanted = one if wanted is None else wanted | one
    sample = sorted(rows.where(wanted & (F.length(F.trim("text")) > 0)).select("lang", order.alias("h"), "doc_id", "text").collect(), key=lambda r: (r.lang, r.h, r.doc_id, r.text))
    taken: dict[str, int] = {}
    kept = []
    for r in sample:
        taken[r.lang] = taken.get(r.lang, 0) + 1
        if taken[r.lang] <= fit_rows:
            kept.append(r)
    return Hierarchy([r.text for r in kept], [r.lang for r in kept], families)


SCHEMA = "doc_id bigint, lang string, family string, predicted string, margin double, known double, accepted boolean"


def language_id(docs: DataFrame, model: Hierarchy | None = None) -> DataFrame:
    """One row per row of ``docs``: declared and predicted language, margin, share of known trigrams, accepted.

    After the bounded fit this is a map without a shuffle; the machines travel with the task.
    """
    model = model or fit_languages(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches(source):
            buf, off = text_buffer(batch.column(1))
            parts = [machine.predict(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in slices(off)]
            family, language, margin, known = (np.concatenate(x) for x in zip(*parts))
            accepted = np.array([x is not None for x in language]) & (margin >= machine.least) & (known >= LEAST_KNOWN)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(family, pa.string()), pa.array(language, pa.string()), pa.array(margin), pa.array(known), pa.array(accepted)],
                names=["doc_id", "lang", "family", "predicted", "margin", "known", "accepted"],
            )

    return narrow(docs, "lang").mapInArrow(judge, SCHEMA)


def keep_identified(docs: DataFrame, model: Hierarchy | None = None) -> DataFrame:
    """The rows of ``docs``, all their columns unchanged, that language ID accepts.

    The decision is made where the row is (an Arrow column function), so no join on
    an id that may be null or repeated is needed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit_languages(docs))

    @F.pandas_udf("boolean")
    def accepted(text: pd.Series) -> pd.Series:
        machine = shared.value
        buf, off = text_buffer(pa.array(text, pa.string()))
        if len(off) == 1:
            return pd.Series([], dtype=bool)
        parts = [machine.predict(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in slices(off)]
        _, language, margin, known = (np.concatenate(x) for x in zip(*parts))
        return pd.Series(np.array([x is not None for x in language]) & (margin >= machine.least) & (known >= LEAST_KNOWN))

    return bound_batches(docs).where(accepted(F.col("text").cast("string")))
