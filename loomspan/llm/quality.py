"""Operator 10, quality rules: an isolation forest over rule statistics.

Nine statistics of a document (word length, symbol and case shares, repetition of
words and lines, bare marks) are computed in whole batches. A forest of random
splits is grown on a bounded sample of labelled rows; a document that few
splits isolate has short paths and a high anomaly score. The threshold comes from
all labelled rows: the lowest one at which at most ``most_lost`` of the good rows
would be called anomalous.

Defined results
  null, empty or blank text: score 1.0, anomalous; null doc_id: scored, never joined to labels;
  repeated rows: scored once each; repeated label rows of a document: the lowest quality holds;
  null labels: left out; no labelled row of either kind: the threshold is ``DEFAULT_THRESHOLD``
  (and the forest grows on a sample of the same size of all rows if none is labelled);
  an empty table: no rows; other columns: ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm._sample import smallest
from loomspan.llm._text import MULTIPLIER, SPACE, batches, narrow, prefix_hash, ragged, segment_sum, slices, span_hash, text_buffer, words
from loomspan.session import settle

#: Labelled rows that the forest is grown on at most (the classifier's sample bound).
FIT_ROWS = 4096
TREES, SUBSAMPLE, SEED = 128, 256, 7
DEFAULT_THRESHOLD = 0.6
MOST_LOST = 0.005
STATISTICS = ("mean_word", "symbols", "upper", "repeated_words", "adjacent_repeats", "short_words", "bare_words", "line_repeats", "shouted_words")

_LETTER, _UPPER, _SYMBOL = (np.zeros(256, np.int64) for _ in range(3))
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(0x80, 0x100))] = 1
_UPPER[65:91] = 1
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"!?-()"]] = 1


def _cum(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x)])


def _repeats(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many items per owner equal an earlier item of the same owner."""
    with np.errstate(over="ignore"):
        key = np.sort((h & np.uint64((1 << 40) - 1)) | (owner.astype(np.uint64) << np.uint64(40)))
    same = key[1:] == key[:-1]
    return np.bincount((key[1:][same] >> np.uint64(40)).astype(np.int64), minlength=n)


def statistics(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of STATISTICS per document, and which documents have no word."""
    n = len(off) - 1
    start, end, per = words(buf, off)
    owner, rank = ragged(per)
    h = prefix_hash(buf)
    hw = span_hash(h, start, end)
    letters, upper, symbols = (_cum(t[buf]) for t in (_LETTER, _UPPER, _SYMBOL))
    of = lambda c: c[off[1:]] - c[off[:-1]]
    solid = segment_sum(end - start, per)
    adjacent = np.zeros(len(start), np.int64)
    adjacent[1:] = (hw[1:] == hw[:-1]) & (rank[1:] > 0)
    size, caps = end - start, upper[end] - upper[start]
    bare = letters[end] == letters[start]
    breaks = np.flatnonzero(buf == 10)
    edges = np.unique(np.concatenate([off, breaks + 1]))
    ls, le = edges[:-1], edges[1:]
    le = le - (buf[np.maximum(le - 1, 0)] == 10) if len(le) else le
    keep = le > ls
    ls, le = ls[keep], le[keep]
    lo = np.searchsorted(off, ls, side="right") - 1
    lines = np.maximum(np.bincount(lo, minlength=n), 1)
    # shares are drawn to 0 by a prior of a few words, so that short texts aren't anomalies for being short
    return np.stack(
        [
            (solid + 50) / (per + 10),
            of(symbols) / (solid + 20),
            of(upper) / (solid + 40),
            _repeats(owner, hw, n) / (per + 20),
            segment_sum(adjacent, per) / (per + 10),
            segment_sum(size <= 2, per) / (per + 20),
            segment_sum(bare, per) / (per + 10),
            _repeats(lo, span_hash(h, ls, le), n) / (lines + per / 40 + 1),
            segment_sum((caps >= 2) & (2 * caps >= size), per) / (per + 10),
        ],
        axis=1,
    ).astype(np.float32), per == 0


def _average_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Isolation trees in flat arrays: feature (-1 at a leaf), split, left child (right is left + 1), path length at a leaf."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.feature, self.split, self.left, self.path, self.root = [], [], [], [], []
        psi = min(subsample, len(sample))
        limit = max(1, math.ceil(math.log2(max(psi, 2))))
        for _ in range(trees):
            self.root.append(len(self.feature))
            todo = [(sample[rng.choice(len(sample), psi, replace=False)], 0, self._node())]
            while todo:
                rows, depth, at = todo.pop()
                open_ = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 and depth < limit else ()
                if not len(open_):
                    self.path[at] = depth + _average_path(len(rows))
                    continue
                low, high = rows.min(0), rows.max(0)
                f = int(rng.choice(open_))
                v = float(rng.uniform(low[f], high[f]))
                self.feature[at], self.split[at], self.left[at] = f, v, (a := self._node())
                b = self._node()
                todo += [(rows[rows[:, f] < v], depth + 1, a), (rows[rows[:, f] >= v], depth + 1, b)]
        self.feature, self.left, self.root = (np.array(x, np.int32) for x in (self.feature, self.left, self.root))
        self.split, self.path = np.array(self.split, np.float32), np.array(self.path, np.float32)
        self.scale, self.limit = max(_average_path(psi), 1e-9), limit

    def _node(self) -> int:
        for part, empty in ((self.feature, -1), (self.split, 0.0), (self.left, 0), (self.path, 0.0)):
            part.append(empty)
        return len(self.feature) - 1

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path) per row: near 1 for anomalies, under 0.5 for ordinary rows."""
        at = np.repeat(self.root[None, :], len(rows), 0)
        lane = np.arange(len(rows))[:, None]
        for _ in range(self.limit):
            f = self.feature[at]
            right = rows[lane, np.maximum(f, 0)] >= self.split[at]
            at = np.where(f >= 0, self.left[at] + right, at)
        # summed in one fixed order, so that a row scores the same in every batch
        return np.round(np.exp2(-self.path[at].astype(np.float64).mean(1) / self.scale), 6)


def rule_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, blank, stats array<float>) of every row."""

    def measure(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            buf, off = text_buffer(batch.column(1))
            parts = [statistics(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in slices(off)]
            rows, blank = (np.concatenate(x) for x in zip(*parts))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blank), flat], names=["doc_id", "blank", "stats"])

    return narrow(docs).mapInArrow(measure, "doc_id bigint, blank boolean, stats array<float>")


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, most_lost: float = MOST_LOST) -> DataFrame:
    """(doc_id, score, threshold, anomalous) of every row of ``docs``.

    The texts are read once; their statistics (a few dozen bytes a document) are
    written to the shared folder, then sampled, scored and calibrated from there.
    """
    stats = settle(rule_statistics(docs))
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = stats.join(marks, "doc_id")
    sample: list = []
    for rows in (labelled.where("not blank"), stats.where("not blank")):
        sample = smallest(rows.select("doc_id", "stats"), fit_rows, "doc_id", SEED, "stats")
        if len(sample) >= 2:
            break
    forest = Forest(np.array([r.stats for r in sample], np.float32)) if len(sample) >= 2 else None

    def judge(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            blank = np.array(batch.column(1))
            score = np.ones(batch.num_rows)
            flat = np.asarray(batch.column(2).flatten()).reshape(-1, len(STATISTICS))
            for i in range(0, len(flat), 2048):
                if forest is not None:
                    score[i : i + 2048] = forest.score(flat[i : i + 2048])
            score[blank] = 1.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), *batch.columns[3:]], names=["doc_id", "score", *batch.schema.names[3:]])

    tally = labelled.select("doc_id", "blank", "stats", "quality").mapInArrow(judge, "doc_id bigint, score double, quality int").groupBy(F.round("score", 3).alias("score"), (F.col("quality") > 0).alias("good")).count().collect()
    threshold = calibrate([(r.score, r.good, r["count"]) for r in tally], most_lost)
    scored = stats.select("doc_id", "blank", "stats").mapInArrow(judge, "doc_id bigint, score double")
    return scored.select("doc_id", "score", F.lit(threshold).alias("threshold"), (F.col("score") >= threshold).alias("anomalous"))


def calibrate(tally: list[tuple[float, bool, int]], most_lost: float = MOST_LOST) -> float:
    """The lowest score (in steps of 0.001) at or above which at most ``most_lost`` of the good rows lie."""
    good = sum(n for _, g, n in tally if g)
    if not good or not any(not g for _, g, _ in tally):
        return DEFAULT_THRESHOLD
    lost, threshold = 0, None
    for value in sorted({s for s, _, _ in tally}, reverse=True):
        lost += sum(n for s, g, n in tally if g and s == value)
        if lost > most_lost * good:
            break
        threshold = value
    # rounding put scores of value +- 0.0005 into one step
    return round((max(s for s, _, _ in tally) + 0.001 if threshold is None else threshold) - 0.0005, 4)
