"""Operator 5, benchmark decontamination: q-gram lemma filtering and banded alignment.

An item of m bytes that lies in a document with at most e edits shares at least
m - q + 1 - q * e of its q-grams with it, on diagonals no more than e apart. The
q-grams of all documents are looked up in an index of the items'; the hits are
counted in diagonal bands that overlap by e, so that some band holds all hits of a
match; bands that meet the item's bound are verified by an alignment of the whole
item within the band. Bytes are compared after folding ASCII and Latin letters to
lower case and every white space to a blank.

Defined results
  null or empty text: no match; null doc_id: matched, reported with a null id;
  repeated rows: reported once each; several matches of an item in a document: the one
  with the fewest edits, then the first; long texts: searched whole;
  items shorter than a q-gram: found where they occur unchanged; null and empty items: ignored, they are in every text;
  repeated items: each is reported; an empty table of either kind: no rows;
  other columns: ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm._text import batches, bound_batches, narrow, ragged, slices, text_buffer

Q = 8
#: Edits allowed, as a part of the item's length.
EDIT_SHARE = 0.1
#: Bytes of items that one pass's index is made of; a larger benchmark takes several passes.
INDEX_BYTES = 8 << 20
#: Hits of q-grams that are held at a time.
_HITS = 1 << 20
_TABLE_BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[0x80:0x9F] += 32  # second bytes of Latin capitals
FOLD[list(b"\t\n\r\x0b\x0c")] = 32


def grams(folded: np.ndarray) -> np.ndarray:
    """The q-gram at every position, as the integer that its eight bytes are."""
    if len(folded) < Q:
        return np.empty(0, np.uint64)
    folded = np.ascontiguousarray(folded)
    return np.ndarray((len(folded) - Q + 1,), np.dtype("<u8"), folded, 0, (1,))


def edit_budget(m: int, share: float = EDIT_SHARE) -> int:
    """Edits allowed for an item of m bytes: as many as leave the lemma a bound of 1 at least."""
    return max(0, min(int(share * m), (m - Q) // Q))


def banded_distance(item: np.ndarray, text: np.ndarray, low: np.ndarray, budget: int, at_once: int = 4096) -> tuple[int, int]:
    """(least edits of the whole item within the text, end of the first such match) on the diagonals of the
    bands low .. low + 2 * budget, each widened by the budget; the bands are aligned side by side."""
    width = 4 * budget + 1
    # 0 is in no text that matters: it never matches
    edge = np.zeros(len(item) + width + budget, np.uint8)
    padded = np.concatenate([edge, text, edge])
    lane = np.arange(width, dtype=np.int32)
    best = (budget + 1, -1)
    start = np.unique(np.clip(low - budget, -len(edge), len(text)))
    for first in start.reshape(-1)[::at_once]:
        part = start[np.searchsorted(start, first) :][:at_once]
        window = (part + len(edge))[:, None] + lane
        row = np.zeros((len(part), width), np.int32)
        for i in range(len(item)):
            step = row + (padded[window + i] != item[i])
            step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
            row = np.minimum.accumulate(step - lane, axis=1) + lane
            if i % 16 == 15:
                alive = row.min(1) <= min(budget, best[0])
                if not alive.all():
                    row, window, part = row[alive], window[alive], part[alive]
                    if not len(part):
                        break
        if len(part):
            k = row.argmin(1)
            best = min(best, *zip(row[np.arange(len(part)), k].tolist(), (part + len(item) + k).tolist()))
    return best


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    x = np.sort(x)
    edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)
    return x[edge[:-1]], np.diff(edge)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts in all parts together."""
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    value, back = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return value, np.bincount(back, np.concatenate([n for _, n in parts]), len(value)).astype(np.int64)


class Index:
    """The items' q-grams with their postings, and the bound of each item."""

    def __init__(self, ids: list, texts: list[str], share: float = EDIT_SHARE):
        folded = [FOLD[np.frombuffer(t.encode(), np.uint8)] for t in texts]
        keep = [i for i, b in enumerate(folded) if len(b) >= Q]
        # shorter items by their length: the bytes as an integer, and the items that have it
        self.short: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        brief = [i for i, b in enumerate(folded) if 0 < len(b) < Q]
        for m in sorted({len(folded[i]) for i in brief}):
            same: dict[int, list[int]] = {}
            for k, i in enumerate(brief):
                if len(folded[i]) == m:
                    same.setdefault(int.from_bytes(folded[i].tobytes(), "little"), []).append(len(keep) + k)
            values = np.array(sorted(same), np.uint64)
            self.short[m] = values, [same[int(v)] for v in values]
        self.ids, self.items = [ids[i] for i in keep + brief], [folded[i] for i in keep]
        self.budget = np.array([edit_budget(len(b), share) for b in self.items], np.int64)
        self.bound = np.array([len(b) - Q + 1 - Q * e for b, e in zip(self.items, self.budget)], np.int64)
        code = np.concatenate([grams(b) for b in self.items]) if keep else np.empty(0, np.uint64)
        size = np.array([len(b) - Q + 1 for b in self.items], np.int64)
        item, at = ragged(size) if keep else (np.empty(0, np.int64), np.empty(0, np.int64))
        order = np.argsort(code, kind="stable")
        self.item, self.at = item[order], at[order]
        self.code, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.code * _SPREAD) >> np.uint64(64 - _TABLE_BITS)] = True

    def search(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, edits, end byte) of every item found in every document."""
        return self._long(buf, off) + self._short(buf, off) if self.short else self._long(buf, off)

    def _short(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        code = grams(np.concatenate([FOLD[buf], np.zeros(Q - 1, np.uint8)]))
        found = []
        for m, (values, items) in self.short.items():
            head = code & np.uint64((1 << 8 * m) - 1)
            slot = np.minimum(np.searchsorted(values, head), len(values) - 1)
            at = np.flatnonzero(values[slot] == head)
            doc = np.searchsorted(off, at, side="right") - 1
            whole = at + m <= off[doc + 1]
            at, doc, slot = at[whole], doc[whole], slot[at[whole]]
            _, first = np.unique(doc * len(values) + slot, return_index=True)
            found += [(int(doc[k]), i, 0, int(at[k] - off[doc[k]] + m)) for k in first for i in items[slot[k]]]
        return found

    def _long(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
        if not self.items or len(buf) < Q:
            return []
        folded = FOLD[buf]
        code = grams(folded)
        with np.errstate(over="ignore"):
            maybe = np.flatnonzero(self.table[(code * _SPREAD) >> np.uint64(64 - _TABLE_BITS)])
        slot = np.minimum(np.searchsorted(self.code, code[maybe]), len(self.code) - 1)
        hit = self.code[slot] == code[maybe]
        maybe, slot = maybe[hit], slot[hit]
        doc = np.searchsorted(off, maybe, side="right") - 1
        whole = maybe + Q <= off[doc + 1]
        maybe, slot, doc = maybe[whole], slot[whole], doc[whole]
        # texts and items of few different q-grams meet in very many places: hits are made a few at a time
        upto = np.cumsum(self.count[slot])
        cuts = np.searchsorted(upto, np.arange(0, int(upto[-1]) if len(upto) else 0, _HITS), side="left")
        cuts = np.unique(np.concatenate([cuts, [len(slot)]]))

        def hits() -> Iterator[tuple[np.ndarray, ...]]:
            """(document and item, item, diagonal, place in the item) of every hit."""
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                which, rank = ragged(self.count[slot[i:j]])
                post = self.first[slot[i:j]][which] + rank
                d, item, place = doc[i:j][which], self.item[post], self.at[post]
                yield d * len(self.items) + item, item, maybe[i:j][which] - off[d] - place, place

        # hits of a document and item, in any band, must reach the bound before bands are looked at
        seen, total = _merged([_distinct(h[0]) for h in hits()])
        enough = total >= self.bound[seen % len(self.items)]
        if not enough.any():
            return []
        longest = int(max(len(b) for b in self.items))
        base = longest + 2 * int(self.budget.max()) + 2
        most = (int(np.diff(off).max()) + 2 * base) // (int(self.budget.min()) + 1) + 2
        parts = []
        for pair, item, diagonal, place in hits():
            back = np.searchsorted(seen, pair)
            own = enough[back]
            back, diagonal, place, budget = back[own], diagonal[own], place[own], self.budget[item[own]]
            band, into = np.divmod(diagonal + base, budget + 1)
            again = into < budget  # also within the overlap of the band before
            key = np.concatenate([back * most + band, (back * most + band - 1)[again]])
            # a q-gram of the item counts once in a band, however often it recurs in the document
            parts.append(_distinct(key * longest + np.concatenate([place, place[again]]))[0])
        once = parts[0] if len(parts) == 1 else _distinct(np.concatenate(parts))[0]
        band_key, number = _distinct(once // longest)
        band_pair = band_key // most
        ok = number >= self.bound[seen[band_pair] % len(self.items)]
        own, band = band_pair[ok], band_key[ok] % most
        edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if len(own) else np.zeros(1, np.int64)
        found = []
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
            d, i = divmod(int(seen[own[x]]), len(self.items))
            e, text, wanted = int(self.budget[i]), folded[off[d] : off[d + 1]], self.items[i]
            at = text.tobytes().find(wanted.tobytes())
            edits, end = (0, at + len(wanted)) if at >= 0 else banded_distance(wanted, text, band[x:y] * (e + 1) - base, e)
            if edits <= e:
                found.append((d, i, edits, end))
        return found


def indexes(benchmark: DataFrame, share: float = EDIT_SHARE, most: int = INDEX_BYTES) -> list[Index]:
    """Indexes over the benchmark's items, each of at most about ``most`` bytes of text.

    The size is measured before anything is gathered; a benchmark beyond one index is
    taken in parts by a hash of the item, one part at a time.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // most))
    found = []
    for k in range(parts):
        rows = sorted(items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).collect(), key=lambda r: (r.item_id is None, r.item_id, r.text))
        found.append(Index([r.item_id for r in rows], [r.text for r in rows], share))
    return found


SCHEMA = "doc_id bigint, item_id bigint, edits bigint, budget bigint, char_end bigint"


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """One row per document and item found in it: edits, the item's edit budget, character position past the match."""
    rows = narrow(docs)

    def part(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def find(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches(source):
                buf, off = text_buffer(batch.column(1))
                rows = []
                for i, j in slices(off):
                    piece, edge = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                    for d, item, edits, end in known.search(piece, edge):
                        chars = int(np.count_nonzero((piece[edge[d] : edge[d] + end] & 0xC0) != 0x80))
                        rows.append((batch.column(0)[i + d].as_py(), known.ids[item], edits, int(known.budget[item]) if item < len(known.budget) else 0, chars))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["doc_id", "item_id", "edits", "budget", "char_end"])

        return rows.mapInArrow(find, SCHEMA)

    return reduce(DataFrame.unionAll, map(part, indexes(benchmark, share)))


def _clean(shared):
    """A column function: whether no item of a broadcast index is found in a text."""

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        buf, off = text_buffer(pa.array(text, pa.string()))
        out = np.ones(len(off) - 1, bool)
        for i, j in slices(off):
            for d, *_ in shared.value.search(buf[off[i] : off[j]], off[i : j + 1] - off[i]):
                out[i + d] = False
        return pd.Series(out)

    return clean


def keep_clean(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """The rows of ``docs``, all their columns unchanged, in which no item is found."""
    docs = bound_batches(docs)
    for index in indexes(benchmark, share):
        clean = _clean(docs.sparkSession.sparkContext.broadcast(index))
        docs = docs.where(clean(F.col("text").cast("string")))
    return docs


def brute_distance(item: bytes, text: bytes) -> int:
    """Least edits between the whole item and any part of the text (folded), by the full table."""
    a, b = FOLD[np.frombuffer(item, np.uint8)], FOLD[np.frombuffer(text, np.uint8)]
    row, lane = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1)
    for i, c in enumerate(a):
        step = np.empty(len(b) + 1, np.int64)
        step[0] = i + 1
        step[1:] = np.minimum(row[:-1] + (b != c), row[1:] + 1)
        row = np.minimum.accumulate(step - lane) + lane
    return int(row.min())
