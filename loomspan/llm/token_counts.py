"""Operator 1, token counts: a linear longest-match automaton.

Each word (a maximal run of characters other than ASCII white space) is read as
the bytes of a blank and the word, and is cut greedily into the longest pieces of
the vocabulary; a vocabulary that has all 256 single bytes cuts everything. The
automaton is the trie of the vocabulary. A state that cannot read the next byte
follows its failure link, and the number of pieces given off on the way was
computed beforehand, so that a word of n bytes costs n table look-ups and no
piece is ever built. The links are folded into a full transition table, which
NumPy then walks for all words of a batch at once, byte position by byte position.

Defined results
  null, empty or blank text: 0 words, 0 tokens; null doc_id: kept as null;
  repeated rows: counted once each (one output row per input row);
  very long words: walked by a scalar loop over the same table, same counts;
  an empty table: no rows; other columns: ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomspan.llm._text import batches, narrow, slices, text_buffer, words
from loomspan.llm.vocab import BYTE_VOCABULARY, read_ranks

#: Words longer than this are walked one at a time instead of in lockstep.
LOCKSTEP = 256
_POP_BITS = 8


class Automaton:
    """Transition table ``step[state * 256 + byte] = next_state << 8 | pieces given off``.

    ``flush[state]`` is the number of pieces given off when the word ends there and
    ``begin`` the state after the blank that opens every word.
    """

    def __init__(self, pieces: list[bytes]):
        if len({p for p in pieces if len(p) == 1}) < 256:
            raise ValueError("the vocabulary must have all 256 single bytes")
        children: list[dict[int, int]] = [{}]
        parent, byte, depth, final = [0], [0], [0], [False]
        for piece in pieces:
            at = 0
            for c in piece:
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = children[at][c] = len(children)
                    children.append({})
                    parent.append(at)
                    byte.append(c)
                    depth.append(depth[at] + 1)
                    final.append(False)
                at = nxt
            final[at] = True
        n, deepest = len(children), max(depth)
        if deepest >= 1 << _POP_BITS:
            raise ValueError("a piece of the vocabulary is too long")
        par, byt, dep, fin = map(np.array, (parent, byte, depth, final))
        table = np.zeros((n, 256), np.int32)
        link, pops, flush = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for level in range(deepest + 1):
            u = np.flatnonzero(dep == level)
            if level:
                # a piece ends here: give it off and start again; else go where the parent's failure leads
                via = table[link[par[u]], byt[u]].astype(np.int64)
                link[u] = np.where(fin[u], 0, via >> _POP_BITS)
                pops[u] = np.where(fin[u], 1, pops[par[u]] + (via & 255))
                flush[u] = pops[u] + flush[link[u]]
                row = table[link[u]]
                table[u] = row + pops[u, None].astype(np.int32)
            kids = np.flatnonzero((dep == level + 1) & np.isin(par, u)) if level < deepest else []
            if len(kids):
                table[par[kids], byt[kids]] = (kids << _POP_BITS).astype(np.int32)
        self.step, self.flush, self.begin = table.reshape(-1), flush, int(table[0, 32]) >> _POP_BITS

    def scan(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of pieces of each word buf[start:end]."""
        size = end - start
        out = np.zeros(len(start), np.int64)
        for w in np.flatnonzero(size > LOCKSTEP):
            state, seen, step = self.begin, 0, self.step
            for c in buf[start[w] : end[w]].tolist():
                t = int(step[state << 8 | c])
                state, seen = t >> _POP_BITS, seen + (t & 255)
            out[w] = seen + self.flush[state]
        short = np.flatnonzero(size <= LOCKSTEP)
        short = short[np.argsort(-size[short], kind="stable")]
        first, length = start[short], size[short]
        alive = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
        state, seen = np.full(len(short), self.begin, np.int32), np.zeros(len(short), np.int32)
        for j, k in enumerate(alive):
            t = self.step[(state[:k] << 8) | buf[first[:k] + j]]
            state[:k] = t >> _POP_BITS
            seen[:k] += t & 255
        out[short] = seen + self.flush[state]
        return out


_built: dict[str, Automaton] = {}


def automaton(path: str, pieces: list[bytes] | None = None) -> Automaton:
    """The automaton of a vocabulary, built once in each worker process."""
    if path not in _built:
        _built[path] = Automaton(list(read_ranks(path)) if pieces is None else pieces)
    return _built[path]


SCHEMA = "doc_id bigint, n_words bigint, n_tokens bigint"


def token_counts(docs: DataFrame, vocabulary: str = BYTE_VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row of ``docs`` (doc_id, text); a map without a shuffle."""
    pieces = list(read_ranks(vocabulary))  # once on the driver: executors need not see the file

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(vocabulary, pieces)
        for batch in batches(source):
            buf, off = text_buffer(batch.column(1))
            n_words, n_tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, j in slices(off):
                part, edge = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                start, end, per = words(part, edge)
                seen = np.concatenate([[0], np.cumsum(machine.scan(part, start, end))])
                bound = np.concatenate([[0], np.cumsum(per)])
                n_words[i:j], n_tokens[i:j] = per, seen[bound[1:]] - seen[bound[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_tokens)], names=["doc_id", "n_words", "n_tokens"])

    return narrow(docs).mapInArrow(count, SCHEMA)


def brute_counts(text: str | None, pieces: set[bytes]) -> int:
    """The same count by cutting pieces off one after another."""
    import re

    total, longest = 0, max(map(len, pieces))
    for word in re.findall(rb"[^ \t\n\r\x0b\x0c]+", (text or "").encode()):
        rest = b" " + word
        while rest:
            k = next(k for k in range(min(longest, len(rest)), 0, -1) if rest[:k] in pieces)
            total, rest = total + 1, rest[k:]
    return total
