"""Operator 4, token-ID / binary output: patched frame-of-reference blocks.

A text is encoded with a public byte-pair vocabulary. Its ids are cut into blocks of
128; a block stores its minimum, the differences to it packed at the width that holds
90 % of them, and the rest as exceptions (place and whole difference). The byte at
which each block starts is given beside the payload, so that any block can be read
alone. All blocks of a batch are packed together, one width at a time.

Block layout, little-endian: u32 minimum, u8 width in bits, u8 values less one, u8
exceptions; ceil(values * width / 8) bytes, value i at bits [i * width, (i + 1) * width)
from the lowest; a u8 place for each exception; a u32 difference for each exception.

Defined results
  null or empty text: 0 tokens, an empty payload, no block; null doc_id: kept as null;
  strings that look like special tokens: ordinary text; repeated rows: one output row each;
  long texts, blank or without a blank: as many blocks as it takes; an empty table: no rows; other columns: ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomspan.llm._text import batches, narrow, ragged
from loomspan.llm.vocab import BYTE_VOCABULARY, read_ranks

BLOCK = 128
PERCENTILE = 0.9
HEAD = 7
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id bigint, n_tokens bigint, block_starts array<int>, payload binary"
#: Tokens packed at a time.
_CHUNK = 1 << 18
#: Runs of white space (as the pattern's \\s has it) that are too long for the pattern's backtracking.
_LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{20000,}")

_encoders: dict[str, object] = {}


def encoder(name: str, ranks: dict[bytes, int]):
    """The byte-pair encoder of a vocabulary, made once in each worker process."""
    if name not in _encoders:
        import tiktoken

        _encoders[name] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def encode(machine, text: str | None) -> np.ndarray:
    """The ids of a text. A long run of white space is a piece of its own but for its last
    character (the pattern's ``\\s+(?!\\S)``), so it is cut out before the pattern sees it."""
    if not text:
        return np.empty(0, np.uint32)
    parts, at = [], 0
    for run in _LONG_BLANK.finditer(text):
        end = run.end() - (run.end() < len(text))
        parts += [machine.encode_to_numpy(text[at : run.start()], disallowed_special=()), np.array(machine._core_bpe.encode_single_piece(text[run.start() : end].encode()), np.uint32)]
        at = end
    rest = machine.encode_to_numpy(text[at:], disallowed_special=()) if at < len(text) else np.empty(0, np.uint32)
    return np.concatenate([*parts, rest]) if parts else rest


def pack(ids: np.ndarray, counts: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(payload bytes, bytes per block, blocks per document) of documents of ``counts`` ids each."""
    ids = np.asarray(ids, np.uint32)
    per_doc = -(-counts // BLOCK)
    nb = int(per_doc.sum())
    if not nb:
        return np.empty(0, np.uint8), np.empty(0, np.int64), per_doc
    doc, rank = ragged(per_doc)
    size = np.minimum(counts[doc] - rank * BLOCK, BLOCK)
    block, place = ragged(size)
    low = np.minimum.reduceat(ids, np.cumsum(size) - size)
    diff = ids - low[block]
    length = np.frexp(diff.astype(np.float64))[1].astype(np.int64)  # bits of the difference, 0 for 0
    held = np.cumsum(np.bincount(block * 33 + length, minlength=nb * 33).reshape(nb, 33), axis=1)
    width = (held < np.ceil(percentile * size)[:, None]).sum(1)
    odd = length > width[block]
    n_odd = np.bincount(block[odd], minlength=nb)
    packed = -(-size * width // 8)
    total = HEAD + packed + 5 * n_odd
    start = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), np.uint8)
    for k in range(4):
        out[start + k] = (low >> np.uint32(8 * k)) & np.uint32(255)
    out[start + 4], out[start + 5], out[start + 6] = width, size - 1, n_odd
    grid = np.zeros((nb, BLOCK), np.uint32)
    grid[block, place] = diff
    for w in np.unique(width).tolist():
        if not w:
            continue
        at = np.flatnonzero(width == w)
        cell = grid[at].astype("<u2" if w <= 16 else "<u4")
        bits = np.unpackbits(cell.view(np.uint8).reshape(len(at), BLOCK, -1), axis=2, count=w, bitorder="little")
        raw = np.packbits(bits.reshape(len(at), BLOCK * w), axis=1, bitorder="little")
        own, column = ragged(packed[at])
        out[start[at][own] + HEAD + column] = raw[own, column]
    own = block[odd]
    nth = ragged(n_odd)[1]
    first = start[own] + HEAD + packed[own]
    out[first + nth] = place[odd]
    for k in range(4):
        out[first + n_odd[own] + 4 * nth + k] = (diff[odd] >> np.uint32(8 * k)) & np.uint32(255)
    return out, total, per_doc


def unpack_block(payload: bytes, start: int = 0) -> np.ndarray:
    """The ids of the block that starts at byte ``start``."""
    raw = np.frombuffer(payload, np.uint8)
    low = int.from_bytes(payload[start : start + 4], "little")
    width, size, n_odd = int(raw[start + 4]), int(raw[start + 5]) + 1, int(raw[start + 6])
    n = -(-size * width // 8)
    body = start + HEAD
    values = np.zeros(size, np.uint32)
    if width:
        bits = np.unpackbits(raw[body : body + n], bitorder="little")[: size * width].reshape(size, width)
        values = (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)
    at = raw[body + n : body + n + n_odd]
    values[at] = np.frombuffer(payload, "<u4", n_odd, body + n + n_odd)
    return values + np.uint32(low)


def unpack(payload: bytes, block_starts: list[int]) -> np.ndarray:
    """All ids of a document."""
    parts = [unpack_block(payload, s) for s in block_starts]
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def token_ids(docs: DataFrame, vocabulary: str = BYTE_VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, block_starts, payload) of every row of ``docs``; a map without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def write(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(vocabulary, shared.value)
        for batch in batches(source):
            texts, i = batch.column(1), 0
            while i < len(texts):
                ids, n = [], 0
                first = i
                while i < len(texts) and n < _CHUNK:
                    ids.append(encode(machine, texts[i].as_py()))
                    n += len(ids[-1])
                    i += 1
                counts = np.array([len(x) for x in ids], np.int64)
                payload, size, per_doc = pack(np.concatenate(ids), counts)
                ends = np.cumsum(size)
                edge = np.concatenate([[0], np.cumsum(per_doc)])
                byte = np.concatenate([[0], ends])[edge]
                own = ragged(per_doc)[0]
                starts = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array((ends - size - byte[own]).astype(np.int32)))
                data = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(byte.astype(np.int64)), pa.py_buffer(payload)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i - first), pa.array(counts), starts, data], names=["doc_id", "n_tokens", "block_starts", "payload"])

    return narrow(docs).mapInArrow(write, SCHEMA)
