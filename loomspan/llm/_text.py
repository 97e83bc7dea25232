"""Whole-batch text kernels over Arrow string buffers (NumPy, no per-row Python).

A batch of texts is one byte buffer plus offsets; every routine here treats all
its documents at once. Null texts count as empty ones.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one pass of a kernel holds; bounds memory, never the input.
SLICE_BYTES = 1 << 20

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value per byte and an odd multiplier: the polynomial hash.
BYTE_CODE = _rng.integers(1, 2**63 - 1, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
MULTIPLIER = _U(0x9E3779B97F4A7C15)
INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: The same, with A-Z equal to a-z and every ASCII white space equal to a blank.
FOLDED_CODE = BYTE_CODE.copy()
FOLDED_CODE[ord("A") : ord("Z") + 1] = BYTE_CODE[ord("a") : ord("z") + 1]
FOLDED_CODE[list(b"\t\n\r\x0b\x0c")] = BYTE_CODE[32]
SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\r\x0b\x0c")] = True
#: Bytes of rows that Spark hands to a Python worker at a time; long texts come one by one.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_powers: dict[str, np.ndarray] = {}


def _return_memory() -> None:
    """Large arrays go back to the system as they are freed: a worker process lives on from task to task."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD, which would grow otherwise
    except (AttributeError, OSError):  # another C library
        pass


_return_memory()


def bound_batches(rows: DataFrame) -> DataFrame:
    """The same rows; their session hands them out in batches of BATCH_BYTES unless it was told another size than Spark's own."""
    conf = rows.sparkSession.conf
    if conf.get(_BATCH) in ("67108864b", "64m", "64MB"):
        conf.set(_BATCH, str(BATCH_BYTES))
    return rows


def narrow(docs: DataFrame, *more: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key as a bigint, text as a string and other columns as strings), whatever else ``docs`` has."""
    return bound_batches(docs).select(F.col(key).cast("bigint").alias(key), *(F.col(c).cast("string").alias(c) for c in (text, *more)))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(size - 1, base, _U)]))
        _powers[key] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> _U(33))
        h = h * _U(0xFF51AFD7ED558CCD)
        h = h ^ (h >> _U(29))
        h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; document i is bytes[offsets[i]:offsets[i+1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of whole documents, each of about ``most`` bytes (one long document may be more)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_hash(buf: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """H with H[i] = sum of code[b_j] * M**j over j < i; differences hash substrings."""
    out = np.zeros(len(buf) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(code[buf] * powers(MULTIPLIER, len(buf)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes[start:end] by content alone (its position is divided out), mixed with its length."""
    with np.errstate(over="ignore"):
        h = (prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start]
        return mix(h + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, per-document count) of maximal runs of non-blank bytes; none crosses documents."""
    n = len(buf)
    if not n:
        z = np.empty(0, np.int64)
        return z, z, np.zeros(len(off) - 1, np.int64)
    solid = ~SPACE[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    heads = off[:-1][off[:-1] < n]
    before[heads] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    tails = off[1:][off[1:] > 0] - 1
    after[tails] = False
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, np.diff(np.searchsorted(start, off))


def segment_sum(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of lengths ``counts`` (0 for an empty run)."""
    total = np.concatenate([[0], np.cumsum(values)])
    edge = np.concatenate([[0], np.cumsum(counts)])
    return total[edge[1:]] - total[edge[:-1]]


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, rank within the owner) for runs of the given lengths."""
    owner = np.repeat(np.arange(len(counts)), counts)
    edge = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - edge[owner]


def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that hold rows."""
    return (b for b in source if b.num_rows)
