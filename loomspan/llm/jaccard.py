"""Operator 8, n-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection.

A document is its set of hashed word trigrams (a shorter text is one n-gram of all its
words; ASCII case is folded). Documents with equal sets become one, so that thousands of
copies cost one row; what is joined are distinct sets, each known by a hash of its own.

Lone sets. A set in which too many n-grams are in no other set has no partner. Of the share
``SHARE`` of all n-grams, by hash, those that fall alone into their cell (of eight or more
an n-gram) are counted in every set; sets with more of them than a similar set could lack
get no keys. This only ever spares work: it leaves out no set that has a partner.

Tiles. Two sets whose similarity reaches the threshold share an n-gram of their prefixes:
the first ``size - ceil(threshold * size) + 1`` n-grams in any one order of all n-grams.
A tile is all sets with the same n-gram in their prefix. The order puts rare n-grams
first, so that tiles are small: n-grams that recur within a few million others are listed
with their counts, the ``LISTED`` commonest ones go last, by count, all others first, by
hash. Which ones are listed changes the cost, never the pairs. A tile of over ``TILE``
sets is split into blocks, and each two blocks meet in a tile of their own.

Bands. The sets of a tile are sorted by size, and each meets those of its band: no larger
than its own size over the threshold. A pair's own sizes say how much it must have in
common, and so how early in both orders one of its common n-grams must come: a tile whose
n-gram comes later in either set is none of the pair's. Of its tiles the first counts: three
prefix n-grams travel with each set, and a pair that both show to meet earlier is left to
that tile; what is left is made unique.

Keys travel packed: a row has some thousands of sets and the sorted keys of one part, as
differences. Signatures and verification. A set's signature has two bits or more for each n-gram, and in
each bit the parity of the n-grams hashed to it; the longer one of a pair is folded to the
length of the other. Half of (sizes less differing bits) is an upper bound of the overlap;
pairs whose bound reaches what the threshold needs go on. A pair is verified where its sets' leaders meet (a set's leader is the smallest
of itself and its partners, so that a group of copies meets in one place), in blocks of
about ``BLOCK_GRAMS``: the sorted arrays are made again from the text, sent there and
intersected exactly. Each place answers with one row a set (its partners counted, one
edge to its group), never with its pairs.

Defined results
  null, empty or blank text: no n-grams, no partner; null doc_id: left out;
  rows repeated with id and text: one document; the same id with another text: each text's
  set is joined on its own, and the document is in one class with the partners of both;
  ties: none, the join has no order; long texts: all their n-grams; a document without
  partner: no row; an empty table: no rows; extra columns: ignored by the join, kept by
  ``keep_one``, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm._text import FOLDED_CODE, batches, mix, narrow, prefix_hash, ragged, segment_sum, slices, span_hash, text_buffer, words
from loomspan.session import release, settle

N = 3
THRESHOLD = 0.6
#: Of all n-grams, by hash, those that tell lone sets.
SHARE = 0.7
#: Cells an n-gram, as a power of two: in one of eight or more n-grams another one's cell is met by chance.
ROOM_BITS = 3
#: N-grams of a part of the search for lone sets, and those that a task packs together for it.
PART_CELLS = 1 << 23
CELLS_AT_ONCE = 1 << 20
#: Sets that the sieve of those that go on is made for (8 bytes each reach the driver); beyond it all sets go on.
SIEVE_SETS = 1 << 23
#: Bits of the sieve, as a power of two: 16 MB at most.
SIEVE_BITS = 27
#: N-grams that are ordered by their count; 12 bytes each reach every executor, 25 MB at most.
LISTED = 1 << 21
#: N-grams that are counted together before the shuffle.
COUNT_AT_ONCE = 1 << 21
#: Bits of a prefix n-gram that make a tile's key; two n-grams with equal bits share a tile, which only costs time.
KEY_BITS = 40
#: Keys that a task packs together, and keys in a part of the join.
KEYS_AT_ONCE = 1 << 19
PART_KEYS = 1 << 20
#: Sets of one tile; a tile of more is split into blocks.
TILE = 1 << 14
#: N-grams of the sets with one leader in a block of the verification.
BLOCK_GRAMS = 1 << 20
#: Prefix n-grams that travel with a set, to tell whether a pair meets in an earlier tile.
PROOFS = 3
#: Rows of ids that may be broadcast; a larger set is joined by a shuffle.
BROADCAST_ROWS = 500_000
_PAIRS_AT_ONCE = 1 << 17
_FACTORS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def ngram_sets(buf: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending and distinct within each document, how many per document)."""
    start, end, per = words(buf, off)
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    h = span_hash(prefix_hash(buf, FOLDED_CODE), start, end)
    count = np.where(per > 0, np.maximum(per - n + 1, 1), 0)
    owner, rank = ragged(count)
    first = (np.cumsum(per) - per)[owner] + rank
    length = np.minimum(per, n)[owner]
    with np.errstate(over="ignore"):
        gram = length.astype(np.uint64) * _FACTORS[-1]
        for k in range(n):
            has = k < length
            gram = gram + np.where(has, h[np.minimum(first + k, len(h) - 1)] * _FACTORS[k % 4] + np.uint64(k), np.uint64(0))
    gram = mix(gram)
    edge = np.concatenate([[0], np.cumsum(count)])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        gram[a:b].sort()
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return gram[new], np.bincount(owner[new], minlength=len(off) - 1)


def set_hash(gram: np.ndarray, size: np.ndarray, salt: np.uint64 = np.uint64(0)) -> np.ndarray:
    """A 64-bit hash of each set, the same in any order."""
    with np.errstate(over="ignore"):
        return segment_sum(mix(gram ^ salt).view(np.int64), size)


def prefix_size(size: np.ndarray, threshold: float) -> np.ndarray:
    """N-grams of the exact prefix: what a set of ``size`` can lack in common with a similar one, and one more."""
    return np.where(size > 0, size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1, 0)


def signatures(gram: np.ndarray, size: np.ndarray) -> pa.Array:
    """The size (eight bytes) and a bitmap per set, of a power of two of bytes with two bits or more an n-gram: the parity of the n-grams of each bit."""
    n_bytes = 8 << np.maximum(0, np.frexp((size / 32).astype(np.float64))[1])
    owner = ragged(size)[0]
    base = np.concatenate([[0], np.cumsum(n_bytes + 8)])
    bit = base[:-1][owner] * 8 + 64 + ((gram >> np.uint64(17)).astype(np.int64) & (n_bytes[owner] * 8 - 1))
    parity = (np.bincount(bit, minlength=int(base[-1]) * 8) & 1).astype(np.uint8)
    data = np.packbits(parity, bitorder="little")
    data[base[:-1][:, None] + np.arange(8)] = size.astype("<u8").view(np.uint8).reshape(-1, 8)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(base.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _grams(source: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """(batch, first row, row past the last, n-grams, set sizes) of slices of the batches; text is column 1."""
    for batch in batches(source):
        buf, off = text_buffer(batch.column(1))
        for i, j in slices(off):
            yield batch, i, j, *ngram_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], n)


def set_table(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, hi, lo, size, bits) of every row with an id and an n-gram: two hashes of its set, its size and signature."""

    def sign(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, j, gram, size in _grams(source, n):
            out = pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(set_hash(gram, size, _FACTORS[0])), pa.array(set_hash(gram, size)), pa.array(size), signatures(gram, size)], names=["doc_id", "hi", "lo", "size", "bits"])
            yield out.filter(pa.array(size > 0))

    return narrow(docs).where("doc_id is not null").mapInArrow(sign, "doc_id bigint, hi bigint, lo bigint, size bigint, bits binary")


def lone_grams(docs: DataFrame, n: int, total: int, share: float = SHARE, part: int = PART_CELLS) -> DataFrame:
    """(hi, lone): of each set the n-grams, of those in the lower ``share`` of all by hash, that are alone in their cell.

    ``total`` n-grams in all sets make the number of cells; each part is a range of them.
    """
    bits = min(60, max(1, int(total)).bit_length() + ROOM_BITS)
    parts = max(1, -(-int(total * share) // part))
    bounds = np.array([int(share * (1 << bits)) * k // parts for k in range(parts + 1)], np.uint64)

    def emit(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []

        def send() -> pa.RecordBatch:
            hi, gram, size = (np.concatenate(h) for h in zip(*held))
            held.clear()
            cell, own = gram >> np.uint64(64 - bits), ragged(size)[0]
            where = np.searchsorted(bounds, cell, side="right") - 1
            order = np.argsort(where, kind="stable")  # set by set, ascending within a set
            cut = np.searchsorted(where[order], np.arange(parts + 1))
            rows = []
            for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                if a < b:
                    at = order[a:b]
                    who, first, count = np.unique(own[at], return_index=True, return_counts=True)
                    step = np.diff(cell[at], prepend=bounds[k])
                    step[first] = cell[at[first]] - bounds[k]
                    rows.append((k, *map(squeeze, (hi[who].view(np.uint64), count, step))))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k == 0 else pa.binary()) for k in range(4)], names=["part", "hi", "count", "steps"])

        for hi, gram, size in _new_sets(source, n, seen):
            held.append((hi, gram, size))
            if sum(len(h[1]) for h in held) >= CELLS_AT_ONCE:
                yield send()
        if held:
            yield send()

    def tell(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, held = None, []  # a part's rows so far

        def close() -> pa.RecordBatch:
            hi, count, cell = (np.concatenate(h) for h in zip(*held))
            held.clear()
            once = np.zeros(len(hi), bool)  # equal sets of several tasks are one
            once[np.unique(hi, return_index=True)[1]] = True
            cell, hi, count = cell[np.repeat(once, count)], hi[once], count[once]
            met = np.sort(cell)
            met = np.unique(met[1:][met[1:] == met[:-1]])
            lone = np.ones(len(cell), bool)
            for i in range(0, len(cell) if len(met) else 0, 1 << 20):
                some = cell[i : i + (1 << 20)]
                lone[i : i + (1 << 20)] = met[np.minimum(np.searchsorted(met, some), len(met) - 1)] != some
            return pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(segment_sum(lone, count))], names=["hi", "lone"])

        for batch in batches(source):
            for k, *row in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                if held and k != open_:
                    yield close()
                open_ = k
                hi, count, step = (unsqueeze(x.as_py()) for x in row)
                count, sum_ = count.astype(np.int64), np.cumsum(step, dtype=np.uint64)
                first = np.cumsum(count) - count
                cell = sum_ - np.repeat(sum_[first] - step[first], count)
                held.append((hi, count, cell.astype(np.uint32) if int(bounds[1]) < 1 << 32 else cell))
        if held:
            yield close()

    packed = narrow(docs).where("doc_id is not null").mapInArrow(emit, "part int, hi binary, count binary, steps binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(tell, "hi bigint, lone bigint").groupBy("hi").agg(F.sum("lone").alias("lone"))


def able(docs: DataFrame, heads: DataFrame, n: int, threshold: float, total: int) -> DataFrame:
    """(hi, size) of the sets that may have a partner: all but those with more lone n-grams than a similar set can lack."""
    most = F.col("size") - F.ceil(threshold * F.col("size") - 1e-9)
    return heads.select("hi", "size").join(lone_grams(docs, n, total), "hi", "left").where(F.coalesce("lone", F.lit(0)) <= most).select("hi", "size")


def sieve_of(sets: DataFrame, n_sets: int) -> np.ndarray | None:
    """A bitmap of 16 bits or more a set (within SIEVE_BITS) that lets all of ``sets`` pass; None lets everything pass."""
    if n_sets > SIEVE_SETS:
        return None
    bits = min(SIEVE_BITS, max(10, int(n_sets).bit_length() + 4))
    sieve = np.zeros(1 << (bits - 3), np.uint8)
    hi = sets.select("hi").toArrow()["hi"].to_numpy().view(np.uint64) >> np.uint64(64 - bits)
    np.bitwise_or.at(sieve, (hi >> np.uint64(3)).astype(np.int64), np.uint8(1) << (hi & np.uint64(7)).astype(np.uint8))
    return sieve


def _new_sets(source: Iterator[pa.RecordBatch], n: int, seen: set[int] | None = None, sieve: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(hi, n-grams, sizes) of the sets that pass the sieve, slice by slice; with ``seen``, of those not in it, which it takes up."""
    for _, _, _, gram, size in _grams(source, n):
        hi = set_hash(gram, size, _FACTORS[0])
        new = size > 0
        if sieve is not None:
            at = hi.view(np.uint64) >> np.uint64(64 - (len(sieve) * 8).bit_length() + 1)
            new &= (sieve[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        if seen is not None:
            if len(seen) > 1 << 20:  # only spares work
                seen.clear()
            for k in np.flatnonzero(new).tolist():
                new[k] = (h := int(hi[k])) not in seen
                seen.add(h)
        if new.any():
            yield hi[new], gram[np.repeat(new, size)], size[new]


def listed_grams(docs: DataFrame, n: int, most: int = LISTED, at_once: int = COUNT_AT_ONCE, sieve: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram ascending, its count) of the commonest n-grams, ``most`` of them at most.

    All documents whose sets pass the sieve are counted, ``at_once`` n-grams at a time; what occurs once in such
    a part isn't sent on, so a count is short by no more than the number of parts.
    """
    passing = docs.sparkSession.sparkContext.broadcast(sieve)

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def tally() -> pa.RecordBatch:
            gram = np.concatenate(held)
            held.clear()
            gram.sort()
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            times = np.diff(first, append=len(gram))
            first, times = first[times > 1], times[times > 1]
            return pa.RecordBatch.from_arrays([pa.array(gram[first].view(np.int64)), pa.array(times)], names=["gram", "n"])

        for _, gram, _ in _new_sets(source, n, sieve=passing.value):
            held.append(gram)
            if sum(map(len, held)) >= at_once:
                yield tally()
        if held:
            yield tally()

    counts = settle(narrow(docs).mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")))
    # counts by eighths of a doubling: the least level that leaves ``most`` n-grams or fewer
    level = F.floor(F.log2("n") * 8).cast("int")
    seen, least = 0, None
    for at, k in sorted((tuple(r) for r in counts.groupBy(level).count().collect()), reverse=True):
        seen += k
        if seen > most:
            break
        least = at
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    table = counts.where(level >= least).toArrow()
    gram, times = (np.asarray(table[c].to_numpy()) for c in ("gram", "n"))
    gram = gram.view(np.uint64)
    order = np.argsort(gram)
    return gram[order], np.minimum(times[order], (1 << 31) - 1).astype(np.int32)


def prefixes(gram: np.ndarray, size: np.ndarray, threshold: float, listed: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(set, n-gram, listed count or 0, rank) of every set's prefix, n-grams ascending within a set."""
    common, times = listed
    count = np.zeros(len(gram), np.int64)
    if len(common):
        slot = np.minimum(np.searchsorted(common, gram), len(common) - 1)
        count = np.where(common[slot] == gram, times[slot], 0)
    owner, rank = ragged(size)
    order = np.lexsort((count, owner))  # stable: by hash within a count
    place = np.empty(len(gram), np.int64)
    place[order] = rank
    keep = place < prefix_size(size, threshold)[owner]
    return owner[keep], gram[keep], count[keep], place[keep]


def split(own: np.ndarray, key: np.ndarray, count: np.ndarray, rank: np.ndarray, hi: np.ndarray, tile: int) -> tuple[np.ndarray, ...]:
    """The same with the n-grams of over ``tile`` sets replaced by one key for each two blocks that a set's block is in."""
    blocks = -(-count // tile)
    big = blocks > 1
    if not big.any():
        return own, key, count, rank
    at = np.flatnonzero(big)
    which, other = ragged(blocks[at])
    at = at[which]
    with np.errstate(over="ignore"):
        mine = (mix(hi[own[at]].view(np.uint64)) % blocks[at].astype(np.uint64)).astype(np.int64)
        pair = np.minimum(mine, other) * blocks[at] + np.maximum(mine, other)
        new = mix(key[at] + (pair.astype(np.uint64) + np.uint64(1)) * _FACTORS[1])
    return np.concatenate([own[~big], own[at]]), np.concatenate([key[~big], new]), np.concatenate([count[~big], count[at]]), np.concatenate([rank[~big], rank[at]])


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers of 0 on, packed: their bytes by place, those in use, compressed."""
    x = np.ascontiguousarray(x, "<u8")
    width = (int(x.max(initial=0)).bit_length() + 7) // 8
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return struct.pack("<IB", len(x), width) + (pa.Codec("zstd", 1).compress(raw, asbytes=True) if raw else b"")


def unsqueeze(data: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<IB", data)
    out = np.zeros((n, 8), np.uint8)
    if n and width:
        raw = pa.Codec("zstd").decompress(data[5:], decompressed_size=n * width, asbytes=True)
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def tile_keys(docs: DataFrame, n: int, threshold: float, listed: tuple[np.ndarray, np.ndarray], tile: int, parts: int, sieve: np.ndarray | None = None) -> DataFrame:
    """(part, keys, who, ranks, hi, size, proofs): every set that passes the sieve in each of its tiles, packed; equal sets of a task are one.

    A key is a prefix n-gram cut to KEY_BITS bits; ``parts`` equal ranges of keys are the
    parts. A row has the keys of one part and of some thousands of documents, in order, with the
    place in its list of sets (hi, size, proofs and their ranks) and the rank in the set's order of each.
    """
    shared = docs.sparkSession.sparkContext.broadcast((listed, sieve))
    bounds = (np.arange(parts + 1, dtype=object) * (1 << KEY_BITS) // parts).astype(np.uint64)
    names = ["part", "keys", "who", "ranks", "hi", "size", "proofs"]

    def emit(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []

        def send() -> pa.RecordBatch:
            first = np.cumsum([0, *(len(h[3]) for h in held)])
            own = np.concatenate([h[0] + f for h, f in zip(held, first)])
            key, rank, hi, size, proof = (np.concatenate([h[k] for h in held]) for k in range(1, 6))
            held.clear()
            order = np.argsort(key, kind="stable")
            own, key, rank = own[order], key[order], rank[order]
            cut = np.searchsorted(key, bounds)
            rows = []
            for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                if a < b:
                    who, at = np.unique(own[a:b], return_inverse=True)
                    packed = (np.diff(key[a:b], prepend=bounds[k]), at, rank[a:b], hi[who].view(np.uint64), size[who], proof[who].reshape(-1))
                    rows.append((k, *map(squeeze, packed)))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k == 0 else pa.binary()) for k in range(len(names))], names=names)

        listed, sieve = shared.value
        for hi, gram, size in _new_sets(source, n, seen, sieve):
            own, key, count, rank = split(*prefixes(gram, size, threshold, listed), hi, tile)
            key = key >> np.uint64(64 - KEY_BITS)
            order = np.lexsort((key, count == 0, own))
            place = ragged(np.bincount(own, minlength=len(size)))[1]
            # (key, rank) of each set's proofs; a key past all keys where there is none
            proof = np.full((len(size), 2 * PROOFS), 1 << KEY_BITS, np.uint64)
            for k in range(PROOFS):
                at = order[place == k]
                proof[own[at], 2 * k], proof[own[at], 2 * k + 1] = key[at], rank[at]
            held.append((own, key, rank, hi, size, proof))
            if sum(len(h[0]) for h in held) >= KEYS_AT_ONCE:
                yield send()
        if held and any(len(h[0]) for h in held):
            yield send()

    return narrow(docs).where("doc_id is not null").mapInArrow(emit, "part int, " + ", ".join(f"{c} binary" for c in names[1:]))


def tile_pairs(key: np.ndarray, who: np.ndarray, rank: np.ndarray, hi: np.ndarray, size: np.ndarray, proof: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b) of the pairs of whole tiles that are in a band and not known to meet earlier; ``who`` is a place in hi, size and proof."""
    order = np.argsort(key, kind="stable")
    key, who, rank = key[order], who[order], rank[order]
    same = np.concatenate([[False], key[1:] == key[:-1], [False]])
    met = np.flatnonzero(same[1:] | same[:-1])
    if not len(met):
        return
    met = met[np.lexsort((hi[who[met]], size[who[met]], key[met]))]
    own = hi[who[met]]
    once = np.ones(len(met), bool)
    once[1:] = (key[met[1:]] != key[met[:-1]]) | (own[1:] != own[:-1])
    met = met[once]
    key, who, rank = key[met], who[met], rank[met].astype(np.int64)
    hi, size, proof = hi[who], size[who].astype(np.int64), proof[who]
    early, ranks = proof[:, 0::2], proof[:, 1::2].astype(np.int64)
    tile = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    # sizes ascend within a tile: the partners of a set are the rows after it up to its band's end
    step = int(size.max()) + 1
    end = np.searchsorted(tile * step + size, tile * step + np.minimum(np.floor(size / threshold + 1e-9).astype(np.int64), step - 1), side="right")
    partners = end - np.arange(len(key)) - 1
    edge = np.concatenate([[0], np.cumsum(partners)])
    for first in range(0, int(edge[-1]), _PAIRS_AT_ONCE):
        at = np.arange(first, min(first + _PAIRS_AT_ONCE, int(edge[-1])))
        x = np.searchsorted(edge, at, side="right") - 1
        y = x + 1 + at - edge[x]
        # the places up to which the two orders hold an n-gram of any pair with enough in common
        need = np.ceil((size[x] + size[y]) * (threshold / (1 + threshold)) - 1e-9).astype(np.int64)
        left = np.flatnonzero((rank[x] <= size[x] - need) & (rank[y] <= size[y] - need))
        x, y, need = x[left], y[left], need[left]
        left = np.ones(len(x), bool)
        for p in range(PROOFS):
            mine = early[x, p]
            shown = (mine < key[x]) & (ranks[x, p] <= size[x] - need)
            for q in range(PROOFS):
                left &= ~(shown & (mine == early[y, q]) & (ranks[y, q] <= size[y] - need))
        x, y = x[left], y[left]
        yield np.minimum(hi[x], hi[y]), np.maximum(hi[x], hi[y])


def candidates(keys: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: the pairs of sets that meet in a tile's band, each once."""

    def meet(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, held = None, []  # a part's rows so far

        def close() -> Iterator[pa.RecordBatch]:
            first = np.cumsum([0, *(len(h[3]) for h in held)])
            who = np.concatenate([(h[1] + np.uint64(f)).astype(np.uint32) for h, f in zip(held, first)])
            key, rank, hi, size = (np.concatenate([h[k] for h in held]) for k in (0, 2, 3, 4))
            proof = np.concatenate([h[5] for h in held]).reshape(-1, 2 * PROOFS)
            held.clear()
            for found in tile_pairs(key, who, rank, hi.view(np.int64), size, proof, threshold):
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])

        for batch in batches(source):
            for row in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                if held and row[0] != open_:
                    yield from close()
                open_ = row[0]
                step, at, rank, *rest = (unsqueeze(x.as_py()) for x in row[1:])
                held.append((np.cumsum(step, dtype=np.uint64), at, rank.astype(np.uint32), *rest))  # keys from the start of the part's range
        if held:
            yield from close()

    return keys.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "a bigint, b bigint").distinct()


def meeting_places(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """(a, b, low, high): where each pair is looked at, by its sets' leaders and their blocks."""
    ends = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
    led = settle(ends.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("leader")).join(heads.select(F.col("hi").alias("u"), "size"), "u"))
    blocks = led.groupBy("leader").agg(F.ceil(F.sum("size") / BLOCK_GRAMS).alias("blocks"))
    homes = led.join(blocks, "leader").select("u", F.xxhash64("leader", F.pmod(F.xxhash64("u"), "blocks")).alias("home"))
    both = pairs.join(homes.toDF("a", "x"), "a").join(homes.toDF("b", "y"), "b")
    return both.select("a", "b", F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high"))


def visits(pairs: DataFrame) -> DataFrame:
    """(hi, low, high): the places that each set in pairs has to be at."""
    return pairs.select(F.col("a").alias("hi"), "low", "high").union(pairs.select("b", "low", "high")).distinct()


def at_places(sets: DataFrame, pairs: DataFrame, kind: str, compare, schema: str, answer) -> DataFrame:
    """Each place's sets (low, high, hi, what) and pairs brought together.

    ``compare(mine, others)`` tells which of a set's partners hold, ``answer(low, high, a, b)`` makes the rows of those pairs.
    """
    sent = sets.select("low", "high", F.col("hi").alias("a"), F.lit(None).cast("bigint").alias("b"), "what")
    asked = pairs.select("low", "high", "a", "b", F.lit(None).cast(kind).alias("what"))
    # sets (b is null) come before the pairs of their place
    rows = sent.union(asked).repartition("low", "high").sortWithinPartitions("low", "high", F.col("b").isNotNull(), "a")

    def look(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, known = None, {}
        for batch in batches(source):
            at, a, b = np.stack([batch.column(k).to_numpy() for k in range(2)], 1), batch.column(2).to_numpy(), batch.column(3)
            is_pair = np.array(b.is_valid())
            other = b.fill_null(0).to_numpy()
            what, slot = batch.column(4).filter(pa.array(~is_pair)), np.cumsum(~is_pair) - 1
            offsets = np.frombuffer(what.buffers()[1], np.int32, len(what) + 1, what.offset * 4) if len(what) else np.zeros(1, np.int32)
            flat = what.values.to_numpy().view(np.uint64) if kind != "binary" else np.frombuffer(what.buffers()[2], np.uint8) if len(what) else np.empty(0, np.uint8)
            cuts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(1) | (is_pair[1:] != is_pair[:-1]) | (is_pair[1:] & (a[1:] != a[:-1]))]))
            found: list[tuple[np.ndarray, ...]] = []
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows]):
                if tuple(at[i]) != here:
                    here, known = tuple(at[i]), {}
                if is_pair[i]:
                    good = compare(known[int(a[i])], [known[x] for x in other[i:j].tolist()])
                    found.append((np.broadcast_to(at[i], (int(good.sum()), 2)), np.full(good.sum(), a[i]), other[i:j][good]))
                else:
                    for k in range(i, j):
                        known[int(a[k])] = flat[offsets[slot[k]] : offsets[slot[k] + 1]].copy()
            if found:
                place, x, y = (np.concatenate(f) for f in zip(*found))
                yield answer(place[:, 0], place[:, 1], x, y)

    return rows.mapInArrow(look, schema)


def bounded(pairs: DataFrame, heads: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, low, high) whose signatures allow for enough in common."""

    def compare(mine: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        size = np.array([int(x[:8].view("<u8")[0]) for x in others])
        both = int(mine[:8].view("<u8")[0]) + size
        differing = np.empty(len(others), np.int64)
        length = np.array([len(x) - 8 for x in others])
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            x, y = mine[None, 8:], np.stack([others[k][8:] for k in at.tolist()])
            while x.shape[1] != y.shape[1]:  # the longer one is folded
                z = x if x.shape[1] > y.shape[1] else y
                z = z[:, : z.shape[1] // 2] ^ z[:, z.shape[1] // 2 :]
                x, y = (z, y) if x.shape[1] > y.shape[1] else (x, z)
            differing[at] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
        return (both - differing) / 2 >= both * (threshold / (1 + threshold)) - 1e-9

    def answer(low, high, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, low, high)], names=["a", "b", "low", "high"])

    sets = visits(pairs).join(heads.select("hi", F.col("bits").alias("what")), "hi")
    return at_places(sets, pairs, "binary", compare, "a bigint, b bigint, low bigint, high bigint", answer)


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, smallest node that the pairs connect it with, its pairs) of the nodes in pairs."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, new = np.minimum(label[u], label[v]), label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label], np.bincount(at, minlength=len(nodes))
        label = new


def verify(docs: DataFrame, heads: DataFrame, pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(hi, near, links): of each set in pairs at or above the threshold its partners, and a member of its group; a row for each place where pairs meet."""
    guests = visits(pairs).groupBy("hi").agg(F.collect_list(F.struct("low", "high")).alias("places"))
    guests = settle(guests.join(heads, "hi").select(F.col("rep").alias("guest"), "hi", "places"))
    few = guests.agg(F.sum(F.size("places"))).first()[0] or 0
    wanted = narrow(docs).join(F.broadcast(guests) if few <= BROADCAST_ROWS else guests, F.col("doc_id") == F.col("guest")).select("hi", "text", "places")

    def arrays(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, j, gram, size in _grams(source, n):
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(gram.view(np.int64)))
            hi = batch.column(0).slice(i, j - i)
            # an id may have several texts; only the one whose set was asked for goes on
            yield pa.RecordBatch.from_arrays([hi, sets, batch.column(2).slice(i, j - i)], names=["hi", "grams", "places"]).filter(pa.array(set_hash(gram, size, _FACTORS[0]) == hi.to_numpy()))

    sent = wanted.mapInArrow(arrays, "hi bigint, grams array<bigint>, places array<struct<low: bigint, high: bigint>>")
    sets = sent.select(F.explode("places").alias("p"), "hi", F.col("grams").alias("what")).select("p.*", "hi", "what")

    def compare(mine: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        size, merged = np.array([len(x) for x in others]), np.concatenate(others)
        common = segment_sum(mine[np.minimum(np.searchsorted(mine, merged), len(mine) - 1)] == merged, size)
        return common / (len(mine) + size - common) >= threshold - 1e-9

    def answer(low, high, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in star(a, b)], names=["hi", "near", "links"])

    return at_places(sets, pairs, "array<bigint>", compare, "hi bigint, near bigint, links bigint", answer)


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, most: int = LISTED, at_once: int = COUNT_AT_ONCE, tile: int = TILE) -> DataFrame:
    """(doc_id, class_id, n_links) of every document that has a partner.

    ``class_id`` is the smallest id of the documents that equal or similar sets connect
    it with; ``n_links`` counts the other sets at or above the threshold to its own set
    (equal sets are one; a document of several texts has the sum of its sets' links).
    """
    sets = settle(set_table(docs, n))
    heads = settle(sets.groupBy("hi", "lo", "size").agg(F.min("doc_id").alias("rep"), (F.min("doc_id") < F.max("doc_id")).alias("copied"), F.any_value("bits").alias("bits")))
    release(docs.sparkSession)
    total = heads.agg(F.sum("size")).first()[0] or 0
    on = settle(able(docs, heads, n, threshold, total))
    release(docs.sparkSession)
    n_sets, total = on.agg(F.count("hi"), F.coalesce(F.sum("size"), F.lit(0))).first()
    sieve = sieve_of(on, n_sets)
    listed = listed_grams(docs, n, most, at_once, sieve)
    pairs = settle(candidates(tile_keys(docs, n, threshold, listed, tile, max(1, -(-int((1 - threshold) * total) // PART_KEYS)), sieve), threshold))
    release(docs.sparkSession)
    pairs = settle(meeting_places(pairs, heads))
    release(docs.sparkSession)
    pairs = settle(bounded(pairs, heads, threshold))
    release(docs.sparkSession)
    near = settle(verify(docs, heads, pairs, n, threshold))
    release(docs.sparkSession)
    # the texts of one document are in one class
    own = sets.groupBy("doc_id").agg(F.min("hi").alias("u"), F.max("hi").alias("last")).where("u < last")
    own = sets.join(own, "doc_id").where("hi > u").select("u", F.col("hi").alias("v"))
    roots = groups(near.where("hi <> near").select("hi", "near").union(own))
    links = near.groupBy("hi").agg(F.sum("links").alias("n_links"))
    known = heads.join(roots.withColumnRenamed("node", "hi"), "hi", "left").join(links, "hi", "left").where("copied or root is not null")
    known = settle(known.select("hi", "lo", "size", "rep", "copied", F.coalesce("root", "hi").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    classes = known.groupBy("root").agg(F.min("rep").alias("class_id"), (F.max("copied") | (F.min("rep") < F.max("rep"))).alias("several")).where("several")
    rows = sets.select("doc_id", "hi", "lo", "size").distinct().join(known.join(classes, "root"), ["hi", "lo", "size"])
    return rows.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))


def groups(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the group that the edges (two columns) connect, for every node in an edge.

    Labels are taken from neighbours and then from the label's own label until none
    changes; each round is written to the shared folder.
    """
    edges = edges.toDF("u", "v")
    links = settle(edges.union(edges.select("v", "u")).distinct())
    labels = settle(links.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")))
    while True:
        around = links.join(labels, links.v == labels.node).groupBy("u").agg(F.min("root").alias("near"))
        step = labels.join(around, labels.node == around.u, "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("new"))
        roots = labels.select(F.col("node").alias("of"), F.col("root").alias("up"))
        step = settle(step.join(roots, step.new == roots.of, "left").select("node", "root", F.least("new", F.coalesce("up", "new")).alias("new")))
        labels = step.select("node", F.col("new").alias("root"))
        if step.where("new <> root").isEmpty():
            return labels


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all their columns unchanged, less those of a class that have not its smallest id.

    Of rows with the same id and text one stays.
    """
    gone = settle(jaccard_join(docs, **options).where("class_id < doc_id").select(F.col("doc_id").alias("gone")))
    lost = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    kept = docs.join(lost, docs["doc_id"] == lost["gone"], "left_anti")
    again = settle(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("again")).count().where("count > 1").select("again"))
    if again.isEmpty():
        return kept
    twice = kept.join(again, kept["doc_id"] == again["again"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, kept["doc_id"] == again["again"], "left_anti").union(twice)


def jaccard_sql(docs: str = "documents", threshold: float = THRESHOLD) -> str:
    """The same in DuckDB, by counting shared n-gram strings of distinct sets and closing the links."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with recursive jwords as (
  select doc_id, regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^ \\t\\n\\r\\x0B\\x0C]+') as ws from {docs} where doc_id is not null and text is not null
), jgrams as (
  select distinct doc_id, array_to_string(ws[i:i + {N - 1}], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - {N - 2}, 2))) as i from jwords where len(ws) > 0)
), jsets as (select doc_id, count(*) as n, md5(array_to_string(list(g order by g), '|')) as h from jgrams group by doc_id
), jreps as (select doc_id, n, min(doc_id) over (partition by h, n) as rep, count(*) over (partition by h, n) as copies from jsets
), jdistinct as (select g.doc_id, g.g, r.n from jgrams g join jreps r using (doc_id) where r.doc_id = r.rep
), jcommon as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as shared from jdistinct a join jdistinct b on a.g = b.g and a.doc_id < b.doc_id group by all
), pairs as (select a, b from jcommon where shared / (na + nb - shared) >= {threshold} - 1e-9
), both_ways as (select a, b from pairs union all select b, a from pairs
), reach as (select a, b from both_ways union select r.a, p.b from reach r join both_ways p on r.b = p.a
), root as (select a, least(a, min(b)) as root from reach group by a
), degree as (select a, count(*) as n_links from both_ways group by a)
select r.doc_id, coalesce(root, rep) as class_id, coalesce(n_links, 0)::bigint as n_links
from jreps r left join root on root.a = rep left join degree on degree.a = rep
where copies > 1 or root is not null"""
