"""Operator 9, substring dedup: sliding spans of consecutive sentences.

A sentence ends with a word whose last character is ``.``, ``!`` or ``?``, at a line
break, or with the text. From every sentence starts one span: the shortest run of at
least two sentences with at least twenty words. With ``ends`` a second span, the shortest
such run, ends at every sentence: a repeated run of several sentences is covered by the
spans that start or end in it, so that its last sentences go too. All spans of all documents are joined
by two hashes of 64 bits (a task sends one row of a span on, the others are known to be repeats); the first (by id, then by place) stays, and every sentence that any
other one covers is removed. The words of what stays are joined by single blanks and
its sentences by line breaks; a document without a repeated span is left as it is.

Defined results
  null, empty or one-sentence text: no span, unchanged; null doc_id: unchanged, its spans don't count;
  rows repeated with the same id: one document, so none of them loses a sentence to the other;
  a span repeated within a document: its later places are removed; long texts: all their spans;
  ties: none, (id, place) orders all; an empty table: no rows; extra columns: kept by ``deduplicated``, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm._text import INVERSE, MULTIPLIER, batches, bound_batches, mix, narrow, powers, prefix_hash, ragged, slices, span_hash, text_buffer, words

SENTENCES = 2
WORDS = 20
#: Spans that a task compares before it sends them on.
AT_ONCE = 1 << 20
_OTHER = np.uint64(0xA0761D6478BD642F)
_OTHER_INVERSE = np.uint64(pow(0xA0761D6478BD642F, -1, 1 << 64))
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def sentences(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word start, word end, first word of each sentence, word past it, sentences per document)."""
    start, end, per = words(buf, off)
    last = np.zeros(len(start), bool)
    if len(start):
        breaks = np.concatenate([[0], np.cumsum(buf == 10)])
        last = _STOP[buf[end - 1]]
        last[:-1] |= breaks[start[1:]] > breaks[end[:-1]]
        tail = np.cumsum(per)[per > 0] - 1
        last[tail] = True
    past = np.flatnonzero(last) + 1
    first = np.concatenate([[0], past[:-1]]) if len(past) else past
    return start, end, first, past, np.diff(np.searchsorted(first, np.concatenate([[0], np.cumsum(per)])))


def spans(buf: np.ndarray, off: np.ndarray, ends: bool = False) -> tuple[np.ndarray, ...]:
    """(hash, another, document, first sentence, sentences) of every span."""
    start, end, first, past, per = sentences(buf, off)
    if not len(first):
        z = np.empty(0, np.int64)
        return z, z, z, z, z
    h = span_hash(prefix_hash(buf), start, end)
    with np.errstate(over="ignore"):
        whole = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(MULTIPLIER, len(h)))])
        again = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + _OTHER) * powers(_OTHER, len(h)))])
    doc, place = ragged(per)
    limit = np.cumsum(per)[doc]
    i = np.arange(len(first))
    j = np.maximum(i + SENTENCES - 1, np.searchsorted(past, first + WORDS))
    ok = j < limit
    if ends:
        last = i.copy()
        back = np.minimum(last - SENTENCES + 1, np.searchsorted(first, past - WORDS, side="right") - 1)
        # a span that starts and ends where one from its start does is given once
        fits = (back >= limit - per[doc]) & (j[np.maximum(back, 0)] != last)
        i, j = np.concatenate([i[ok], back[fits]]), np.concatenate([j[ok], last[fits]])
        doc, place = doc[i], place[i]
    else:
        i, j, doc, place = i[ok], j[ok], doc[ok], place[ok]
    a, b = first[i], past[j]
    with np.errstate(over="ignore"):
        code = mix((whole[b] - whole[a]) * powers(INVERSE, len(whole))[a] + (b - a).astype(np.uint64))
        other = mix((again[b] - again[a]) * powers(_OTHER_INVERSE, len(again))[a] + (b - a).astype(np.uint64))
    return code.view(np.int64), other.view(np.int64), doc, place, j - i + 1


def span_table(docs: DataFrame, ends: bool = False) -> DataFrame:
    """(span, other, doc_id, place, n, later) of every span of every row with an id; ``later``: not the first in its task."""
    names = ["span", "other", "doc_id", "place", "n", "later"]

    def find(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def send() -> Iterator[pa.RecordBatch]:
            rows = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            order = np.lexsort((rows[3], rows[2], rows[1], rows[0]))
            rows = [x[order] for x in rows]
            later = np.zeros(len(order), bool)
            # rows repeated with an id are one place
            later[1:] = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])
            same = np.zeros(len(order), bool)
            same[1:] = later[1:] & (rows[2][1:] == rows[2][:-1]) & (rows[3][1:] == rows[3][:-1])
            rows, later = [x[~same] for x in rows], later[~same]
            for i in range(0, len(later), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 17)]) for x in (*rows, later)], names=names)

        for batch in batches(source):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            buf, off = text_buffer(batch.column(1))
            for i, j in slices(off):
                code, other, doc, place, n = spans(buf[off[i] : off[j]], off[i : j + 1] - off[i], ends)
                held.append((code, other, ids[i:j][doc], place.astype(np.int32), n.astype(np.int32)))
                if sum(len(x[0]) for x in held) >= AT_ONCE:
                    yield from send()
        if held:
            yield from send()

    return narrow(docs).where("doc_id is not null").mapInArrow(find, "span bigint, other bigint, doc_id bigint, place int, n int, later boolean")


def repeated(docs: DataFrame, ends: bool = False) -> DataFrame:
    """(doc_id, cuts): the spans (place, n) of each document that are not the first of their kind.

    One shuffle by the span's hashes. A span that a third of all documents share has one row
    a task to be ranked; the rows known to be repeats go to partitions of their own.
    """
    own = F.when(F.col("later"), F.xxhash64("doc_id", "place").bitwiseOR(1)).otherwise(0)
    order = Window.partitionBy("span", "other", "own").orderBy("doc_id", "place")
    later = span_table(docs, ends).withColumn("own", own).withColumn("nth", F.rank().over(order)).where("later or nth > 1")
    return later.groupBy("doc_id").agg(F.collect_list(F.struct("place", "n")).alias("cuts"))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_sentences", T.IntegerType()), T.StructField("n_removed", T.IntegerType())]))
def _cut(text: pd.Series, cuts: pd.Series) -> pd.DataFrame:
    buf, off = text_buffer(pa.array(text, pa.string()))
    rows = []
    for d, marks in enumerate(cuts):
        part = buf[off[d] : off[d + 1]]
        start, end, first, past, _ = sentences(part, np.array([0, len(part)]))
        if marks is None or not len(marks):
            rows.append((text.iloc[d], len(first), 0))
            continue
        edge = np.zeros(len(first) + 1, np.int64)
        at, n = np.array([m["place"] for m in marks]), np.array([m["n"] for m in marks])
        np.add.at(edge, at, 1)
        np.add.at(edge, np.minimum(at + n, len(first)), -1)
        gone = np.cumsum(edge[:-1]) > 0
        raw = part.tobytes()
        kept = [b" ".join(raw[start[w] : end[w]] for w in range(first[s], past[s])) for s in np.flatnonzero(~gone)]
        rows.append((b"\n".join(kept).decode(), len(first), int(gone.sum())))
    return pd.DataFrame(rows, columns=["text", "n_sentences", "n_removed"])


def substring_dedup(docs: DataFrame, ends: bool = False) -> DataFrame:
    """(doc_id, n_sentences, n_removed, text) of the documents that lose sentences; all others stay as they are."""
    cut = repeated(docs, ends)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(cut, "doc_id")
    return rows.select("doc_id", _cut("text", "cuts").alias("r")).select("doc_id", "r.n_sentences", "r.n_removed", "r.text")


def deduplicated(docs: DataFrame, ends: bool = False) -> DataFrame:
    """All rows and columns of ``docs``, with repeated spans removed from their texts."""
    tag = f"__{uuid.uuid4().hex}"  # no column of docs has this name
    cut = repeated(docs, ends).select(F.col("doc_id").alias(f"{tag}_id"), F.col("cuts").alias(tag))
    rows = bound_batches(docs).join(cut, docs["doc_id"] == cut[f"{tag}_id"], "left")
    clean = F.when(F.col(tag).isNull(), docs["text"]).otherwise(_cut(docs["text"], F.col(tag))["text"])
    return rows.select(*[clean.alias("text") if c == "text" else docs[c] for c in docs.columns])


def dedup_sql(ends: bool = False) -> str:
    """The same in DuckDB, by joining the spans' texts."""
    back = f"""
  union select b.doc_id, max(a.place) as place, b.place as till from sent a join sent b on a.doc_id = b.doc_id and b.place >= a.place + {SENTENCES - 1} and b.upto - a.upto + a.n >= {WORDS} group by b.doc_id, b.place""" if ends else ""
    blank = r"[ \t\r\x0B\x0C]"
    return f"""
with lines as (
  select doc_id, string_split(regexp_replace(text, '([.!?]){blank}+', '\\1' || chr(10), 'g'), chr(10)) as ls from documents where doc_id is not null and text is not null
), raw as (select doc_id, unnest(ls) as l, generate_subscripts(ls, 1) as k from lines
), worded as (select doc_id, k, regexp_extract_all(l, '[^ \\t\\n\\r\\x0B\\x0C]+') as ws from raw
), sent as (
  select doc_id, row_number() over (partition by doc_id order by k) - 1 as place, array_to_string(ws, ' ') as s, len(ws) as n,
         sum(len(ws)) over (partition by doc_id order by k) as upto
  from worded where len(ws) > 0
), reach as (
  select a.doc_id, a.place, min(b.place) as till from sent a join sent b on a.doc_id = b.doc_id and b.place >= a.place + {SENTENCES - 1} and b.upto - a.upto + a.n >= {WORDS} group by all{back}
), span as (
  select r.doc_id, r.place, r.till, string_agg(s.s, ' ' order by s.place) as body from reach r join sent s on s.doc_id = r.doc_id and s.place between r.place and r.till group by all
), later as (select doc_id, place, till from (select *, rank() over (partition by body order by doc_id, place) as nth from span) where nth > 1
), gone as (select distinct s.doc_id, s.place from sent s join later l on s.doc_id = l.doc_id and s.place between l.place and l.till
)
select s.doc_id, count(*)::int as n_sentences, count(g.place)::int as n_removed,
       coalesce(string_agg(s.s, chr(10) order by s.place) filter (where g.place is null), '') as text
from sent s left join gone g on g.doc_id = s.doc_id and g.place = s.place
where s.doc_id in (select doc_id from later)
group by s.doc_id
"""
