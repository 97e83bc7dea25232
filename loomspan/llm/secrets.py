"""Operator 6, secret scans: sliding-window Shannon entropy per character class.

A candidate is a maximal run of at least ``window`` characters out of
``A-Z a-z 0-9 + / _ -``. For every character class the entropy of each window of
``window`` characters that lies wholly in the class and has both a letter and a
digit is kept up by incremental counts: the character that leaves and the one that
enters change two terms of the sum. A candidate is reported for a class if its
highest window reaches the class's threshold, unless an allow-list expression
matches the candidate.

Defined results
  null or empty text, no candidate: no row; null doc_id: reported with a null id;
  repeated rows: reported once each; ties between windows: the first is given;
  long texts and long candidates: every window is looked at;
  an empty table: no rows; other columns: ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomspan.llm._text import batches, narrow, slices, text_buffer

WINDOW = 20
#: class -> (members, least entropy in bits of a window)
CLASSES = {
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.8),
    "hex": ("0123456789ABCDEFabcdef", 3.0),
}
#: The same with classes for keys of fewer characters or one case: (members, least entropy, window). The least
#: is under the 0.1 % quantile of windows of random characters out of the class (A-Z and 2-7 for one case).
KEY_CLASSES: dict[str, tuple] = CLASSES | {
    "upper": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 2.89, 16),
    "lower": ("abcdefghijklmnopqrstuvwxyz0123456789", 2.89, 16),
    "alphanumeric": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 3.15, 16),
}
#: Candidates that one of these matches are placeholders or identifiers, not secrets.
ALLOW = (
    "(?i)example|placeholder|dummy|changeme|your[_-]?(key|token)",
    "0123456789|1234567890|abcdefghij",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
SCHEMA = "doc_id bigint, char_start bigint, n_chars bigint, char_class string, max_entropy double, window_start bigint"

_CANDIDATE = np.zeros(256, bool)
_CANDIDATE[list(CLASSES["base64"][0].encode())] = True


def best_window(text: str, members: str, window: int = WINDOW) -> tuple[float, int] | None:
    """(entropy, start) of the first window with the highest entropy, or None; counts are kept incrementally."""
    allowed, counts, total = set(members), {}, 0.0
    letters = digits = run = 0
    term = [0.0, *(c * math.log2(c) for c in range(1, window + 1))]
    best: tuple[float, int] | None = None
    for i, ch in enumerate(text):
        if ch not in allowed:
            counts, total, letters, digits, run = {}, 0.0, 0, 0, 0
            continue
        if run == window:
            out = text[i - window]
            c = counts[out]
            counts[out] = c - 1
            total += term[c - 1] - term[c]
            letters -= out.isalpha()
            digits -= out.isdigit()
        else:
            run += 1
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += term[c + 1] - term[c]
        letters += ch.isalpha()
        digits += ch.isdigit()
        if run == window and letters and digits:
            entropy = round(math.log2(window) - total / window, 6)
            if best is None or entropy > best[0]:
                best = (entropy, i - window + 1)
    return best


def secret_scan(docs: DataFrame, window: int = WINDOW, classes: dict[str, tuple] | None = None, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """One row per candidate and class that reaches the class's threshold; a map without a shuffle.

    ``char_start`` is the 0-based character position of the candidate in the text,
    ``window_start`` that of its best window within the candidate. A class without a window has ``window``.
    """
    classes = {name: (members, least, *(own or [window])) for name, (members, least, *own) in (classes or CLASSES).items()}
    shortest = min(w for _, _, w in classes.values())

    def scan(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suppress = [re.compile(x) for x in allow]
        for batch in batches(source):
            ids = batch.column(0)
            buf, off = text_buffer(batch.column(1))
            rows: list[tuple] = []
            for i, j in slices(off):
                part, edge = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                inside = np.zeros(len(part) + 2, np.int8)
                inside[1:-1] = _CANDIDATE[part]
                # a run may touch the next document's first bytes: the edges cut it
                start, end = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
                cut = edge[1:-1]
                cut = cut[(cut > 0) & (cut < len(part))]
                cut = np.unique(cut[inside[cut].astype(bool) & inside[cut + 1].astype(bool)])
                start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
                keep = end - start >= shortest
                for s, e in zip(start[keep].tolist(), end[keep].tolist()):
                    d = int(np.searchsorted(edge, s, side="right")) - 1
                    candidate = part[s:e].tobytes().decode()
                    if any(x.search(candidate) for x in suppress):
                        continue
                    for name, (members, least, width) in classes.items():
                        found = best_window(candidate, members, width)
                        if found and found[0] >= least:
                            at = int(np.count_nonzero((part[edge[d] : s] & 0xC0) != 0x80))
                            rows.append((ids[i + d].as_py(), at, e - s, name, found[0], found[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64()))],
                names=["doc_id", "char_start", "n_chars", "char_class", "max_entropy", "window_start"],
            )

    return narrow(docs).mapInArrow(scan, SCHEMA)


def secret_sql(window: int = WINDOW) -> str:
    """The same in DuckDB, every window counted afresh."""
    allowed = " or ".join(f"regexp_matches(c, '{x}')" for x in ALLOW)
    kinds = ", ".join(f"('{name}', '{'[0-9A-Fa-f]' if name == 'hex' else '[A-Za-z0-9+/_-]'}', {least})" for name, (_, least) in CLASSES.items())
    return f"""
with hit as (
  select doc_id, regexp_extract_all(text, '[A-Za-z0-9+/_-]{{{window},}}') as cs, regexp_split_to_array(text, '[A-Za-z0-9+/_-]{{{window},}}') as gaps
  from documents where regexp_matches(text, '[A-Za-z0-9+/_-]{{{window},}}')
), one as (
  select doc_id, k, cs[k] as c, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(cs[1:k-1], lambda x: length(x))), 0) as char_start
  from (select doc_id, cs, gaps, unnest(range(1, len(cs) + 1)) as k from hit)
), kind(char_class, members, least) as (values {kinds}
), win as (
  select doc_id, k, char_start, c, char_class, least, w, substr(c, w::int + 1, {window}) as s
  from (select one.*, kind.*, unnest(range(0, length(c) - {window} + 1)) as w from one, kind where not ({allowed}))
  where regexp_full_match(substr(c, w::int + 1, {window}), members || '+')
    and regexp_matches(substr(c, w::int + 1, {window}), '[0-9]') and regexp_matches(substr(c, w::int + 1, {window}), '[A-Za-z]')
), letter as (
  select doc_id, k, char_start, c, char_class, least, w, ch, count(*) as n
  from (select *, unnest(string_split(s, '')) as ch from win) group by all
), entropy as (
  select doc_id, k, char_start, c, char_class, least, w, round(log2({window}::double) - sum(n * log2(n::double)) / {window}, 6) as h from letter group by all
)
select doc_id, char_start::bigint as char_start, length(c)::bigint as n_chars, char_class, max(h) as max_entropy, arg_min(w, (-h, w))::bigint as window_start
from entropy group by doc_id, k, char_start, c, char_class, least having max(h) >= least
"""
