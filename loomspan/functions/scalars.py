"""Scalar functions as column expressions: pair numbering, text helpers, polynomials, downsampling, sub-words."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def pair_to_index(i: Column, j: Column) -> Column:
    """The number of the pair (i, j), i > j >= 0, counted row by row."""
    return (i * (i - 1) / 2).cast("bigint") + j


def index_to_pair(n: Column) -> tuple[Column, Column]:
    i = F.floor((F.sqrt(8 * n + 1) + 1) / 2)
    return i, n - (i * (i - 1) / 2).cast("bigint")


def is_numeric(text: Column) -> Column:
    return text.try_cast("double").isNotNull()


def infer(text: Column) -> Column:
    """'int', 'float', 'str' or null (empty) by what the text can be read as."""
    t = F.trim(text)
    return F.when(t == "", None).when(t.try_cast("bigint").isNotNull() & ~t.contains("."), "int").when(t.try_cast("double").isNotNull(), "float").when(t.isNotNull(), "str")


def without_quotes(line: Column) -> Column:
    return F.regexp_replace(line, '"[^"]*"', "")


def split_quoted(line: Column, sep: str = ",") -> Column:
    """Parts between separators outside double quotes, quotes taken off."""
    parts = F.regexp_extract_all(F.concat(line, F.lit(sep)), F.lit(rf'((?:[^"\Q{sep}\E]|"[^"]*")*)\Q{sep}\E'), F.lit(1))
    return F.transform(parts, lambda p: F.replace(p, F.lit('"'), F.lit("")))


def first_code_block(text: Column) -> Column:
    """The body of the first fenced block, or the text itself."""
    body = F.regexp_extract(text, r"```[^\n]*\n([\s\S]*?)```", 1)
    return F.when(text.rlike(r"```[^\n]*\n[\s\S]*?```"), body).otherwise(text)


def unwrapped(text: Column) -> Column:
    """Without surrounding white space, quotes and backticks."""
    return F.regexp_replace(text, "^[\\s'\"`]+|[\\s'\"`]+$", "")


def non_ascii(text: Column) -> Column:
    """Array of (char, index) of the characters beyond ASCII; texts without one cost one regular expression."""
    every = F.filter(F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("char"), i.alias("index"))), lambda x: x.char.rlike(r"[^\x00-\x7F]"))
    return F.when(text.rlike(r"[^\x00-\x7F]"), every).otherwise(F.array().cast("array<struct<char:string,index:int>>"))


def is_text(text: Column) -> Column:
    return F.instr(F.substring(text, 1, 1024), "\x00") == 0


def to_ascii(text: Column, table: dict[str, str]) -> Column:
    """Replaces by the table: single characters in one pass, longer replacements one after another."""
    single = {k: v for k, v in table.items() if len(k) == len(v) == 1}
    out = F.translate(text, "".join(single), "".join(single.values())) if single else text
    for k, v in table.items():
        if k not in single:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def paragraphs(text: Column, max_tokens: int = 42) -> Column:
    """Greedy packing of paragraphs; a paragraph counts max(words, length / 5) tokens and a pack holds at most max_tokens, or one paragraph."""
    parts = F.filter(F.split(text, r"\n\n"), lambda p: F.trim(p) != "")
    size = lambda p: F.greatest(F.size(F.split(F.trim(p), r"\s+")), F.floor(F.length(p) / 5).cast("int"))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def add(state: Column, p: Column) -> Column:
        fits = (state.n == 0) | (state.n + size(p) <= max_tokens)
        return F.when(fits, F.struct(state.done.alias("done"), F.when(state.n == 0, p).otherwise(F.concat(state.open, F.lit("\n\n"), p)).alias("open"), (state.n + size(p)).cast("int").alias("n"))).otherwise(
            F.struct(F.concat(state.done, F.array(state.open)).alias("done"), p.alias("open"), size(p).cast("int").alias("n"))
        )

    return F.aggregate(parts, empty, add, lambda s: F.when(s.n > 0, F.concat(s.done, F.array(s.open))).otherwise(s.done))


def horner(x: Column, coefficients: Sequence[float]) -> Column:
    """A polynomial with the highest power's coefficient first."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + F.lit(float(c))
    return out


def derivative(coefficients: Sequence[float]) -> list[float]:
    n = len(coefficients) - 1
    return [c * (n - k) for k, c in enumerate(coefficients[:-1])] or [0.0]


def integral(coefficients: Sequence[float], constant: float = 0.0) -> list[float]:
    n = len(coefficients)
    return [c / (n - k) for k, c in enumerate(coefficients)] + [constant]


def interpolate(x: Sequence[float], y: Sequence[float], slopes: dict[int, float] | None = None) -> list[float]:
    """Coefficients of the least polynomial through the points (and slopes at some), exact in rationals."""
    rows, right = [], []
    n = len(x) + len(slopes or {})
    for a, b in zip(x, y):
        rows.append([Fraction(a) ** (n - 1 - k) for k in range(n)])
        right.append(Fraction(b))
    for i, s in (slopes or {}).items():
        rows.append([(n - 1 - k) * Fraction(x[i]) ** (n - 2 - k) if n - 1 - k > 0 else Fraction(0) for k in range(n)])
        right.append(Fraction(s))
    for c in range(n):
        p = next(r for r in range(c, n) if rows[r][c] != 0)
        rows[c], rows[p], right[c], right[p] = rows[p], rows[c], right[p], right[c]
        for r in range(n):
            if r != c and rows[r][c] != 0:
                f = rows[r][c] / rows[c][c]
                rows[r] = [u - f * v for u, v in zip(rows[r], rows[c])]
                right[r] -= f * right[c]
    return [float(right[k] / rows[k][k]) for k in range(n)]


def spline(x: Column, knots: Sequence[float], pieces: Sequence[Sequence[float]]) -> Column:
    """The piece of the last knot at or below x; the first one below all knots."""
    out = horner(x, pieces[0])
    for k, p in zip(knots[1:], pieces[1:]):
        out = F.when(x >= k, horner(x, p)).otherwise(out)
    return out


def interpolate_1d(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Linear between neighbouring points, clipped to the observed range of values outside them."""
    pts = sorted(points)
    out = F.lit(float(pts[0][1]))
    for (a, fa), (b, fb) in zip(pts, pts[1:]):
        out = F.when(x >= a, F.lit(float(fa)) + (x - a) * ((fb - fa) / (b - a))).otherwise(out)
    return F.when(x >= pts[-1][0], F.lit(float(pts[-1][1]))).otherwise(out)


def edge_heavy(total: int, sample: int, bias: float = 2.0) -> list[int]:
    """``sample`` positions of 0 .. total-1, symmetric, denser at both ends."""
    if sample >= total:
        return list(range(total))
    t = np.linspace(-1, 1, sample)
    place = np.rint((np.sign(t) * (1 - (1 - np.abs(t)) ** bias) + 1) / 2 * (total - 1)).astype(int)
    taken: list[int] = sorted(set(place.tolist()))
    for k in (x for pair in zip(range(total // 2), range(total - 1, -1, -1)) for x in pair):
        if len(taken) >= sample:
            break
        if k not in taken:
            taken = sorted([*taken, k])
    return taken


def flatten(value) -> list:
    """All scalars of nested lists, in order."""
    return [x for v in value for x in flatten(v)] if isinstance(value, (list, tuple)) else [value]


def subwords(word: Column, low: int = 3, high: int = 6) -> Column:
    """All n-grams of ``<word>`` with low .. high characters."""
    w = F.concat(F.lit("<"), word, F.lit(">"))
    n = F.length(w)
    parts = [F.coalesce(F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), _cut(w, k))), F.array().cast("array<string>")) for k in range(low, high + 1)]
    return F.flatten(F.array(*parts))


def _cut(w: Column, k: int):
    return lambda i: F.substr(w, i, F.lit(k))


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of the UTF-8 bytes."""
    h = F.hex(F.encode(text, "UTF-8"))
    codes = F.transform(F.sequence(F.lit(1), F.length(h) - 1, F.lit(2)), lambda i: F.conv(F.substr(h, i, F.lit(2)), 16, 10).cast("bigint"))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda s, c: (s.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))


def newton(x: Sequence[float], y: Sequence[float]) -> tuple[list[float], list[float]]:
    """(nodes, divided differences) of the polynomial through the points; exact in rationals."""
    table = [Fraction(v) for v in y]
    nodes = [Fraction(v) for v in x]
    for k in range(1, len(table)):
        for i in range(len(table) - 1, k - 1, -1):
            table[i] = (table[i] - table[i - 1]) / (nodes[i] - nodes[i - k])
    return [float(v) for v in nodes], [float(v) for v in table]


def newton_value(x: Column, nodes: Sequence[float], differences: Sequence[float]) -> Column:
    """The Newton form at x, by nested products."""
    out = F.lit(float(differences[-1]))
    for n, c in zip(reversed(nodes[: len(differences) - 1]), reversed(differences[:-1])):
        out = out * (x - F.lit(float(n))) + F.lit(float(c))
    return out


def fit_spline(x: Sequence[float], y: Sequence[float], slopes: Sequence[float] | None = None) -> tuple[list[float], list[list[float]]]:
    """(knots, cubic pieces) through the points with continuous slopes; unless given, a slope is that of the parabola through a point and its neighbours."""
    pts = sorted(zip(x, y))
    x, y = [p[0] for p in pts], [p[1] for p in pts]
    if slopes is None:
        slopes = [local_slope(x, y, i) for i in range(len(x))]
    return list(x[:-1]), [interpolate([a, b], [fa, fb], {0: s, 1: t}) for a, b, fa, fb, s, t in zip(x, x[1:], y, y[1:], slopes, slopes[1:])]


def local_slope(x: Sequence[float], y: Sequence[float], i: int, order: int = 2) -> float:
    """The slope at point i of ``local_polynomial``."""
    p = derivative(local_polynomial(x, y, i, order))
    return sum(c * float(x[i]) ** (len(p) - 1 - k) for k, c in enumerate(p))


def local_polynomial(x: Sequence[float], y: Sequence[float], i: int, order: int = 2) -> list[float]:
    """The polynomial through point i and its ``order`` nearest others (by place in x, ties to the left)."""
    near = sorted(range(len(x)), key=lambda k: (abs(x[k] - x[i]), k))[: order + 1]
    near.sort()
    return interpolate([x[k] for k in near], [y[k] for k in near])


def edge_heavy_items(values: Column, sample: int, bias: float = 2.0) -> Column:
    """Of an array's elements the ones at ``edge_heavy`` places; an array of ``sample`` or fewer stays."""
    @F.udf("array<int>", useArrow=True)
    def places(n):
        return None if n is None or n <= sample else edge_heavy(n, sample, bias)

    at = places(F.size(values))
    return F.when(F.size(values) <= sample, values).otherwise(F.transform(at, lambda k: F.get(values, k)))


def python_text(value: Column, kind: str) -> Column:
    """The text that Python's ``str`` gives: None, True, 1.0, 1e+16."""
    if kind in ("double", "float"):
        return F.udf(lambda v: str(v), "string", useArrow=True)(value.cast("double"))
    if kind == "boolean":
        return F.when(value.isNull(), "None").when(value, "True").otherwise("False")
    return F.coalesce(value.cast("string"), F.lit("None"))


def stable_hash(*columns: Column | str) -> Column:
    """A hash of a row's values, arrays, maps and nulls included, the same in every run."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def flatten_column(value: Column, depth: int) -> Column:
    """Arrays nested ``depth`` deep as one array; null inner arrays are left out."""
    for _ in range(depth - 1):
        value = F.flatten(F.filter(value, lambda x: x.isNotNull()))
    return value
