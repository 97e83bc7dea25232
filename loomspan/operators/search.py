"""Documents as token lists: windows, n-grams, sequence search, filters, ranked search over vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.joins import small, squared_distance

WINDOW_SIZES = (32, 128, 512, 1024)
#: Digests of n-grams that a task makes distinct together, and tokens whose n-grams a range is made for (12 bytes each).
GRAMS_AT_ONCE, GRAMS_OF_A_RANGE = 1 << 20, 1 << 22
_WORDS_AT_ONCE, _LONG_WORD = 1 << 18, 64
_draw = np.random.Generator(np.random.PCG64(7))
_CODES = [(_draw.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), _draw.integers(1, 1 << 60, dtype=np.uint64) * np.uint64(8) + np.uint64(5)) for _ in range(2)]
_FACTORS = [np.uint64(f) for f in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def integer_tokens(text: Column) -> Column:
    """White-space separated integers as unsigned 32-bit values; anything else is skipped."""
    parts = F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())
    return F.transform(parts, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)))


def word_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\r\x0B\x0C]+"), lambda w: w != "")


def plain_embedding(tokens: Column) -> Column:
    """[mean, count, range, first] of a token list; [0] if it is empty."""
    total = F.aggregate(tokens, F.lit(0).cast("double"), lambda s, x: s + x.cast("double"))
    full = F.array(total / F.size(tokens), F.size(tokens).cast("double"), (F.array_max(tokens) - F.array_min(tokens)).cast("double"), F.get(tokens, F.lit(0)).cast("double"))
    return F.when(F.size(tokens) > 0, full).otherwise(F.array(F.lit(0.0)))


def unit(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def windows(df: DataFrame, length: str, sizes: Sequence[int] = WINDOW_SIZES, overlap: float = 0.5) -> DataFrame:
    """Adds (window, start, end) rows: every size, at steps of size * (1 - overlap), with a last one that ends with the text.

    Sizes beyond the text are left out, except that the smallest is cut to fit.
    """
    n = F.col(length)
    parts = []
    for k, size in enumerate(sorted(sizes)):
        step = max(1, int(size * (1 - overlap)))
        whole = F.when(n >= size, F.transform(_starts(n, size, step), _window(size)))
        short = F.when((n > 0) & (n < size), F.array(F.struct(F.lit(size).alias("window"), F.lit(0).alias("start"), n.cast("int").alias("end")))) if k == 0 else F.lit(None)
        parts.append(F.coalesce(whole, short, F.array().cast("array<struct<window:int,start:int,end:int>>")))
    return df.withColumn("__w", F.explode(F.flatten(F.array(*parts)))).select(*df.columns, "__w.window", "__w.start", "__w.end")


def _starts(n: Column, size: int, step: int) -> Column:
    last = (n - size).cast("int")
    regular = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))
    return F.array_distinct(F.concat(regular, F.array(last)))


def _window(size: int):
    return lambda s: F.struct(F.lit(size).alias("window"), s.cast("int").alias("start"), (s + size).cast("int").alias("end"))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens; none if there are fewer."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.slice(tokens, i, n))).otherwise(F.array().cast("array<array<string>>"))


def _digests(words: pa.Array) -> list[np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    words = words.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data = words.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    off = off - off[0]
    long = np.flatnonzero(np.diff(off) > _LONG_WORD)
    out = []
    with np.errstate(over="ignore"):
        for k, (code, base) in enumerate(_CODES):
            power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(buf), base, np.uint64)]))
            back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(buf), pow(int(base), -1, 1 << 64), np.uint64)]))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(code[buf] * power[:-1])])
            h = _mixed((sums[off[1:]] - sums[off[:-1]]) * back[off[:-1]] + np.diff(off).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            for i in long.tolist():  # sums of powers are weak for long words
                h[i] = int.from_bytes(hashlib.blake2b(buf[off[i] : off[i + 1]].tobytes(), digest_size=8, salt=bytes([k])).digest(), "little")
            out.append(h)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def _unique_digests(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, ``hi`` ascending."""
    order = np.argsort(hi)
    hi, lo = hi[order], lo[order]
    same = np.flatnonzero(hi[1:] == hi[:-1])
    if (lo[same] != lo[same + 1]).any():  # pairs that differ in ``lo`` only
        order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
    new = np.ones(len(hi), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    return hi[new], lo[new]


def distinct_ngrams(df: DataFrame, tokens: str, most: int = 3, at_most: int | None = None) -> DataFrame:
    """(n, n_distinct) for n = 1 .. most, exact: by a 96-bit digest (two of 10^10 agree with a chance of 10^-9), so that long n-grams aren't shuffled.

    The digests of a task are made distinct by the million and go packed to the ranges that they fall in. ``at_most``
    is a bound of the tokens in all, if one is known (they are counted otherwise); it sets the number of ranges only.
    """
    spark, words = df.sparkSession, df.select(F.col(tokens).alias("t"))
    if at_most is None:
        at_most = words.agg(F.sum(F.size("t"))).first()[0] or 0
    parts = max(1, -(-int(at_most) // GRAMS_OF_A_RANGE))
    bounds = (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(np.uint64)

    def emit(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(most)]

        def send(n: int) -> pa.RecordBatch:
            hi, lo = _unique_digests(*map(np.concatenate, zip(*held[n])))
            held[n].clear()
            cut = [0, *np.searchsorted(hi, bounds).tolist(), len(hi)]
            rows = [(n * parts + k, hi[a:b].tobytes() + lo[a:b].tobytes()) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if a < b]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["cell", "data"])

        for batch in source:
            lists = batch.column(0)
            lists = lists.filter(lists.is_valid())
            if not len(lists):
                continue
            per = np.asarray(pc.list_value_length(lists), np.int64)
            edge, flat = np.concatenate([[0], np.cumsum(per)]), lists.flatten()
            i = 0
            while i < len(per):
                j = max(i + 1, int(np.searchsorted(edge, edge[i] + _WORDS_AT_ONCE, side="right")) - 1)
                hashes = _digests(flat.slice(edge[i], edge[j] - edge[i]))
                left = np.repeat(edge[i + 1 : j + 1] - edge[i], per[i:j]) - np.arange(edge[j] - edge[i])  # words from here to the text's end
                for n in range(most):
                    at = np.flatnonzero(left > n)
                    if len(at):
                        with np.errstate(over="ignore"):
                            hi, lo = (_mixed(sum((h[at + k] * _FACTORS[k % len(_FACTORS)] + np.uint64(k) for k in range(1, n + 1)), h[at]) * np.uint64(2 * n + 1)) for h in hashes)
                        held[n].append((hi, lo.astype(np.uint32)))
                    if sum(len(x[0]) for x in held[n]) >= GRAMS_AT_ONCE:
                        yield send(n)
                i = j
        for n in range(most):
            if held[n]:
                yield send(n)

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = 0, []
        for batch in source:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                cell, raw = k, data.as_py()
                held.append((np.frombuffer(raw, np.uint64, len(raw) // 12), np.frombuffer(raw, np.uint32, len(raw) // 12, len(raw) // 12 * 8)))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([cell // parts + 1], pa.int32()), pa.array([len(_unique_digests(*map(np.concatenate, zip(*held)))[0])], pa.int64())], names=["n", "n_distinct"])

    found = words.mapInArrow(emit, "cell int, data binary").repartitionById(most * parts, F.col("cell")).mapInArrow(count, "n int, n_distinct bigint")
    return found.groupBy("n").agg(F.sum("n_distinct").alias("n_distinct"))


def find_sequence(df: DataFrame, tokens: str, wanted: Sequence) -> DataFrame:
    """The rows whose tokens have ``wanted`` as a contiguous run, with (start, end) of its first place, end exclusive.

    Tokens are integers or texts without the character U+0001.
    """
    k, sep = len(wanted), "\x01"
    joined = F.concat(F.lit(sep), F.array_join(F.col(tokens).cast("array<string>"), sep), F.lit(sep))
    # a single search in the joined tokens; the place is the number of separators before it
    at = F.instr(joined, sep + sep.join(map(str, wanted)) + sep)
    found = df.withColumn("start", F.when(at > 0, F.regexp_count(F.substr(joined, F.lit(1), at), F.lit(sep)) - 1))
    return found.where("start is not null").withColumn("end", F.col("start") + k)


def filters(df: DataFrame, include: Mapping[str, Sequence[str]] | None = None, ranges: Mapping[str, tuple[float, float]] | None = None) -> Column:
    """All keys must hold: a label among the allowed ones (any of a list), a number within its closed range; missing fails."""
    kinds = dict(df.dtypes)
    parts = []
    for key, allowed in (include or {}).items():
        if key not in kinds:
            return F.lit(False)
        parts.append(F.arrays_overlap(F.col(key), F.array(*[F.lit(a) for a in allowed])) if kinds[key].startswith("array") else F.col(key).isin(*allowed))
    for key, (low, high) in (ranges or {}).items():
        if key not in kinds:
            return F.lit(False)
        parts.append(F.col(key).between(low, high))
    return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


def category_hash(text: Column) -> Column:
    """The first eight bytes of the SHA-256 of the UTF-8 text, little-endian, as a decimal."""
    h = F.sha2(F.encode(text, "UTF-8"), 256)
    turned = F.concat(*[F.substring(h, 15 - 2 * k, 2) for k in range(8)])
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


def rank(df: DataFrame, vector: str, wanted: Sequence[float], top_k: int = 10, id_col: str = "id") -> DataFrame:
    """The top_k rows by squared distance to a vector, ties by id; a bounded heap a partition, no full sort."""
    target = F.array(*[F.lit(float(x)) for x in wanted])
    return df.withColumn("distance", squared_distance(F.col(vector), target)).orderBy("distance", id_col).limit(top_k)


def search(docs: DataFrame, windows_: DataFrame, doc: str, vector: str, spec: Mapping) -> DataFrame:
    """(doc, score): filtered documents ranked by their best window, score = -distance; or by a token sequence.

    ``spec``: embeddings, token_sequence, label_include, numeric_range, top_k (10).
    """
    top_k = spec.get("top_k", 10)
    kept = docs.where(filters(docs, spec.get("label_include"), spec.get("numeric_range")))
    if spec.get("embeddings"):
        target = F.array(*[F.lit(float(x)) for x in spec["embeddings"][0]])
        near = windows_.join(kept.select(doc), doc).select(doc, squared_distance(F.col(vector), target).alias("d")).groupBy(doc).agg(F.min("d").alias("d"))
        return near.orderBy("d", doc).limit(top_k).select(doc, (F.lit(0.0) - F.sqrt("d")).alias("score"))
    if spec.get("token_sequence"):
        found = find_sequence(kept, "tokens", spec["token_sequence"])
        return found.orderBy(doc).limit(top_k).select(doc, F.lit(0.0).alias("score"), "start", "end")
    return kept.orderBy(doc).limit(top_k).select(doc, F.lit(0.0).alias("score"))


def denormalised(windows_: DataFrame, docs: DataFrame, categories: DataFrame, doc: str, category: str) -> DataFrame:
    """One row a window with its document's columns and the category's name instead of its id."""
    names = categories.select(F.col("id").alias(category), F.col("value").alias(f"{category}_name"))
    return windows_.join(docs, doc).join(small(names), category, "left")


def merge_categories(maps: DataFrame) -> DataFrame:
    """(field, value, id) merged over workers; the same value with two ids is an error."""
    merged = maps.groupBy("field", "value").agg(F.min("id").alias("id"), F.count_distinct("id").alias("__ids"))
    return merged.withColumn("id", F.when(F.col("__ids") > 1, F.raise_error(F.concat(F.lit("two ids for "), "field", F.lit("="), "value"))).otherwise(F.col("id"))).drop("__ids")


def passes_upper_bound(nodes: DataFrame, include: Mapping[str, Sequence[str]], ranges: Mapping[str, tuple[float, float]]) -> Column:
    """Whether a node can hold a match: for every key some allowed label has a count, for every number the ranges meet.

    ``nodes`` has ``labels`` map<string, map<string, bigint>>, ``low`` and ``high`` map<string, double>.
    """
    out = F.lit(True)
    for key, allowed in include.items():
        out = out & reduce(lambda a, b: a | b, [F.coalesce(F.try_element_at(F.try_element_at(F.col("labels"), F.lit(key)), F.lit(a)), F.lit(0)) > 0 for a in allowed], F.lit(False))
    for key, (low, high) in ranges.items():
        out = out & F.coalesce((F.try_element_at(F.col("high"), F.lit(key)) >= low) & (F.try_element_at(F.col("low"), F.lit(key)) <= high), F.lit(False))
    return out


def hash_sample(df: DataFrame, n: int, id_col: str, seed: int = 0) -> DataFrame:
    """n rows drawn by a hash of the id: the same rows however the table is split."""
    return df.orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))), id_col).limit(n)


def detokenize(tokens: Column) -> Column:
    """The inverse of ``integer_tokens``: numbers with blanks between them."""
    return F.array_join(F.transform(tokens, lambda x: x.cast("string")), " ")


def parse_query(text: str) -> dict:
    """A search's ``spec`` from JSON: text, embeddings, token_sequence, label_include, numeric_range, top_k (10)."""
    import json

    given = json.loads(text)
    if not isinstance(given, dict):
        raise ValueError("a query is a JSON object")
    known = {"text": str, "embeddings": list, "token_sequence": list, "label_include": dict, "numeric_range": dict, "top_k": int}
    for key, value in given.items():
        if key not in known:
            raise ValueError(f"a query has no {key!r}")
        if value is not None and (not isinstance(value, known[key]) or isinstance(value, bool)):
            raise ValueError(f"{key!r} is not a {known[key].__name__}")
    spec = {k: v for k, v in given.items() if v is not None}
    spec["numeric_range"] = {k: (float(v[0]), float(v[1])) for k, v in spec.get("numeric_range", {}).items()}
    spec["label_include"] = {k: [str(x) for x in v] for k, v in spec.get("label_include", {}).items()}
    return {"top_k": 10} | spec


def tokenized(df: DataFrame, text: str, tokenizer: Callable[[list[str]], list[list[int]]], name: str = "tokens") -> DataFrame:
    """Adds the token ids that a function gives for a batch of texts; null texts have none."""
    @F.pandas_udf("array<bigint>")
    def tokens(texts: pd.Series) -> pd.Series:
        given = texts.notna()
        out = pd.Series([None] * len(texts), dtype=object)
        if given.any():
            out[given] = pd.Series(tokenizer(texts[given].tolist()), index=texts.index[given], dtype=object).to_numpy()
        return out

    return df.withColumn(name, tokens(F.col(text).cast("string")))


def embedded(df: DataFrame, tokens: str, embedder: Callable[[list], list], name: str = "embedding") -> DataFrame:
    """Adds the vector, at length 1, that a function gives for a batch of token lists; null lists have none."""
    import numpy as np
    @F.pandas_udf("array<double>")
    def vectors(rows: pd.Series) -> pd.Series:
        given = rows.notna()
        out = pd.Series([None] * len(rows), dtype=object)
        if given.any():
            made = np.asarray(embedder([list(r) for r in rows[given]]), float)
            norm = np.sqrt((made**2).sum(1, keepdims=True))
            out[given] = pd.Series(list(made / np.where(norm > 0, norm, 1)), index=rows.index[given]).to_numpy()
        return out

    return df.withColumn(name, vectors(tokens))


def bin_pack(sizes: DataFrame, bins: int, item: str = "path", size: str = "num_bytes") -> DataFrame:
    """(item, bin): the largest items first, each to the bin with the least in it.

    The greedy rule needs one order over all items; sizes are grouped first, and only
    (size, how many) goes to the driver, where runs of one size are dealt out together.
    """
    import heapq

    counts = sizes.groupBy(F.col(size).alias("s")).count().orderBy(F.desc("s"))
    load = [(0, b) for b in range(bins)]
    dealt = []
    for row in counts.toLocalIterator():
        for k in range(row["count"]):
            full, b = heapq.heappop(load)
            dealt.append((row.s, k, b))
            heapq.heappush(load, (full + row.s, b))
    from pyspark.sql import Window

    numbered = sizes.select(item, F.col(size).alias("s"), (F.row_number().over(Window.partitionBy(size).orderBy(item)) - 1).cast("bigint").alias("k"))
    plan = sizes.sparkSession.createDataFrame(dealt, "s bigint, k bigint, bin int")
    return numbered.join(plan, ["s", "k"]).select(item, "bin")


def node_statistics(rows: DataFrame, node: str, labels: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """(node, labels, low, high) as ``passes_upper_bound`` reads them: label counts and number ranges of each node's rows."""
    parts = []
    for c in labels:
        each = rows.where(F.col(c).isNotNull()).groupBy(F.col(node).alias("node"), F.col(c).cast("string").alias("v")).count()
        parts.append(each.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("v", "count"))).alias("m")).select("node", F.struct(F.lit(c).alias("key"), F.col("m").alias("value")).alias("e")))
    ranges = rows.groupBy(F.col(node).alias("node")).agg(*[f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(numbers) for k, f in (("l", F.min), ("h", F.max))], F.count(F.lit(1)).alias("n"))
    table = lambda k: F.map_from_arrays(F.array(*[F.lit(c) for c in numbers]), F.array(*[F.col(f"{k}{i}") for i in range(len(numbers))])) if numbers else F.create_map().cast("map<string,double>")
    out = ranges.select("node", "n", table("l").alias("low"), table("h").alias("high"))
    if not parts:
        return out.withColumn("labels", F.create_map().cast("map<string,map<string,bigint>>"))
    counted = reduce(DataFrame.union, parts).groupBy("node").agg(F.map_from_entries(F.collect_list("e")).alias("labels"))
    return out.join(counted, "node", "left").withColumn("labels", F.coalesce("labels", F.create_map().cast("map<string,map<string,bigint>>")))


def descend_filtered(rows: DataFrame, node: str, include: Mapping[str, Sequence[str]], ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """The rows that meet the filters, out of the nodes whose statistics allow a match."""
    nodes = node_statistics(rows, node, [k for k in include if k in rows.columns], [k for k in ranges if k in rows.columns])
    open_ = nodes.where(passes_upper_bound(nodes, include, ranges)).select(F.col("node").alias("__node"))
    return rows.join(small(open_), F.col(node).eqNullSafe(F.col("__node")), "left_semi").where(filters(rows, include, ranges))


def merge_summaries(parts: DataFrame) -> DataFrame:
    """Summaries of workers, merged by field: ``sketch`` (distinct values), ``values`` map<string, bigint>, ``n``, ``low``, ``high``."""
    counted = parts.select("field", F.explode("values").alias("v", "c")).groupBy("field", "v").agg(F.sum("c").alias("c")).groupBy("field").agg(F.map_from_entries(F.collect_list(F.struct("v", "c"))).alias("values"))
    rest = parts.groupBy("field").agg(F.hll_union_agg("sketch", True).alias("sketch"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return rest.join(counted, "field", "left")


def word_vectors(words: DataFrame, word: str, known: DataFrame, pieces: DataFrame, buckets: int, low: int = 3, high: int = 6) -> DataFrame:
    """(word, vector): a known word's own vector, or the mean of its sub-words' vectors.

    ``known`` is (word, vector); ``pieces`` is (id, vector), the id of a sub-word being its
    32-bit FNV-1a hash modulo ``buckets``. Sub-words without a vector count as zeros; a word without any sub-word has null.
    """
    from loomspan.functions.scalars import fnv1a, subwords

    each = words.select(F.col(word).alias("word")).where("word is not null").distinct()
    own = each.join(known.select("word", F.col("vector").alias("own")), "word", "left")
    rest = own.where("own is null").select("word", F.explode(subwords(F.col("word"), low, high)).alias("piece"))
    placed = rest.select("word", F.pmod(fnv1a(F.col("piece")), F.lit(buckets)).alias("id")).join(pieces.select("id", "vector"), "id", "left")
    n = placed.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    sums = placed.select("word", F.posexplode("vector").alias("k", "x")).groupBy("word", "k").agg(F.sum("x").alias("x"))
    mean = sums.join(n, "word").groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", (F.col("x") / F.col("n")).alias("x")))), lambda s: s.x).alias("mean"))
    return own.join(mean, "word", "left").select("word", F.coalesce("own", "mean").alias("vector"))
