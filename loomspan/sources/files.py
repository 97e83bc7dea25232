"""Files in and out: delimited text, Parquet, directories of documents, snapshots, chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.errors import Empty, Unsupported

_SEPARATORS = {".csv": ",", ".tsv": "\t", ".txt": None}
_PREFERRED = (",", " ", "\t", ";")


def _extension(path: str) -> str:
    name = path.removesuffix(".gz").rsplit("/", 1)[-1]
    return f".{name.rsplit('.', 1)[1]}" if "." in name else ""


def detect_separator(spark: SparkSession, path: str) -> str:
    """The character that occurs equally often in every line outside double quotes; comma, blank, tab, semicolon first."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.regexp_replace("value", '"[^"]*"', "").alias("l"), F.monotonically_increasing_id().alias("k"))
    each = lines.select("k", F.explode(F.split("l", "")).alias("c")).where("c <> ''").groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"))
    even = each.groupBy("c").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("lines")).where("low = high")
    n = lines.count()
    found = {r.c: r.low for r in even.where(F.col("lines") == n).collect()}  # at most one row a character
    marks = {c: k for c, k in found.items() if not c.isalnum()}
    if not marks:
        raise Unsupported(f"no separator found in {path}")
    return next((c for c in _PREFERRED if c in marks), max(marks, key=lambda c: (marks[c], c)))


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, header: bool = True, fraction: float | None = None, seed: int = 0) -> DataFrame:
    """Typed columns (int, float, text); empty cells are null, short rows are padded, blank lines skipped.

    The whole file is read; a sample only if ``fraction`` asks for it.
    """
    df = spark.read.csv(path, header=header, inferSchema=True, sep=sep or detect_separator(spark, path), mode="PERMISSIVE", nullValue="", quote='"', escape='"')
    df = df if header else df.toDF(*[str(i) for i in range(len(df.columns))])
    df = df.select(*[F.col(f"`{c}`").cast({"int": "bigint", "date": "string", "timestamp": "string", "boolean": "string"}.get(t, t)).alias(c) for c, t in df.dtypes])
    return df if fraction is None else df.sample(fraction, seed)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """By extension (``.gz`` allowed): csv, tsv, txt, json; anything else is Parquet."""
    kind = _extension(path)
    if kind in _SEPARATORS:
        return read_delimited(spark, path, options.pop("sep", _SEPARATORS[kind]), **options)
    return spark.read.json(path) if kind in (".json", ".jsonl") else spark.read.parquet(path)


def save(df: DataFrame, path: str, mode: str = "errorifexists", header: bool = True) -> None:
    """The inverse; nulls become empty cells. One file a partition: the writers never meet on one task."""
    if not df.columns:
        raise Empty("nothing to save")
    kind = _extension(path)
    if kind in _SEPARATORS:
        df.write.csv(path, mode=mode, header=header, sep=_SEPARATORS[kind] or ",", nullValue="", emptyValue="", quote='"', escape='"', compression="gzip" if path.endswith(".gz") else None)
    elif kind in (".json", ".jsonl"):
        df.write.json(path, mode=mode)
    else:
        df.write.parquet(path, mode=mode)


def scan_documents(spark: SparkSession, root: str, skip: Sequence[str] = ()) -> DataFrame:
    """(path, name, num_bytes, file_kind, text) of all UTF-8 files below a folder, less those under skipped paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = without_paths(files, "path", skip)
    text = F.try_validate_utf8(F.col("content"))
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.regexp_extract(name, r"\.([^.]+)$", 1)
    return files.select("path", name.alias("name"), F.col("length").alias("num_bytes"), F.lower(kind).alias("file_kind"), text.alias("text")).where("text is not null")


def without_paths(df: DataFrame, path: str, skip: Sequence[str]) -> DataFrame:
    """The rows whose path has none of the names in ``skip`` (relative, at any depth) as leading folders or file."""
    for s in skip:
        part = s.strip("/")
        df = df.where(~(F.contains(F.concat(F.lit("/"), F.col(path), F.lit("/")), F.lit(f"/{part}/"))))
    return df


def snapshot(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, digest) by SHA-256."""
    return df.select(F.col(path).alias("path"), F.sha2(F.col(content).cast("binary"), 256).alias("digest"))


def diff_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of what was created, deleted or modified."""
    a, b = old.select("path", F.col("digest").alias("was")), new.select("path", F.col("digest").alias("now"))
    both = a.join(b, "path", "fullouter")
    change = F.when(F.col("was").isNull(), "create").when(F.col("now").isNull(), "delete").when(F.col("was") != F.col("now"), "modify")
    return both.select("path", change.alias("change")).where("change is not null")


def undo(current: DataFrame, changes: DataFrame, saved: DataFrame) -> DataFrame:
    """The rows as saved: created ones go, deleted and modified ones come back."""
    back = saved.join(changes.where("change <> 'create'").select("path"), "path", "left_semi")
    return current.join(changes.select("path"), "path", "left_anti").unionByName(back)


def write_chunks(df: DataFrame, path: str, rows_a_file: int = 100_000, by: Sequence[str] = ()) -> None:
    """Parquet in files of bounded length, sorted by document within a file so that a look-up skips row groups."""
    order = [*by, "doc_id"] if "doc_id" in df.columns else list(by)
    (df.sortWithinPartitions(*order) if order else df).write.option("maxRecordsPerFile", rows_a_file).partitionBy(*by).parquet(path, mode="overwrite")


def read_chunk(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("doc_id") == doc_id)


def consolidated(parts: Sequence[DataFrame]) -> DataFrame:
    """All chunks' rows in one order, ids made unique by (part, id) and numbered densely."""
    from loomspan.operators.table import POS, number_rows

    tagged = [p.withColumn("__part", F.lit(k)) for k, p in enumerate(parts)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return number_rows(out, "__part", "doc_id").withColumn("doc_id", F.col(POS) + 1).drop(POS, "__part")


def flat_json(df: DataFrame, column: str) -> DataFrame:
    """(…, path, value) of every scalar in a JSON text: dotted paths, list elements under their parent's path, a root list under ``item``."""
    keep = [c for c in df.columns if c != column]
    found = df.select(*keep, F.explode(F.udf(_json_scalars, "array<struct<path: string, value: string>>", useArrow=True)(F.col(column))).alias("__found"))
    return found.select(*keep, "__found.path", "__found.value")


def _json_scalars(text):
    """Every scalar at any depth; numbers as they are written. A text that isn't JSON has none."""
    import json

    try:
        todo, out = [("", json.loads(text, parse_float=str, parse_int=str, parse_constant=str))], []
    except (TypeError, ValueError, RecursionError):
        return []
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{path}.{k}" if path else k, x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(path or "item", x) for x in reversed(v)]
        else:
            out.append((path or "item", {True: "true", False: "false"}.get(v, v) if isinstance(v, bool) else v))
    return out


def save_pickle(rows: Sequence, path: str) -> None:
    """Plain Python rows of a small table to a pickle file (``.gz`` allowed); tables of any size go to Parquet by ``save``."""
    import gzip
    import pickle

    with (gzip.open if path.endswith(".gz") else open)(path, "wb") as out:
        pickle.dump(list(rows), out)


def load_pickle(path: str) -> list:
    """The rows of ``save_pickle``. Only for files of one's own: unpickling runs code."""
    import gzip
    import pickle

    with (gzip.open if path.endswith(".gz") else open)(path, "rb") as file:
        return pickle.load(file)


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows at random, exactly (all if there are fewer): the smallest of random numbers, found with a heap a task."""
    return df.withColumn("__draw", F.rand(seed)).orderBy("__draw").limit(n).drop("__draw")


def load_onto(table: DataFrame, path: str, **options) -> DataFrame:
    """The table with a file's rows behind its own, by name; missing columns are null."""
    return table.unionByName(load(table.sparkSession, path, **options), allowMissingColumns=True)


def with_path_tags(df: DataFrame, path: str, root: str) -> DataFrame:
    """Adds ``tags``: the names of the folders between the root and each file."""
    below = F.regexp_replace(F.col(path), F.concat(F.lit("^.*?"), F.lit(f"\\Q{root.rstrip('/')}\\E/")), F.lit(""))
    parts = F.split(below, "/")
    return df.withColumn("tags", F.slice(parts, F.lit(1), F.size(parts) - 1))


def share_of_work(df: DataFrame, worker: int, workers: int, path: str = "path") -> DataFrame:
    """The documents of one worker out of several, by a hash of the path: the same split in every run."""
    return df.where(F.pmod(F.xxhash64(path), F.lit(workers)) == worker)
