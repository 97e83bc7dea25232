"""An ordered, immutable table over a DataFrame.

Row order is data: a hidden ``__pos`` column, dense from 0, carries it. Operations
return new tables and never collect rows; positions are renumbered with per-partition
counts (a range sort and one small aggregate), never with a global window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan import errors as E
from loomspan.session import settle

POS = "__pos"
_PY = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType(), bytes: T.BinaryType()}


def number_rows(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds dense positions in the given order.

    Rows are range-partitioned by the order; a partition's first position is the count
    of the rows before it, so that no task ever holds more than its share.
    """
    spark = df.sparkSession
    if order:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # written once: a second run of the range sort could draw other bounds than those that were counted
    # monotonically_increasing_id is partition << 33 | row: its parts are what is needed
    marked = settle(df.withColumn("__id", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__id", 33))
    sizes = marked.groupBy("__part").agg((F.max("__id").bitwiseAND((1 << 33) - 1) + 1).alias("__n")).withColumn(
        "__first", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    placed = marked.join(F.broadcast(sizes.select("__part", "__first")), "__part")  # one row a partition
    return placed.withColumn(POS, F.col("__first") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__part", "__first")


def _field(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


class Table:
    """``df`` with positions; ``columns`` are those without the hidden one.

    Filtering and grouping leave gaps between positions. Order alone is enough for most
    operations, so the gaps are closed only when a position itself is asked for.
    """

    def __init__(self, df: DataFrame, *order: Column | str, numbered: bool = False, dense: bool = True):
        self._raw = df if numbered or POS in df.columns else number_rows(df, *order)
        self._is_dense = dense

    @property
    def df(self) -> DataFrame:
        if not self._is_dense:
            self._raw, self._is_dense = number_rows(self._raw.withColumnRenamed(POS, "__was"), "__was").drop("__was"), True
        return self._raw

    # -- construction -------------------------------------------------------

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Iterable[Sequence[Any]], names: Sequence[str] | None = None, types: Sequence[type] | None = None) -> "Table":
        """From Python rows; the first non-null value of a column fixes its type and later ones are cast to it."""
        rows = [list(r) for r in rows]
        width = len(names) if names is not None else len(types) if types is not None else len(rows[0]) if rows else 0
        if names is not None and types is not None and len(names) != len(types):
            raise E.NameTypeMismatch(f"{len(names)} names and {len(types)} types")
        if names is not None and any(not isinstance(n, str) for n in names):
            raise E.BadSpecifiedName("column names must be strings")
        if types is not None and any(not isinstance(t, type) for t in types):
            raise E.BadSpecifiedType("column types must be types")
        names = list(names) if names is not None else [str(i) for i in range(width)]
        kinds: list[type | None] = list(types) if types is not None else [None] * width
        for r in rows:
            if len(r) != width:
                raise E.BadElement(f"a row has {len(r)} values, {width} are needed")
            for i, v in enumerate(r):
                if v is None:
                    continue
                if kinds[i] is None:
                    kinds[i] = type(v)
                if not isinstance(v, kinds[i]) or isinstance(v, bool) != (kinds[i] is bool):
                    try:
                        r[i] = kinds[i](v)
                    except (TypeError, ValueError) as e:
                        raise E.BadValue(f"{v!r} isn't of type {kinds[i].__name__}") from e
        fields = []
        for i, (n, k) in enumerate(zip(names, kinds)):
            sample = next((r[i] for r in rows if r[i] not in (None, [], ())), None)
            fields.append(T.StructField(n, _PY.get(k) or (T._infer_type(sample) if sample is not None else T.ArrayType(T.StringType()) if k in (list, tuple) else T.StringType())))
        fields.append(T.StructField(POS, T.LongType()))
        return cls(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], T.StructType(fields)), numbered=True)

    @property
    def columns(self) -> list[str]:
        return [c for c in self._raw.columns if c != POS]

    names = columns

    @property
    def types(self) -> list[str]:
        return [t for c, t in self._raw.dtypes if c != POS]

    @property
    def shape(self) -> tuple[int, int]:
        return len(self), len(self.columns)

    def __len__(self) -> int:
        return self._raw.count()

    @property
    def empty(self) -> bool:
        return self._raw.isEmpty()

    def ordered(self) -> DataFrame:
        """The rows in order, without positions."""
        return self._raw.orderBy(POS).select(*self.columns)

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.ordered().collect()]

    def preview(self, rows: int = 10, width: int = 30) -> str:
        """The first rows as text, long values cut, with types and the count of missing values."""
        cut = lambda v: (s if len(s := str(v)) <= width else s[: width - 3] + "...")
        body = [[cut(v) for v in r] for r in self.df.orderBy(POS).limit(rows).select(*self.columns).collect()]
        lines = [" | ".join(x) for x in [self.columns, self.types, *body]]
        missing = self.df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in self.columns]).first()
        return "\n".join([*lines, "missing: " + ", ".join(f"{c} {missing[c] or 0}" for c in self.columns)])

    def _check(self, *names: str) -> None:
        for n in names:
            if n not in self.columns:
                raise E.UnknownName(f"no column {n!r}")

    def _dense(self, df: DataFrame, *order: Column | str) -> "Table":
        """Renumbers what is left of the rows, in the order of ``order`` (default: their positions)."""
        order = order or (POS,)
        tagged = df.select("*", *[(o if isinstance(o, Column) else F.col(o)).alias(f"__o{i}") for i, o in enumerate(order)]).drop(POS)
        return Table(number_rows(tagged, *[f"__o{i}" for i in range(len(order))]).drop(*[f"__o{i}" for i in range(len(order))]), numbered=True)

    # -- predicates ---------------------------------------------------------

    def equals(self, column: str, value: Any) -> Column:
        """Two-valued equality: null equals null; a set means membership; NaN equals nothing."""
        self._check(column)
        c = F.col(column)
        if isinstance(value, (set, frozenset)):
            plain = [v for v in value if v is not None]
            member = F.coalesce(c.isin(*plain), F.lit(False)) if plain else F.lit(False)
            return member | c.isNull() if None in value else member
        if isinstance(value, Column):
            return c.eqNullSafe(value)
        same = c.eqNullSafe(F.lit(value))
        return same & ~F.isnan(c) if dict(self._raw.dtypes)[column] in ("double", "float") and value is not None else same

    def differs(self, column: str, value: Any) -> Column:
        return ~self.equals(column, value)

    def _listed(self, values: Sequence[Any], kind: T.DataType | str, name: str = "__value") -> DataFrame:
        """(position, value) of a value for each row; an error if their numbers differ."""
        values = list(values)
        if len(values) != len(self):
            raise E.BadData(f"{len(values)} values for {len(self)} rows")
        kind = self._raw.schema[kind].dataType if isinstance(kind, str) else kind
        return self._raw.sparkSession.createDataFrame(list(enumerate(values)), T.StructType([T.StructField(POS, T.LongType()), T.StructField(name, kind)]))

    def equals_each(self, column: str, values: Sequence[Any]) -> DataFrame:
        """(position, same): each row's value against the one at its place in ``values``; null equals null."""
        self._check(column)
        return self.df.join(self._listed(values, column), POS).select(POS, F.col(column).eqNullSafe(F.col("__value")).alias("same"))

    def has_value(self, column: str, value: Any) -> bool:
        """Whether a column has a value anywhere."""
        return not self._raw.where(self.equals(column, value)).isEmpty()

    def rowwise(self, operator: Callable[[Column, Column], Column], other: Any) -> "Table":
        """Every cell with ``other``: one value for all columns, or one for each. A missing side gives null."""
        others = list(other) if isinstance(other, (list, tuple)) else [other] * len(self.columns)
        if len(others) != len(self.columns):
            raise E.BadElement(f"{len(others)} values for {len(self.columns)} columns")
        return Table(self._raw.select(*[operator(F.col(c), o if isinstance(o, Column) else F.lit(o)).alias(c) for c, o in zip(self.columns, others)], POS), numbered=True, dense=self._is_dense)

    @staticmethod
    def floor_divide(a: Column, b: Column) -> Column:
        return F.floor(a / b)

    # -- selection ----------------------------------------------------------

    def select(self, *names: str | int | slice | Sequence[bool]) -> "Table":
        """Columns by name, position (negative counts from the end), slice or mask, in the given order.

        A name may repeat: its second place is called ``name_2`` and so on, as Spark can't tell equal names apart.
        """
        chosen: list[str] = []
        for n in names:
            if isinstance(n, (list, tuple)) and n and all(isinstance(x, bool) for x in n):
                if len(n) != len(self.columns):
                    raise E.BadIndex(f"a mask of {len(n)} for {len(self.columns)} columns")
                chosen += [c for c, keep in zip(self.columns, n) if keep]
            elif isinstance(n, slice):
                chosen += self.columns[n]
            elif isinstance(n, bool):
                raise E.BadIndex("a column isn't named by a truth value")
            elif isinstance(n, int):
                if not -len(self.columns) <= n < len(self.columns):
                    raise E.BadIndex(f"no column {n}")
                chosen.append(self.columns[n])
            else:
                chosen.append(n)
        self._check(*chosen)
        called: list[str] = []
        for c in chosen:
            k, new = 1, c
            while new in called:
                k += 1
                new = f"{c}_{k}"
            called.append(new)
        return Table(self._raw.select(*[F.col(f"`{c}`").alias(new) for c, new in zip(chosen, called)], POS), numbered=True, dense=self._is_dense)

    def where(self, condition: Column) -> "Table":
        return Table(self._raw.where(condition), numbered=True, dense=False)

    def row(self, i: int) -> tuple:
        """One row by position; negative counts from the end."""
        i = i if i >= 0 else len(self) + i
        found = self.df.where(F.col(POS) == i).select(*self.columns).take(1)
        if not found:
            raise E.BadIndex(f"no row {i}")
        return tuple(found[0])

    def cell(self, i: int, column: str) -> Any:
        self._check(column)
        return self.select(column).row(i)[0]

    def slice(self, start: int | None = None, stop: int | None = None, step: int = 1) -> "Table":
        """Rows as Python slices take them, backwards too."""
        a, b, s = slice(start, stop, step).indices(len(self))
        pos = F.col(POS)
        inside = ((pos >= a) & (pos < b)) if s > 0 else ((pos <= a) & (pos > b))
        kept = self.df.where(inside & (F.pmod(pos - a, F.lit(abs(s))) == 0))
        return Table(kept.withColumn(POS, ((pos - a) / s).cast("long")), numbered=True)

    def gather(self, ids: Sequence[int]) -> "Table":
        """Rows in the given order, repeats allowed."""
        if any(isinstance(i, bool) or not isinstance(i, int) for i in ids):
            raise E.BadIndex("row indices must be integers")
        n = len(self)
        if any(not -n <= i < n for i in ids):
            raise E.BadIndex("a row index is out of range")
        wanted = self.df.sparkSession.createDataFrame([(k, i % n) for k, i in enumerate(ids)], "__to long, __from long")
        return Table(self.df.join(F.broadcast(wanted), F.col(POS) == F.col("__from")).drop(POS, "__from").withColumnRenamed("__to", POS), numbered=True)  # as long as the caller's list

    def positions_of(self, values: Sequence[Any]) -> DataFrame:
        """Positions of rows that equal ``values``; a null on either side matches; another width never does."""
        if len(values) != len(self.columns):
            return self.df.select(POS).limit(0)
        same = [F.coalesce(F.col(c) == F.lit(v), F.lit(True)) for c, v in zip(self.columns, values) if v is not None]
        return self.df.where(reduce(lambda a, b: a & b, same, F.lit(True))).select(POS)

    def index(self, values: Sequence[Any]) -> int:
        first = self.positions_of(values).agg(F.min(POS)).first()[0]
        if first is None:
            raise ValueError("no such row")
        return first

    def contains(self, values: Sequence[Any]) -> bool:
        return not self.positions_of(values).isEmpty()

    # -- mutation -----------------------------------------------------------

    def append(self, values: Sequence[Any], at: int | None = None) -> "Table":
        """A row more, at the end or at a position; values are cast to the columns' types."""
        if len(values) != len(self.columns):
            raise E.BadElement(f"a row has {len(values)} values, {len(self.columns)} are needed")
        at = len(self) if at is None else at
        kinds = dict(self.df.dtypes)
        row = self.df.sparkSession.range(1).select(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(self.columns, values)], F.lit(at).cast("long").alias(POS))
        moved = self.df.withColumn(POS, F.when(F.col(POS) >= at, F.col(POS) + 1).otherwise(F.col(POS)))
        return Table(moved.unionByName(row), numbered=True)

    def assign(self, column: str, value: Any, condition: Column | None = None) -> "Table":
        """A column set to a value or expression, everywhere or where a condition holds."""
        new = value if isinstance(value, Column) else F.lit(value)
        if condition is not None:
            self._check(column)
            old = dict(self.df.dtypes)[column]
            probe = self.df.select(new.alias("x")).dtypes[0][1]
            if probe not in (old, "void") and not {probe, old} <= {"int", "bigint", "double", "float"}:
                raise E.BadAssignment(f"{probe} doesn't fit column {column!r} of {old}")
            new = F.when(condition, new.cast(old)).otherwise(F.col(column))
        return Table(self.df.withColumn(column, new).select(*dict.fromkeys([*self.columns, column]), POS), numbered=True)

    def assign_each(self, column: str, values: Sequence[Any], ids: Sequence[int] | None = None) -> "Table":
        """A column's values set one by one, in all rows or at the positions ``ids``; as many values as rows."""
        self._check(column)
        if ids is None:
            new = self._listed(values, column)
        else:
            values, n = list(values), len(self)
            if len(values) != len(ids):
                raise E.BadAssignment(f"{len(values)} values for {len(ids)} rows")
            if any(not -n <= i < n for i in ids):
                raise E.BadIndex("a row index is out of range")
            new = self._raw.sparkSession.createDataFrame(list({i % n: v for i, v in zip(ids, values)}.items()), T.StructType([T.StructField(POS, T.LongType()), T.StructField("__value", self._raw.schema[column].dataType)]))
        new = F.broadcast(new.withColumn("__set", F.lit(True))) if len(values) <= 100_000 else new.withColumn("__set", F.lit(True))
        joined = self.df.join(new, POS, "left")
        return Table(joined.withColumn(column, F.when(F.col("__set"), F.col("__value")).otherwise(F.col(column))).select(*self.columns, POS), numbered=True)

    def map_column(self, f: Callable[[Any], Any], column: str, kind: str, name: str | None = None) -> "Table":
        """A column from a Python function of another one's values, in Arrow batches; nulls are passed to it."""
        self._check(column)
        return self.with_column(name or column, F.udf(f, kind, useArrow=True)(F.col(column)))

    def add_column(self, values: Sequence[Any], name: str | None = None, index: int | None = None) -> "Table":
        """A column from Python values, one a row, of one type."""
        if name is not None and not isinstance(name, str):
            raise E.BadSpecifiedName("column names must be strings")
        name = name if name is not None else str(len(self.columns))
        if name in self.columns:
            raise E.BadSpecifiedName(f"there is a column {name!r}")
        kinds = {type(v) for v in values if v is not None}
        if len(kinds) > 1:
            raise E.BadValue("a column has one type")
        if len(values) != len(self):
            raise E.BadData(f"{len(values)} values for {len(self)} rows")
        kind = _PY.get(next(iter(kinds), str)) or T._infer_type(next(v for v in values if v is not None))
        column = self.df.sparkSession.createDataFrame(list(enumerate(values)), T.StructType([T.StructField(POS, T.LongType()), T.StructField(name, kind)]))
        names = list(self.columns)
        names.insert(len(names) if index is None else index, name)
        return Table(self.df.join(column, POS).select(*names, POS), numbered=True)

    def with_column(self, name: str, expression: Column, index: int | None = None) -> "Table":
        names = [c for c in self.columns if c != name]
        names.insert(len(names) if index is None else index, name)
        return Table(self.df.withColumn(name, expression).select(*names, POS), numbered=True)

    def pop_row(self, i: int) -> "Table":
        n = len(self)
        if not n:
            raise E.Empty("no rows")
        i = i if i >= 0 else n + i
        pos = F.col(POS)
        return Table(self.df.where(pos != i).withColumn(POS, F.when(pos > i, pos - 1).otherwise(pos)), numbered=True)

    def pop_column(self, name: str) -> "Table":
        self._check(name)
        return Table(self.df.drop(name), numbered=True)

    def reorder(self, names: Sequence[str]) -> "Table":
        self._check(*names)
        return Table(self.df.select(*dict.fromkeys([*names, *self.columns]), POS), numbered=True)

    def retype(self, types: dict[str, str]) -> "Table":
        """Casts; a non-null value that can't be cast fails the query under ANSI rules."""
        self._check(*types)
        return Table(self.df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in self.columns], POS), numbered=True)

    def rename(self, names: dict[str, str]) -> "Table":
        self._check(*names)
        return Table(self.df.withColumnsRenamed(names), numbered=True)

    # -- reshaping ----------------------------------------------------------

    def unpack(self, column: str) -> "Table":
        """A list column as columns ``name 1`` .. ``name k``, nulls past the end, appended last."""
        self._check(column)
        k = self.df.agg(F.max(F.size(column))).first()[0] or 0
        return Table(self.df.select(*[c for c in self.columns if c != column], *[F.get(column, F.lit(i)).alias(f"{column} {i + 1}") for i in range(max(k, 0))], POS), numbered=True)

    def pack(self, name: str) -> "Table":
        """The inverse: columns ``name <number>`` by number, trailing nulls dropped, all null as null."""
        parts = sorted((c for c in self.columns if c.rpartition(" ")[0] == name and c.rpartition(" ")[2].isdigit()), key=lambda c: int(c.rpartition(" ")[2]))
        if not parts:
            raise E.BadIndex(f"no columns {name!r} with a number")
        full = F.array(*parts)
        past = F.size(full) - F.array_position(F.reverse(F.transform(full, lambda x: x.isNotNull())), True) + 1
        packed = F.when(F.exists(full, lambda x: x.isNotNull()), F.slice(full, F.lit(1), past.cast("int")))
        return Table(self.df.select(*[c for c in self.columns if c not in parts], packed.alias(name), POS), numbered=True)

    def stack(self, columns: Sequence[str]) -> "Table":
        """Groups by all other columns; the named ones become lists in row order, nulls kept; groups by first row."""
        self._check(*columns)
        rest = [c for c in self.columns if c not in columns]
        grouped = self.df.groupBy(*rest).agg(F.min(POS).alias("__first"), F.array_sort(F.collect_list(F.struct(POS, *columns))).alias("__all"))
        lists = [F.transform("__all", _field(c)).alias(c) for c in columns]
        wide = grouped.select(*rest, *lists, F.col("__first").alias(POS))
        return Table(wide.select(*self.columns, POS), numbered=True, dense=False)

    def unstack(self, columns: Sequence[str]) -> "Table":
        """Explodes parallel lists; a null or empty list keeps one row of nulls; unequal lengths are an error."""
        self._check(*columns)
        first = F.coalesce(F.size(columns[0]), F.lit(0))
        uneven = reduce(lambda a, b: a | b, [F.coalesce(F.size(c), F.lit(0)) != first for c in columns[1:]], F.lit(False))
        if len(columns) > 1 and not self.df.where(uneven).isEmpty():
            raise E.BadData("lists in a row differ in length")
        rest = [c for c in self.columns if c not in columns]
        out = self.df.select(*rest, POS, F.posexplode_outer(F.arrays_zip(*columns)).alias("__k", "__v")).select(*rest, *[F.col("__v")[c].alias(c) for c in columns], POS, "__k")
        t = self._dense(out, POS, F.coalesce("__k", F.lit(0)))
        return Table(t.df.select(*self.columns, POS), numbered=True)

    def collect(self, other: "Table") -> "Table":
        """Appends lists of the other table's own columns to the rows with the same shared columns.

        Of equal keys on the left only the last row receives values; others get empty lists.
        """
        shared = [c for c in self.columns if c in other.columns]
        own = [c for c in other.columns if c not in shared]
        if not shared:
            raise E.Unsupported("no shared columns")
        lists = other.df.groupBy(*[F.col(c).alias(f"__k_{c}") for c in shared]).agg(F.array_sort(F.collect_list(F.struct(POS, *own))).alias("__all"))
        last = self.df.groupBy(*shared).agg(F.max(POS).alias("__last")).select("__last")
        left = self.df.join(last.withColumn("__is", F.lit(True)), F.col(POS) == F.col("__last"), "left")
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in shared], F.col("__is"))
        joined = left.join(lists, same, "left")
        values = [F.coalesce(F.transform("__all", _field(c)), F.array()).alias(c) for c in own]
        return Table(joined.select(*self.columns, *values, POS), numbered=True)

    # -- whole tables -------------------------------------------------------

    def unique(self) -> "Table":
        """Distinct rows in the order of their first occurrence (one partial aggregation)."""
        return Table(self._raw.groupBy(*self.columns).agg(F.min(POS).alias(POS)).select(*self.columns, POS), numbered=True, dense=False)

    def sort(self, *keys: str | Column, key: Callable[..., Any] | None = None, key_type: str = "double") -> "Table":
        """Stable; by whole rows if no key is given; nulls last. A Python callable over rows runs as an Arrow-batched function."""
        if key is not None:
            f = F.udf(lambda r: key(tuple(r)), key_type, useArrow=True)
            return self._dense(self.df.withColumn("__key", f(F.struct(*self.columns))), F.col("__key").isNull(), "__key", POS)._without("__key")
        by = [F.col(k).asc_nulls_last() if isinstance(k, str) else k for k in (keys or self.columns)]
        pos = [F.col(k) if isinstance(k, str) else k for k in (keys or self.columns)]
        if all(isinstance(k, str) for k in (keys or self.columns)):
            tag = [x for c in pos for x in (c.isNull(), c)]
            return self._dense(self.df, *tag, POS)
        return Table(number_rows(self.df.withColumnRenamed(POS, "__was"), *by, "__was").drop("__was"), numbered=True)

    def argsort(self, *keys: str) -> DataFrame:
        """(rank, position): the positions in sorted order; ties by position, nulls last."""
        marked = self.df.withColumn("__at", F.col(POS))
        return Table(marked, numbered=True).sort(*(keys or self.columns)).df.select(F.col(POS).alias("rank"), F.col("__at").alias("position"))

    def _without(self, name: str) -> "Table":
        return Table(self.df.drop(name), numbered=True)

    def extend(self, other: "Table") -> "Table":
        """``+=``: same names append by name; disjoint names and equal length zip; subset names append with nulls."""
        if other is self:
            raise E.Unsupported("a table can't extend itself")
        a, b = set(self.columns), set(other.columns)
        if a & b == set() and a and b:
            if len(self) != len(other):
                raise E.Unsupported("tables with disjoint columns must have equal length")
            return Table(self.df.join(other.df, POS).select(*self.columns, *other.columns, POS), numbered=True)
        if not (a <= b or b <= a):
            raise E.Unsupported("names neither equal, nor disjoint, nor one within the other")
        n = len(self)
        kinds = dict(self.df.dtypes)
        right = other.df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in other.columns], (F.col(POS) + n).alias(POS))
        both = self.df.unionByName(right, allowMissingColumns=True)
        return Table(both.select(*dict.fromkeys([*self.columns, *other.columns]), POS), numbered=True)

    def __add__(self, other: "Table") -> "Table":
        return other if not self.columns else Table(self.df, numbered=True).extend(other)

    def k_fold(self, k: int, seed: int = 0) -> DataFrame:
        """The rows with a ``fold`` 0 .. k-1: cuts of a seeded shuffle at floor(0.5 + b * n / k)."""
        shuffled = number_rows(self.df.withColumnRenamed(POS, "__was"), F.md5(F.concat(F.col("__was").cast("string"), F.lit(f":{seed}"))), "__was")
        n = len(self)
        edges = [int(0.5 + b * n / k) for b in range(1, k)]
        fold = reduce(lambda a, e: a + F.when(F.col(POS) >= e, 1).otherwise(0), edges, F.lit(0))
        return shuffled.withColumn("fold", fold).drop(POS).withColumnRenamed("__was", POS)
