"""Operator 3, mixing sources to target weights: iterative proportional fitting.

Documents fall into cells (source, language, topic). The cells' token weights are
raked: scaled to the target share of every source, then language, then topic, again
and again. A cell's sampling rate is its raked weight over its own tokens, scaled so
that the expected tokens meet the budget, and never over 1: cells that would need
more than they have give all, and the rest share what is left. A document is kept if
a hash of its id, read as a number in [0, 1), is below its cell's rate, so that the
same documents are drawn whenever the same table is mixed.

Defined results
  null source, language or topic: a value of its own; null or blank text: no tokens,
  a cell without tokens has rate 1; null doc_id: drawn as the id -1; repeated rows: drawn alike;
  targets that name no existing value: the others share theirs; values without a target: weight 0;
  an empty table: no rows; extra columns: kept by ``mix``, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.session import settle

DIMENSIONS = ("source", "lang", "topic")
#: Default targets: a dimension's token shares to this power, so that small ones gain.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Expected tokens kept, as a part of all.
KEEP_SHARE = 0.7
SWEEPS, SEED = 30, 17
#: Cells raked on the driver at most; beyond that they stay in a table and are raked there.
DRIVER_CELLS = 200_000
_WORD = r"[^ \t\n\r\x0B\x0C]+"


def topic_of(text: Column) -> Column:
    """A coarse topic by the marks that a text carries; any other column expression can take its place."""
    low = F.lower(text)
    return (
        F.when(low.contains("license") | low.contains("all rights reserved"), "legal")
        .when(text.contains(" | "), "tabular")
        .when(text.contains("@"), "contact")
        .otherwise("general")
    )


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the id alone."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-1")), F.lit(f":{SEED}"))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _cells(docs: DataFrame, topic: Column) -> DataFrame:
    return docs.select("source", "lang", topic.alias("topic"), F.coalesce(F.regexp_count(F.col("text"), F.lit(_WORD)), F.lit(0)).alias("tokens")).groupBy(*DIMENSIONS).agg(F.sum("tokens").cast("double").alias("tokens"))


def rake(tokens: np.ndarray, marks: list[np.ndarray], targets: list[np.ndarray], sweeps: int = SWEEPS) -> np.ndarray:
    """Weights (of sum 1) whose share of value v in dimension d is targets[d][v]; marks[d] has each cell's value."""
    weight = tokens / max(tokens.sum(), 1e-300)
    for _ in range(sweeps):
        for mark, target in zip(marks, targets):
            total = np.bincount(mark, weight, len(target))
            weight = weight * np.where(total > 0, target / np.where(total > 0, total, 1), 0)[mark]
    return weight


def rates(tokens: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """min(1, k * weight / tokens) with k such that the expected tokens are ``budget``; 1 where there are no tokens."""
    ratio = np.where(weight > 0, tokens / np.where(weight > 0, weight, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    given = np.concatenate([[0], np.cumsum(tokens[order])[:-1]])
    left = np.cumsum(weight[order][::-1])[::-1]
    scale = np.where(left > 0, (budget - given) / np.where(left > 0, left, 1), np.inf)
    fits = np.flatnonzero(scale <= ratio[order] * (1 + 1e-12))
    k = scale[fits[0]] if len(fits) else np.inf
    with np.errstate(invalid="ignore"):
        rate = np.where(tokens > 0, np.minimum(1.0, np.where(weight > 0, k * weight, 0) / np.where(tokens > 0, tokens, 1)), 1.0)
    return rate


def _tempered(tokens: np.ndarray, mark: np.ndarray, n: int, power: float) -> np.ndarray:
    total = np.bincount(mark, tokens, n)
    share = np.where(total > 0, total, 0) ** power * (total > 0)
    return share / max(share.sum(), 1e-300)


def cell_rates(docs: DataFrame, targets: dict[str, dict] | None = None, keep_share: float = KEEP_SHARE, topic: Column | None = None, driver_cells: int = DRIVER_CELLS) -> tuple[DataFrame, bool]:
    """(source, lang, topic, rate) of every cell, and whether they are few enough to be broadcast."""
    topic = topic_of(F.col("text")) if topic is None else topic
    spark = docs.sparkSession
    cells = settle(_cells(docs, topic))
    if cells.count() > driver_cells:
        return _rake_in_place(cells, targets, keep_share), False
    rows = sorted(cells.collect(), key=lambda r: tuple((x is not None, x or "") for x in r[:3]))
    schema = "source string, lang string, topic string, rate double"
    if not rows:
        return spark.createDataFrame([], schema), True
    tokens = np.array([r.tokens for r in rows])
    marks, wanted = [], []
    for d, name in enumerate(DIMENSIONS):
        values = {v: k for k, v in enumerate(dict.fromkeys(r[d] for r in rows))}
        mark = np.array([values[r[d]] for r in rows])
        if targets and name in targets:
            share = np.array([float(targets[name].get(v, 0)) for v in values])
            share = share / max(share.sum(), 1e-300)
        else:
            share = _tempered(tokens, mark, len(values), TEMPER[name])
        marks.append(mark)
        wanted.append(share)
    rate = rates(tokens, rake(tokens, marks, wanted), keep_share * tokens.sum())
    return spark.createDataFrame([(*r[:3], float(p)) for r, p in zip(rows, rate)], schema), True


def _rake_in_place(cells: DataFrame, targets: dict[str, dict] | None, keep_share: float) -> DataFrame:
    """The same by joins over the table of cells, settled after every sweep; nothing is gathered but single numbers."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    state = cells.withColumn("weight", F.col("tokens") / F.lit(max(total, 1e-300)))
    goals = {}
    for name in DIMENSIONS:
        if targets and name in targets:
            all_of = sum(map(float, targets[name].values())) or 1.0
            goals[name] = spark.createDataFrame([(v, float(x) / all_of) for v, x in targets[name].items()], "value string, goal double")
        else:
            share = cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("t")).withColumn("goal", F.when(F.col("t") > 0, F.pow("t", F.lit(TEMPER[name]))).otherwise(0.0))
            norm = share.agg(F.sum("goal")).first()[0] or 1.0
            goals[name] = settle(share.select("value", (F.col("goal") / F.lit(norm)).alias("goal")))
    for _ in range(SWEEPS):
        for name in DIMENSIONS:
            has = state.groupBy(F.col(name).alias("value")).agg(F.sum("weight").alias("has"))
            factor = has.join(goals[name].withColumnRenamed("value", "goal_value"), F.col("value").eqNullSafe(F.col("goal_value")), "left").select("value", F.when(F.col("has") > 0, F.coalesce("goal", F.lit(0.0)) / F.col("has")).otherwise(0.0).alias("factor"))
            state = state.join(factor, state[name].eqNullSafe(factor["value"]), "left").select(*DIMENSIONS, "tokens", (F.col("weight") * F.coalesce("factor", F.lit(0.0))).alias("weight"))
        state = settle(state)
    # k by bisection: the expected tokens grow with it
    low, high, budget = 0.0, 1.0, keep_share * total

    def expected(k: float) -> float:
        return state.agg(F.sum(F.least("tokens", F.col("weight") * k))).first()[0] or 0.0

    most = state.agg(F.sum(F.when(F.col("weight") > 0, F.col("tokens")))).first()[0] or 0.0
    if most > budget:
        while expected(high) < budget:
            high *= 4
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if expected(middle) < budget else (low, middle)
    else:
        high = float("inf")
    scaled = F.when(F.col("weight") > 0, F.col("weight") * high).otherwise(0.0)
    return state.select(*DIMENSIONS, F.when(F.col("tokens") > 0, F.least(F.lit(1.0), scaled / F.col("tokens"))).otherwise(1.0).alias("rate"))


def _with_rate(docs: DataFrame, topic: Column, cells: tuple[DataFrame, bool]) -> tuple[DataFrame, str, str]:
    """``docs`` with its topic and rate, and their names, which no column of ``docs`` has."""
    table, few = cells
    tag = f"__{uuid.uuid4().hex}"
    rates_ = table.select(*[F.col(c).alias(f"{tag}_{c}") for c in table.columns])
    tagged = docs.withColumn(f"{tag}_of", topic)
    same = tagged["source"].eqNullSafe(rates_[f"{tag}_source"]) & tagged["lang"].eqNullSafe(rates_[f"{tag}_lang"]) & tagged[f"{tag}_of"].eqNullSafe(rates_[f"{tag}_topic"])
    return tagged.join(F.broadcast(rates_) if few else rates_, same, "left"), f"{tag}_of", f"{tag}_rate"


def sampling(docs: DataFrame, targets: dict[str, dict] | None = None, keep_share: float = KEEP_SHARE, topic: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, rate, kept) of every row; the texts are read once to count and once to find topics."""
    topic = topic_of(F.col("text")) if topic is None else topic
    rows, of, rate = _with_rate(docs.select("doc_id", "source", "lang", "text"), topic, cell_rates(docs, targets, keep_share, topic))
    return rows.select("doc_id", "source", "lang", F.col(of).alias("topic"), F.round(rate, 6).alias("rate"), (draw(F.col("doc_id")) < F.col(rate)).alias("kept"))


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, keep_share: float = KEEP_SHARE, topic: Column | None = None) -> DataFrame:
    """The drawn rows of ``docs``, all their columns unchanged."""
    topic = topic_of(F.col("text")) if topic is None else topic
    rows, _, rate = _with_rate(docs, topic, cell_rates(docs, targets, keep_share, topic))
    return rows.where(draw(F.col("doc_id")) < F.col(rate)).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_sql(docs: str = "documents", keep: str | None = None) -> str:
    """The same in DuckDB; ``docs`` is a table or CTE name. With ``keep``, a column list, only the drawn rows."""
    temper = "\n".join(
        f", goal_{n} as (select {n}, p / sum(p) over () as goal from (select {n}, case when sum(tokens) > 0 then pow(sum(tokens), {TEMPER[n]}) else 0 end as p from cells group by {n}))" for n in DIMENSIONS
    )
    step = "w"
    inner = "(select it, source, lang, topic, tokens, w from raked where it < {n})".format(n=SWEEPS)
    for n in DIMENSIONS:
        inner = f"(select s.it, s.source, s.lang, s.topic, s.tokens, case when s.has > 0 then s.{step} * g.goal / s.has else 0 end as w from (select *, sum(w) over (partition by {n}) as has from {inner}) s join goal_{n} g on s.{n} is not distinct from g.{n})"
    picked = f"select {keep} from drawn where kept" if keep else "select doc_id, source, lang, topic, round(rate, 6) as rate, kept from drawn"
    return f"""
with recursive topical as (
  select *, case when contains(lower(text), 'license') or contains(lower(text), 'all rights reserved') then 'legal' when contains(text, ' | ') then 'tabular' when contains(text, '@') then 'contact' else 'general' end as topic
  from {docs}
), cells as (
  select source, lang, topic, sum(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\x0B\\x0C]+')), 0))::double as tokens from topical group by all
){temper}
, raked as (
  select 0 as it, source, lang, topic, tokens, tokens / (select sum(tokens) from cells) as w from cells
  union all
  select it + 1, source, lang, topic, tokens, w from {inner}
), last as (select *, case when w > 0 then tokens / w else 'inf'::double end as ratio from raked where it = {SWEEPS}
), filled as (
  select *, ({KEEP_SHARE}::double * (select sum(tokens) from cells) - coalesce(sum(tokens) over (order by ratio, source, lang, topic rows between unbounded preceding and 1 preceding), 0))
     / nullif(sum(w) over (order by ratio, source, lang, topic rows between current row and unbounded following), 0) as k from last
), scale as (select coalesce(arg_min(k, (ratio, source, lang, topic)), 'inf'::double) as k from filled where k <= ratio * (1 + 1e-12)
), priced as (select source, lang, topic, case when tokens > 0 then least(1.0, case when w > 0 then k * w else 0 end / tokens) else 1.0 end as rate from last, scale
), drawn as (
  select t.*, p.rate, ('0x' || substr(md5(coalesce(doc_id::varchar, '-1') || ':{SEED}'), 1, 13))::bigint / {1 << 52}::double < p.rate as kept
  from topical t join priced p on t.source is not distinct from p.source and t.lang is not distinct from p.lang and t.topic is not distinct from p.topic
)
{picked}
"""
