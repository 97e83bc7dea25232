"""Streams: sketches kept up online, reservoirs, and (an extension) windowed counts with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def update_sketches(stream: DataFrame, path: str, value: str, checkpoint: str):
    """Starts a query that writes one distinct-count sketch a batch; ``current`` merges them.

    A batch is written under its own number, so one that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.agg(F.hll_sketch_agg(value, 13).alias("sketch"), F.count(value).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, path: str) -> DataFrame:
    """(n, n_distinct) over all batches so far."""
    return spark.read.parquet(path).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts a tumbling window and key; rows later than ``late`` behind the newest are dropped. An extension."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs a stream over what is there now, into Parquet."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def incremental(indexed: DataFrame, added: DataFrame, search: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """The k best over an indexed part and rows added since: each is searched, the winners are merged."""
    return search(indexed).unionByName(search(added)).orderBy("distance").limit(k)
