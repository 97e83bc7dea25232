"""The bounded sample of rows that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

_SCALE = 1 << 30


def smallest(rows: DataFrame, n: int, key: str, seed: int, *ties) -> list[Row]:
    """The n rows with the smallest hash of ``key``, however the table is split.

    The rows are counted first, and only those whose hash lies below what n rows need
    (with a margin) are sorted: what the tasks send to the driver is about n rows
    in all, not n rows a task.
    """
    mark = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(_SCALE))
    share = (1.3 * n + 50) / max(rows.count(), 1)
    if share < 1:
        some = rows.where(mark < int(share * _SCALE)).orderBy(mark, key, *ties).limit(n).collect()
        if len(some) == n:
            return some
    return rows.orderBy(mark, key, *ties).limit(n).collect()
