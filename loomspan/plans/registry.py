"""Every query over the reference's own operators, with its SQL."""

from __future__ import annotations

from loomspan.plans import more, search, stats, tables
from loomspan.plans.common import Query

_MODULES = (tables, stats, search, more)
QUERIES: dict[str, Query] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
