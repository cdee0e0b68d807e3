"""The query catalogue: one entry for each operator, with its SQL counterpart."""

from __future__ import annotations

from lacuna.plans import exchange, operations, retrieval, verse
from lacuna.plans.inputs import Query

PARTS = (retrieval, verse, operations, exchange)
QUERIES: dict[str, Query] = {name: q for part in PARTS for name, q in part.C.queries.items()}
SQL: dict[str, str] = {name: s for part in PARTS for name, s in part.C.sql.items()}
