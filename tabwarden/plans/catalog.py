"""The registered queries of the cleaning, schema, privacy and text operators, and their SQL."""

from __future__ import annotations

from tabwarden.plans import cleaning, governance, matching, protection, schema, streams, texts
from tabwarden.plans.register import Query

_ALL = (cleaning.R, schema.R, matching.R, governance.R, protection.R, texts.R, streams.R)
QUERIES: dict[str, Query] = {k: f for r in _ALL for k, f in r.queries.items()}
ORACLE_SQL: dict[str, str] = {k: s for r in _ALL for k, s in r.sql.items()}
