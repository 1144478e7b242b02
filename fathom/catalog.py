"""All registered queries of the engine with their SQL twins."""

from __future__ import annotations

from fathom import queries as registry
from fathom.queries import components, relational, retrieval, streams, text  # noqa: F401  they register themselves


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.SQL)
