"""The registered queries over the given tables, with their SQL."""

from __future__ import annotations

from tieweave.plans import base

# Each module registers its queries when it is imported.
from tieweave.plans import documents, graph, joins, leads, matching, metrics, more, reports, resolve, scores, wealth  # noqa: F401  isort: skip


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
