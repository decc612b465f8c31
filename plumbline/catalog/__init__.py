"""Every operator as a query over the driver's tables, by its inventory id."""

from __future__ import annotations

from plumbline import registry
from plumbline.catalog import analytics, evidence, layers, metadata, oracles, relational  # noqa: F401  (they register their queries)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
