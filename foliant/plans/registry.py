"""All core queries by name."""

from __future__ import annotations

import importlib.util

from foliant.plans import base

for _module in ("text_queries", "retrieval_queries", "analytics_queries", "metric_queries", "element_queries", "storage_queries"):
    if importlib.util.find_spec(f"foliant.plans.{_module}"):
        importlib.import_module(f"foliant.plans.{_module}")


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
