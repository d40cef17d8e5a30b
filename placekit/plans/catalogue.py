"""All queries: name -> (spark, sf_dir) -> DataFrame, with SQL for the same rows."""

from __future__ import annotations

from placekit.plans import entities, gates, grids, joins, layered, research, rules, scans, sections, serving, shaped, shapes, values, viewer  # noqa: F401  they register themselves
from placekit.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
