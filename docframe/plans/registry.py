"""All queries over the driver's tables."""

from __future__ import annotations

from . import durable, intake, jobs, media
from .base import Query

_GROUPS = (intake.plans, jobs.plans, media.plans, durable.plans)


def queries() -> dict[str, Query]:
    return {name: query for group in _GROUPS for name, query in group.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in _GROUPS for name, sql in group.sql.items()}
