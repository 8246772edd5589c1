"""All registered queries of the library's core, with their SQL counterparts."""

from __future__ import annotations

from uqframe.plans import analysis, base, calibration, checks, file_queries, inventory, preparation, records, report_queries, shared_draws  # noqa: F401  modules register their queries
from uqframe.plans.base import Query


def queries() -> dict[str, Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
