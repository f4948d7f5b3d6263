"""All named queries."""

from __future__ import annotations

from plumbline.suite import (
    column_checks,
    product_queries,
    report_queries,
    row_checks,
    run_queries,
    table_checks,
)
from plumbline.suite.helpers import ORACLES, QUERIES, Query

_MODULES = (row_checks, column_checks, table_checks, run_queries, product_queries, report_queries)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
