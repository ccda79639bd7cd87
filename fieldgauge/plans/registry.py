"""Where queries and their DuckDB oracles are registered."""

from __future__ import annotations

from fieldgauge.sources.views import SQL, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def S(expr: str, n: int = 6) -> str:
    """DuckDB: the value of an expression to n significant figures."""
    return f"CAST(printf('%.{n - 1}e', CAST({expr} AS DOUBLE)) AS DOUBLE)"


def VAR(expr: str) -> str:
    """DuckDB: the sample variance, with 0 for what is below 1e-15 of the mean square."""
    return f"CASE WHEN var_samp({expr}) <= 1e-15 * avg({expr} * {expr}) THEN CAST(0 AS DOUBLE) ELSE var_samp({expr}) END"


def query(name: str, views: str = "", sql: str | None = None):
    """Register a query; ``views`` names the working tables of its SQL, separated by spaces."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(sql, *(v for v in views.split() if v in SQL)) if any(v in SQL for v in views.split()) else sql
        return f

    return put
