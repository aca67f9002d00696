"""All queries but the corpus operators', each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def load() -> tuple[dict, dict[str, str]]:
    """The registered queries and their SQL, after importing the modules that register them."""
    from loomwright.functions import scalar  # noqa: F401
    from loomwright.operators import aggregates, filters, joins, ranges, sets, sketches, udfs, windows  # noqa: F401
    from loomwright.sources import databases, files, logged  # noqa: F401
    from loomwright.streaming import events  # noqa: F401

    return QUERIES, SQL
