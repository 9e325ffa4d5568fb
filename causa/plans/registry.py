"""Names of queries, and their SQL for comparison."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from causa.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, ctes: str = "") -> Callable[[Query], Query]:
    """Register a function under its name. ctes: names of derived tables that the SQL reads."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            parts = [f"{n} AS ({tables.DERIVED[n]})" for n in tables.with_needs(ctes.split())]
            body = sql.strip()
            head = re.match(r"(?i)WITH (RECURSIVE )?", body)
            if parts and head:
                body = f"{head[0]}{', '.join(parts)}, {body[head.end():]}"
            elif parts:
                body = f"WITH {', '.join(parts)} {body}"
            ORACLES[f.__name__] = body
        return f

    return add
