"""Plan checks: what the physical plan must not contain, and what a scan reads."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def problems(df: DataFrame) -> list[str]:
    """Nested-loop or cross joins, and windows over everything at once."""
    plan = physical(df)
    found = [f for f in FORBIDDEN if f in plan]
    if re.search(r"Window \[[^\n]*windowspecdefinition\((?![^)]*#)", plan):
        found.append("Window without keys")
    return found


def columns_read(df: DataFrame) -> set[str]:
    """Column names the file scans of a plan read."""
    return set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<([^>]*)>", physical(df)))))


def pushed_filters(df: DataFrame) -> str:
    return " ".join(re.findall(r"PushedFilters: \[([^\]]*)\]", physical(df)))


def exchanges(df: DataFrame) -> int:
    return physical(df).count("Exchange hashpartitioning")
