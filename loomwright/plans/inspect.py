"""What a physical plan holds, for tests and for looking at plans while tuning."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def physical(df: DataFrame) -> str:
    """The physical plan as text, before adaptive execution changes it."""
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df: DataFrame) -> Counter:
    """How often each physical operator occurs."""
    return Counter(re.findall(r"^[\s:+\-|]*(?:\*\(\d+\)\s*)?([A-Z]\w+)", physical(df), re.M))


def shuffles(df: DataFrame) -> int:
    return operators(df)["Exchange"]


def pushed_filters(df: DataFrame) -> list[str]:
    """The filters that each scan has taken over; Spark shortens long lists."""
    return re.findall(r"PushedFilters: \[(.*?)\]?, ReadSchema", physical(df))


def columns_read(df: DataFrame) -> list[str]:
    """The schema that each scan reads."""
    return re.findall(r"ReadSchema: (struct<.*?>)(?:\n|$|,)", physical(df))


def python_nodes(df: DataFrame) -> list[str]:
    return sorted(x for x in operators(df) if re.search("Python|Pandas|Arrow", x))
