"""Aggregates in the type of their argument. COUNT, COUNT(DISTINCT), MIN and MAX are Spark's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_(x: Column, of: str) -> Column:
    """SUM in the argument's type; overflow is an error."""
    return F.sum(x).cast(of)


def avg(x: Column, of: str) -> Column:
    """AVG in the argument's type; integers truncate toward zero."""
    if of in ("tinyint", "smallint", "int", "bigint"):
        return F.call_function("div", F.sum(x), F.count(x)).cast(of)
    return F.avg(x).cast(of)
