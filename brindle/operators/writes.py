"""Writes as rewrites: each gives the table's new content as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.errors import NotNullViolation, TypeRefused, UniqueViolation
from brindle.functions.casts import assign


def _one_of_each(rows: DataFrame, key: list[str], order: list[Column] | None, last: bool) -> DataFrame:
    """Of new rows with one key the first, or the last, in an order; without one in the order that they come in."""
    names = rows.columns
    if not order:
        rows, order = rows.withColumn("__at", F.monotonically_increasing_id()), [F.col("__at")]
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    if last:
        n = F.count("*").over(Window.partitionBy(*key)) - n + 1
    return rows.withColumn("__n", n).where("__n = 1").select(*names)


def insert(table: DataFrame, rows: DataFrame, key: list[str] | None = None) -> DataFrame:
    """All rows; a key that would occur twice is an error."""
    rows = rows.select(*table.columns)
    if key:
        again = table.select(*key).unionAll(rows.select(*key)).groupBy(*key).count().where("count > 1").limit(1).collect()
        if again:
            raise UniqueViolation(str(again[0].asDict()))
    return table.unionByName(rows)


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows whose key is not there yet; existing rows win, then the first new one in the order."""
    new = _one_of_each(rows.select(*table.columns), key, order, last=False)
    return table.unionByName(new.join(table.select(*key), key, "left_anti").select(*table.columns))


def insert_or_replace(table: DataFrame, rows: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """New rows take the place of old ones with their key; of new rows the last in the order wins."""
    new = _one_of_each(rows.select(*table.columns), key, order, last=True)
    return table.join(new.select(*key), key, "left_anti").select(*table.columns).unionByName(new)


def update(table: DataFrame, condition: Column, key: list[str] | None = None, types: dict[str, str] | None = None, **assignments: Column) -> DataFrame:
    """Assigned values see the old row, and are converted by assignment to the column's type (types has the declared ones): loss is an error. Keys may change if no two rows end up with one."""
    hit = F.coalesce(condition, F.lit(False))

    def value(c):
        source = table.select(assignments[c].alias("v")).schema["v"].dataType.simpleString()
        target = (types or {}).get(c, table.schema[c].dataType.simpleString())
        mine = F.when(hit, assignments[c])
        try:
            return F.when(hit, mine.cast(target) if source == target else assign(mine, source, target)).otherwise(F.col(c)).alias(c)
        except TypeError as e:
            raise TypeRefused(f"{c}: {e}") from e

    out = table.select(*(value(c) if c in assignments else F.col(c) for c in table.columns))
    if key and set(key) & set(assignments) and out.groupBy(*key).count().where("count > 1").limit(1).count():
        raise UniqueViolation(", ".join(key))
    return out


def delete(table: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def check_not_null(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows, which are looked at once for all columns."""
    if columns:
        found = rows.select(*(F.col(c).isNull().alias(c) for c in columns)).agg(*(F.max(c).alias(c) for c in columns)).first()
        for c in columns:
            if found[c]:
                raise NotNullViolation(c)
    return rows
