"""Scans, projections, joins, set operations, sorting: declared on DataFrames and left to Catalyst to plan."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.errors import TypeRefused

JOIN_KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def scan(df: DataFrame, columns: list[str] | None = None, key: str | None = None, lower=None, upper=None, lower_inclusive: bool = True, upper_inclusive: bool = False) -> DataFrame:
    """Rows with key between the bounds (an absent bound is open), as filters that reach the file scan. A bound that is the null Column gives no rows."""
    if key is not None:
        k = F.col(key)
        for bound, keep in ((lower, k.__ge__ if lower_inclusive else k.__gt__), (upper, k.__le__ if upper_inclusive else k.__lt__)):
            if bound is not None:
                df = df.where(keep(bound if isinstance(bound, Column) else F.lit(bound)))
    return df.select(*columns) if columns else df


def find(df: DataFrame, columns: list[str] | None = None, **keys) -> DataFrame:
    """Rows whose key columns equal the values; a null value finds nothing."""
    for k, v in keys.items():
        df = df.where(F.col(k) == F.lit(v))
    return df.select(*columns) if columns else df


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Literal rows."""
    return spark.createDataFrame(rows, schema)


def project(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns."""
    return df.withColumns(columns)


def filter_(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true; false and unknown go."""
    return df.where(condition)


def branches(df: DataFrame, *each) -> list[DataFrame]:
    """One input for several consumers; equal subplans share their exchanges."""
    return [f(df) for f in each]


def join(left: DataFrame, right: DataFrame, on: list[str] | str | Column, kind: str = "inner", residual: Column | None = None) -> DataFrame:
    """Equi join with an optional further condition on pairs; null keys meet nothing. kind: inner, left, right, full, semi, anti.

    An outer join keeps a row once if no partner passes the whole condition. Named keys must be told
    apart by the caller when there is a residual. Which side is hashed, sorted or broadcast is
    decided by size at run time.
    """
    if kind not in JOIN_KINDS:
        raise TypeRefused(f"unknown join {kind}")
    if residual is None:
        return left.join(right, on, JOIN_KINDS[kind])
    if not isinstance(on, Column):
        on = reduce(lambda a, b: a & b, [left[c] == right[c] for c in ([on] if isinstance(on, str) else on)])
    return left.join(right, on & residual, JOIN_KINDS[kind])


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def natural(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on all columns of one name."""
    return left.join(right, [c for c in left.columns if c in right.columns])


#: Rows of one key that meet in one block of a dealt join, of either side; a task gets the pairs of about two full blocks.
BLOCK_ROWS = 2048
#: Tasks of a dealt join; with more pairs than these hold, tasks get longer.
MOST_TASKS = 10_000


def keyed(df: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a null key; NaN is a value and meets NaN."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on]))


def counted(df: DataFrame, on: list[str], name: str) -> DataFrame:
    """Rows of each key, as a double: products of counts may be large."""
    return keyed(df, on).groupBy(*on).agg(F.count("*").cast("double").alias(name))


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], pairs: DataFrame, orders: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """Inner join on named keys whose tasks follow the number of pairs, not the bytes read: few keys with many rows make far more than they read.

    pairs has the keys that both sides have, with their rows as __l and __r; it is summed up when this is called.
    A key of more than BLOCK_ROWS squared pairs is cut into blocks: each side is dealt by a hash of its rows into pieces of
    about BLOCK_ROWS, and each piece meets every piece of the other side once (equal rows stay in one piece).
    orders: columns by which each side's rows of a key are sorted then.
    """
    made = F.col("__l") * F.col("__r")
    total, most = pairs.agg(F.sum(made), F.max(made)).first()
    if (total or 0) <= BLOCK_ROWS**2:
        return left.join(right, on)
    left, right, keys = keyed(left, on), keyed(right, on), list(on)
    if most > BLOCK_ROWS**2:
        keys += ["__i", "__j"]
        heavy = F.broadcast(pairs.where(made > BLOCK_ROWS**2).select(*on, *(F.ceil(F.col(c) / BLOCK_ROWS).alias(n) for c, n in (("__l", "__is"), ("__r", "__js")))))

        def blocks(df, own, others):
            """df with the piece of each row, once for every piece of the other side."""
            piece = F.xxhash64(*(c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind))
            n = lambda c: F.coalesce(f"__{c}s", F.lit(1).cast("bigint"))
            df = df.join(heavy, on, "left").withColumn(f"__{own}", F.pmod(piece, n(own))).withColumn(f"__{others}", F.explode(F.sequence(F.lit(0).cast("bigint"), n(others) - 1)))
            return df.drop("__is", "__js")

        left, right = blocks(left, "i", "j"), blocks(right, "j", "i")
    tasks = min(MOST_TASKS, math.ceil(total / BLOCK_ROWS**2 / 2))
    left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)  # a number that is given is kept, whatever the bytes
    if orders:  # a sort below a join is dropped as useless, but not from below a row number that is read
        left, right = (df.sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id()).where("__at >= 0").drop("__at") for df, order in zip((left, right), orders, strict=True))
    return left.join(right, keys).drop("__i", "__j")


def n_way(*frames: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of all inputs on one key. The rows of each key are counted first, so that tasks follow the rows made."""
    joined, have = frames[0], counted(frames[0], on, "__l")
    for df in frames[1:]:
        pairs = have.join(counted(df, on, "__r"), on)
        joined, have = dealt_join(joined, df, on, pairs), pairs.select(*on, (F.col("__l") * F.col("__r")).alias("__l"))
    return joined


#: Cells of one size that an interval is cut into at most; a wider one goes to cells eight times as wide, and so on.
RANGE_CELLS = 8


def range_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float, kind: str = "inner") -> DataFrame:
    """Rows of left with their value in [low, high) of a row of right.

    Both sides are cut into cells and the join is on cells, so no pair outside one cell is looked at.
    Cells come in sizes, one of the given width, each RANGE_CELLS times the one before, the smallest a part of the given width for
    intervals no longer than that; an interval takes the smallest size of which it meets about RANGE_CELLS at most, and a value has one cell of
    each size that some interval took, so a wide interval costs no more rows than a narrow one.
    Rows of each cell are counted first, so that tasks follow the pairs looked at. Rows of a cell come in the order of value
    and low: neighbours have nearly the same intervals in the same order, which a compressed file keeps small.
    """
    if kind != "inner":
        raise TypeRefused(f"no range join of kind {kind}")
    size = F.greatest(F.lit(-1), F.ceil(F.log(float(RANGE_CELLS), (F.col(high) - F.col(low)) / F.lit(width * RANGE_CELLS)))).cast("int")
    wide = lambda n: F.lit(float(width)) * F.pow(F.lit(float(RANGE_CELLS)), n)
    cell = lambda c, n: F.floor(c / wide(n)).cast("bigint")
    spread = right.where(F.col(low) < F.col(high)).withColumn("__size", size)
    sizes = [r[0] for r in spread.select("__size").distinct().collect()]  # a handful: the logarithm of the widest interval
    spread = spread.withColumn("__cell", F.explode(F.sequence(cell(F.col(low), F.col("__size")), cell(F.col(high), F.col("__size")))))
    mine = left.withColumn("__size", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>"))).withColumn("__cell", cell(F.col(value), F.col("__size")))
    on = ["__size", "__cell"]
    met = dealt_join(mine, spread, on, counted(mine, on, "__l").join(counted(spread, on, "__r"), on), ([value], [low]))
    return met.where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop(*on)


def scalar_or_error(df: DataFrame, keys: list[str], right: DataFrame, value: str) -> DataFrame:
    """df with the one value that right has under its keys: null if none, an error if more (rows, not different values)."""
    one = right.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(value).alias(value))
    one = one.withColumn(value, F.when(F.col("__n") > 1, F.raise_error(F.lit("a scalar subquery has more than one row")).cast(right.schema[value].dataType)).otherwise(F.col(value))).drop("__n")
    return df.join(one, keys, "left")


def union_all(*frames: DataFrame) -> DataFrame:
    """By position; types are unified."""
    return reduce(DataFrame.union, frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return union_all(*frames).distinct()


def except_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nulls are equal to each other."""
    return a.subtract(b)


def intersect_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def limit(df: DataFrame, n: int) -> DataFrame:
    if not 0 <= n < 1 << 31:
        raise TypeRefused(f"LIMIT {n}")
    return df.limit(n)


def top_k(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows; nulls are smallest."""
    return limit(df.orderBy(*order), n)


def top_k_per_group(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group; the planner cuts groups before the shuffle."""
    from pyspark.sql import Window

    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")
