"""Connected components of links, by alternating star contractions in DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.work import Workspace


#: So many links fit one task (16 bytes each, and a tree over their nodes): the rounds below would only add jobs.
ONE_TASK = 1 << 18


def _trees(batches):
    """Each node of the links with the smallest node of its component."""
    parent: dict[int, int] = {}

    def find(i):
        while (up := parent.setdefault(i, i)) != i:
            parent[i] = i = parent[up]
        return i

    for b in batches:
        for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist()):
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(i) for i in nodes], pa.int64())], names=["node", "root"])


def components(links: DataFrame, ws: Workspace) -> DataFrame:
    """node, root (the smallest node of its component) for each node of links (a, b), which are bigint and not null.

    Large-star and small-star rounds until a round changes nothing; every round is a written table,
    the one before it is removed. The number of links never grows. Minima of a node's neighbours
    are combined before the shuffle; the join that gives them back has exchanges on both sides, so a
    hub's neighbours are split by adaptive execution. ONE_TASK links at most are joined in a single task, with the same result.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    cur = ws.table(links.distinct(), "links")
    if cur.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return cur.coalesce(1).mapInArrow(_trees, "node bigint, root bigint")
    last = None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("u"), F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = ws.table(large.distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "u")
        joined = large.join(low, F.col("a") == F.col("u")).select("a", "b", "low")
        small = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("low").alias("b")))
        new = ws.table(small.distinct(), "small")
        ws.drop(large)
        ws.drop(cur)
        cur = new
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
