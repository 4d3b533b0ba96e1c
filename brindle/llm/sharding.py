"""Sharding by Hilbert-curve order.

Several metadata columns are quantised to a few bits each, the cell of a row gets its place on a
Hilbert curve through that grid, and the rows, sorted by that place, are cut into runs. Rows of a
shard lie close together in all dimensions at once, so a filter on any of them leaves out shards
(and row groups in them) by their minima and maxima.

All of it is DataFrame expressions. The order is laid down once by a range partitioning on
(curve index, hash of the row), which a cell with a third of all rows does not make uneven; ranks
come from the place in the partition plus the counts of the partitions before, so no task sees
more than its own range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.work import Workspace, partitions, table

SHARDS = 8
BITS = 8


def _rotl(x: int, by: int, n: int) -> int:
    by %= n
    return ((x << by) | (x >> (n - by))) & ((1 << n) - 1)


def _rules(n: int) -> tuple[list[int], list[int], list[int]]:
    """For n dimensions: the inverse Gray code, and entry point and direction of each subcube of a Hilbert curve."""
    size = 1 << n
    gray = [i ^ (i >> 1) for i in range(size)]
    inverse = [0] * size
    for i, g in enumerate(gray):
        inverse[g] = i
    entry = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, size)]
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing ones of i
    direction = [0] + [(ones(i - 1) if i % 2 == 0 else ones(i)) % n for i in range(1, size)]
    return inverse, entry, direction


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a cell whose coordinates are dims, each in [0, 2**bits)."""
    n = len(dims)
    inverse, entry, direction = _rules(n)
    size = 1 << n
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    rotate = lambda x, by: F.element_at(F.element_at(F.array(*(F.array(*(F.lit(_rotl(v, b, n)) for v in range(size))) for b in range(n))), (by + 1).cast("int")), (x + 1).cast("int"))
    steps = F.array(*(sum(((F.shiftright(d.cast("int"), bit) % 2) * (1 << k) for k, d in enumerate(dims[1:], 1)), F.shiftright(dims[0].cast("int"), bit) % 2).cast("int") for bit in range(bits - 1, -1, -1)))

    def turned(s, cell):
        return F.struct(s["h"].alias("h"), s["e"].alias("e"), s["d"].alias("d"), pick(inverse, rotate(cell.bitwiseXOR(s["e"]), (n - (s["d"] + 1) % n) % n)).alias("w"))

    def step(s, cell):
        t = turned(s, cell)
        return F.struct(
            (t["h"] * size + t["w"]).alias("h"),
            t["e"].bitwiseXOR(rotate(pick(entry, t["w"]), (t["d"] + 1) % n)).cast("int").alias("e"),
            ((t["d"] + pick(direction, t["w"]) + 1) % n).cast("int").alias("d"),
        )

    return F.aggregate(steps, F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d")), step, lambda s: s["h"])


def _levels(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """The distinct values of a column with their quantised code: equally filled, in the order of the values, null first.

    One row for each distinct value takes part in the single ordered pass.
    """
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    w = Window.orderBy(F.col(column).asc_nulls_first())
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select(F.col(column).alias(f"{column}__v"), F.expr("0").alias("z"), before.alias("b"), total.alias("t")).select(f"{column}__v", F.least(F.floor(F.col("b") * (1 << bits) / F.col("t")), F.lit((1 << bits) - 1)).cast("int").alias(f"{column}__q"))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Shard and slot of each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve_index.

    The dimensions are the columns named by dims (equally filled levels in the order of their
    values, null lowest) and the logarithm of the size. The law is ``rows``: the sorted run of n
    rows is cut so that shard s starts at row ceil(s n / shards), hence counts differ by one at
    most; slots count from 0 in each shard in curve order. size is the text's UTF-8 bytes plus 1 (a null text: 1).
    Null ids, nulls in dimensions and repeated rows are ordinary rows; an empty table gives an
    empty result; other columns are ignored. With fewer rows than shards, some shards are empty.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "hilbert")
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = ws.table(docs.select(F.col(id_col).alias("doc_id"), *(F.col(c).alias(f"d{i}") for i, c in enumerate(dims)), (F.octet_length(raw) + F.lit(1)).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32")), "rows")
    coded = rows
    for i in range(len(dims)):
        coded = coded.join(_levels(rows, f"d{i}", bits), F.col(f"d{i}").eqNullSafe(F.col(f"d{i}__v")))
    size_q = F.least(F.floor(F.log2("size") * ((1 << bits) / 32)), F.lit((1 << bits) - 1)).cast("int")
    coded = coded.withColumn("curve_index", hilbert_index([*(F.col(f"d{i}__q") for i in range(len(dims))), size_q], bits))
    coded = coded.select("doc_id", "size", "text_crc32", "curve_index", F.xxhash64("doc_id", "size", "text_crc32").alias("tie"))
    n = partitions(spark)
    order = ["curve_index", "tie", "doc_id"]
    placed = ws.table(ws.table(coded, "coded").repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("part", F.expr("shiftright(at, 33)")).withColumn("inside", F.expr(f"at & {(1 << 33) - 1}"))
    w = Window.orderBy("part")
    starts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(w) - F.col("n")).alias("start"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    ranked = placed.join(starts, "part").withColumn("rank", F.col("start") + F.col("inside"))
    ranked = ranked.withColumn("shard", F.expr(f"(rank * {shards}) div total").cast("int"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve_index")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", **options) -> None:
    """Write docs with a unique id as one folder of Parquet files for each shard, sorted by curve index, for pruning."""
    where = hilbert_shards(docs, shards, id_col=id_col, **options).select(F.col("doc_id").alias("__id"), "shard", "curve_index")
    out = docs.join(where, F.col(id_col) == F.col("__id")).drop("__id")
    out.repartitionByRange(partitions(docs.sparkSession), "shard", "curve_index", id_col).sortWithinPartitions("shard", "curve_index").drop("curve_index").write.partitionBy("shard").parquet(path)


def op5_hilbert_sharding(spark, sf_dir):
    return hilbert_shards(table(spark, sf_dir, "documents"))
