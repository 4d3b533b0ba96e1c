"""Exact dedup by deterministic block naming.

Every normalised text is cut into fixed-size byte blocks. The distinct blocks are sorted and
numbered, which gives each content one integer name; adjacent names are then paired, the distinct
pairs sorted and numbered again, until one name is left. Texts of equally many blocks have the
same last name if and only if they are equal: a name stands for one content, never for a hash.

Block contents cross the network once, after map-side combination, so a text that a third of all
rows repeat is one row of a partition's output. The rows of the documents meet the names through a
128-bit key; that the key tells all contents of this corpus apart is checked on the contents
themselves, and if it ever does not a wider key is taken, in the end the content itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.work import SPACE, Workspace, named_as, numbered, table

BLOCK_BYTES = 8192


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space made one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def _keys(width: int) -> list:
    """Functions of a block whose values together are its key: 128 bits at first, then 120 more, at last the block itself."""
    out = [lambda b: F.xxhash64(b), lambda b: F.xxhash64(F.lit(1), b)]
    if width == 2:
        return [lambda b: b]
    return out if width == 0 else [*out, lambda b: F.conv(F.substring(F.sha2(b, 512), 1, 15), 16, 10).cast("long"), lambda b: F.conv(F.substring(F.sha2(b, 512), 16, 15), 16, 10).cast("long")]


def _blocks(raw: Column, n: Column, block_bytes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes)))


def _named(distinct: DataFrame, *order: str) -> DataFrame:
    """Numbers for distinct rows: by partition, and by their sorted place there."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rid (one for each row), doc_id, text_sha256, n_blocks, name: rows are equal texts if and only if (n_blocks, name) agree."""
    raw = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).cast("binary").alias("raw")).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / F.lit(block_bytes))).cast("int"))
    for width in range(3):
        keys = _keys(width)
        k = [f"k{i}" for i in range(len(keys))]
        rows = ws.table(
            raw.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2("raw", 256).alias("text_sha256"), "n_blocks", F.transform(_blocks(F.col("raw"), F.col("n_blocks"), block_bytes), lambda b: F.struct(*(f(b).alias(c) for c, f in zip(k, keys)))).alias("keys")),
            "rows",
        )
        contents = raw.select(F.explode(_blocks(F.col("raw"), F.col("n_blocks"), block_bytes)).alias("block")).groupBy("block").agg(F.lit(1).alias("one"))
        names = ws.table(_named(contents, "block").select(*(f(F.col("block")).alias(c) for c, f in zip(k, keys)), "name"), "names")
        clash = names.groupBy(*k).count().where("count > 1").limit(1).count()
        if not clash:
            break
    cur = rows.select("rid", "n_blocks", F.posexplode("keys").alias("pos", "key")).select("rid", "n_blocks", "pos", *(F.col(f"key.{c}") for c in k))
    cur = cur.join(names, k).select("rid", "n_blocks", "pos", "name")
    most = rows.agg(F.max("n_blocks")).first()[0] or 1
    cur = ws.table(cur, "level0") if most > 1 else cur
    done = cur.where("n_blocks = 1").select("rid", "name")
    width = 1
    while width < most:
        pairs = cur.where(f"n_blocks > {width}").groupBy("rid", "n_blocks", F.expr("pos div 2").alias("pos")).agg(F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("left"), F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(-1)).alias("right"))
        pairs = ws.table(pairs, "pairs")
        named = ws.table(_named(pairs.select("left", "right").distinct(), "left", "right"), "pair-names")
        width *= 2
        cur = pairs.join(named, ["left", "right"]).select("rid", "n_blocks", F.col("pos").cast("int").alias("pos"), "name")
        cur = ws.table(cur, "level") if width < most else cur
        done = done.unionByName(cur.where(f"n_blocks <= {width}").select("rid", "name"))
    return ws.table(rows.drop("keys").join(done, "rid"), "identities")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays, a null id comes last, and of rows with one
    id and equal texts exactly one stays. A null text counts as empty, empty texts are equal to each
    other. An empty table gives an empty result; further columns of docs, whatever their names, are
    not looked at.
    """
    ws = Workspace(docs.sparkSession, "exact-dedup")
    ids = identities(docs, ws, id_col, text_col, block_bytes)
    groups = ids.groupBy("n_blocks", "name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("rid").alias("c"))).alias("best"), F.count("*").alias("group_size"))
    groups = ws.table(groups, "groups")  # so that both sides of the join have exchanges of their own, and a large group can be split
    return ids.join(groups, ["n_blocks", "name"]).select(
        "doc_id", F.col("best.b").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.c")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with their own text; columns and values stay as they are, whatever their names."""
    ws = Workspace(docs.sparkSession, "copies")
    own, doc_id, text = numbered(docs, id_col, text_col)
    rows = ws.table(exact_dedup(own, doc_id, text, **options).select("doc_id", "text_sha256", "kept"), "kept")
    kept = rows.where("kept").select("doc_id", "text_sha256")
    again = rows.groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count()
    own = own.withColumn("sha", F.sha2(normalised(F.col(text)).cast("binary"), 256))
    out = own.join(kept, F.col(doc_id).eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("text_sha256")), "left_semi")
    return named_as(out.dropDuplicates([doc_id, "sha"]) if again else out, docs)


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(t) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS LAST, rid)
"""
