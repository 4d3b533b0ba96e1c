"""Mixing sources to target weights, by blocks of words.

Each source's documents, in a fixed order, are one stream of words packed into blocks of a fixed
length. Each output shard draws a multinomial number of blocks of each source (one independent draw
for each of its slots). The draws of a source are numbered through all shards, and number j takes
block perm(j mod N) of the source's N blocks, where perm is a pseudorandom permutation of [0, N)
that is computed, not stored, another one for each pass over the source. The slots then meet the
blocks by (source, block index).

A source never gives more than its quota of blocks: draws beyond it are passed on, and closing
shards take the sources that are still short, so totals are exact while shards stay random. Of
a source's last draw only the words are taken that its target still wants.

All of it is DataFrame expressions. Work is dealt by (source, hash bucket of the document) or by
(source, block index), so a source with a third of all rows spreads like any other; the passes
ordered by source alone see one row for each bucket or shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.work import SPACE, Workspace, named_as, numbered, partitions, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_WORDS = 128
SHARD_BLOCKS = 16384
SEED = 17
#: Rounds of the swap-or-not shuffle; any number gives a permutation, more mix better.
ROUNDS = 24
#: Most documents of a source that one ordered pass over a hash bucket is meant to hold.
BUCKET_ROWS = 4096
#: Buckets whose sums are added up at a time.
BUCKET_GROUP = 1024
#: Least number of buckets; the rest depends on the rows alone, so that the mix does not depend on the cluster.
LEAST_BUCKETS = 64
#: Cells of [0, 1) through which a uniform draw finds its source.
CELLS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """The place of x under a pseudorandom permutation of [0, n), by swap-or-not rounds."""

    def one(v, r):
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - v, n)
        return F.when(F.xxhash64(key, r, F.greatest(v, other)) % 2 == 0, v).otherwise(other)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("bigint"), one)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """sizes (source, source_size) with sid, weight and target: share of all words dealt by weight, none above most times its size.

    Sources in code-point order, null last, take the weights in turn. The limit of the words that a
    unit of weight gets is found in one pass over the sources sorted by the point where they fill up.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    s = sizes.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(most)).withColumn("fills", F.col("cap") / F.col("weight")).withColumn("all", F.sum("source_size").over(every) * share)
    by_fill = Window.orderBy("fills", "sid")
    full = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("unit", (F.col("all") - full) / left)
    level = F.min(F.when(F.col("unit") <= F.col("fills"), F.struct("fills", "sid", "unit"))).over(every)["unit"]
    return s.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))).select("source", "source_size", "sid", "weight", "target")


class Mix:
    """What mix_sources returns.

    documents: a row for each input row: doc_id, size, source_size, target, taken, digest, source.
    plan: shard, sid, number, block, words: the blocks of each output shard, and how many words of each are taken.
    covered: doc_id, digest, nth, start, size, block, times, first, words, rest: for each row the blocks
    over it, how often each is taken, which of the row's words (from 0) it holds, and how many of them one more, cut draw takes.
    """

    def __init__(self, documents: DataFrame, plan: DataFrame, covered: DataFrame):
        self.documents, self.plan, self.covered = documents, plan, covered


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Mix whole documents' words by source; see Mix for the tables.

    A null text has no words; documents and sources without words take no part and get taken 0.
    A null source is a source of its own, the last. Repeated rows are separate documents. The draw
    depends on ids, sizes and the seed only (and texts' hashes, where ids repeat), so reruns agree on any cluster. A document's words are
    taken at most ``most`` times. Other columns are ignored; an empty table gives empty tables.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mixing")
    rows = ws.table(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("digest")), "rows")
    sources = ws.table(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")).drop("rows"), weights, share, most), "sources")
    # a target is so many whole passes over the source and some words of one more; one block of a source is short
    quotas = sources.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(float(block_words))).cast("bigint")).withColumn("wanted", F.least(F.col("source_size") * most, F.round("target").cast("bigint")))
    quotas = quotas.withColumn("passes", F.coalesce(F.expr("wanted div nullif(source_size, 0)"), F.lit(0))).withColumn("extra", F.col("wanted") - F.col("passes") * F.col("source_size")).withColumn("short", F.col("blocks") * block_words - F.col("source_size"))
    quotas = ws.table(quotas.withColumn("quota", F.col("passes") * F.col("blocks") + F.when(F.col("extra") > 0, F.least(F.col("blocks"), F.expr(f"(extra + short + {block_words - 1}) div {block_words}"))).otherwise(0)), "quotas")
    slots, n_rows = (x or 0 for x in (quotas.agg(F.sum("quota")).first()[0], rows.count()))
    shards = -(-slots // shard_blocks)

    # where each document starts in its source's stream
    n_buckets = max(LEAST_BUCKETS, -(-n_rows // BUCKET_ROWS))
    bucket = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n_buckets
    placed = rows.join(sources.drop("weight"), rows["source"].eqNullSafe(sources["source"])).select("doc_id", "digest", "size", "sid", rows["source"].alias("source"), "source_size", "target", bucket.alias("bucket"))
    sums = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("words")).withColumn("group", F.expr(f"bucket div {BUCKET_GROUP}"))
    groups = sums.groupBy("sid", "group").agg(F.sum("words").alias("all"))
    groups = groups.select("sid", "group", (F.sum("all").over(Window.partitionBy("sid").orderBy("group")) - F.col("all")).alias("earlier"))
    sums = sums.join(groups, ["sid", "group"]).withColumn("before", F.col("earlier") + F.sum("words").over(Window.partitionBy("sid", "group").orderBy("bucket")) - F.col("words")).select("sid", "bucket", "before")
    inside = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nth = F.row_number().over(Window.partitionBy("sid", "bucket", "doc_id", "size", "digest").orderBy("doc_id"))
    placed = placed.withColumn("nth", nth).withColumn("upto", F.sum("size").over(inside)).join(sums, ["sid", "bucket"])
    placed = ws.table(placed.withColumn("start", F.col("before") + F.col("upto") - F.col("size")).drop("before", "upto", "bucket"), "placed")

    # multinomial counts of each shard, then numbers for each source's draws through the shards
    w = Window.orderBy("sid")
    upto = quotas.where("quota > 0").select("sid", "quota", (F.sum("quota").over(w) / F.lit(float(max(1, slots)))).alias("high"), ((F.sum("quota").over(w) - F.col("quota")) / F.lit(float(max(1, slots)))).alias("low"))
    cells = upto.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS).cast("int"), F.least(F.lit(CELLS - 1), F.floor(F.col("high") * CELLS)).cast("int"))))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 48)) / float(1 << 48)
    draws = spark.range(0, slots, 1, partitions(spark)).withColumn("u", u).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    drawn = draws.join(cells, "cell").where("u >= low and u < high").groupBy(F.expr(f"id div {shard_blocks}").alias("shard"), "sid", "quota").count()
    run = F.sum("count").over(Window.partitionBy("sid").orderBy("shard"))
    drawn = ws.table(drawn.withColumn("first", run - F.col("count")), "drawn")
    within = drawn.withColumn("count", F.least(F.col("count"), F.col("quota") - F.col("first"))).where("count > 0").select("shard", "sid", "first", "count")
    short = quotas.select("sid", "quota").join(drawn.groupBy("sid").agg(F.sum("count").alias("got")), "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < quota")
    closing = short.withColumn("k", F.explode(F.expr(f"sequence(0L, (quota - got - 1) div {shard_blocks})"))).select((F.lit(shards) + F.col("k")).alias("shard"), "sid", F.expr(f"got + k * {shard_blocks}").alias("first"), F.expr(f"least({shard_blocks}, quota - got - k * {shard_blocks})").alias("count"))
    plan = within.unionByName(closing).join(quotas.select("sid", "source_size", "blocks", "passes", "extra", "short"), "sid").repartition(partitions(spark), "shard", "sid")
    plan = plan.withColumn("number", F.explode(F.expr("sequence(first, first + count - 1)")))
    key = F.xxhash64(F.lit(seed), F.col("sid"), F.expr("number div blocks"))
    plan = ws.table(plan.withColumn("block", permuted(F.expr("number % blocks"), F.col("blocks"), key)).select("shard", "sid", "number", "blocks", "passes", "extra", "short", "block"), "plan")
    # in the pass that is not whole, the words before a draw are those of the draws before it, of which one may be the short block
    shorter = plan.groupBy("sid").agg(F.max(F.expr("if(number >= passes * blocks and block = blocks - 1, number, null)")).alias("short_at"))  # a row for each source, so that the join is there whether a short block is drawn or not
    before = F.expr(f"(number - passes * blocks) * {block_words} - if(short_at < number, short, 0L)")
    whole = F.expr(f"{block_words} - if(block = blocks - 1, short, 0L)")
    plan = plan.join(shorter, "sid").withColumn("words", F.when(F.expr("number < passes * blocks"), whole).otherwise(F.least(whole, F.col("extra") - before)))
    plan = plan.where("words > 0").select("shard", "sid", "number", "block", "words", (F.col("words") == whole).alias("whole"))

    # blocks meet documents by index
    times = plan.groupBy("sid", "block").agg(F.count_if("whole").alias("times"), F.max(F.expr("if(whole, 0L, words)")).alias("cut"))
    over = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")))
    over = over.withColumn("first", F.greatest(F.lit(0), F.col("block") * block_words - F.col("start"))).withColumn("words", F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("start")) - F.col("first"))
    covered = over.join(times, ["sid", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    rest = F.least(F.col("words"), F.coalesce("cut", F.lit(0)) + F.col("block") * block_words - F.col("start") - F.col("first"))
    covered = covered.withColumn("rest", F.greatest(F.lit(0), rest)).drop("cut")
    row = ["doc_id", "digest", "nth", "source", "size", "source_size", "target"]
    taken = covered.groupBy(*row, "start").agg(F.sum(F.col("times") * F.col("words") + F.col("rest")).alias("taken")).select(*row, "taken")
    none = placed.where("size = 0").select(*row, F.lit(0).cast("bigint").alias("taken"))
    return Mix(taken.unionByName(none), plan, covered)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows with the columns of docs, each a taken stretch of a document.

    A pass over a document in which every block is taken gives its whole text unchanged; a pass in
    which some are gives one row for each unbroken run of taken blocks. n_chars, where there is such
    a column, is made to fit. Rows of documents that no block was taken of are gone.
    """
    names = [options.pop(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))]
    own, doc_id, text, source = numbered(docs, *names)
    mix = mix_sources(own, id_col=doc_id, text_col=text, source_col=source, **options)
    passes = mix.covered.where("times > 0 or rest > 0").withColumn("pass", F.explode(F.expr("sequence(1, cast(times as int) + if(rest > 0, 1, 0))"))).withColumn("words", F.expr("if(pass > times, rest, words)"))
    row = ["doc_id", "digest", "nth", "source", "size"]
    in_order = Window.partitionBy(*row, "pass").orderBy("block")
    runs = passes.withColumn("island", F.col("block") - F.row_number().over(in_order)).groupBy(*row, "pass", "island").agg(F.min("first").alias("first"), F.sum("words").alias("words"))
    runs = runs.groupBy(*row).agg(F.collect_list(F.struct("first", "words")).alias("runs"))
    own = own.withColumn("mine", F.xxhash64(F.col(text)))
    repeated = mix.documents.where("nth > 1").limit(1).count()
    own = own.withColumn("n", F.row_number().over(Window.partitionBy(doc_id, "mine", source).orderBy(doc_id)) if repeated else F.lit(1))
    out = own.join(runs, F.col(doc_id).eqNullSafe(F.col("doc_id")) & (F.col("mine") == F.col("digest")) & (F.col("n") == F.col("nth")) & F.col(source).eqNullSafe(F.col("source"))).withColumn("run", F.explode("runs"))
    part = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(f"([^{SPACE}]+[{SPACE}]*)"), F.lit(1)), (F.col("run.first") + 1).cast("int"), F.col("run.words").cast("int")), "")
    out = out.withColumn(text, F.when(F.col("run.words") == F.col("size"), F.col(text)).otherwise(F.regexp_replace(part, f"[{SPACE}]+$", "")))
    if "n_chars" in docs.columns:
        n_chars = numbered(docs, "n_chars")[1]
        out = out.withColumn(n_chars, F.char_length(F.col(text)).cast(docs.schema["n_chars"].dataType))
    return named_as(out, docs)


def op3_source_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).documents.select("doc_id", "size", "source_size", "target", "taken")
