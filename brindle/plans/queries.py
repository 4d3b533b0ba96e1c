"""The registered queries of the relational surface, each with its SQL oracle."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import aggregates as A
from brindle.functions import casts as C
from brindle.functions import scalar as S
from brindle.operators import relational as R
from brindle.operators import writes as W
from brindle.operators.apply import Functions
from brindle.plans import sql as Q
from brindle.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    """Register a function under its name, with the SQL that must give its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return files.read_table(spark, sf, name)


def same_sql(name: str, text: str, tables: list[str], oracle: str | None = None, params: dict | None = None) -> None:
    """Register SQL text that runs through the engine's statement runner; the oracle is the same text unless given."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        files.register_tables(spark, sf, tables)
        return Q.run(spark, text, params)

    QUERIES[name] = run
    ORACLES[name] = oracle or text


def scratch(spark: SparkSession) -> str:
    """A folder for round trips: the shared one where the cluster names one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        return tempfile.mkdtemp(prefix="brindle-io-")

    return f"{root.rstrip('/')}/io-{uuid.uuid4().hex}"


# scans, projections, filters


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-04-01'")
def scan_range(spark, sf):
    return R.scan(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"], "l_shipdate", F.expr("timestamp_ntz'1995-01-01'"), F.expr("timestamp_ntz'1995-04-01'"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def find_point(spark, sf):
    return R.find(t(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"], o_orderkey=7)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = NULL")
def find_null(spark, sf):
    return R.find(t(spark, sf, "orders"), ["o_orderkey", "o_custkey"], o_custkey=None)


@query("SELECT l_orderkey, l_linenumber, CAST(l_partkey // 7 AS BIGINT) AS q, CAST((l_linenumber - 4) // 3 AS INTEGER) AS qi, CAST(l_partkey % 7 AS BIGINT) AS r, l_extendedprice * (1 - l_discount) AS net, -l_linenumber AS neg FROM lineitem")
def project_arith_intdiv(spark, sf):
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.divide(k, F.lit(7), "bigint").alias("q"), S.divide(n - 4, F.lit(3), "int").alias("qi"), S.remainder(k, F.lit(7), "bigint").alias("r"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), (-n).alias("neg"))


same_sql(
    "filter_three_valued",
    """SELECT event_id, (value > 50) IS TRUE AS is_true, (nullif(event_type, 'click') = 'view') IS FALSE AS is_false, (nullif(event_type, 'click') = 'view') IS NULL AS is_unknown,
       nullif(event_type, 'click') IS NOT DISTINCT FROM NULL AS same_null, nullif(event_type, 'click') IS DISTINCT FROM 'view' AS differs
       FROM events WHERE NOT (nullif(event_type, 'click') = 'view') OR value > 50""",
    ["events"],
)


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', CAST(1.5 AS DOUBLE)), (2, NULL, 2.5), (NULL, 'c', NULL)) v(c0, c1, c2)")
def values_rows(spark, sf):
    return R.values(spark, [(1, "a", 1.5), (2, None, 2.5), (None, "c", None)], "c0 bigint, c1 string, c2 double")


same_sql("values_subquery", "SELECT (SELECT max(n_nationkey) FROM nation) AS c0 UNION ALL SELECT (SELECT min(n_nationkey) FROM nation) UNION ALL VALUES (7)", ["nation"], "SELECT * FROM (VALUES ((SELECT max(n_nationkey) FROM nation)), ((SELECT min(n_nationkey) FROM nation)), (7)) v(c0)")
same_sql("table_shorthand", "SELECT * FROM (TABLE region)", ["region"], "SELECT * FROM region")
same_sql("in_list", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3, NULL) AND n_nationkey NOT IN (2, 4)", ["nation"])
same_sql("host_variables", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = :region AND n_nationkey >= :low LIMIT :most", ["nation"], "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey >= 2 LIMIT 100", {"region": 1, "low": 2, "most": 100})


@query("SELECT * FROM (SELECT n_regionkey AS k, CAST(count(*) AS BIGINT) AS n, 'nations' AS what FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, CAST(max(n_nationkey) AS BIGINT), 'last' FROM nation GROUP BY 1)")
def buffer_branches(spark, sf):
    a, b = R.branches(t(spark, sf, "nation"), lambda d: d.groupBy("n_regionkey").agg(F.count("*").alias("n")).withColumn("what", F.lit("nations")), lambda d: d.groupBy("n_regionkey").agg(F.max("n_nationkey").cast("bigint").alias("n")).withColumn("what", F.lit("last")))
    return R.union_all(a, b).withColumnRenamed("n_regionkey", "k")


# sorting and limits


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority NULLS FIRST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def limit_topk(spark, sf):
    return R.top_k(t(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), 50, F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM orders LIMIT 17)")
def limit_plain(spark, sf):
    return R.limit(t(spark, sf, "orders"), 17).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders LIMIT 0")
def limit_zero(spark, sf):
    return R.limit(t(spark, sf, "orders").select("o_orderkey"), 0)


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def topk_per_group(spark, sf):
    return R.top_k_per_group(t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], 2, F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey")


# distinct and set operations


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct(spark, sf):
    return t(spark, sf, "customer").select("c_nationkey", "c_mktsegment").distinct()


def _keys(spark, sf):
    of = lambda name, p: t(spark, sf, name).selectExpr(f"nullif({p}_nationkey, 3) AS k", f"CAST(floor({p}_acctbal / 500) AS BIGINT) AS b")
    return of("customer", "c"), of("supplier", "s")


_A, _B = (f"SELECT nullif({p}_nationkey, 3) AS k, CAST(floor({p}_acctbal / 500) AS BIGINT) AS b FROM {name}" for name, p in (("customer", "c"), ("supplier", "s")))


@query(f"{_A} UNION ALL {_B}")
def union_all(spark, sf):
    return R.union_all(*_keys(spark, sf))


@query("SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier UNION ALL SELECT 5")
def union_types(spark, sf):
    return R.union_all(t(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), t(spark, sf, "supplier").select("s_suppkey"), R.values(spark, [(5,)], "c int"))


@query(f"{_A} UNION {_B}")
def union_distinct(spark, sf):
    return R.union_distinct(*_keys(spark, sf))


@query(f"{_A} EXCEPT {_B}")
def except_distinct(spark, sf):
    return R.except_distinct(*_keys(spark, sf))


@query(f"{_A} INTERSECT {_B}")
def intersect_distinct(spark, sf):
    return R.intersect_distinct(*_keys(spark, sf))


# joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf):
    return R.join(t(spark, sf, "orders"), t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 20")
def join_theta(spark, sf):
    return R.join(t(spark, sf, "orders"), t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "inner", F.col("o_totalprice") > F.col("c_acctbal") * 20).select("o_orderkey", "c_custkey")


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(spark, sf):
    return R.cross(t(spark, sf, "region"), t(spark, sf, "nation")).select("r_name", "n_name")


_LR = "(SELECT nullif(n_nationkey, 5) AS k, n_name FROM nation WHERE n_nationkey < 15) l {} JOIN (SELECT nullif(n_nationkey, 5) AS k2, n_regionkey FROM nation WHERE n_nationkey > 3) r ON k = k2"


def _sides(spark, sf):
    n = t(spark, sf, "nation")
    return n.where("n_nationkey < 15").select(F.expr("nullif(n_nationkey, 5)").alias("k"), "n_name"), n.where("n_nationkey > 3").select(F.expr("nullif(n_nationkey, 5)").alias("k2"), "n_regionkey")


def _register_outer(kind: str, sql: str):
    def run(spark, sf):
        a, b = _sides(spark, sf)
        return R.join(a, b, F.col("k") == F.col("k2"), kind)

    QUERIES[f"join_{kind}"] = run
    ORACLES[f"join_{kind}"] = f"SELECT k, n_name, k2, n_regionkey FROM {_LR.format(sql)}"


for _kind, _sql in (("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):
    _register_outer(_kind, _sql)


@query(f"SELECT k, n_name, k2, n_regionkey FROM {_LR.format('FULL')} AND n_regionkey > 1")
def join_full_residual(spark, sf):
    a, b = _sides(spark, sf)
    return R.join(a, b, F.col("k") == F.col("k2"), "full", F.col("n_regionkey") > 1)


@query(f"SELECT k, n_name, k2, n_regionkey FROM {_LR.format('LEFT')} AND n_regionkey > 1")
def join_left_residual(spark, sf):
    a, b = _sides(spark, sf)
    return R.join(a, b, F.col("k") == F.col("k2"), "left", F.col("n_regionkey") > 1)


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def join_semi(spark, sf):
    return R.join(t(spark, sf, "customer"), t(spark, sf, "orders").where("o_totalprice > 100000"), F.col("o_custkey") == F.col("c_custkey"), "semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < 30000)")
def join_anti(spark, sf):
    return R.join(t(spark, sf, "customer"), t(spark, sf, "orders").where("o_totalprice < 30000"), F.col("o_custkey") == F.col("c_custkey"), "anti").select("c_custkey", "c_name")


@query("SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) NATURAL JOIN (SELECT c_nationkey AS k, c_custkey AS b FROM customer)")
def join_natural(spark, sf):
    return R.natural(t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a")), t(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("b")))


@query("SELECT k, a, b, c FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) JOIN (SELECT s_nationkey AS k, s_suppkey AS b FROM supplier) USING (k) JOIN (SELECT c_nationkey AS k, c_custkey AS c FROM customer) USING (k)")
def join_nway(spark, sf):
    return R.n_way(t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a")), t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("b")), t(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("c")), on=["k"])


same_sql("join_mixed_types", "SELECT n_name, s_suppkey FROM nation JOIN supplier ON CAST(n_nationkey AS DECIMAL(5, 0)) = CAST(s_nationkey AS REAL) AND n_nationkey = CAST(s_nationkey AS BIGINT)", ["nation", "supplier"])


@query("SELECT o_orderkey, band FROM orders JOIN (SELECT c_custkey AS band, c_acctbal * 40 AS low, c_acctbal * 40 + 500 AS high FROM customer) ON o_totalprice >= low AND o_totalprice < high")
def join_range(spark, sf):
    bands = t(spark, sf, "customer").select(F.col("c_custkey").alias("band"), (F.col("c_acctbal") * 40).alias("low"), (F.col("c_acctbal") * 40 + 500).alias("high"))
    return R.range_join(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "low", "high", 1000.0).select("o_orderkey", "band")


@query("SELECT n_nationkey, r_name FROM nation LEFT JOIN region ON r_regionkey = nullif(n_regionkey, 2)")
def join_find(spark, sf):
    return R.join(t(spark, sf, "nation").withColumn("k", F.expr("nullif(n_regionkey, 2)")), t(spark, sf, "region"), F.col("k") == F.col("r_regionkey"), "left").select("n_nationkey", "r_name")


# aggregation


@query("""SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_linenumber) AS INTEGER) AS lines, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS disc, min(l_shipdate) AS first_ship, max(l_quantity) AS most
          FROM lineitem GROUP BY ALL""")
def agg_group(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), A.sum_(F.col("l_linenumber"), "int").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.avg("l_discount"), 6).alias("disc"), F.min("l_shipdate").alias("first_ship"), F.max("l_quantity").alias("most"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, min(o_orderdate) AS first_day, round(sum(o_totalprice), 1) AS total FROM orders")
def agg_global(spark, sf):
    return t(spark, sf, "orders").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first_day"), F.round(F.sum("o_totalprice"), 1).alias("total"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(o_custkey) AS BIGINT) AS m, max(o_custkey) AS top, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders WHERE o_orderkey < 0")
def agg_empty(spark, sf):
    return t(spark, sf, "orders").where("o_orderkey < 0").agg(F.count("*").alias("n"), F.count("o_custkey").alias("m"), F.max("o_custkey").alias("top"), A.sum_(F.col("o_custkey"), "bigint").alias("total"))


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 100000")
def having(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top")).where("n > 12 AND top > 100000").select("o_custkey", "n")


same_sql("having_global", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders HAVING max(o_totalprice) > 0", ["orders"])


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS rows_, CAST(count(nullif(o_orderpriority, '5-LOW')) AS BIGINT) AS some, CAST(count(NULL) AS BIGINT) AS none FROM orders GROUP BY 1")
def count_variants(spark, sf):
    return t(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("rows_"), F.count(F.expr("nullif(o_orderpriority, '5-LOW')")).alias("some"), F.count(F.lit(None)).alias("none"))


@query("SELECT l_returnflag, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers, CAST(count(DISTINCT l_shipdate) AS BIGINT) AS days, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def count_distinct(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_shipdate").alias("days"), F.count("*").alias("n"))


same_sql(
    "minmax_types",
    """SELECT min(p_partkey) AS a, max(p_size) AS b, min(CAST(p_size AS REAL)) AS c, max(p_retailprice) AS d, min(CAST(p_size AS DECIMAL(8, 2))) AS e, max(p_name) AS f, min(CAST(p_brand AS {b})) AS g,
       max(CAST('2020-01-01' AS DATE)) AS h FROM part""".replace("{b}", "BINARY"),
    ["part"],
    """SELECT min(p_partkey) AS a, max(p_size) AS b, min(CAST(p_size AS REAL)) AS c, max(p_retailprice) AS d, min(CAST(p_size AS DECIMAL(8, 2))) AS e, max(p_name) AS f, min(CAST(p_brand AS BLOB)) AS g,
       max(CAST('2020-01-01' AS DATE)) AS h FROM part""",
)


@query("SELECT l_returnflag, CAST(sum(l_linenumber) AS INTEGER) AS i, CAST(sum(l_suppkey) AS BIGINT) AS b, CAST(sum(CAST(l_linenumber AS DECIMAL(10, 2))) AS DECIMAL(38, 2)) AS d FROM lineitem GROUP BY 1")
def sum_typed(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(A.sum_(F.col("l_linenumber"), "int").alias("i"), A.sum_(F.col("l_suppkey"), "bigint").alias("b"), A.sum_(F.col("l_linenumber").cast("decimal(10,2)"), "decimal(38,2)").alias("d"))


@query("SELECT l_returnflag, CAST(sum(l_linenumber - 5) // count(*) AS INTEGER) AS i, CAST(sum(l_suppkey) // count(*) AS BIGINT) AS b FROM lineitem GROUP BY 1")
def avg_typed(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(A.avg(F.col("l_linenumber") - 5, "int").alias("i"), A.avg(F.col("l_suppkey"), "bigint").alias("b"))


# subqueries

same_sql("subq_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", ["orders", "customer"])
same_sql("subq_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49) AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND n_regionkey = 2)", ["supplier", "lineitem", "nation"])
same_sql("subq_exists_column", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer", ["customer", "orders"])
same_sql("subq_scalar", "SELECT o_orderkey, (SELECT max(c_custkey) FROM customer) AS top FROM orders WHERE o_custkey > (SELECT max(c_custkey) - 20 FROM customer)", ["orders", "customer"])
same_sql("subq_scalar_corr", "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer", ["customer", "orders"])


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def subq_at_most_one(spark, sf):
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return R.scalar_or_error(t(spark, sf, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], n, "n_name").select("c_custkey", "n_name")


# functions


@query("""SELECT p_partkey, CASE WHEN length(p_name) >= 3 THEN substring(p_name, 3, 4) END AS a, CAST(NULL AS VARCHAR) AS b, CASE WHEN length(p_name) >= 2 THEN substring(p_name, 2) END AS c, CAST(NULL AS VARCHAR) AS d,
          CASE WHEN length(p_name) >= 1 THEN '' END AS e FROM part""")
def fn_substring(spark, sf):
    n = F.col("p_name")
    return t(spark, sf, "part").select("p_partkey", S.substring(n, 3, 4).alias("a"), S.substring(n, 0, 2).alias("b"), S.substring(n, 2).alias("c"), S.substring(n, 1, -1).alias("d"), S.substring(n, 1, 0).alias("e"))


@query("SELECT doc_id, translate(source, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS up, translate('ÀBc' || source, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents")
def fn_case_map(spark, sf):
    return t(spark, sf, "documents").select("doc_id", S.upper(F.col("source")).alias("up"), S.lower(F.concat(F.lit("ÀBc"), F.col("source"))).alias("low"))


same_sql("fn_length", "SELECT doc_id, CAST(char_length(text) AS BIGINT) AS chars, CAST(octet_length(text) AS BIGINT) AS bytes_ FROM documents", ["documents"], "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(strlen(text) AS BIGINT) AS bytes_ FROM documents")
same_sql("fn_position", "SELECT doc_id, CAST(position('en' IN text) AS BIGINT) AS a, CAST(position('' IN text) AS BIGINT) AS b, CAST(position('~~' IN text) AS BIGINT) AS c FROM documents", ["documents"])
same_sql("fn_trim", "SELECT r_regionkey, ltrim('  ' || r_name || '  ') AS l, rtrim('  ' || r_name || '  ') AS r FROM region", ["region"])
same_sql("fn_concat", "SELECT c_custkey, c_name || '/' || nullif(c_mktsegment, 'BUILDING') AS both_ FROM customer", ["customer"])
same_sql("fn_abs", "SELECT c_custkey, abs(c_acctbal) AS a, abs(c_nationkey - 10) AS b FROM customer", ["customer"])
same_sql("fn_mod", "SELECT l_orderkey, l_linenumber, mod(l_partkey - 100, 7) AS a, mod(CAST(l_linenumber AS DECIMAL(5, 1)), CAST(1.5 AS DECIMAL(5, 1))) AS b FROM lineitem", ["lineitem"], "SELECT l_orderkey, l_linenumber, mod(l_partkey - 100, 7) AS a, CAST(mod(CAST(l_linenumber AS DECIMAL(5, 1)), CAST(1.5 AS DECIMAL(5, 1))) AS DECIMAL(5, 1)) AS b FROM lineitem")


@query("SELECT p_partkey, translate(p_brand, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS up, CAST(NULL AS VARCHAR) AS none, substring(p_name, 2, 3) AS part_ FROM part WHERE length(p_name) >= 2")
def fn_dialect_sql(spark, sf):
    files.register_tables(spark, sf, ["part"])
    return Q.run_in_dialect(spark, "SELECT p_partkey, upper(p_brand) AS up, substring(p_name, 0, 2) AS none, substring(p_name FROM 2 FOR 3) AS part_ FROM part WHERE char_length(p_name) >= 2")


@query("SELECT p_partkey, CAST(ceil(p_retailprice) AS DOUBLE) AS c, CAST(floor(p_retailprice) AS DOUBLE) AS f, p_size AS ci, CAST(ceil(CAST(p_retailprice AS DECIMAL(12, 2))) AS DECIMAL(12, 2)) AS cd FROM part")
def fn_ceil_floor(spark, sf):
    p = F.col("p_retailprice")
    return t(spark, sf, "part").select("p_partkey", S.ceil(p, "double").alias("c"), S.floor(p, "double").alias("f"), S.ceil(F.col("p_size"), "int").alias("ci"), S.ceil(p.cast("decimal(12,2)"), "decimal(12,2)").alias("cd"))


@query("SELECT p_partkey, CAST(round(CAST(p_retailprice AS DECIMAL(12, 2)), 1) AS DECIMAL(12, 1)) AS a, CAST(round(p_size, -1) AS INTEGER) AS b FROM part")
def fn_round(spark, sf):
    return t(spark, sf, "part").select("p_partkey", S.round_(F.col("p_retailprice").cast("decimal(12,2)"), "decimal(12,1)", 1).alias("a"), S.round_(F.col("p_size"), "int", -1).alias("b"))


@query("SELECT n_nationkey, base64(encode(n_name)) AS e, encode(n_name) AS d FROM nation")
def fn_base64(spark, sf):
    e = S.encode(F.col("n_name").cast("binary"), "BASE64")
    return t(spark, sf, "nation").select("n_nationkey", e.alias("e"), S.decode(e, "base64").alias("d"))


same_sql("fn_time_family", "SELECT current_date() = CAST(localtimestamp() AS DATE) AS same_day, current_timestamp() IS NOT NULL AS has_now", [], "SELECT true AS same_day, true AS has_now")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e_a%' OR p_name LIKE '%\\%'")
def like_plain(spark, sf):
    n = F.col("p_name")
    return t(spark, sf, "part").where(S.like(n, "%e_a%") | S.like(n, "%\\%")).select("p_partkey", "p_name")


@query("SELECT p_partkey, replace(p_name, ' ', '_') LIKE '%a#_%' ESCAPE '#' AS m FROM part")
def like_escape(spark, sf):
    return t(spark, sf, "part").select("p_partkey", S.like(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), "%a#_%", "#").alias("m"))


same_sql("case_coalesce_nullif", "SELECT event_id, CASE WHEN value < 20 THEN 'low' WHEN value < 80 THEN 'mid' END AS band, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS code, coalesce(nullif(event_type, 'click'), nullif(event_type, 'view'), '-') AS kind FROM events", ["events"])


@query("""SELECT l_orderkey, l_linenumber, CAST(least(greatest(trunc(l_extendedprice * 1000000), -2147483648), 2147483647) AS INTEGER) AS i, CAST(trunc(l_extendedprice - 30000) AS BIGINT) AS b,
          CAST(CASE WHEN l_partkey > 99 THEN 99 ELSE l_partkey END AS DECIMAL(2, 0)) AS d, CAST(trunc(l_quantity * 10) / 10 AS DOUBLE) AS q FROM lineitem""")
def cast_numeric(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.to_integer(F.col("l_extendedprice") * 1000000, "double", "int").alias("i"), C.to_integer(F.col("l_extendedprice") - 30000, "double", "bigint").alias("b"), C.to_decimal(F.col("l_partkey"), "bigint", 2, 0).alias("d"), C.to_decimal(F.col("l_quantity"), "double", 10, 1).cast("double").alias("q"))


@query("SELECT p_partkey, p_name[1:5] AS v, rpad(p_brand[1:12], 12, ' ') AS c, CAST(trunc(p_retailprice) AS INTEGER) AS n, CAST(p_size AS VARCHAR) AS s, p_size % 2 = 0 AS b FROM part")
def cast_string(spark, sf):
    return t(spark, sf, "part").select("p_partkey", C.to_varchar(F.col("p_name"), 5).alias("v"), C.to_char(F.col("p_brand"), 12).alias("c"), C.to_integer(F.concat(F.lit(" "), F.col("p_retailprice").cast("decimal(12,2)").cast("string")), "string", "int").alias("n"), C.to_text(F.col("p_size")).alias("s"), C.to_boolean(F.when(F.col("p_size") % 2 == 0, "Tr").otherwise("FALS")).alias("b"))


@query("SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE) AS d, o_orderdate AS ts FROM orders")
def cast_temporal(spark, sf):
    x = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return t(spark, sf, "orders").select("o_orderkey", C.to_date(F.substring(x, 1, 10)).alias("d"), C.to_timestamp(x).alias("ts"))


@query("SELECT n_nationkey, encode(n_name) AS raw FROM nation")
def cast_varbinary(spark, sf):
    return t(spark, sf, "nation").select("n_nationkey", C.to_varbinary(F.hex("n_name")).alias("raw"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS INTEGER) AS a FROM lineitem")
def assign_checked(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.assign_integer(F.col("l_linenumber").cast("decimal(10,2)"), "decimal(10,2)", "int").alias("a"))


# APPLY and functions of the user


class Steps:
    """1 to n."""

    def eval(self, n: int):
        for i in range(1, (n or 0) + 1):
            yield (i, i * i)


def _apply(spark, sf, outer):
    f = Functions(spark)
    f.register_table("steps", Steps, "i int, sq int")
    return f.apply(t(spark, sf, "nation").select("n_nationkey", "n_regionkey"), "steps", ["n_regionkey"], outer)


@query("SELECT n_nationkey, n_regionkey, CAST(i AS INTEGER) AS i, CAST(i * i AS INTEGER) AS sq FROM nation, range(1, n_regionkey + 1) r(i)")
def apply_cross(spark, sf):
    return _apply(spark, sf, False)


@query("SELECT n_nationkey, n_regionkey, CAST(i AS INTEGER) AS i, CAST(i * i AS INTEGER) AS sq FROM nation LEFT JOIN LATERAL (SELECT * FROM range(1, n_regionkey + 1) r(i)) ON true")
def apply_outer(spark, sf):
    return _apply(spark, sf, True)


@query("SELECT c_custkey, CAST(c_nationkey * 3 + 1 AS BIGINT) AS y FROM customer")
def udf_scalar(spark, sf):
    def triple(x):
        return x * 3 + 1

    triple.__annotations__ = {"x": __import__("pandas").Series, "return": __import__("pandas").Series}
    Functions(spark).register_scalar("triple_and_one", triple, "bigint")
    return t(spark, sf, "customer").selectExpr("c_custkey", "triple_and_one(CAST(c_nationkey AS BIGINT)) AS y")


# writes

_NEW = "SELECT c_custkey + 100 AS c_custkey, 'new' AS c_name, c_acctbal FROM customer"


def _customers(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return c, c.select((F.col("c_custkey") + 100).alias("c_custkey"), F.lit("new").alias("c_name"), "c_acctbal")


@query(f"SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT * FROM ({_NEW}) WHERE c_custkey > (SELECT max(c_custkey) FROM customer)")
def dml_insert_skip(spark, sf):
    return W.insert_or_ignore(*_customers(spark, sf), ["c_custkey"])


@query(f"SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey + 100 FROM customer) UNION ALL {_NEW}")
def dml_insert_overwrite(spark, sf):
    return W.insert_or_replace(*_customers(spark, sf), ["c_custkey"])


@query("SELECT k, v FROM (SELECT c_nationkey AS k, c_custkey AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) AS r FROM customer) WHERE r = 1")
def dml_insert_select_order(spark, sf):
    rows = t(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("v"), "c_acctbal")
    empty = rows.limit(0)
    return W.insert_or_replace(empty, rows, ["k"], [F.asc("c_acctbal"), F.asc("v")]).select("k", "v")


@query("SELECT * FROM region UNION ALL SELECT r_regionkey + 10, upper(r_name) FROM region")
def dml_insert(spark, sf):
    r = t(spark, sf, "region")
    return W.insert(r, r.select((F.col("r_regionkey") + 10).cast("int").alias("r_regionkey"), S.upper(F.col("r_name")).alias("r_name")), ["r_regionkey"])


@query("SELECT s_suppkey, s_name, CASE WHEN s_nationkey < 10 THEN s_nationkey + 1 ELSE s_nationkey END AS s_nationkey, CASE WHEN s_nationkey < 10 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM supplier")
def dml_update(spark, sf):
    return W.update(t(spark, sf, "supplier"), F.col("s_nationkey") < 10, s_nationkey=F.col("s_nationkey") + 1, s_acctbal=F.col("s_acctbal") * 2)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_totalprice > 100000 AND o_orderstatus <> 'O')")
def dml_delete(spark, sf):
    return W.delete(t(spark, sf, "orders"), (F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") != "O")).select("o_orderkey", "o_custkey")


# round trips


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def io_parquet_roundtrip(spark, sf):
    path = f"{scratch(spark)}/nation"
    files.dump_parquet(t(spark, sf, "nation"), path)
    return files.load_parquet(spark, [path], {"n_nationkey": 0, "n_name": "n_name", "n_regionkey": 2})


@query("SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderdate FROM orders")
def io_arrow_roundtrip(spark, sf):
    names = files.dump_arrow(t(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate"), f"{scratch(spark)}/orders")
    return files.load_arrow(spark, names)


# whole queries


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def tpch_q6(spark, sf):
    rows = R.scan(t(spark, sf, "lineitem"), None, "l_shipdate", F.expr("timestamp_ntz'1994-01-01'"), F.expr("timestamp_ntz'1995-01-01'")).where("l_discount BETWEEN 0.05D AND 0.07D AND l_quantity < 24")
    return rows.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


same_sql(
    "tpch_q2_min_cost",
    """WITH ps AS (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS cost FROM lineitem GROUP BY l_partkey, l_suppkey)
       SELECT l_partkey, min(cost) AS low FROM ps JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       WHERE r_regionkey = 1 GROUP BY l_partkey""",
    ["lineitem", "supplier", "nation", "region"],
)
same_sql(
    "tpch_q2_suppliers",
    """WITH ps AS (SELECT l_partkey, l_suppkey, round(min(l_extendedprice / l_quantity), 4) AS cost FROM lineitem GROUP BY l_partkey, l_suppkey)
       SELECT s_acctbal, s_name, n_name, p_partkey FROM ps JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey
       WHERE p_size < 20 AND cost = (SELECT min(x.cost) FROM ps x WHERE x.l_partkey = ps.l_partkey)
       ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    ["lineitem", "part", "supplier", "nation"],
)
same_sql(
    "tpch_q14",
    """SELECT round(100 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo
       FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1995-09-01' AND l_shipdate < TIMESTAMP '1995-10-01'""",
    ["lineitem", "part"],
    None,
)
same_sql(
    "tpch_q19",
    """SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
       WHERE (p_size BETWEEN 1 AND 15 AND l_quantity >= 1 AND l_quantity <= 11) OR (p_size BETWEEN 16 AND 30 AND l_quantity >= 10 AND l_quantity <= 20) OR (p_size BETWEEN 31 AND 50 AND l_quantity >= 20 AND l_quantity <= 30)""",
    ["lineitem", "part"],
)
same_sql(
    "tpch_q1",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, CAST(count(*) AS BIGINT) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
    ["lineitem"],
)
same_sql(
    "tpch_q3",
    """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
       WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    ["customer", "orders", "lineitem"],
)
same_sql(
    "tpch_q5",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
       JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 2 GROUP BY n_name""",
    ["customer", "orders", "lineitem", "supplier", "nation", "region"],
)
same_sql("tpcc_district_lookup", "SELECT s_nationkey, s_acctbal FROM supplier WHERE s_suppkey = :s AND s_nationkey = :n", ["supplier"], "SELECT s_nationkey, s_acctbal FROM supplier WHERE s_suppkey = 3 AND s_nationkey = (SELECT s_nationkey FROM supplier WHERE s_suppkey = 3)")
same_sql("tpcc_stock_level", "SELECT l_orderkey, CAST(count(DISTINCT l_partkey) AS BIGINT) AS low FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 15 GROUP BY l_orderkey", ["lineitem", "part"])
same_sql("tpcc_order_status", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7 AND o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_custkey = 7)", ["orders"])


def _district(spark, sf):
    """The key comes from a first statement, as a client's transaction would bind it."""
    files.register_tables(spark, sf, ["supplier"])
    n = spark.sql("SELECT s_nationkey FROM supplier WHERE s_suppkey = 3").first()
    return Q.Prepared(spark, "SELECT s_nationkey, s_acctbal FROM supplier WHERE s_suppkey = :s AND s_nationkey = :n", {"s": int, "n": int}).execute(s=3, n=n and n[0])


QUERIES["tpcc_district_lookup"] = _district


@query("SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS paid_cents, CAST(count(*) AS BIGINT) AS orders_ FROM orders GROUP BY o_custkey")
def tpcc_payment_totals(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("paid_cents"), F.count("*").alias("orders_"))


# SQL text in the engine's dialect: the oracle says the same in another way


def dialect(name: str, text: str, tables: list[str], oracle: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        files.register_tables(spark, sf, tables)
        return Q.run_in_dialect(spark, text)

    QUERIES[name] = run
    ORACLES[name] = oracle


dialect("sql_divide", "SELECT l_orderkey, l_linenumber, l_partkey / 7 AS q, (l_linenumber - 4) / 3 / 2 AS qi, l_quantity / 4 AS qd FROM lineitem", ["lineitem"], "SELECT l_orderkey, l_linenumber, CAST(l_partkey // 7 AS BIGINT) AS q, CAST(((l_linenumber - 4) // 3) // 2 AS INTEGER) AS qi, l_quantity / 4 AS qd FROM lineitem")
dialect("sql_aggregates", "SELECT l_returnflag, avg(l_linenumber - 5) AS a, sum(l_linenumber) AS s, avg(l_suppkey) AS b FROM lineitem GROUP BY l_returnflag", ["lineitem"], "SELECT l_returnflag, CAST(sum(l_linenumber - 5) // count(*) AS INTEGER) AS a, CAST(sum(l_linenumber) AS INTEGER) AS s, CAST(sum(l_suppkey) // count(*) AS BIGINT) AS b FROM lineitem GROUP BY 1")
dialect("sql_rounding", "SELECT p_partkey, ceil(p_retailprice) AS c, floor(p_size) AS f, round(CAST(p_size AS DECIMAL(8, 2)) + 0.05, 1) AS r FROM part", ["part"], "SELECT p_partkey, CAST(ceil(p_retailprice) AS DOUBLE) AS c, p_size AS f, CAST(round(CAST(p_size AS DECIMAL(8, 2)) + 0.05, 1) AS DECIMAL(9, 2)) AS r FROM part")
dialect("sql_casts", "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice * 1000000 AS INT) AS i, CAST(l_extendedprice AS BIGINT) AS b FROM lineitem", ["lineitem"], "SELECT l_orderkey, l_linenumber, CAST(least(trunc(l_extendedprice * 1000000), 2147483647) AS INTEGER) AS i, CAST(trunc(l_extendedprice) AS BIGINT) AS b FROM lineitem")
dialect("sql_like", "SELECT p_partkey, p_name LIKE '%e_a%' AS a, concat(p_name, chr(92)) LIKE '%\\\\' AS b FROM part", ["part"], "SELECT p_partkey, p_name LIKE '%e_a%' AS a, true AS b FROM part")


@query("SELECT o_orderkey, CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) || '00000000000000000000' AS a, '9999' AS b FROM orders")
def cast_decimal_edges(spark, sf):
    whole = F.floor("o_totalprice").cast("string")
    return t(spark, sf, "orders").select("o_orderkey", C.to_decimal(F.concat(whole, F.lit("e20")), "string", 38, 0).cast("string").alias("a"), C.to_decimal(F.concat(whole, F.lit("E+30")), "string", 4, 0).cast("string").alias("b"))


@query("SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN CAST(n_nationkey / 2 AS DECIMAL(6, 1)) ELSE CAST(n_nationkey AS DECIMAL(6, 1)) END AS d, rpad(n_name, 30, ' ') AS c FROM nation WHERE n_regionkey <> 2")
def dml_sql_text(spark, sf):
    """Definitions, INSERT, UPDATE and DELETE as text over a fresh database."""
    from brindle.plans.catalog import Database
    from brindle.plans.statements import execute

    files.register_tables(spark, sf, ["nation"])
    db = Database(spark, f"{scratch(spark)}/db")
    for text in (
        "CREATE TABLE copied (k INT PRIMARY KEY, d DECIMAL(6, 1) DEFAULT 0, c CHAR(30), r INT NOT NULL)",
        "INSERT INTO copied (k, d, c, r) SELECT n_nationkey, n_nationkey, n_name, n_regionkey FROM nation",
        "UPDATE copied SET d = CAST(d / 2 AS DECIMAL(6, 1)) WHERE r = 1",
        "DELETE FROM copied WHERE r = 2",
    ):
        execute(db, text)
    return execute(db, "SELECT k, d, c FROM copied")
