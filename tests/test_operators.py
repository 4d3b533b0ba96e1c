import datetime

import pytest
from pyspark.sql import functions as F

from brindle.errors import AlreadyExists, NotNullViolation, Restricted, SymbolNotFound, SyntaxRefused, TypeRefused, UniqueViolation, Unsupported
from brindle.operators import relational as R
from brindle.operators import writes as W
from brindle.operators.apply import Functions, flattened
from brindle.plans import sql as Q
from brindle.plans.catalog import ColumnSpec, Database, Identity
from brindle.sources import files


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_scan_bounds_and_find(spark):
    d = spark.createDataFrame([(i,) for i in range(5)] + [(None,)], "k int")
    assert rows(R.scan(d, None, "k", 1, 3)) == [(1,), (2,)]
    assert rows(R.scan(d, ["k"], "k", 1, 3, lower_inclusive=False, upper_inclusive=True)) == [(2,), (3,)]
    assert rows(R.scan(d, None, "k", F.lit(None).cast("int"))) == []
    assert rows(R.find(d, k=2)) == [(2,)] and rows(R.find(d, k=None)) == []


def test_scan_reaches_the_file(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") * 2).alias("v"), F.lit("x").alias("w")).write.parquet(str(tmp_path / "t"))
    plan = Q.explain(R.scan(spark.read.parquet(str(tmp_path / "t")), ["id"], "id", 10, 20))
    assert "GreaterThanOrEqual(id,10)" in plan and "ReadSchema: struct<id:bigint>" in plan


def sides(spark):
    left = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (None, 9)], "a int, b int")
    return left, spark.createDataFrame([(1, 1), (30, 3), (31, 3), (4, 4), (None, None)], "c int, d int")


@pytest.mark.parametrize("kind,want", [
    ("inner", [(1, 1, 1, 1), (3, 3, 30, 3), (3, 3, 31, 3)]),
    ("left", [(1, 1, 1, 1), (2, 2, None, None), (3, 3, 30, 3), (3, 3, 31, 3), (None, 9, None, None)]),
    ("right", [(1, 1, 1, 1), (3, 3, 30, 3), (3, 3, 31, 3), (None, None, 4, 4), (None, None, None, None)]),
    ("full", [(1, 1, 1, 1), (2, 2, None, None), (3, 3, 30, 3), (3, 3, 31, 3), (None, 9, None, None), (None, None, 4, 4), (None, None, None, None)]),
    ("semi", [(1, 1), (3, 3)]),
    ("anti", [(2, 2), (None, 9)]),
])
def test_join_kinds(spark, kind, want):
    left, right = sides(spark)
    assert rows(R.join(left, right, F.col("b") == F.col("d"), kind)) == sorted(want, key=repr)


def test_full_join_with_residual_keeps_rows_once(spark):
    left, right = spark.createDataFrame([(1, 1), (2, 1)], "a int, b int"), spark.createDataFrame([(10, 1), (20, 1)], "c int, d int")
    got = rows(R.join(left, right, F.col("b") == F.col("d"), "full", F.col("c") > 15))
    assert got == sorted([(1, 1, 20, 1), (2, 1, 20, 1), (None, None, 10, 1)], key=repr)
    assert rows(R.join(left, right, F.col("b") == F.col("d"), "left", F.col("c") > 99)) == [(1, 1, None, None), (2, 1, None, None)]
    with pytest.raises(TypeRefused):
        R.join(left, right, "b", "sideways")


def test_null_keys_meet_nothing(spark):
    t0 = spark.createDataFrame([(1, 1), (2, None)], "a int, k int")
    assert R.join(t0, t0.withColumnRenamed("a", "b"), "k").count() == 1


def test_n_way_tasks_follow_the_rows_made(spark):
    """One key of 6,000 rows on either side makes 36 million: no task makes more than a block's worth or two of them."""
    a, b = (spark.range(0, 6000, 1, 1).select(F.lit(1).alias("k"), F.col("id").alias(n)) for n in "ab")
    made = [r["count"] for r in R.n_way(spark.createDataFrame([(1, "x"), (2, "y")], "k int, n string"), a, b, on=["k"]).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 36_000_000 and max(made) <= 20_000_000


def test_n_way_blocks_give_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_ROWS", 4)
    left = [(None, 0), (2, 100)] + [(1, i // 2) for i in range(30)] + [(3, i) for i in range(3)] + [(5, 7)] * 9
    right = [(None, 0), (4, 1)] + [(1, i) for i in range(11)] + [(3, 8)] * 2 + [(5, i) for i in range(5)]
    third = [(None, 1), (1, 6), (1, 7), (3, 9), (5, 1), (5, 1), (4, 4)]
    want = [(k, a, b, c) for k, a in left for k2, b in right for k3, c in third if k is not None and k == k2 == k3]
    frames = (spark.createDataFrame(x, f"k int, {n} int") for x, n in ((left, "a"), (right, "b"), (third, "c")))
    got = R.n_way(*frames, on=["k"])
    assert got.columns == ["k", "a", "b", "c"] and rows(got) == sorted(want, key=repr)
    odd = spark.createDataFrame([(float("nan"), i) for i in range(12)] + [(0.0, i) for i in range(7)] + [(None, 1)], "k double, a int")
    got = R.n_way(odd, odd.selectExpr("-k AS k", "a AS b"), on=["k"]).selectExpr("isnan(k) AS k", "a", "b")  # NaN meets NaN, 0 meets -0
    assert rows(got) == rows(spark.createDataFrame([(n == 12, a, b) for n in (12, 7) for a in range(n) for b in range(n)], "k boolean, a int, b int"))


def test_range_join_against_pairs(spark):
    import random

    rnd = random.Random(5)
    pts = [(i, rnd.uniform(-50, 50)) for i in range(200)] + [(999, None)]
    iv = [(j, x, x + rnd.uniform(-1, 30)) for j in range(60) for x in [rnd.uniform(-60, 60)]]
    want = sorted((i, j) for i, v in pts for j, a, b in iv if v is not None and a <= v < b)
    got = R.range_join(spark.createDataFrame(pts, "i int, v double"), spark.createDataFrame(iv, "j int, a double, b double"), "v", "a", "b", 7.0).select("i", "j")
    assert sorted(map(tuple, got.collect())) == want


def test_range_join_tasks_follow_the_pairs(spark):
    a, b = (spark.range(0, 6000, 1, 1).select(F.col("id").alias(n), (F.col("id") / 100).alias(x)) for n, x in (("i", "v"), ("j", "a")))
    got = R.range_join(a, b.selectExpr("j", "a - 100 AS a", "a + 100 AS b"), "v", "a", "b", 1000.0)  # every value is in every interval
    made = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 36_000_000 and max(made) <= 20_000_000


def test_range_join_result_is_small_on_disk(spark, tmp_path):
    """Neighbours in a file have nearly the same intervals: much less than a byte a row."""
    a = spark.range(0, 16000, 1, 1).selectExpr("id AS i", "CAST(id * 7919 % 16000 AS double) AS v")
    b = spark.range(0, 16000, 1, 1).selectExpr("id AS j", "CAST(id * 6007 % 16000 AS double) AS a").selectExpr("*", "a + 500 AS b")
    R.range_join(a, b, "v", "a", "b", 1000.0).select("i", "j").write.parquet(str(tmp_path / "out"))
    n = spark.read.parquet(str(tmp_path / "out")).count()
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert n == sum(min(v + 1, 500) for v in range(16000)) and size < 0.5 * n


def test_range_join_blocks_and_small_intervals_against_pairs(spark, monkeypatch):
    import random

    monkeypatch.setattr(R, "BLOCK_ROWS", 4)
    rnd = random.Random(6)
    pts = [(i, rnd.choice([3.0, rnd.uniform(-50, 50)])) for i in range(150)] + [(998, float("nan")), (999, None)]
    iv = [(j, x, x + rnd.choice([-1, 0, 1e-9, 0.5, 6.9, 7, 7.1, 90])) for j in range(80) for x in [rnd.choice([3.0, rnd.uniform(-60, 60)])]] + [(97, None, 1.0), (98, 1.0, None)]
    want = [(i, j) for i, v in pts for j, a, b in iv if None not in (v, a, b) and a <= v < b]
    got = R.range_join(spark.createDataFrame(pts, "i int, v double"), spark.createDataFrame(iv, "j int, a double, b double"), "v", "a", "b", 7.0)
    assert got.columns == ["i", "v", "j", "a", "b"] and rows(got.select("i", "j")) == sorted(want, key=repr)


def test_sets_treat_nulls_as_equal(spark):
    a, b = spark.createDataFrame([(None,), (None,), (2,)], "x int"), spark.createDataFrame([(None,), (1,)], "x int")
    assert rows(R.except_distinct(a, b)) == [(2,)]
    assert rows(R.intersect_distinct(a, b)) == [(None,)]
    assert rows(R.union_distinct(a, b)) == [(1,), (2,), (None,)] and R.union_all(a, b).count() == 5


def test_limits_and_null_order(spark):
    d = spark.createDataFrame([(3,), (None,), (1,)], "x int")
    assert [r.x for r in R.top_k(d, 2, F.asc("x")).collect()] == [None, 1]
    assert [r.x for r in R.top_k(d, 2, F.desc("x")).collect()] == [3, 1]
    assert R.limit(d, 0).count() == 0
    for n in (-1, 1 << 31):
        with pytest.raises(TypeRefused):
            R.limit(d, n)


def test_scalar_subquery_cardinality(spark):
    t = spark.createDataFrame([(1,), (2,)], "k int")
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    assert rows(R.scalar_or_error(t, ["k"], one, "v")) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="more than one row"):
        R.scalar_or_error(t, ["k"], one.union(one), "v").collect()


def test_apply(spark):
    class Echo:
        def eval(self, n):
            if n == 13:
                raise ValueError("thirteen")
            for i in range(n or 0):
                yield (n, f"r{i}")

    f = Functions(spark)
    f.register_table("echo_rows", Echo, "c1 bigint, c2 string")
    t = spark.createDataFrame([(1, 2), (2, 0), (3, None)], "k int, n bigint")
    assert rows(f.apply(t, "echo_rows", ["n"])) == [(1, 2, 2, "r0"), (1, 2, 2, "r1")]
    assert rows(f.apply(t, "echo_rows", ["n"], outer=True)) == sorted([(1, 2, 2, "r0"), (1, 2, 2, "r1"), (2, 0, None, None), (3, None, None, None)], key=repr)
    with pytest.raises(Exception, match="thirteen"):
        f.apply(t, "echo_rows", ["n + 13 - n"]).collect()
    with pytest.raises(SymbolNotFound):
        f.apply(t, "nobody", [])
    nested = spark.sql("SELECT named_struct('a', 1, 'b', named_struct('c', 2)) AS s, 3 AS t")
    assert flattened(nested).columns == ["s_a", "s_b_c", "t"]


def test_writes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z")], "k int, v string")
    assert rows(W.insert_or_ignore(t, new, ["k"], [F.asc("v")])) == [(1, "a"), (2, "b"), (3, "y")]
    assert rows(W.insert_or_replace(t, new, ["k"], [F.asc("v")])) == [(1, "a"), (2, "x"), (3, "z")]
    with pytest.raises(UniqueViolation):
        W.insert(t, new, ["k"])
    assert W.insert(t, new).count() == 5
    assert rows(W.update(t, F.col("k") == 1, v=F.lit("q"))) == [(1, "q"), (2, "b")]
    assert rows(W.update(t, F.lit(True), ["k"], k=F.col("k") + 1)) == [(2, "a"), (3, "b")]
    with pytest.raises(UniqueViolation):
        W.update(t, F.col("k") == 1, ["k"], k=F.lit(2))
    assert rows(W.delete(t, F.col("v") == F.lit(None))) == [(1, "a"), (2, "b")] and rows(W.delete(t, F.col("k") > 1)) == [(1, "a")]


def test_catalogue(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    db.create_table("tt", [ColumnSpec("k", "int"), ColumnSpec("v", "string", default="dflt"), ColumnSpec("d", "date", default="current_date()"), ColumnSpec("g", "bigint", identity=Identity())], ["k"])
    with pytest.raises(AlreadyExists):
        db.create_table("tt", [])
    db.create_index("tt", "tt_v", ["v"])
    db.insert_values("tt", [(1, "a"), (2, "b")], ["k", "v"])
    db.insert_values("tt", [(3,)], ["k"])
    got = {r.k: r for r in db.table("tt").collect()}
    assert got[3].v == "dflt" and isinstance(got[3].d, datetime.date) and sorted(r.g for r in got.values()) == [1, 2, 3]
    assert spark.table("tt").count() == 3
    with pytest.raises(UniqueViolation):
        db.insert_values("tt", [(1, "x")], ["k", "v"])
    assert db.table("tt").count() == 3  # a failed write leaves the old version
    with pytest.raises(Restricted):
        db.insert_values("tt", [(9, 9)], ["k", "g"])
    with pytest.raises(NotNullViolation):
        db.insert_values("tt", [(None, "x")], ["k", "v"])
    db.insert_values("tt", [(1, "new"), (4, "four")], ["k", "v"], "ignore")
    db.insert_values("tt", [(1, "new")], ["k", "v"], "replace")
    db.update("tt", F.col("k") == 2, v=F.lit("B"))
    db.delete("tt", F.col("k") == 3)
    assert sorted((r.k, r.v) for r in db.table("tt").collect()) == [(1, "new"), (2, "B"), (4, "four")]
    with pytest.raises(Restricted):
        db.create_index("tt", "late", ["v"])
    with pytest.raises(Restricted):
        db.update("tt", F.lit(True), g=F.lit(1))
    assert [r.in_key for r in db.describe("tt").collect()] == [True, False, False, False] and db.list_tables() == ["tt"]
    db.truncate("tt", restart_identity=True)
    db.insert_values("tt", [(7,)], ["k"])
    assert db.table("tt").first().g == 1
    db.drop_index("tt_v")
    db.drop_table("tt")
    for f in (lambda: db.table("tt"), lambda: db.drop_table("tt"), lambda: db.drop_index("tt_v")):
        with pytest.raises(SymbolNotFound):
            f()
    with pytest.raises(TypeRefused):
        db.create_table("u", [ColumnSpec("k", "string", identity=Identity())])


def test_statements(spark):
    assert Q.split_statements("select ';' -- a; b\n; /* ; */ select 2;;") == ["select ';'", "select 2"]
    assert Q.run(spark, " ; ") is None
    assert Q.run(spark, "SELECT :a + 1 AS x", {"a": 2}).first().x == 3
    for text, error in (("SELECT 1; SELECT 2", SyntaxRefused), ("SELEC 1", SyntaxRefused), ("SELECT nope", SymbolNotFound), ("SELECT * FROM nope", SymbolNotFound), ("SELECT 'a", SyntaxRefused)):
        with pytest.raises(error):
            Q.run(spark, text)
    p = Q.Prepared(spark, "SELECT :a AS x", {"a": int})
    assert p.execute(a=5).first().x == 5 and p.execute(a=None).first().x is None
    for bad, error in (({"a": "5"}, TypeRefused), ({"a": True}, TypeRefused), ({}, SymbolNotFound), ({"b": 1}, SymbolNotFound)):
        with pytest.raises(error):
            p.execute(**bad)


def test_dialect(spark):
    assert Q.in_dialect("SELECT upper ('upper(') , substring(substr(a, 1) FROM 2 FOR 3) FROM t") == "SELECT brindle_upper ('upper(') , brindle_substring(brindle_substring(a, 1) , 2 , 3) FROM t"
    r = Q.run_in_dialect(spark, "SELECT upper('aé') AS u, LOWER('AÉ') AS l, substring('abc' FROM 0 FOR 2) AS a, substr('abc', 2) AS b, substring('abc', 2, 1) AS c, substring('abc', 1, -1) AS d, encode(X'6162', 'BASE64') AS e, decode('YWI=', 'base64') AS f")
    assert tuple(r.first()) == ("Aé", "aÉ", None, "bc", "b", None, "YWI=", b"ab")
    with pytest.raises(Exception):
        Q.run_in_dialect(spark, "SELECT encode(X'6162', 'hex')").collect()


def test_file_round_trips(spark, tmp_path):
    d = spark.sql("SELECT 1 AS i, 2L AS b, 1.5D AS d, 'tëxt' AS s, X'0a' AS x, CAST(1.25 AS DECIMAL(6, 2)) AS c, DATE'2020-01-01' AS dt, TIMESTAMP_NTZ'2020-01-01 01:02:03.000004' AS ts, true AS t UNION ALL SELECT null, null, null, null, null, null, null, null, null")
    want = rows(d)
    assert len(files.dump_parquet(d, str(tmp_path / "p"))) >= 1
    assert rows(files.load_parquet(spark, [str(tmp_path / "p")])) == want
    names = files.dump_arrow(d, str(tmp_path / "a"), batch_rows=1)
    back = files.load_arrow(spark, names)
    assert rows(back) == want and back.dtypes == d.dtypes
    assert rows(files.load_arrow(spark, names, {"first": 0, "s": "s"})) == sorted([(1, "tëxt"), (None, None)], key=repr)
    with pytest.raises(SymbolNotFound):
        files.load_arrow(spark, names, {"x": "nope"})
    fixed = files.dump_arrow(d.select("s"), str(tmp_path / "f"), metadata_version="V4", fixed_char={"s": 8})
    assert rows(files.load_arrow(spark, fixed)) == sorted([("tëxt   ",), (None,)], key=repr)
    assert files.dump_arrow(d.limit(0), str(tmp_path / "e")) == []
    with pytest.raises(Unsupported):
        files.dump_arrow(d, str(tmp_path / "v"), metadata_version="V1")
