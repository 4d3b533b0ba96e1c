"""SQL text in the engine's dialect, and statements over a Database."""

import json
import math
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from brindle.errors import EngineError, NotNullViolation, Restricted, SyntaxRefused, TypeRefused, UniqueViolation, Unsupported
from brindle.functions import casts as C
from brindle.plans.catalog import Database
from brindle.plans.sql import run_in_dialect
from brindle.plans.statements import execute


@pytest.mark.parametrize(
    "text,want",
    [
        ("SELECT 7 / 2, -7 / 2, 7L / 2, 7.0D / 2", (3, -3, 3, 3.5)),
        ("SELECT (a + 1) / b / 2, a / CAST(b AS DOUBLE) FROM VALUES (8, 2) t(a, b)", (2, 4.0)),
        ("SELECT avg(a), sum(a), avg(b) FROM VALUES (1, 1D), (2, 2D), (null, null) t(a, b)", (1, 3, 1.5)),
        ("SELECT ceil(x), floor(x), ceil(d), round(d, 1) FROM VALUES (1.2D, CAST(1.25 AS DECIMAL(4, 2))) t(x, d)", (2.0, 1.0, D("2.00"), D("1.30"))),
        ("SELECT CAST(1e20D AS INT), CAST(-1e20D AS BIGINT), CAST(3000000000L AS INT), CAST(1.9D AS INT)", (2147483647, -(2**63), 2147483647, 1)),
        (r"SELECT x LIKE 'a\\%', x LIKE 'a_b' , 'a%' LIKE 'a#%' ESCAPE '#' FROM VALUES ('a\\b') t(x)", (True, True, True)),
        ("SELECT upper('é1x'), substring('abc' FROM 2 FOR 1) -- it's\n, upper('y')", ("é1X", "b", "Y")),
        ("SELECT (SELECT max(a) / 2 FROM VALUES (7) u(a)) AS h", (3,)),
    ],
)
def test_dialect_text(spark, text, want):
    assert tuple(run_in_dialect(spark, text).first()) == want


def test_dialect_types_and_refusals(spark):
    got = run_in_dialect(spark, "SELECT avg(a) AS x, sum(a) AS y, ceil(a) AS z FROM VALUES (1), (2) t(a) GROUP BY a ORDER BY a LIMIT 1")
    assert got.dtypes == [("x", "int"), ("y", "int"), ("z", "int")]
    with pytest.raises(Unsupported):
        run_in_dialect(spark, "SELECT 7.5D % 2")
    with pytest.raises(EngineError):
        run_in_dialect(spark, "SELECT nothing FROM nowhere")


@pytest.mark.parametrize(
    "v,source,p,s,want",
    [
        ("123456789012345678901234567890", "string", 38, 0, D("123456789012345678901234567890")), (1e25, "double", 38, 0, D(10) ** 25), (1e-20, "double", 38, 30, D("1e-20")), (" -1e3 ", "string", 10, 2, D("-1000.00")), ("1e40", "string", 5, 1, D("9999.9")), (-math.inf, "double", 3, 0, D(-999)),
        ("-0.0019", "string", 5, 3, D("-0.001")), (".5", "string", 2, 1, D("0.5")), ("1e999999", "string", 4, 0, D(9999)), ("1e-999999", "string", 4, 2, D("0.00")), (D("12345678901234567890.99"), "decimal(38,2)", 38, 0, D("12345678901234567890")), (7, "int", 2, 2, D("0.99")), ("", "string", 1, 0, None), ("0", "string", 1, 0, D(0)),
    ],
)
def test_decimals_of_any_size(spark, v, source, p, s, want):
    df = spark.createDataFrame([(v,)], f"x {source}").select(C.to_decimal(F.col("x"), source, p, s).alias("v"))
    if want is None:
        with pytest.raises(Exception, match="not a number"):
            df.first()
    else:
        assert df.first()[0] == want


@pytest.mark.parametrize("v,target,want", [("1e40", "bigint", 2**63 - 1), ("-1e40", "int", -(2**31)), ("1.9", "int", 1), ("9223372036854775808", "bigint", 2**63 - 1), (" 12 ", "smallint", 12), (None, "int", None)])
def test_text_to_integers_clamps(spark, v, target, want):
    assert spark.createDataFrame([(v,)], "x string").select(C.to_integer(F.col("x"), "string", target).alias("v")).first()[0] == want


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


def test_statements(db, spark, tmp_path):
    run = lambda text, **p: execute(db, text, p)
    rows = lambda text: sorted(map(tuple, run(text).collect()))
    run("CREATE TABLE t (k INT PRIMARY KEY, v VARCHAR(3) DEFAULT 'x', d DECIMAL(5, 2), n BIGINT GENERATED ALWAYS AS IDENTITY (START 10 INCREMENT 5), c CHAR(4), r REAL NOT NULL DEFAULT 1.5)")
    run("INSERT INTO t (k, v, d, c) VALUES (1, 'abc', 1.25, 'ab'), (2, NULL, 3, 'abcd')")
    assert [(r.k, r.v, r.d, r.c, r.r) for r in run("SELECT * FROM t ORDER BY k").collect()] == [(1, "abc", D("1.25"), "ab  ", 1.5), (2, None, D("3.00"), "abcd", 1.5)]
    assert sorted(r.n for r in run("SELECT n FROM t").collect())[0] == 10
    run("INSERT INTO t (k, d) VALUES (:k, :d)", k=3, d=2)
    assert rows("SELECT k, v FROM t WHERE k = 3") == [(3, "x")]
    with pytest.raises(UniqueViolation):
        run("INSERT INTO t (k) VALUES (1)")
    for bad in ("INSERT INTO t (k, v) VALUES (9, 'abcd')", "INSERT INTO t (k, d) VALUES (9, 1.234)", "UPDATE t SET d = 12345 WHERE k = 1", "INSERT INTO t (k) VALUES (3000000000)"):
        with pytest.raises(Exception, match="of more than|digits|range"):
            run(bad)
    with pytest.raises(TypeRefused):
        run("INSERT INTO t (k) VALUES (CAST(1.5 AS DOUBLE))")
    with pytest.raises(TypeRefused):
        run("UPDATE t SET k = 2.7D WHERE k = 1")
    with pytest.raises(NotNullViolation):
        run("INSERT INTO t (k, r) VALUES (9, NULL)")
    with pytest.raises(Restricted):
        run("UPDATE t SET n = 1")
    assert run("SELECT count(*) FROM t").first()[0] == 3
    run("INSERT OR IGNORE INTO t (k, v) VALUES (1, 'new'), (4, 'a'), (4, 'b')")
    run("INSERT OR REPLACE INTO t (k, v) SELECT k, 'two' FROM t WHERE k = 2")
    assert rows("SELECT k, v FROM t") == [(1, "abc"), (2, "two"), (3, "x"), (4, "a")]
    run("UPDATE t SET v = upper(v), d = k / 2 WHERE k >= 3 AND v <> 'wherever'")
    run("DELETE FROM t WHERE v = 'two'")
    assert rows("SELECT k, v FROM t") == [(1, "abc"), (3, "X"), (4, "A")]
    again = Database(spark, db.folder)  # definitions outlive the object
    assert again.list_tables() == ["t"] and again.table("t").count() == 3 and again.tables["t"].column("n").identity.increment == 5
    assert rows("SHOW TABLES") == [("t",)] and run("DESCRIBE t").count() == 6
    tree = json.loads(run("EXPLAIN SELECT k FROM t WHERE k = 1").first()[0])
    assert tree["kind"] and tree["inputs"]
    assert run("ALTER TABLE t RENAME TO u") is None and db.list_tables() == ["t"]
    with pytest.raises(Restricted):
        run("CREATE INDEX i ON t (v)")
    run("TRUNCATE TABLE t RESTART IDENTITY")
    run("CREATE INDEX i ON t (v)")
    run("DROP INDEX i")
    run("DROP TABLE t")
    run("DROP TABLE IF EXISTS t")
    assert db.list_tables() == []
    for bad in ("FLY TO x", "SELECT 1; SELECT 2", "CREATE TABLE"):
        with pytest.raises(SyntaxRefused):
            run(bad)
