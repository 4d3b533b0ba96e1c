import math
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from brindle.errors import TypeRefused, Unsupported, ValueRefused
from brindle.functions import aggregates as A
from brindle.functions import casts as C
from brindle.functions import scalar as S


def one(spark, *columns, row=(1,), schema="x int"):
    return tuple(spark.createDataFrame([row], schema).select(*columns).first())


def fails(spark, column, row=(1,), schema="x int"):
    with pytest.raises(Exception):
        spark.createDataFrame([row], schema).select(column).collect()


X, Y = F.col("x"), F.col("y")


@pytest.mark.parametrize("of", ["int", "bigint"])
@pytest.mark.parametrize("a,b,q,r", [(3, 2, 1, 1), (-7, 2, -3, -1), (7, -2, -3, 1), (-7, -2, 3, -1), (None, 2, None, None), (0, 5, 0, 0)])
def test_integer_division_and_remainder(spark, of, a, b, q, r):
    df = spark.createDataFrame([(a, b)], f"x {of}, y {of}").select(S.divide(X, Y, of).alias("q"), S.remainder(X, Y, of).alias("r"))
    assert [t for _, t in df.dtypes] == [of, of]
    assert tuple(df.first()) == (q, r)


def test_division_by_zero_and_approximate_remainder(spark):
    fails(spark, S.divide(X, F.lit(0), "int"))
    fails(spark, S.remainder(X, F.lit(0), "int"))
    with pytest.raises(Unsupported):
        S.remainder(X, Y, "double")


@pytest.mark.parametrize("text,start,length,want", [("abcde", 2, 3, "bcd"), ("abcde", 0, 2, None), ("abcde", -1, 2, None), ("abcde", 6, 1, None), ("abcde", 5, 9, "e"), ("abcde", 1, 0, ""), ("abcde", 1, -1, None), ("", 1, 1, None), ("漢字x", 2, 1, "字"), (None, 1, 1, None), ("abcde", 3, None, "cde")])
def test_substring(spark, text, start, length, want):
    assert one(spark, S.substring(X, start, length), row=(text,), schema="x string") == (want,)
    if text and text.isascii():
        assert one(spark, S.substring(X, start, length), row=(text.encode(),), schema="x binary") == (None if want is None else want.encode(),)


def test_case_maps_ascii_only(spark):
    assert one(spark, S.upper(X), S.lower(X), row=("aÀßzéZ",), schema="x string") == ("AÀßZéZ", "aÀßzéz")


@pytest.mark.parametrize("text,pattern,escape,want", [("a_c", "a#_c", "#", True), ("abc", "a#_c", "#", False), ("a\\c", "a\\c", "", True), ("abc", "a%", "", True), ("a%", "a\\%", "", False), ("a\\x", "a\\%", "", True), ("", "%", "", True), (None, "%", "", None), ("50%", "50!%", "!", True), ("a!b", "a!!b", "!", True)])
def test_like(spark, text, pattern, escape, want):
    assert one(spark, S.like(X, pattern, escape), row=(text,), schema="x string") == (want,)


@pytest.mark.parametrize("pattern,escape", [("ab#", "#"), ("#", "#"), ("a", "##")])
def test_like_refuses(pattern, escape):
    with pytest.raises(ValueRefused):
        S.like(X, pattern, escape)


@pytest.mark.parametrize("of,v,up,down", [("int", 5, 5, 5), ("bigint", -5, -5, -5), ("double", -1.5, -1.0, -2.0), ("double", 1e300, 1e300, 1e300), ("float", 2.5, 3.0, 2.0), ("decimal(5,2)", D("1.25"), D("2.00"), D("1.00")), ("double", math.inf, math.inf, math.inf), ("double", None, None, None)])
def test_ceil_floor_keep_the_type(spark, of, v, up, down):
    df = spark.createDataFrame([(v,)], f"x {of}").select(S.ceil(X, of).alias("c"), S.floor(X, of).alias("f"))
    assert [t for _, t in df.dtypes] == [of, of]
    assert tuple(df.first()) == (up, down)


def test_ceil_of_nan(spark):
    assert math.isnan(one(spark, S.ceil(X, "double"), row=(math.nan,), schema="x double")[0])


@pytest.mark.parametrize("of,v,scale,want", [("int", 15, -1, 20), ("int", -15, -1, -20), ("double", 2.5, 0, 3.0), ("double", -2.5, 0, -3.0), ("bigint", 149, -2, 100), ("double", 1.2345, 2, 1.23)])
def test_round(spark, of, v, scale, want):
    assert one(spark, S.round_(X, of, scale), row=(v,), schema=f"x {of}") == (want,)


@pytest.mark.parametrize("of,scale", [("int", 1), ("int", -10), ("bigint", -19), ("float", 8), ("double", 16), ("decimal(5,2)", 39)])
def test_round_scale_bounds(of, scale):
    with pytest.raises(ValueRefused):
        S.round_(X, of, scale)


def test_base64(spark):
    assert one(spark, S.encode(X, "Base64"), S.decode(F.lit("YWI="), "base64"), row=(b"ab",), schema="x binary") == ("YWI=", b"ab")
    with pytest.raises(TypeRefused):
        S.encode(X, "hex")
    fails(spark, S.decode(X, "base64"), row=("@@@",), schema="x string")


NUMERIC = ["int", "bigint", "float", "double", "decimal(10,2)"]


@pytest.mark.parametrize("of", NUMERIC)
def test_aggregate_type_matrix(spark, of):
    make = {"decimal(10,2)": D, "float": float, "double": float}.get(of, int)
    df = spark.createDataFrame([(make(1),), (make(2),), (make(4),), (None,)], f"x {of}")
    out = df.agg(A.sum_(X, of).alias("s"), A.avg(X, of).alias("a"), F.count(X).alias("n"), F.count("*").alias("m"), F.countDistinct(X).alias("d"), F.max(X).alias("hi"), F.min(X).alias("lo"))
    assert [t for _, t in out.dtypes] == [of, of, "bigint", "bigint", "bigint", of, of]
    r = out.first()
    assert (r.s, r.n, r.m, r.d, r.hi, r.lo) == (make(7), 3, 4, 3, make(4), make(1))
    assert r.a == (2 if make is int else D("2.33") if make is D else pytest.approx(7 / 3))


def test_aggregate_of_nothing(spark):
    r = spark.createDataFrame([], "x int").agg(A.sum_(X, "int"), A.avg(X, "int"), F.count(X), F.count("*"), F.max(X)).first()
    assert tuple(r) == (None, None, 0, 0, None)


def test_negative_integer_average_truncates(spark):
    assert spark.createDataFrame([(-3,), (-4,)], "x int").agg(A.avg(X, "int")).first()[0] == -3


@pytest.mark.parametrize("source,v,target,want", [
    ("bigint", 1 << 40, "int", 2147483647), ("bigint", -(1 << 40), "int", -2147483648), ("int", 7, "bigint", 7), ("double", 1.9, "int", 1), ("double", -1.9, "int", -1), ("double", math.inf, "bigint", (1 << 63) - 1),
    ("double", -math.inf, "int", -2147483648), ("double", 1e30, "bigint", (1 << 63) - 1), ("float", 2.5, "int", 2), ("decimal(10,2)", D("-1.99"), "int", -1), ("string", " 1.9 ", "int", 1), ("string", "1e3", "bigint", 1000), ("string", "99999999999", "int", 2147483647), ("int", None, "bigint", None), ("double", None, "int", None),
])
def test_cast_to_integer(spark, source, v, target, want):
    df = spark.createDataFrame([(v,)], f"x {source}").select(C.to_integer(X, source, target).alias("v"))
    assert df.dtypes == [("v", target)] and df.first()[0] == want


def test_cast_to_integer_refuses(spark):
    fails(spark, C.to_integer(X, "double", "int"), row=(math.nan,), schema="x double")
    fails(spark, C.to_integer(X, "string", "int"), row=("abc",), schema="x string")


@pytest.mark.parametrize("source,v,p,s,want", [("int", 12345, 4, 1, D("999.9")), ("double", 1.29, 4, 1, D("1.2")), ("double", -1.29, 4, 1, D("-1.2")), ("string", "1.999", 3, 2, D("1.99")), ("decimal(10,4)", D("-12345.6789"), 4, 0, D("-9999")), ("int", None, 4, 1, None)])
def test_cast_to_decimal(spark, source, v, p, s, want):
    assert one(spark, C.to_decimal(X, source, p, s), row=(v,), schema=f"x {source}") == (want,)


@pytest.mark.parametrize("text,n,want", [("ABCDEF", 5, "ABCDE"), ("AB", 5, "AB"), ("", 3, ""), (None, 3, None), ("é漢字", 4, "é"), ("漢字", 3, "漢"), ("😀", 3, "")])
def test_cast_to_varchar_and_char(spark, text, n, want):
    got = one(spark, C.to_varchar(X, n), C.to_char(X, n), row=(text,), schema="x string")
    assert got[0] == want
    assert got[1] == (None if want is None else want + " " * (n - len(want.encode())))


@pytest.mark.parametrize("text,want", [("t", True), ("TRU", True), ("true", True), ("f", False), ("False", False), (None, None)])
def test_cast_to_boolean(spark, text, want):
    assert one(spark, C.to_boolean(X), row=(text,), schema="x string") == (want,)


@pytest.mark.parametrize("text", ["", "yes", "truex", "1"])
def test_cast_to_boolean_refuses(spark, text):
    fails(spark, C.to_boolean(X), row=(text,), schema="x string")


def test_cast_binary_double_text_temporal(spark):
    assert one(spark, C.to_varbinary(X), C.to_varbinary(X, 1), row=(" 0aFF ",), schema="x string") == (b"\x0a\xff", b"\x0a")
    fails(spark, C.to_varbinary(X), row=("zz",), schema="x string")
    assert one(spark, C.to_double(X, "string"), row=("1e400",), schema="x string") == (math.inf,)
    assert one(spark, C.to_text(X), row=(-math.inf,), schema="x double") == ("-Infinity",)
    assert str(one(spark, C.to_timestamp(X), row=("2020-01-02 03:04:05",), schema="x string")[0]) == "2020-01-02 03:04:05"
    fails(spark, C.to_timestamp(X), row=("2020-01-02 03:04:05+09:00",), schema="x string")
    assert one(spark, C.to_timestamp(X, True), row=("2020-01-02 03:04:05+09:00",), schema="x string")[0] is not None
    assert str(one(spark, C.to_date(X), row=("2020-02-29",), schema="x string")[0]) == "2020-02-29"


def test_assignment_refuses_loss(spark):
    assert one(spark, C.assign_integer(X, "decimal(10,2)", "int"), row=(D("3.00"),), schema="x decimal(10,2)") == (3,)
    fails(spark, C.assign_integer(X, "decimal(10,2)", "int"), row=(D("3.50"),), schema="x decimal(10,2)")
    fails(spark, C.assign_integer(X, "bigint", "int"), row=(1 << 40,), schema="x bigint")
    with pytest.raises(TypeError):
        C.assign_integer(X, "double", "int")
    assert one(spark, C.assign_varchar(X, 3), row=("abc",), schema="x string") == ("abc",)
    fails(spark, C.assign_varchar(X, 2), row=("abc",), schema="x string")
