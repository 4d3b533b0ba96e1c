"""CAST (out-of-range values clamp, excess is cut off) and assignment conversion (loss is an error)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGES = {"tinyint": (-(1 << 7), (1 << 7) - 1), "smallint": (-(1 << 15), (1 << 15) - 1), "int": (-(1 << 31), (1 << 31) - 1), "bigint": (-(1 << 63), (1 << 63) - 1)}
TRUTH = {"true": True, "false": False}
OFFSET = r"([+-]\d{2}(:?\d{2})?|Z|z)\s*$"


def family(of: str) -> str:
    of = of.lower()
    return "decimal" if of.startswith("decimal") else "text" if of.startswith(("string", "varchar", "char")) else of


def _whole(x: Column) -> Column:
    """Without its fraction, toward zero."""
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))


def _bound(value: Column, f) -> Column:
    """f(value), with value evaluated once: otherwise each use of it would repeat its whole expression."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _with_parts(x: Column, f) -> Column:
    """f(p) for a number as text, at any length and with any exponent; p holds ok (whether it is a number), sign, whole (digits without leading zeros), fraction (digits after the point) and null."""
    t = F.trim(x.cast("string"))
    pattern = r"^([+-]?)(?=\.?\d)(\d*)\.?(\d*)(?:[eE]([+-]?\d{1,9}))?$"
    said = F.struct(x.isNull().alias("null"), F.regexp_like(t, F.lit(pattern)).alias("ok"), *(F.regexp_extract(t, pattern, i).alias(n) for i, n in enumerate(("sign", "w", "f", "e"), 1)))

    def shifted(r):
        digits = F.ltrim(F.concat(r["w"], r["f"]), F.lit("0"))
        point = F.coalesce(F.nullif(r["e"], F.lit("")).cast("int"), F.lit(0)) - F.char_length(r["f"]) + F.char_length(digits)
        near = F.greatest(F.lit(-100), F.least(F.lit(100), point))  # 38 digits are the most on either side
        return F.struct(r["null"].alias("null"), r["ok"].alias("ok"), r["sign"].alias("sign"), digits.alias("digits"), near.alias("near"))

    def cut(q):
        digits, near = q["digits"], q["near"]
        whole = F.when((digits == "") | (near <= 0), "").otherwise(F.rpad(F.substring(digits, F.lit(1), near), near, F.lit("0")))
        fraction = F.when(digits == "", "").when(near < 0, F.concat(F.repeat(F.lit("0"), -near), digits)).otherwise(F.substring(digits, near + 1, F.lit(1000)))
        return F.struct(q["null"].alias("null"), q["ok"].alias("ok"), q["sign"].alias("sign"), whole.alias("whole"), fraction.alias("fraction"))

    return _bound(_bound(_bound(said, shifted), cut), f)


def _whole_number(p) -> Column:
    return F.concat(p["sign"], F.when(p["whole"] == "", "0").otherwise(F.substring(p["whole"], 1, 30))).cast("decimal(38,0)")


def _all_nines(precision: int, scale: int) -> Column:
    return F.lit(("9" * (precision - scale) or "0") + ("." + "9" * scale if scale else "")).cast(f"decimal({precision},{scale})")


def to_integer(x: Column, source: str, target: str) -> Column:
    """Clamped to the target's range; fractions are cut off; NaN, and text that is no number, is an error."""
    low, high = RANGES[target]
    if family(source) == "text":
        x = _with_parts(x, lambda p: F.when(~p["null"] & ~p["ok"], F.raise_error(F.lit("not a number")).cast("decimal(38,0)")).when(F.char_length(p["whole"]) > 30, F.when(p["sign"] == "-", F.lit(low)).otherwise(F.lit(high)).cast("decimal(38,0)")).otherwise(_whole_number(p)))
    if family(source) in ("float", "double"):
        x = F.when(F.isnan(x), F.raise_error(F.lit("arithmetic error: NaN as an integer"))).otherwise(x)
        d = x.cast("double")
        # the comparisons are made on doubles: the highest bigint is not one, 2 ** 63 is
        return F.when(d >= F.lit(float(high)), F.lit(high)).when(d <= F.lit(float(low)), F.lit(low)).otherwise(F.when((d < F.lit(float(high))) & (d > F.lit(float(low))), d).cast("bigint")).cast(target)
    wide = x.cast("decimal(38,0)") if family(source) in (*RANGES, "text") else _whole(x).cast("decimal(38,0)")
    return F.greatest(F.lit(low).cast("decimal(38,0)"), F.least(F.lit(high).cast("decimal(38,0)"), wide)).cast(target) + F.when(x.isNull(), F.lit(None).cast(target)).otherwise(F.lit(0).cast(target))


def to_decimal(x: Column, source: str, precision: int, scale: int) -> Column:
    """Excess digits of the fraction are cut off, values beyond the precision become all nines; at any size, infinities too. NaN, and text that is no number, is an error."""
    of = f"decimal({precision},{scale})"
    top = _all_nines(precision, scale)
    low = (-top).cast(of)
    refused = F.when(x.isNull(), F.lit(None).cast(of))
    if family(source) in ("float", "double"):
        inf = F.lit(float("inf"))
        refused = refused.when(F.isnan(x), F.raise_error(F.lit("arithmetic error: NaN as a decimal")).cast(of)).when(x == inf, top).when(x == -inf, low)

    def made(p):
        text = F.concat(p["sign"], F.when(p["whole"] == "", "0").otherwise(p["whole"]), *([F.lit("."), F.substring(F.concat(p["fraction"], F.lit("0")), 1, scale)] if scale else []))
        beyond = F.when(p["sign"] == "-", low).otherwise(top)
        return F.when(p["null"], F.lit(None).cast(of)).when(~p["ok"], F.raise_error(F.lit("not a number")).cast(of)).when(F.char_length(p["whole"]) > precision - scale, beyond).otherwise(text.cast(of))

    return refused.otherwise(_with_parts(x, made))


def to_double(x: Column, source: str) -> Column:
    """Too large becomes an infinity, too small a zero, never an error."""
    return F.trim(x).cast("double") if family(source) == "text" else x.cast("double")


def to_varchar(x: Column, n: int) -> Column:
    """Cut to n bytes, and back to a whole character."""
    raw = x.cast("string").cast("binary")
    whole = F.lit(None).cast("string")
    for k in range(3, -1, -1):
        part = F.substring(raw, 1, max(0, n - k)).cast("string")
        whole = F.when(F.is_valid_utf8(part), part).otherwise(whole)
    return F.when(F.octet_length(raw) <= n, x.cast("string")).otherwise(whole)


def to_char(x: Column, n: int) -> Column:
    """Cut like to_varchar, then filled with blanks to n bytes."""
    cut = to_varchar(x, n)
    return F.concat(cut, F.repeat(F.lit(" "), F.lit(n) - F.octet_length(cut)))


def to_boolean(x: Column) -> Column:
    """Text that starts true or false, in any case, of one letter at least; otherwise an error."""
    t = F.lower(F.trim(x))
    out = F.when(x.isNull(), F.lit(None).cast("boolean"))
    for word, value in TRUTH.items():
        out = out.when((t != "") & F.lit(word).startswith(t), F.lit(value))
    return out.otherwise(F.raise_error(F.lit("not a boolean")).cast("boolean"))


def to_varbinary(x: Column, n: int | None = None) -> Column:
    """Text as hexadecimal digits; cut to n bytes."""
    raw = F.when(x.isNotNull(), F.coalesce(F.unhex(F.trim(x)), F.raise_error(F.lit("not hexadecimal")).cast("binary")))
    return raw if n is None else F.substring(raw, 1, n)


def to_text(x: Column) -> Column:
    """Numbers and booleans as text; floats as NaN, Infinity, -Infinity."""
    return x.cast("string")


def to_date(x: Column) -> Column:
    return F.trim(x).cast("date")


def to_timestamp(x: Column, with_zone: bool = False) -> Column:
    """Text with an offset is only a timestamp WITH TIME ZONE; without one the session's zone counts."""
    t = F.trim(x)
    if with_zone:
        return t.cast("timestamp")
    return F.when(F.regexp_like(t, F.lit(r"[ T]\d{1,2}:.*" + OFFSET)), F.raise_error(F.lit("an offset in a timestamp without time zone")).cast("timestamp_ntz")).otherwise(t.cast("timestamp_ntz"))


def _no_loss(bad: Column, out: Column, of: str, what: str) -> Column:
    return F.when(bad, F.raise_error(F.lit(what)).cast(of)).otherwise(F.when(~bad, out))


def assign_integer(x: Column, source: str, target: str) -> Column:
    """Assignment: loss is an error, approximate numbers are refused."""
    if family(source) in ("float", "double"):
        raise TypeError("an approximate number is not assigned to an exact column")
    low, high = RANGES[target]

    def lost(p):
        return ~p["null"] & p["ok"] & ((F.char_length(p["whole"]) > 30) | (_whole_number(p) < low) | (_whole_number(p) > high) | (F.ltrim(p["fraction"], F.lit("0")) != ""))

    return _no_loss(_with_parts(x, lost), to_integer(x, source, target), target, "value out of range or with a fraction")


def assign_decimal(x: Column, source: str, precision: int, scale: int) -> Column:
    """Assignment: digits that the column has no room for are an error, approximate numbers are refused."""
    if family(source) in ("float", "double"):
        raise TypeError("an approximate number is not assigned to an exact column")

    def lost(p):
        return ~p["null"] & ((F.char_length(p["whole"]) > precision - scale) | (F.ltrim(F.substring(p["fraction"], scale + 1, 1000), F.lit("0")) != ""))

    return _no_loss(_with_parts(x, lost), to_decimal(x, source, precision, scale), f"decimal({precision},{scale})", "value out of range or with too many digits")


def assign_varchar(x: Column, n: int) -> Column:
    return F.when(F.octet_length(x) > n, F.raise_error(F.lit(f"text of more than {n} bytes")).cast("string")).otherwise(x)


def parameters(of: str) -> tuple[str, list[int]]:
    """varchar(3) as varchar and [3]; a type's usual names as Spark's."""
    name, _, rest = of.lower().replace(" ", "").partition("(")
    names = {"integer": "int", "real": "float", "doubleprecision": "double", "character": "char", "charactervarying": "varchar", "text": "string", "varbinary": "varbinary", "numeric": "decimal", "dec": "decimal"}
    return names.get(name, name), [38 if x == "*" else int(x) for x in rest.rstrip(")").split(",") if x]


def stored(of: str) -> str:
    """The type in which Spark keeps a column of a declared type; lengths are checked by assignment."""
    name, sizes = parameters(of)
    if name in ("varchar", "char", "string"):
        return "string"
    if name in ("varbinary", "binary"):
        return "binary"
    if name == "timestamp" or name.startswith("timestampwithouttimezone"):
        return "timestamp_ntz"
    if name.startswith("timestampwithtimezone"):
        return "timestamp"
    return f"decimal({sizes[0] if sizes else 38},{sizes[1] if len(sizes) > 1 else 0})" if name == "decimal" else name


def assign(x: Column, source: str, target: str) -> Column:
    """x, of a Spark type, as the value of a column of a declared type: conversions that lose something are errors."""
    name, sizes = parameters(target)
    of = stored(target)
    if source == "void":
        return x.cast(of)
    if name in RANGES:
        return assign_integer(x, source, name)
    if name == "decimal":
        return assign_decimal(x, source, sizes[0] if sizes else 38, sizes[1] if len(sizes) > 1 else 0)
    if of == "string":
        text = x if source == "string" else x.cast("string")
        if sizes:
            text = assign_varchar(text, sizes[0])
        return F.concat(text, F.repeat(F.lit(" "), F.lit(sizes[0]) - F.octet_length(text))) if name == "char" and sizes else text
    if of == "binary":
        raw = x if source == "binary" else to_varbinary(x)
        if sizes:
            raw = F.when(F.octet_length(raw) > sizes[0], F.raise_error(F.lit(f"more than {sizes[0]} bytes")).cast("binary")).otherwise(raw)
        return F.rpad(raw, sizes[0], F.lit(b"\x00")) if name == "binary" and sizes else raw
    if family(source) == "text" and of in ("boolean", "date", "timestamp", "timestamp_ntz", "float", "double"):
        return {"boolean": to_boolean, "date": to_date, "float": lambda v: to_double(v, source).cast("float"), "double": lambda v: to_double(v, source)}.get(of, lambda v: to_timestamp(v, of == "timestamp"))(x)
    return x.cast(of)
