"""Scalar functions whose results differ from Spark's own; the rest (abs, mod, position, char_length, octet_length, ltrim, rtrim, ||) is Spark's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.errors import TypeRefused, Unsupported, ValueRefused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Allowed ROUND scales by type.
ROUND_SCALES = {"int": (-9, 0), "bigint": (-18, 0), "float": (-7, 7), "double": (-15, 15), "decimal": (-38, 38)}


def divide(a: Column, b: Column, of: str) -> Column:
    """a / b in type ``of``: integers truncate toward zero and keep their type; division by zero is an error."""
    if of in ("int", "bigint"):
        return F.call_function("div", a, b).cast(of)
    return (a / b).cast(of)


def remainder(a: Column, b: Column, of: str) -> Column:
    """a % b with the sign of a; not for REAL and DOUBLE."""
    if of in ("float", "double"):
        raise Unsupported("no remainder of approximate numbers")
    return (a % b).cast(of)


def substring(text: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """Null if start is before the first or after the last character, or length negative; an empty text has no valid start. For text and binary alike."""
    start = start if isinstance(start, Column) else F.lit(start)
    size = F.length(text)
    n = size if length is None else (length if isinstance(length, Column) else F.lit(length))
    bad = (start < 1) | (start > size) | (n < 0)
    return F.when(~bad, F.substring(text, start.cast("int"), n.cast("int")))


def upper(text: Column) -> Column:
    """a-z only."""
    return F.translate(text, LOWER, UPPER)


def lower(text: Column) -> Column:
    """A-Z only."""
    return F.translate(text, UPPER, LOWER)


def like(text: Column, pattern: str, escape: str = "") -> Column:
    """LIKE without a default escape character. The escape is at most one character; a pattern may not end in an open escape."""
    if len(escape) > 1:
        raise ValueRefused("an escape of more than one character")
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape:
            if i + 1 == len(pattern):
                raise ValueRefused("the pattern ends in its escape")
            out.append("\\" + pattern[i + 1] if pattern[i + 1] in "%_\\" else pattern[i + 1])
            i += 2
            continue
        out.append("\\\\" if c == "\\" else c)
        i += 1
    return text.like("".join(out))


def ceil(x: Column, of: str) -> Column:
    """The type of x is kept; NaN and infinities pass."""
    return _kept(F.ceil, x, of)


def floor(x: Column, of: str) -> Column:
    return _kept(F.floor, x, of)


def _kept(f, x: Column, of: str) -> Column:
    if of in ("float", "double"):
        whole = F.abs(x) >= F.lit(float(1 << 52))
        return F.when(F.isnan(x) | whole, x).otherwise(f(F.when(~F.isnan(x) & ~whole, x)).cast(of))
    return f(x).cast(of)


def round_(x: Column, of: str, scale: int = 0) -> Column:
    """Half away from zero, in the type of x; scales outside the type's range are an error."""
    low, high = ROUND_SCALES[of.split("(")[0]]
    if not low <= scale <= high:
        raise ValueRefused(f"scale {scale} for {of}")
    return F.round(x, scale).cast(of)


def encode(x: Column, how: str) -> Column:
    """Binary to text; base64 only, the name in any case."""
    if how.lower() != "base64":
        raise TypeRefused(f"unknown encoding {how}")
    return F.base64(x)


def decode(x: Column, how: str) -> Column:
    """Text to binary; base64 only; malformed text is an error."""
    if how.lower() != "base64":
        raise TypeRefused(f"unknown encoding {how}")
    return F.to_binary(x, F.lit("base64"))
