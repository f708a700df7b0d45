"""Numbers as text, exactly as the stored prices write them.

Java rounds a double's shortest decimal; the stored prices round its exact binary value. So prices are taken apart into
whole numbers, in Spark's own arithmetic. Usage amounts are written in shortest digits, for which Spark has no format that
is right for each double, so these are Arrow UDFs over whole columns.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def plain(x: float | None) -> str | None:
    """Shortest digits without an exponent."""
    if x is None or pd.isna(x):
        return None
    text = f"{Decimal(repr(float(x))):f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def general(x: float | None) -> str | None:
    """Shortest digits, with an exponent of at least two digits below 1e-04 and from 1e+06 up."""
    if x is None or pd.isna(x):
        return None
    sign, digits, exponent = Decimal(repr(float(x))).normalize().as_tuple()
    top = len(digits) + exponent - 1
    if x != 0 and (top < -4 or top >= 6):
        rest = "." + "".join(map(str, digits[1:])) if len(digits) > 1 else ""
        return f"{'-' * sign}{digits[0]}{rest}e{'-' if top < 0 else '+'}{abs(top):02d}"
    return plain(x)


def _whole(n: int) -> Column:
    return F.lit(Decimal(n)).cast(f"decimal({len(str(n))},0)")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _places(part: Column) -> Column:
    """Of a double from 0 to 1: its ten places as a whole number, ties to even. It is a whole number of 2^-64, or of 2^-96
    where it is below 2^-11, as 53 bits reach no further; what lies below that is no half of the last place."""
    tiny = part < 2.0**-11
    unit = F.when(tiny, _whole(2**96)).otherwise(_whole(2**64))

    def rounded(value: Column) -> Column:
        floor, left = F.call_function("div", value, unit), (value % unit) * _whole(2)
        return _with(floor, lambda n: n + ((left > unit) | ((left == unit) & (n % 2 == 1))).cast("long"))

    def bits(scaled: Column) -> Column:
        high = F.floor(scaled)
        low = F.floor((scaled - high.cast("double")) * 2.0**32)
        return ((high.cast("decimal(20,0)") * _whole(2**32) + low.cast("decimal(20,0)")).cast("decimal(26,0)") * _whole(10**10)).cast("decimal(38,0)")

    return _with(_with(part * F.when(tiny, 2.0**64).otherwise(2.0**32), bits), rounded)


def _minus(v: Column) -> Column:
    return F.when(v.cast("string").startswith("-"), "-").otherwise("")


def usd_text(x: Column | str) -> Column:
    """Ten places of a double's exact value, ties to even; null for null and NaN. From 2^126 on, places that a double cannot
    tell are zeros. What is after the point is exact below 2^53, and its product with 10^10 is off by at most 2^-20:
    where it is no nearer than that to a tie, its rounding is the exact one; else the value is taken apart."""

    def written(size: Column) -> Column:
        top = F.floor(size / 2.0**63)

        def joined(rest: Column) -> Column:
            def text(n: Column) -> Column:
                whole = top.cast("decimal(19,0)") * _whole(2**63) + F.floor(rest).cast("decimal(19,0)") + F.floor(n / F.lit(10**10)).cast("decimal(1,0)")
                return F.concat(whole.cast("string"), F.lit("."), F.lpad((n % 10**10).cast("string"), 10, "0"))

            return _with(_places(rest - F.floor(rest).cast("double")), text)

        return _with(size - top.cast("double") * 2.0**63, joined)

    def signed(v: Column) -> Column:
        size = F.abs(v)
        far = F.when(size == float("inf"), "inf").otherwise(F.format_string("%.10f", size))
        text = F.when(size < 2.0**126, _with(F.when(size < 2.0**126, size).otherwise(0.0), written)).otherwise(far)
        return F.when(v.isNotNull() & ~F.isnan(v), F.concat(_minus(v), text))

    v = (F.col(x) if isinstance(x, str) else x).cast("double")
    whole = F.floor(F.abs(v))
    near = (F.abs(v) - whole.cast("double")) * 1e10
    n = F.rint(near).cast("long")
    short = F.concat(_minus(v), (whole + F.call_function("div", n, F.lit(10**10))).cast("string"), F.lit("."), F.lpad((n % 10**10).cast("string"), 10, "0"))
    return F.when((F.abs(v) < 2.0**53) & (F.abs(near - F.rint(near)) < 0.4999), short).otherwise(_with(v, signed))


def usd_texts(lists: Column | str) -> Column:
    """usd_text of every entry of an array."""
    return F.transform(lists, usd_text)


@F.pandas_udf(StringType())
def general_text(x: pd.Series) -> pd.Series:
    codes, values = pd.factorize(x, use_na_sentinel=False)  # few amounts, many rows
    return pd.Series([general(v) for v in values], dtype=object).take(codes).reset_index(drop=True)


@F.pandas_udf(StringType())
def plain_text(x: pd.Series) -> pd.Series:
    return x.map(plain)


@F.pandas_udf(ArrayType(StringType()))
def plain_texts(lists: pd.Series) -> pd.Series:
    """plain_text of every entry of an array."""
    return lists.map(lambda xs: None if xs is None else [plain(x) for x in xs])


def number(text: Column) -> Column:
    """A price or amount as a double; null if it is no number."""
    return text.try_cast("double")
