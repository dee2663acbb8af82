"""Exact unit conversion on text.

``decimal(38,18)`` products and quotients lose scale in Spark, so units are
shifted by moving the decimal point inside the digits instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerhop.schema import AMOUNT

# All digits of decimal(38,18); a plain cast may print small values with an exponent.
_PLAIN = "9" * 19 + "0." + "0" * 18


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside ``body``.

    Spark does not share repeated subexpressions inside lambdas, so nested rewrites would
    otherwise grow with every use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shift_left(digits: Column, places: Column) -> Column:
    """Text of ``digits / 10**places`` for an optionally signed integer text."""
    zeros = F.repeat(F.lit("0"), places + F.lit(1))
    unsigned = F.concat(zeros, F.regexp_replace(digits, "^[+-]", ""))
    last = F.concat(F.lit("(\\d{"), places, F.lit("})$"))
    return F.concat(F.regexp_extract(digits, "^-?", 0), F.regexp_replace(unsigned, last, F.lit(".$1")))


def plain_text(amount: Column) -> Column:
    """``decimal(38,18)`` as text with all 18 places and no exponent."""
    return F.trim(F.to_char(amount, F.lit(_PLAIN)))


def to_amount(raw: Column, decimals: Column) -> Column:
    """Amount from base units; text with a point is an amount already, NULL is 0.

    Text that does not fit ``decimal(38,18)`` gives NULL, see :func:`overflowed`.
    """
    text = F.trim(raw.cast("string"))
    places = decimals.cast("int")
    scientific = (text.try_cast("double") / F.pow(F.lit(10.0), places)).try_cast(AMOUNT)
    shifted = shift_left(text, F.greatest(places, F.lit(0)))
    return (
        F.when(text.rlike(r"^[+-]?\d+$"), shifted.try_cast(AMOUNT))
        .when(text.contains("."), text.try_cast(AMOUNT))
        .when(raw.isNull(), F.lit(0).cast(AMOUNT))
        .otherwise(scientific)
    )


def overflowed(raw: Column, decimals: Column) -> Column:
    """True where a raw amount is present but not representable."""
    return raw.isNotNull() & to_amount(raw, decimals).isNull()


def to_raw(amount: Column, decimals: Column) -> Column:
    """Base-unit text of a ``decimal(38,18)`` amount, rounded towards zero."""
    places = decimals.cast("int")
    padding = F.repeat(F.lit("0"), F.greatest(places - F.lit(18), F.lit(0)))
    padded = F.concat(plain_text(F.abs(amount)), padding)
    cut = F.concat(F.lit("\\.(\\d{"), places, F.lit("})\\d*$"))
    bare = F.regexp_replace(F.regexp_replace(padded, cut, F.lit("$1")), "^0+(?=.)", "")
    signed = F.when(amount < 0, F.concat(F.lit("-"), bare)).otherwise(bare)
    return F.coalesce(F.regexp_replace(signed, "^-0$", "0"), F.lit("0"))


def raw_units(raw: Column, amount: Column, decimals: Column) -> Column:
    """Base-unit text of a raw amount with its parsed ``amount``.

    A whole number keeps its own digits, however many they are; other text is converted, and kept
    as it is where the amount has no representation.
    """
    text = F.trim(raw)
    bare = F.regexp_replace(F.regexp_replace(text, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    return (
        F.when(text.rlike(r"^[+-]?\d+$"), F.regexp_replace(bare, "^-0$", "0"))
        .when(raw.isNotNull() & amount.isNull(), text)
        .otherwise(to_raw(amount, decimals))
    )


def is_dust(amount: Column, threshold: float | str) -> Column:
    return amount < F.lit(str(threshold)).cast(AMOUNT)
