"""Numbers as column expressions: exact money, and numbers written in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY, QUANTITY, RATE = "decimal(18,2)", "decimal(18,4)", "decimal(9,6)"


def money(c: Column) -> Column:
    return c.cast(MONEY)


def quantity(c: Column) -> Column:
    return c.cast(QUANTITY)


def rate(c: Column) -> Column:
    """A share, held between 0 and 1."""
    return F.greatest(F.lit(0).cast(RATE), F.least(F.lit(1).cast(RATE), c.cast(RATE)))


def r2(c: Column) -> Column:
    """Half-up to two places."""
    return F.round(c, 2).cast(MONEY)


def out(c: Column) -> Column:
    """Exact decimals leave an operator as doubles."""
    return c.cast("double")


def ascii_digits(c: Column) -> Column:
    """Full-width digits and signs as ASCII."""
    return F.translate(c, "０１２３４５６７８９．，－％", "0123456789.,-%")


def parse_number(c: Column) -> Column:
    """A number written with either decimal mark; null where there is none.

    Of . and , the one that stands last is the decimal mark, if both occur; several of one kind group thousands; a single
    comma is the decimal mark with at most two digits after it and at most six before it.
    """
    t = F.regexp_extract(F.regexp_replace(ascii_digits(c), r"\s", ""), r"-?[0-9][0-9.,]*", 0)
    t = F.regexp_replace(t, r"[.,]+$", "")
    # the lambda's argument is worked out once, not for each case
    return F.get(F.transform(F.array(t), _value_of), F.lit(0))


def _value_of(t: Column) -> Column:
    dots, commas = (F.length(t) - F.length(F.replace(t, F.lit(m))) for m in ".,")
    last_dot, last_comma = (F.length(t) - F.instr(F.reverse(t), m) for m in ".,")
    plain = (
        F.when((dots > 0) & (commas > 0) & (last_dot > last_comma), F.replace(t, F.lit(",")))
        .when((dots > 0) & (commas > 0), F.replace(F.replace(t, F.lit(".")), F.lit(","), F.lit(".")))
        .when(dots > 1, F.replace(t, F.lit(".")))
        .when((commas == 1) & t.rlike(r"^-?[0-9]{1,6},[0-9]{1,2}$"), F.replace(t, F.lit(","), F.lit(".")))
        .otherwise(F.replace(t, F.lit(",")))
    )
    return F.when(t != "", plain.try_cast("double"))


def to_ten_thousands(c: Column, unit: Column) -> Column:
    """An amount in units of 10,000; already so where the unit says it."""
    return F.round(F.when(unit == "万元", c).otherwise(c / 10000), 6)


def parse_percent(c: Column) -> Column:
    """A share from '13%', '0.13' or '13'; null beyond 0..100 %."""
    n = parse_number(c)
    share = F.when(ascii_digits(c).contains("%") | (n > 1), n / 100).otherwise(n)
    return F.when((share >= 0) & (share <= 1), F.round(share, 6))


def parse_discount(c: Column) -> Column:
    """The share taken off: '9折' leaves nine tenths, '85折' 85 hundredths; else a percentage."""
    fold = F.regexp_extract(ascii_digits(c), r"([0-9]+(?:\.[0-9]+)?)\s*折", 1)
    left = fold.try_cast("double")
    return F.when(fold != "", F.round(1 - F.when(left > 10, left / 100).otherwise(left / 10), 6)).otherwise(parse_percent(c))
