"""Dates in text, and accounting periods, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _made(text: Column, pattern: str, order: tuple[int, int, int]) -> Column:
    y, m, d = (F.regexp_extract(text, pattern, i) for i in order)
    return F.when(y != "", F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"))


def parse_date(c: Column, day_first: bool = False) -> Column:
    """The first date of a text: year first with - / . or 年月日, eight digits, or the year last. Of dates with the year
    last, the month comes first unless day_first."""
    late = (3, 2, 1) if day_first else (3, 1, 2)
    return F.coalesce(
        _made(c, r"([12][0-9]{3})\s*[-/.年]\s*([0-9]{1,2})\s*[-/.月]\s*([0-9]{1,2})", (1, 2, 3)),
        _made(c, r"(?:^|[^0-9])([12][0-9]{3})([01][0-9])([0-3][0-9])(?:[^0-9]|$)", (1, 2, 3)),
        _made(c, r"(?:^|[^0-9])([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([12][0-9]{3})", late),
    )


def month_period(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def fiscal_start(d: Column, month: int, day: int) -> Column:
    """The first day of the fiscal year that d lies in; 29 February falls on the last of February."""
    start = lambda year: F.least(F.make_date(year, F.lit(month), F.lit(1)) + (day - 1), F.last_day(F.make_date(year, F.lit(month), F.lit(1))))
    this = start(F.year(d))
    return F.when(this <= d, this).otherwise(start(F.year(d) - 1))


def period_445(d: Column, month: int = 1, day: int = 1) -> Column:
    """FYyyyy-Pnn of a 4-4-5 calendar; what lies beyond week 52 belongs to period 12."""
    begin = fiscal_start(d, month, day)
    week = F.floor(F.datediff(d, begin) / 7)
    quarter, inner = F.floor(week / 13), week % 13
    period = F.when(week >= 52, 12).otherwise(quarter * 3 + F.when(inner < 4, 1).when(inner < 8, 2).otherwise(3))
    return F.concat(F.lit("FY"), F.year(begin), F.lit("-P"), F.lpad(period.cast("string"), 2, "0"))


def period_side(d: Column, end: Column) -> Column:
    return F.when(d <= end, "BEFORE_OR_ON").when(d > end, "AFTER")


def payment_days(text: Column) -> Column:
    """The first number of days in a description of terms."""
    return F.regexp_extract(text, r"([0-9]+)\s*(?:天|日|days?)", 1).try_cast("int")


#: Dates as they stand in running text.
DATE_IN_TEXT = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"


def all_dates(c: Column) -> Column:
    """The dates of a text in their order; what is no date of the calendar is left out."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(DATE_IN_TEXT), F.lit(0))
    return F.filter(F.transform(found, lambda d: parse_date(d)), lambda d: d.isNotNull())


# How the dates of a receipt are written in running text, the surest way first, and its inspection period.
_TOKEN = r"([0-9]{4}[年./-][0-9]{1,2}[月./-][0-9]{1,2}日?)"
ACCEPTED = (
    _TOKEN + r"\s*为\s*(?:验收完成|期限届满|验收合格|验收确认)",
    r"(?:验收完成|期限届满|验收合格|验收确认)\s*[/／、]?\s*(?:期限届满)?\s*[:：]?\s*" + _TOKEN,
    _TOKEN + r".{0,16}(?:验收完成|期限届满|验收合格)",
    r"(?:验收完成|期限届满|验收合格).{0,24}" + _TOKEN,
)
ARRIVED = (
    _TOKEN + r"\s*为\s*(?:实物到货|到货日|到货事实|货物到达)",
    r"(?:实物到货|到货日|到货事实|货物到达)\s*[:：]?\s*" + _TOKEN,
    _TOKEN + r".{0,16}(?:实物到货|到货日|到货事实)",
)
RECEIVED = (r"(?:签收日期|入库日期|验收日期|收货日期|交货日期)\s*[:：]?\s*" + _TOKEN,)
INSPECTION = (r"([0-9]+)\s*日\s*验收期", r"验收期\s*([0-9]+)\s*[日天]", r"([0-9]+)\s*[日天]\s*验收期", r"合同约定.*?([0-9]+)\s*日\s*验收")


def _first_written(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*(parse_date(F.nullif(F.regexp_extract(text, p, 1), F.lit(""))) for p in patterns))


def receipt_dates(text: Column, terms: Column | None = None) -> Column:
    """struct<delivery_date, acceptance_date, receipt_date, source> of a receipt's text.

    The receipt's date is that of acceptance; else of arrival and the days of inspection, which may stand in the payment
    terms; else the labelled one; else, in a text that tells of a receipt, the latest of several dates or the only one.
    Null and blank texts have none.
    """
    t = F.coalesce(text, F.lit(""))
    accepted, arrived, received = (_first_written(t, p) for p in (ACCEPTED, ARRIVED, RECEIVED))
    within = lambda c: F.coalesce(*(F.regexp_extract(c, p, 1).try_cast("int") for p in INSPECTION), payment_days(c))
    days = within(t) if terms is None else F.coalesce(within(t), within(F.coalesce(terms, F.lit(""))))
    computed, dates = F.date_add(arrived, days), all_dates(t)
    told, several = t.rlike("验收|签收|入库|到货"), (F.size(dates) >= 2) & t.rlike("验收|期限届满|到货")
    latest, earliest = F.array_max(dates), F.array_min(dates)
    source = (
        F.when(accepted.isNotNull(), "acceptance_completion")
        .when(computed.isNotNull(), "arrival_plus_inspection_period")
        .when(arrived.isNotNull() & (days >= 0), None)
        .when(received.isNotNull(), "receipt_labeled")
        .when(told & several, "latest_of_multiple_dates")
        .when(told & (F.size(dates) > 0), "first_date_fallback")
    )
    by = lambda *cases: F.coalesce(*(F.when(source == s, c) for s, c in cases))
    receipt = by(("acceptance_completion", accepted), ("arrival_plus_inspection_period", computed), ("receipt_labeled", received), ("latest_of_multiple_dates", latest), ("first_date_fallback", F.get(dates, F.lit(0))))
    acceptance = by(("acceptance_completion", accepted), ("arrival_plus_inspection_period", computed), ("latest_of_multiple_dates", latest))
    delivery = F.coalesce(arrived, by(("receipt_labeled", received), ("latest_of_multiple_dates", earliest)))
    return F.struct(delivery.alias("delivery_date"), acceptance.alias("acceptance_date"), receipt.alias("receipt_date"), source.alias("source"))
