"""Cut-off: whether control passed and revenue was booked in one accounting period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import month_period, period_445


def check_cutoff(df: DataFrame, control: str = "control_date", posting: str = "posting_date", calendar: str = "month", period_end: Column | None = None, fiscal_month: int = 1, fiscal_day: int = 1) -> DataFrame:
    """Adds deviation_days (posting less control), control_period, posting_period, cutoff_status and cutoff_reason.

    A missing date is a WARNING. With a period end, dates on different sides of it FAIL before anything else. Else one
    period passes; different ones FAIL, early if the posting came first. calendar: "month" or "445".
    """
    c, p = F.col(control), F.col(posting)
    key = month_period if calendar == "month" else lambda d: period_445(d, fiscal_month, fiscal_day)
    missing = c.isNull() | p.isNull()
    crossed = F.lit(False) if period_end is None else (c <= period_end) != (p <= period_end)
    same = key(c) == key(p)
    reason = F.when(missing, "MISSING_DATE").when(crossed, "PERIOD_END_CROSSED").when(same, "SAME_PERIOD").when(p < c, "EARLY").otherwise("LATE")
    status = F.when(missing, "WARNING").when(crossed | ~same, "FAIL").otherwise("PASS")
    return df.withColumns({"deviation_days": F.datediff(p, c).cast("long"), "control_period": key(c), "posting_period": key(p), "cutoff_status": status, "cutoff_reason": reason})


def route_risk(df: DataFrame) -> DataFrame:
    """Adds direction, interval and risk_level from cutoff_status, deviation_days and cutoff_reason."""
    d, status, crossed = F.col("deviation_days"), F.col("cutoff_status"), F.col("cutoff_reason") == "PERIOD_END_CROSSED"
    size = F.abs(d)
    interval = F.when(d.isNull(), "unknown").when(size == 0, "d0").when(size <= 7, "d1_7").when(size <= 30, "d8_30").otherwise("d31_plus")
    direction = F.when((status == "FAIL") & (d < 0), "early").when((status == "FAIL") & (d > 0), "late").when(crossed, "period_end_cross").otherwise("in_period")
    level = (
        F.when((direction == "in_period") & status.isin("PASS", "WARNING"), "low")
        .when(crossed, "high")
        .when(direction == "early", F.when(interval == "d31_plus", "high").otherwise("medium"))
        .when(direction == "late", F.when(interval.isin("d8_30", "d31_plus"), "high").otherwise("medium"))
        .otherwise("medium")
    )
    return df.withColumns({"direction": direction, "interval": interval, "risk_level": level})


def period_assertion(df: DataFrame, period_end: Column, control: str = "control_date", posting: str = "posting_date") -> DataFrame:
    """Adds in_period, true, false or null, and assertion_status: NOT_TESTED without a period end, WARNING without a date."""
    c, p = F.col(control), F.col(posting)
    untested, missing = period_end.isNull(), c.isNull() | p.isNull()
    status = F.when(untested, "NOT_TESTED").when(missing, "WARNING").when((c <= period_end) == (p <= period_end), "PASS").otherwise("FAIL")
    return df.withColumns({"assertion_status": status, "in_period": F.when(status == "PASS", True).when(status == "FAIL", False)})


def chronology(df: DataFrame, dates: list[str]) -> DataFrame:
    """Adds chronology: FAIL if a date lies before the one named before it, else REVIEW if any is missing, else PASS.
    A missing date parts its neighbours."""
    inverted = [F.coalesce(F.col(b) < F.col(a), F.lit(False)) for a, b in zip(dates, dates[1:])]  # noqa: B905
    any_inverted, any_missing = inverted[0], F.col(dates[0]).isNull()
    for x in inverted[1:]:
        any_inverted = any_inverted | x
    for d in dates[1:]:
        any_missing = any_missing | F.col(d).isNull()
    return df.withColumn("chronology", F.when(any_inverted, "FAIL").when(any_missing, "REVIEW").otherwise("PASS"))
