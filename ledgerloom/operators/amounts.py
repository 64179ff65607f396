"""Recomputation of amounts from quantity, price, discount and tax, and what a difference tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import money, parse_number, quantity, r2, rate

TOLERANCE = "0.02"


def recompute(df: DataFrame, qty: str = "qty", price: str = "price", discount: str = "discount", tax: str = "tax") -> DataFrame:
    """Adds gross_list, net, vat and total. Each is rounded half up once; a tax of 0 or less is an export without VAT.
    Null quantity or price gives nulls."""
    q, p, d = quantity(F.col(qty)), quantity(F.col(price)), rate(F.coalesce(F.col(discount).cast("decimal(9,6)"), F.lit(0)))
    t = F.greatest(F.lit(0).cast("decimal(9,6)"), F.coalesce(F.col(tax).cast("decimal(9,6)"), F.lit(0)))
    full = (q * p).cast("decimal(28,6)")
    out = df.withColumn("gross_list", r2(full)).withColumn("net", r2((full * (1 - d).cast("decimal(9,6)")).cast("decimal(38,10)")))
    out = out.withColumn("vat", r2((F.col("net") * t).cast("decimal(28,8)")))
    return out.withColumn("total", money(F.col("net") + F.col("vat"))).withColumn("basis", F.when(t > 0, "DOMESTIC").otherwise("EXPORT"))


def layers(df: DataFrame, book_total: str = "book_total", book_net: str = "book_net", book_vat: str = "book_vat", tolerance: str = TOLERANCE) -> DataFrame:
    """Adds the differences of book and recomputed amounts for total, net and VAT, and whether each is within the
    tolerance; null where the book has no such amount."""
    tol = F.lit(tolerance).cast("decimal(18,2)")
    for name, book, own in (("total", book_total, "total"), ("net", book_net, "net"), ("vat", book_vat, "vat")):
        diff = money(money(F.col(book)) - F.col(own))
        df = df.withColumns({f"{name}_diff": diff, f"{name}_ok": F.abs(diff) <= tol})
    return df


def _price_or_discount(qty: Column, price: Column, discount: Column, net: Column) -> Column:
    """Which of the two a wrong net amount points to: a discount only if the implied one is near the agreed one and the
    implied price hardly differs."""
    implied = net / qty / F.greatest(1 - discount, F.lit(1e-9))
    implied_off = 1 - net / (qty * price)
    gap = F.abs(implied - price) / F.greatest(F.abs(price), F.lit(1e-9))
    slip = F.abs(implied_off - discount)
    near = (discount > 1e-12) & (implied_off > -0.001) & (implied_off < 0.5) & (slip >= 0.002) & (slip <= 0.05)
    return (
        F.when(qty.isNull() | price.isNull() | (qty == 0) | (price == 0) | net.isNull(), "AMOUNT_ENTRY_ERROR")
        .when(near & (gap <= 0.0001), "COMMERCIAL_DISCOUNT_ERROR")
        .when(gap > 1e-9, "UNIT_PRICE_ENTRY_ERROR")
        .otherwise("COMMERCIAL_DISCOUNT_ERROR")
    )


def diagnose(df: DataFrame, qty: str = "qty", price: str = "price", discount: str = "discount", book_total: str = "book_total", book_net: str = "book_net", tolerance: str = TOLERANCE) -> DataFrame:
    """Adds test_status, issue_type and direction to the result of layers()."""
    tol = F.lit(tolerance).cast("decimal(18,2)")
    no_book = F.col("total_diff").isNull()
    fine = F.abs(F.col("total_diff")) <= tol
    # without a split in the book, its net amount is the total less tax
    net = F.coalesce(money(F.col(book_net)).cast("double"), (money(F.col(book_total)) - F.col("vat")).cast("double"))
    which = _price_or_discount(quantity(F.col(qty)).cast("double"), quantity(F.col(price)).cast("double"), F.coalesce(F.col(discount).cast("double"), F.lit(0.0)), net)
    net_ok, vat_ok = F.col("net_ok"), F.col("vat_ok")
    issue = (
        F.when(no_book | fine, "NONE")
        .when(net_ok & ~vat_ok, "OUTPUT_VAT_ENTRY_ERROR")
        .when(~net_ok & ~vat_ok, which)
        .when(~net_ok & vat_ok & (F.col("vat") == 0), which)
        .when(~net_ok & vat_ok, "AMOUNT_ENTRY_ERROR")
        .when(net_ok & vat_ok, "LEDGER_BASIS_MISMATCH")
        .otherwise(which)
    )
    status = F.when(no_book, "WARNING").when(fine, "PASS").otherwise("FAIL")
    direction = F.when(no_book | fine, "NONE").when(F.col("total_diff") > 0, "BOOK_OVERSTATED").otherwise("BOOK_UNDERSTATED")
    return df.withColumns({"test_status": status, "issue_type": issue, "direction": direction})


def two_hypotheses(df: DataFrame, book_total: str = "book_total", tax: str = "tax", tolerance: str = TOLERANCE) -> DataFrame:
    """For books with a total only: the net and VAT it has if both are wrong in proportion (split by the tax rate), and
    those it has if only the VAT is wrong (net as recomputed); and the likelier one, that with the smaller difference
    of net and VAT together, the first on a tie."""
    total, t = money(F.col(book_total)), F.greatest(F.lit(0.0), F.coalesce(F.col(tax), F.lit(0.0)).cast("double"))
    even = r2(total.cast("double") / (1 + t))
    locked_vat = money(total - F.col("net"))
    even_gap = F.abs(even - F.col("net")) + F.abs(money(total - even) - F.col("vat"))
    locked_gap = F.abs(locked_vat - F.col("vat"))
    likelier = F.when(F.abs(total - F.col("total")) <= F.lit(tolerance).cast("decimal(18,2)"), "NONE").when(even_gap <= locked_gap, "PROPORTIONAL").otherwise("VAT_ONLY")
    return df.withColumns({"even_net": even, "even_vat": money(total - even), "locked_vat": locked_vat, "hypothesis": likelier})


def ambiguous(df: DataFrame, net: str = "net", tax: str = "vat", total: str = "total", tolerance: str = "0.01") -> DataFrame:
    """Adds reason: a total that is missing, or that net and tax do not add up to; null where nothing is amiss."""
    n, t, s = (money(F.col(c)) for c in (net, tax, total))
    off = F.abs(n + t - s) > F.lit(tolerance).cast("decimal(18,2)")
    return df.withColumn("reason", F.when(s.isNull() & n.isNotNull(), "MISSING_TOTAL").when(off, "RECONCILIATION_FAILED"))


# Labels of totals with and without tax, in the order in which they are looked for, and what an amount looks
# like.
TOTAL_LABELS = ("价税合计", "含税总金额", "合计金额", "总金额", "金额合计", "totalamount", "grand total")
NET_LABELS = ("合计（不含税）", "合计不含税", "折后不含税金额", "折后不含税", "未税金额", "不含税金额合计", "不含税金额", "未税小计", "金额", "amount")
AMOUNT_IN_TEXT = r"-?(?:[0-9]{1,3}(?:[.,][0-9]{3})+|[0-9]+)(?:[.,][0-9]{1,2})?"


def labelled_amount(text: Column, labels: tuple[str, ...]) -> Column:
    """The first positive amount after the first label that has one."""
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i)\Q{x}\E\s*[:：]?\s*[¥￥$]?\s*({AMOUNT_IN_TEXT})"), F.lit(1)) for x in labels]
    return F.get(F.filter(F.transform(F.concat(*found), parse_number), lambda v: v > 0), F.lit(0))


def total_with_basis(text: Column, total: Column, net: Column, tax: Column, rate: Column, qty: Column, price: Column) -> Column:
    """struct<amount double, basis string>: a document's total with tax: as its field or its text states it, else the net
    amount (of its field or its text) with the tax or at the rate, else quantity times price. Only positive numbers count;
    null where nothing does."""
    up = lambda c: F.when(c > 0, c)
    told, before = labelled_amount(text, TOTAL_LABELS), F.coalesce(up(net), labelled_amount(text, NET_LABELS))
    made = lambda value, basis: F.when(value.isNotNull(), F.struct(value.cast("double").alias("amount"), F.lit(basis).alias("basis")))
    return F.coalesce(made(up(total), "FIELD"), made(told, "LABEL"), made(before + up(tax), "NET_AND_TAX"), made(before * (1 + rate), "NET_AT_RATE"), made(up(qty) * up(price), "QUANTITY_TIMES_PRICE"))
