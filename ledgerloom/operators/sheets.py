"""Populations from sheets whose headers stand somewhere in their first rows: header search, key column, records.

A cells table has a row for each row of a sheet: (sheet, row, cells array<string>), rows numbered from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import parse_date
from ledgerloom.functions.ids import compact_id, normalize_id
from ledgerloom.functions.numbers import parse_number
from ledgerloom.operators.dedupe import usable_key
from ledgerloom.plans.stash import small, stash

# What headers say, for the search of the key column and of the other columns.
STRONG = ("业务编号", "业务id", "业务索引", "业务流水", "样本编号", "样本索引", "审计索引", "业务主键")
SECONDARY = ("销售订单", "采购订单", "订单编号", "订单号", "交易号", "交易编号", "参考号", "reference", "case ref", "business key", "record id")
BARRED = ("凭证", "发票", "行号", "序号", "日期", "时间", "金额", "客户", "供应商", "名称", "数量", "单位", "币种", "date", "amount", "customer", "vendor", "name", "quantity", "currency", "voucher", "invoice")
ROLES = {
    "order_number": ("销售订单号", "订单编号", "销售订单", "订单号", "sono", "salesorder", "order_no"),
    "book_date": ("过账日期", "入账日期", "记账日期", "凭证日期", "账载日期", "过账日", "posting"),
    "book_amount": ("贷方金额", "贷方发生额", "贷方", "借方金额", "借方发生额", "借方", "价税合计", "含税金额", "入账金额", "账载金额", "收入金额", "金额"),
    "customer": ("客户名称", "往来单位名称", "客户"),
    "invoice_number": ("发票号码", "发票编号", "发票号", "invoice no", "invoice number", "invoice_no"),
    "voucher_number": ("凭证号", "凭证编号", "记账凭证号", "voucher no", "voucher number"),
    "material_name": ("物料名称", "商品名称", "产品名称", "规格型号", "物料", "material", "item description"),
    "quantity": ("数量", "开票数量", "验收数量", "签收数量", "qty", "quantity"),
    "unit": ("单位", "计量单位", "unit"),
    "currency": ("币种", "货币", "currency"),
}
#: Roles that may not be taken by the key column; rows in which a header is looked for.
NOT_THE_KEY, HEADER_ROWS = ("order_number", "book_amount", "invoice_number", "voucher_number"), 12


def _plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))


def header_says(header: Column, hints: tuple[str, ...]) -> Column:
    """Whether a header holds one of the hints or is part of one; case and white space aside."""
    h = _plain(header)
    known = F.array(*(_plain(F.lit(x)) for x in hints))
    return (h != "") & F.exists(known, lambda x: F.contains(h, x) | F.contains(x, h))


def tier(header: Column) -> Column:
    """3 for names of business keys, 2 for other numbers, -1 for what is no key, else 0."""
    return F.when(header_says(header, STRONG), 3).when(header_says(header, SECONDARY), 2).when(header_says(header, BARRED), -1).otherwise(0)


def _filled(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return (t != "") & ~F.lower(t).isin("none", "nan", "-")


def find_headers(cells: DataFrame, rows: int = HEADER_ROWS) -> DataFrame:
    """(sheet, header_row, headers, key_index, key_column, method, score): each sheet's header and its key column.

    Of the first rows, those with two filled cells and a known word are tried. Under each, columns are ranked by what their
    header says and by how filled and how distinct their values are; a row that has an acceptable key column counts with
    that column's score and two for each header, eight at the most. The best row is the header, the first of equals.
    Sheets without one have no row.
    """
    known = STRONG + SECONDARY + BARRED + tuple(x for hints in ROLES.values() for x in hints)
    tried = cells.where(F.col("row") <= rows).where((F.size(F.filter("cells", lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")) >= 2) & F.exists("cells", lambda x: header_says(x, known)))
    tried = stash(tried.select("sheet", F.col("row").alias("header_row"), F.transform("cells", lambda x: F.trim(F.coalesce(x, F.lit("")))).alias("headers")), "tried")
    # every cell is counted once: for each place of a header, how often a value stands below it
    under, filled = range(1, rows + 1), cells.where(F.exists("cells", _filled))
    below = lambda h: F.count_if(F.col("row") > h)
    sizes = filled.groupBy("sheet").agg(F.array(*map(below, under)).alias("sizes"))
    values = filled.select("sheet", "row", F.posexplode("cells").alias("i", "v")).select("sheet", "row", "i", F.when(usable_key(F.col("v")), normalize_id(F.col("v"))).alias("v")).where("v IS NOT NULL")
    by_value = values.groupBy("sheet", "i", "v").agg(*(below(h).alias(f"n{h}") for h in under))
    plain = F.col("v").rlike(r"^[0-9]+(?:\.0+)?$")
    of = lambda n: F.struct(F.sum(n).alias("usable"), F.count_if(F.col(n) > 0).alias("distinct"), F.coalesce(F.bool_and(F.when(F.col(n) > 0, plain)), F.lit(True)).alias("digits"), F.sum(F.length("v") * F.col(n)).alias("chars"))
    counted = by_value.groupBy("sheet", "i").agg(F.array(*(of(f"n{h}") for h in under)).alias("c"))
    named = tried.select("sheet", "header_row", F.posexplode("headers").alias("i", "header")).where("header <> ''")
    at = F.col("header_row") - 1
    got = named.join(sizes, "sheet").join(counted, ["sheet", "i"], "left").select("sheet", "header_row", "i", "header", F.get("sizes", at).alias("rows"), F.get("c", at).alias("c")).where("rows > 0")
    got = got.select("sheet", "header_row", "i", "header", "rows", *(F.coalesce(f"c.{c}", F.lit(0)).alias(c) for c in ("usable", "distinct", "chars")), F.coalesce("c.digits", F.lit(True)).alias("digits"))
    got = got.withColumns({"tier": tier(F.col("header")), "fill": F.col("usable") / F.col("rows"), "unique": F.when(F.col("usable") > 0, F.col("distinct") / F.col("usable")).otherwise(0.0)})
    by_name = (F.col("usable") > 0) & (F.col("fill") >= 0.5) & ((F.col("tier") == 3) | ((F.col("tier") == 2) & (F.col("unique") >= 0.9)))
    by_values = (F.col("tier") == 0) & (F.col("usable") >= 2) & (F.col("fill") >= 0.8) & (F.col("unique") >= 0.98) & ~F.col("digits") & (F.col("chars") <= 40 * F.col("usable"))
    score = F.round(F.col("tier") * 100 + F.col("unique") * 20 + F.col("fill") * 10 + F.when(by_values, 40).otherwise(0), 3)
    method = F.when(by_name, "keyword").when(by_values, "uniqueness_fallback")
    ok = got.withColumns({"method": method, "score": score}).where("method IS NOT NULL")
    key = ok.groupBy("sheet", "header_row").agg(F.max_by(F.struct("i", "header", "method", "score"), F.struct(F.col("score"), -F.col("i"))).alias("k"))
    scored = key.join(tried, ["sheet", "header_row"]).withColumn("total", F.col("k.score") + 2 * F.least(F.size(F.filter("headers", lambda x: x != "")), F.lit(8)))
    best = scored.groupBy("sheet").agg(F.max_by(F.struct("header_row", "headers", "k"), F.struct("total", -F.col("header_row"))).alias("b"))
    return best.select("sheet", "b.header_row", "b.headers", F.col("b.k.i").alias("key_index"), F.col("b.k.header").alias("key_column"), F.col("b.k.method").alias("method"), F.col("b.k.score").alias("score"))


def column_of(headers: Column, hints: tuple[str, ...], skip: Column | None = None) -> Column:
    """Where the first header stands that the first possible hint fits; null if there is none. skip: a header not to take."""
    at = F.sequence(F.lit(0), F.size(headers) - 1)
    free = lambda h: F.lit(True) if skip is None else _plain(h) != _plain(skip)
    first = lambda hint: F.get(F.filter(at, lambda i: header_says(F.get(headers, i), (hint,)) & free(F.get(headers, i))), F.lit(0))
    return F.coalesce(*map(first, hints))


def records(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(sheet, row, business_id, and a value for each role): the rows under each sheet's header that have a usable key."""
    places = [column_of(F.col("headers"), hints, F.col("key_column") if role in NOT_THE_KEY else None).alias(f"at_{role}") for role, hints in ROLES.items()]
    placed = stash(headers.select("sheet", "header_row", "key_index", *places), "places")
    met = cells.join(small(placed), "sheet").where(F.col("row") > F.col("header_row"))
    take = lambda role: F.trim(F.get("cells", F.col(f"at_{role}")))
    filled = lambda role: F.when(_filled(take(role)), take(role))
    out = {role: filled(role) for role in ROLES}
    out["order_number"] = F.when(usable_key(take("order_number")), normalize_id(take("order_number")))
    out["book_date"] = parse_date(take("book_date"))
    out["book_amount"], out["quantity"] = parse_number(take("book_amount")), parse_number(take("quantity"))
    out["currency"] = F.upper(out["currency"])
    key = F.get("cells", F.col("key_index"))
    return met.where(usable_key(key)).select("sheet", "row", normalize_id(key).alias("business_id"), *(c.alias(r) for r, c in out.items()))


def businesses(rows: DataFrame) -> DataFrame:
    """(business_id, sheets, order_numbers, invoice_numbers, voucher_numbers, amount, rows): the records of all sheets, one
    row for each compact key, named as in its first record."""
    values = lambda c: F.array_sort(F.collect_set(c)).alias(f"{c}s")
    first = F.min_by("business_id", F.struct("sheet", "row"))
    return rows.groupBy(compact_id(F.col("business_id")).alias("__key")).agg(first.alias("business_id"), values("sheet"), values("order_number"), values("invoice_number"), values("voucher_number"), F.sum("book_amount").alias("amount"), F.count("*").alias("rows")).drop("__key")
