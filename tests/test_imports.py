"""Sheets, identifiers in texts, line evidence, merged groups and assertions on small cases."""

from pyspark.sql import functions as F

from ledgerloom.functions import ids
from ledgerloom.operators import allocation, assertions, entities, sheets


def test_identifiers_of_texts(spark):
    cases = {
        "订单号：SO25-0281，合同编号=HT25-0282": ["SO25-0281", "HT25-0282"],
        "kjht25-0282": ["KJHT25-0282"],
        "业务编号=S025-0281": ["SO25-0281"],
        "SO25-002I": ["SO25-0021"],
        "nothing 12": [],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", ids.ids_in_free_text(F.col("t")).alias("ids"), ids.page_keys(F.col("t")).alias("k"))
    got = {r.t: r for r in df.collect()}
    assert {t: list(r.ids) for t, r in got.items()} == cases
    assert (got["订单号：SO25-0281，合同编号=HT25-0282"].k.order_no, got["订单号：SO25-0281，合同编号=HT25-0282"].k.contract_no) == ("SO25-0281", "HT25-0282")
    fields = spark.createDataFrame([({"documentNo": "net 30 days SO25-0001", "invoiceNo": "12345678", "remarks": "see PO25-0007"},)], "f map<string, string>")
    assert list(fields.select(ids.document_keys(F.col("f")).alias("k")).first().k) == ["SO25-0001", "12345678", "PO25-0007"]


def cells(spark, sheet, rows):
    return spark.createDataFrame([(sheet, i + 1, r) for i, r in enumerate(rows)], "sheet string, row long, cells array<string>")


def test_headers_of_sheets(spark):
    a = cells(spark, "a", [["Sales 2025", "", ""], ["凭证号", "订单编号", "金额"], ["SA25-0001", "SO25-0001", "1,000.00"], ["SA25-0001", "SO25-0002", "5"], ["", None, ""]])
    b = cells(spark, "b", [["Record Locator", "备注"], ["CASE-A9", "x"], ["CASE-B7", "x"]])
    c = cells(spark, "c", [["行号", "日期", "金额", "客户名称"], ["1", "2025-01-01", "5", "X"]])
    df = a.unionByName(b).unionByName(c)
    heads = sheets.find_headers(df)
    got = {r.sheet: (r.header_row, r.key_column, r.method) for r in heads.collect()}
    assert got["a"] == (2, "订单编号", "keyword") and "c" not in got
    rows = [r for r in sheets.records(df, heads).collect() if r.sheet == "a"]
    assert sorted((r.business_id, r.voucher_number, r.book_amount) for r in rows) == [("SO25-0001", "SA25-0001", 1000.0), ("SO25-0002", "SA25-0001", 5.0)]
    assert {r.business_id: r.amount for r in sheets.businesses(sheets.records(df, heads)).collect() if r.amount} == {"SO25-0001": 1000.0, "SO25-0002": 5.0}


def test_line_cascade(spark):
    orders = spark.createDataFrame([("b", 1, "C1", "M1", "G", 5), ("b", 2, "C2", "M1", "G", 7), ("s", 1, None, None, "G", 1)], "business_id string, order_line_id int, item_code string, model string, goods string, quantity int")
    lines = [("b", 1, "C1", None, "G"), ("b", 2, "C9", "M1", "G"), ("b", 3, None, "M1", "G"), ("b", 4, None, "M9", "G"), ("b", 5, None, None, "other"), ("s", 6, "C5", None, None), ("none", 7, "C1", None, None)]
    source = spark.createDataFrame([(*x, r, 5) for x in lines for r in ("receipt", "invoice")], "business_id string, source_id int, item_code string, model string, goods string, role string, quantity int")
    bound = allocation.bind_by_evidence(source, orders)
    got = {r.source_id: (list(r.order_line_ids), r.basis) for r in bound.collect()}
    assert got == {1: ([1], "ITEM_CODE"), 2: ([], "STRONG_ITEM_CODE_CONFLICT"), 3: ([1, 2], "TIED"), 4: ([], "STRONG_MODEL_CONFLICT"), 5: ([], "UNBOUND"), 6: ([1], "SOLE_LINE"), 7: ([], "UNBOUND")}
    out = {(r.business_id, r.order_line_id): (r.quantity_result, list(r.reasons)) for r in allocation.line_evidence(bound.where("source_id <> 3"), orders.select("business_id", "order_line_id", "quantity")).collect()}
    assert out == {("b", 1): ("PASS", []), ("b", 2): ("REVIEW", ["LINE_ROLE_EVIDENCE_MISSING"]), ("s", 1): ("FAIL", ["QUANTITY_OVERAGE"])}


def test_keys_that_are_one(spark):
    keys = spark.createDataFrame([(1, "j", "SO25-002"), (2, "j", "SO25-0021"), (3, "j", "HT25-0001"), (4, "k", "SO25-7777"), (5, "k", "HT25-7777"), (6, "k", "HT25-7777")], "doc_id int, job string, key string")
    plain = {r.doc_id: r.group for r in entities.business_groups(keys).collect()}
    assert plain[1] != plain[2] and plain[5] == plain[6] == "HT25-7777"
    merged = {r.doc_id: r.group for r in entities.business_groups(keys, merges=entities.key_merges(keys, job="job")).collect()}
    assert merged == {1: "SO25-0021", 2: "SO25-0021", 3: "HT25-0001", 4: "SO25-7777", 5: "SO25-7777", 6: "SO25-7777"}

    # a scan cut off after the prefix joins nothing; across jobs a beginning must have enough digits to name one order
    cut = spark.createDataFrame([(1, "a", "SO"), (2, "a", "SO25"), (3, "b", "SO25-0021"), (4, "c", "SO25-002"), (5, "d", "SO25-0099")], "doc_id int, job string, key string")
    assert {tuple(r) for r in entities.key_merges(cut).collect()} == {("SO25-002", "SO25-0021")}
    assert {tuple(r) for r in entities.key_merges(cut, job="job").collect()} == {("SO", "SO25")}


def test_worst_status(spark):
    rows = [("a", "PASS"), ("a", "CONFLICT"), ("b", "PASS_WITH_WARNING"), ("b", "odd"), ("c", None)]
    df = spark.createDataFrame(rows, "k string, s string").groupBy("k").agg(assertions.worst(F.col("s")).alias("w"))
    assert {r.k: r.w for r in df.collect()} == {"a": "CONFLICT", "b": "PASS_WITH_WARNING", "c": "PASS"}
