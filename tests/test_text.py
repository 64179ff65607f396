"""Indexes over text, fields and tables in text."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates
from ledgerloom.operators import grids, retrieval, textfields, textindex, trigrams
from ledgerloom.sources import versions


def plain_hits(texts, term):
    return {d: n for d, t in texts.items() if (n := sum((t or "").lower().startswith(term, i) for i in range(len(t or ""))))}


def test_trigram_occurrences_equal_a_scan(spark, tmp_path):
    rng = random.Random(3)
    texts = {i: "".join(rng.choice("abAB 订单号x😀") for _ in range(rng.randrange(400))) for i in range(60)} | {90: None, 91: "", 92: "ab", 93: "aaaaaa" * 2000}
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, gram int")
    trigrams.build(df, f"{tmp_path}/i")
    asked = ["aba", "aaaa", "订单号", "x订单", "单号x😀", "😀😀😀", "b 订", "abab a", "zzz", "ab", "订单号订单号订"]
    got = trigrams.occurrences(f"{tmp_path}/i", spark.createDataFrame([(a,) for a in asked], "term string")).collect()
    want = {(a, d): n for a in asked if len(a) > 2 for d, n in plain_hits(texts, a).items()}
    assert want and {(r.term, r.doc): r.tf for r in got} == want


def test_trigram_search(spark, tmp_path):
    texts = [(1, "the unbelievable story"), (2, "nothing here"), (3, "believe in 采购订单号 and more"), (4, None), (5, "go up: it is so"), (6, "it")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    trigrams.build(df, f"{tmp_path}/i")
    asked = spark.createDataFrame([(1, "Believ"), (2, "订单"), (3, "订单号 zq"), (4, "it up"), (5, "none"), (6, None), (7, "???")], "query_id long, text string")
    got = {}
    for r in trigrams.search(f"{tmp_path}/i", df, asked).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, round(r.score, 6)))
    assert [d for _, d, _ in sorted(got[1])] == [1, 3] or [d for _, d, _ in sorted(got[1])] == [3, 1]
    assert sorted(got[2]) == [(1, 3, 0.0)]  # two characters only: the fallback
    assert [d for _, d, _ in got[3]] == [3] and got[3][0][2] > 0
    assert sorted(got[4]) == [(1, 5, 0.0), (2, 6, 0.0)] and set(got) == {1, 2, 3, 4}


def test_trigram_search_reads_no_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, "abcdef"), (2, "xyz")], "doc_id long, text string")
    trigrams.build(df, f"{tmp_path}/i")
    unread = df.withColumn("text", F.raise_error(F.lit("a text was read")).cast("string"))
    asked = spark.createDataFrame([(1, "bcd")], "query_id long, text string")
    assert [r.doc_id for r in trigrams.search(f"{tmp_path}/i", unread, asked).collect()] == [1]


def test_trigram_search_of_nothing(spark, tmp_path):
    trigrams.build(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/i")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert trigrams.search(f"{tmp_path}/i", empty, spark.createDataFrame([(1, "abc")], "query_id long, text string")).count() == 0


def test_versions(spark, tmp_path):
    path, one = f"{tmp_path}/v", spark.range(3)
    m0 = versions.manifest(spark, path)
    assert (m0.version, versions.table(spark, path, m0, "t")) == (0, None)
    m1 = versions.commit(spark, path, m0, {"t": [versions.part(one, path, "t")]}, {"n": 3})
    versions.part(spark.range(100), path, "t")  # of a job that dies before it commits
    assert versions.table(spark, path, versions.manifest(spark, path), "t").count() == 3
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, m0, {"t": []})
    m2 = versions.commit(spark, path, m1, {"t": [*m1.tables["t"], versions.part(spark.range(2), path, "t")], "u": [versions.part(one, path, "u")]}, {"n": 5, "名": "é"})
    assert versions.manifest(spark, path) == m2 and versions.manifest(spark, path, 1) == m1
    assert versions.table(spark, path, m2, "t").count() == 5
    m3 = versions.rollback(spark, path, 1)
    assert (m3.version, m3.tables, m3.facts) == (3, m1.tables, m1.facts) and versions.versions(spark, path) == [1, 2, 3]


def test_index_after_changes_equals_one_from_scratch(spark, tmp_path):
    rng, path = random.Random(4), f"{tmp_path}/x"
    words = ["alpha", "beta", "gamma", "delta", "eps", "订单"]
    text = lambda: rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))])
    now = {}
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "订单 eps"), (3, "none")], "query_id long, text string")
    schema = "doc_id long, source string, text string, term string, length int"
    assert textindex.search(spark, path, queries) is None

    def change(sources, gone=()):
        rows = [(rng.randrange(10**6), s, text(), "x", 0) for s in sources for _ in range(rng.randrange(1, 9))]
        for k in [k for k, v in now.items() if v[1] in (*sources, *gone)]:
            del now[k]
        now.update({r[0]: r for r in rows})
        textindex.replace_sources(spark, path, spark.createDataFrame(rows, schema), spark.createDataFrame([(g,) for g in gone], "source string") if gone else None)

    def same():
        got = textindex.search(spark, path, queries, k=5).withColumnRenamed("doc", "doc_id")
        want = retrieval.bm25(spark.createDataFrame(list(now.values()), schema), queries, k=5)
        key = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 7)) for r in df.collect())
        assert key(got) == key(want)

    change(["a", "b", "c", None])
    same()
    change(["b", None], gone=["c"])
    same()
    textindex.merge(spark, path)
    same()
    change(["c", "a"])
    change(["a"])
    same()
    textindex.merge(spark, path)
    same()
    old = textindex.search(spark, path, queries, k=5, version=1)
    assert old.count() > 0  # an older version stays readable
    # a change that fails before it commits leaves the index as it was
    before = versions.manifest(spark, path)
    bad = spark.createDataFrame([(1, "a", "x", "x", 0)], schema).withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        textindex.replace_sources(spark, path, bad)
    assert versions.manifest(spark, path) == before


def test_ingested_paragraphs(spark):
    text = "# Title one\r\nbody of it\n\n  \nshort\n\n## Next heading\nmore text here\n# Third and last\nend of text"
    rows = textindex.ingested(spark.createDataFrame([("f.md", text), ("g.md", None)], "source_file string, text string")).orderBy("seq").collect()
    assert [(r.seq, r.raw_text) for r in rows] == [(1, "# Title one\nbody of it"), (2, "## Next heading\nmore text here"), (3, "# Third and last\nend of text")]
    import hashlib

    assert rows[0].id == hashlib.sha1(("f.md:1:" + rows[0].raw_text).encode()).hexdigest()[:16]


def test_quoted_label(spark):
    hits = spark.createDataFrame([(1, 1, "Delivery FOB Shanghai"), (1, 2, None), (2, 1, "x"), (3, 1, "CIF Hamburg"), (4, 1, "a")], "query_id long, seq int, raw_text string")
    said = spark.createDataFrame([(1, "fob", "0.95", "FOB Shang"), (2, "FOB", "0.9", "not there"), (3, "sea", "7", "CIF")], "query_id long, trade_mode string, confidence string, evidence string")
    got = {r.query_id: tuple(r)[1:] for r in textindex.quoted_label(said, hits).collect()}
    assert got == {1: ("FOB", 0.95, "FOB Shang"), 2: ("FOB", 0.4, ""), 3: ("unknown", 1.0, "CIF"), 4: ("unknown", 0.0, "")}


NOTE = """采购订单号：PO-77_1
订单日期 2025年3月4日  供应商名称：第一 公司
实收数量 12 差异数量：3
合 计 ¥1,234.50 税率 13 % 折扣率: 5 %
<table><tr><td>项目名称</td><td>规格型号</td><td>单价 9</td><td>税率</td></tr></table>
贸易术语：FOB Shanghai port
签收后 30 天内付款"""


def test_text_fields(spark):
    docs = [(1, NOTE), (2, None), (3, "nothing"), (4, "业务编号 SO24-1 签收日期：2025/13/1 交货日期 2025-1-9"), (5, "357件 27.40 数量 5"), (6, "Supplier: Supplier: ACME\nbuyer Bob"), (None, NOTE)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, field string")
    got = {r.doc_id: dict(r.fields) for r in textfields.text_fields(df).collect()}
    assert got[1] == {
        "documentNo": "PO-77_1", "orderNo": "PO-77_1", "invoiceNo": "PO-77_1", "documentDate": "2025-03-04", "supplierName": "第一 公司", "quantity": "12", "totalAmount": "1234.50", "taxRate": "13",
        "discountRate": "5%", "transportTerms": "FOB Shanghai port", "paymentTerms": "签收后 30 天内付款", "settlementTerms": "签收后 30 天内付款",
    }
    assert got[4] == {"orderNo": "SO24-1", "documentNo": "SO24-1"}  # the first date is none of the calendar
    assert got[5]["quantity"] == "357" and got[6] == {"supplierName": "Supplier: ACME", "buyerName": "Bob"}
    assert set(got) == {1, 4, 5, 6}


def test_candidates_do_not_overlap_and_rules_can_be_added(spark):
    df = spark.createDataFrame([(1, NOTE + "\n项目 AB-1")], "doc_id long, text string")
    found = textfields.candidates(df, more=[("项目", "project", "code", 1)]).collect()
    by = {}
    for c in found:
        assert NOTE[c.start : c.end].endswith(c.value) or c.field == "project"
        by.setdefault(c.field, []).append((c.start, c.end))
    assert "project" in by and all(a[1] <= b[0] for v in by.values() for a, b in zip(sorted(v), sorted(v)[1:], strict=False))


def test_tables_in_text(spark):
    text = """| a | b |
| --- | :---: |
| 1 | 2 | 3 |
between
<table><tr><th>x</th><th colspan=2>y</th></tr><tr><td rowspan="2">A &amp; <b>B</b></td><td>1</td><td>2</td></tr><tr><td>3<td>4</tr></table>
| last |"""
    df = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "a | b", 0), (4, "<table><tr><td>open", 0)], "doc_id long, text string, row int")
    got = sorted((r.doc_id, r.table, r.row, r.line if r.line is not None else -1, r.header, list(r.cells)) for r in grids.rows(df).collect())
    assert got == [
        (1, 0, 0, 0, True, ["a", "b"]), (1, 0, 1, 2, False, ["1", "2", "3"]), (1, 1, 0, -1, True, ["x", "y", "y"]), (1, 1, 1, -1, False, ["A & B", "1", "2"]), (1, 1, 2, -1, False, ["A & B", "3", "4"]),
        (1, 2, 0, 5, False, ["last"]), (4, 0, 0, -1, False, ["open"]),
    ]
    assert grids.cells(grids.rows(df)).where("doc_id = 1 AND table = 1 AND col = 0").count() == 3
    assert grids.rows(df.where("doc_id > 4")).count() == 0


def test_prices_and_quantities_in_tables(spark):
    price = "| 品名 | 数量 | 基础不含税单价 | 商业折扣 | 税率 | 折后不含税金额 |\n|---|---|---|---|---|---|\n| x | | 5 | 9折 | 13% | 1 |\n| y | 1,200 件 | 2,5 | 9折 | 913 | 1 |"
    after = "| 折后数量 | 实收数量 | 数量 | 基础不含税单价 | 折扣 |\n| 7 | 8 | 9 | 10 | 5% |"
    receipt = "| 品名 | 差异数量 | 实收数量 |\n|---|---|---|\n| x | 1 | ４８ 支 |"
    html = "<table><tr><td>发货数量</td><td>备注</td></tr><tr><td>0</td><td/></tr><tr><td>1 234</td><td>z</td></tr></table>"
    docs = [(1, price), (2, after), (3, receipt), (4, html), (5, "实收数量：48.5"), (6, None), (7, "| 数量 | a |\n| none | b |")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    made = grids.rows(df)
    assert {r.doc_id: tuple(r)[1:] for r in grids.price_tables(made).collect()} == {1: (1200.0, 2.5, 0.1, 0.13), 2: (9.0, 10.0, 0.05, 0.13)}
    assert {r.doc_id: r.quantity for r in grids.delivery_quantities(df).collect()} == {1: 1.0, 2: 8.0, 3: 48.0, 4: 1234.0, 5: 48.5}  # commas count only where nothing follows the number


def test_receipt_dates(spark):
    cases = [
        ("2026年1月5日为验收完成", None, ("2026-01-05", "2026-01-05", None, "acceptance_completion")),
        ("到货日：2026-01-02，验收期 7 日", None, ("2026-01-09", "2026-01-09", "2026-01-02", "arrival_plus_inspection_period")),
        ("到货日：2026-01-02", "签收后 30 天", ("2026-02-01", "2026-02-01", "2026-01-02", "arrival_plus_inspection_period")),
        ("签收日期 2026/1/3", None, ("2026-01-03", None, "2026-01-03", "receipt_labeled")),
        ("验收于 2026-01-03 和 2026-01-09", None, ("2026-01-09", "2026-01-09", "2026-01-03", "latest_of_multiple_dates")),
        ("入库 2026-01-03", None, ("2026-01-03", None, None, "first_date_fallback")),
        ("发票 2026-01-03", None, (None, None, None, None)), (None, None, (None, None, None, None)), ("", "x", (None, None, None, None)),
    ]
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(cases)], "i int, t string, p string")
    got = {r.i: r.d for r in df.select("i", dates.receipt_dates(F.col("t"), F.col("p")).alias("d")).collect()}
    for i, (_, _, want) in enumerate(cases):
        d = got[i]
        assert tuple(None if x is None else str(x) for x in (d.receipt_date, d.acceptance_date, d.delivery_date, d.source)) == want, i


def test_postings_are_stored_once_and_in_order(spark, tmp_path):
    import glob

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/ledgerloom/*"
    before = set(glob.glob(folder))
    trigrams.build(spark.createDataFrame([(i, f"some text {i} abc") for i in range(40)], "doc_id long, text string").repartition(3), f"{tmp_path}/i")
    assert set(glob.glob(folder)) == before
    for f in glob.glob(f"{tmp_path}/i/postings/*.parquet"):
        rows = [(r.gram, r.doc) for r in spark.read.parquet(f).collect()]
        assert rows == sorted(rows)
