"""Queries on populations from sheets, identifiers in texts, line evidence, merged groups and assertions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import dates, ids
from ledgerloom.operators import allocation, amounts, assertions, clauses, entities, sheets
from ledgerloom.plans import canonical as C
from ledgerloom.plans.registry import query
from ledgerloom.plans.stash import shared_dir
from ledgerloom.sources import files
from ledgerloom.sources import workbooks as B

# ---- sheets: the orders of each year, under titles of different length and headers of four kinds

_HEADS = [
    ["业务编号", "过账日期", "贷方金额", "客户名称", "凭证号", "币种"],
    ["Record Locator", "过账日期", "金额", "客户", "备注", "单位"],
    ["序号", "销售订单号", "记账日期", "借方金额", "客户名称", "数量"],
    ["行号", "日期", "金额", "客户名称", "数量", "单位"],
]
_SHEET, _TITLES = "CAST(year({d}) AS INT)", "pmod({s}, 4)"
_CELLS = [
    "['SO' || o_orderkey, {d}, {a}, 'C' || o_custkey, 'V' || o_orderkey, 'cny']",
    "['Case-' || o_orderkey, {d}, {a}, 'C' || o_custkey, o_orderstatus, 'EA']",
    "[CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 40 > 0 THEN 'so-' || (o_orderkey + 10000) ELSE '-' END, {d}, {a}, 'C' || o_custkey, CAST(o_orderkey % 9 AS VARCHAR)]",
    "[CAST(o_orderkey AS VARCHAR), {d}, {a}, 'C' || o_custkey, '1', 'EA']",
]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for each year of orders: as many title rows as the year's rest by 4, a header, and a row for each order."""
    o = C.table(spark, sf_dir, "orders")
    d, a = F.date_format("o_orderdate", "yyyy-MM-dd"), F.format_number("o_totalprice", 2)
    text = lambda c: F.col(c).cast("string")
    say = lambda p, c: F.concat(F.lit(p), text(c))
    kinds = [
        F.array(say("SO", "o_orderkey"), d, a, say("C", "o_custkey"), say("V", "o_orderkey"), F.lit("cny")),
        F.array(say("Case-", "o_orderkey"), d, a, say("C", "o_custkey"), "o_orderstatus", F.lit("EA")),
        F.array(text("o_orderkey"), F.when(F.col("o_orderkey") % 40 > 0, F.concat(F.lit("so-"), (F.col("o_orderkey") + 10000).cast("string"))).otherwise("-"), d, a, say("C", "o_custkey"), (F.col("o_orderkey") % 9).cast("string")),
        F.array(text("o_orderkey"), d, a, say("C", "o_custkey"), F.lit("1"), F.lit("EA")),
    ]
    year = F.year("o_orderdate")
    kind = lambda s, of: F.when(s % 4 == 0, of[0]).when(s % 4 == 1, of[1]).when(s % 4 == 2, of[2]).otherwise(of[3])
    rows = o.select(year.cast("string").alias("sheet"), (F.lit(20) + F.col("o_orderkey")).alias("row"), kind(year, kinds).alias("cells"))
    years = o.select(year.alias("y")).distinct()
    heads = years.select(F.col("y").cast("string").alias("sheet"), (F.col("y") % 4 + 1).cast("long").alias("row"), kind(F.col("y"), [F.array(*map(F.lit, h)) for h in _HEADS]).alias("cells"))
    titles = years.where("y % 4 > 0").select(F.col("y").cast("string").alias("sheet"), F.explode(F.sequence(F.lit(1).cast("long"), (F.col("y") % 4).cast("long"))).alias("row"), F.array(F.lit("金额单位"), F.lit("sheet"), F.lit(""), F.lit(""), F.lit(""), F.lit("")).alias("cells"))
    return rows.unionByName(heads).unionByName(titles)


_SAYS = lambda c, hints: "(len(" + c + ") > 0 AND (" + " OR ".join(f"contains({c}, '{h}') OR contains('{h}', {c})" for h in ["".join(x.split()).lower() for x in hints]) + "))"
_KNOWN = sheets.STRONG + sheets.SECONDARY + sheets.BARRED + tuple(x for h in sheets.ROLES.values() for x in h)
_HEAD_SQL = "CASE y % 4 " + " ".join(f"WHEN {i} THEN {h}" for i, h in enumerate(_HEADS)) + " END"
_CELL_SQL = "CASE year(o_orderdate) % 4 " + " ".join(f"WHEN {i} THEN {c.format(d='''strftime(o_orderdate, '%Y-%m-%d')''', a='''format('{:,.2f}', o_totalprice)''')}" for i, c in enumerate(_CELLS)) + " END"
_SHEETS_SQL = f"""years AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders),
cells AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS sheet, 20 + o_orderkey AS row, {_CELL_SQL} AS cells FROM orders
  UNION ALL SELECT CAST(y AS VARCHAR), y % 4 + 1, {_HEAD_SQL} FROM years
  UNION ALL SELECT CAST(y AS VARCHAR), unnest(range(1, y % 4 + 1)), ['金额单位', 'sheet', '', '', '', ''] FROM years),
tried AS (SELECT sheet, row AS header_row, cells AS headers FROM cells WHERE row <= 12 AND len(list_filter(cells, lambda x: trim(x) <> '')) >= 2
  AND len(list_filter(list_transform(cells, lambda x: lower(replace(x, ' ', ''))), lambda x: {_SAYS('x', _KNOWN)})) > 0),
vals AS (SELECT t.sheet, header_row, i, headers[i] AS header, cells[i] AS raw FROM (SELECT tried.*, unnest(range(1, 7)) AS i FROM tried) t JOIN cells c ON c.sheet = t.sheet AND c.row > t.header_row
  WHERE trim(headers[i]) <> '' AND len(list_filter(cells, lambda x: trim(x) <> '' AND lower(trim(x)) NOT IN ('none', 'nan', '-'))) > 0),
norm AS (SELECT *, CASE WHEN regexp_matches(raw, '[0-9A-Za-z]') AND lower(raw) NOT IN ('none', 'nan', 'null', '-') THEN regexp_replace(regexp_replace(upper(replace(raw, ' ', '')), '([0-9])[IL]$', '\\11'), '([0-9])O$', '\\10') END AS v FROM vals),
stats AS (SELECT sheet, header_row, i, header, count(*) AS n, count(v) AS u, count(DISTINCT v) AS d, coalesce(bool_and(regexp_full_match(v, '[0-9]+([.]0+)?')), true) AS digits, coalesce(sum(length(v)), 0) AS chars, lower(replace(header, ' ', '')) AS h FROM norm GROUP BY 1, 2, 3, 4),
ranks AS (SELECT *, CASE WHEN {_SAYS('h', sheets.STRONG)} THEN 3 WHEN {_SAYS('h', sheets.SECONDARY)} THEN 2 WHEN {_SAYS('h', sheets.BARRED)} THEN -1 ELSE 0 END AS tier, u / n AS fill, CASE WHEN u > 0 THEN d / u ELSE 0 END AS uni FROM stats),
ways AS (SELECT *, CASE WHEN u > 0 AND fill >= 0.5 AND (tier = 3 OR (tier = 2 AND uni >= 0.9)) THEN 'keyword' WHEN tier = 0 AND u >= 2 AND fill >= 0.8 AND uni >= 0.98 AND NOT digits AND chars <= 40 * u THEN 'uniqueness_fallback' END AS way FROM ranks),
keys AS (SELECT *, round(tier * 100 + uni * 20 + fill * 10 + CASE WHEN way = 'uniqueness_fallback' THEN 40 ELSE 0 END, 3) AS score FROM ways WHERE way IS NOT NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY sheet, header_row ORDER BY score DESC, i) AS a FROM keys),
heads AS (SELECT b.*, t.headers, row_number() OVER (PARTITION BY b.sheet ORDER BY score + 2 * least(len(list_filter(headers, lambda x: x <> '')), 8) DESC, header_row) AS r FROM best b JOIN tried t USING (sheet, header_row) WHERE a = 1),
found AS (SELECT * FROM heads WHERE r = 1)"""


@query(f"WITH {_SHEETS_SQL} SELECT sheet, CAST(header_row AS BIGINT) AS header_row, header AS key_column, way AS method, score FROM found")
def sheet_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.find_headers(_cells(spark, sf_dir)).select("sheet", "header_row", "key_column", "method", "score")


def _at(role: str) -> str:
    """The place of the first header that the first possible hint fits, in SQL."""
    hints = ["".join(x.split()).lower() for x in sheets.ROLES[role]]
    free = " AND lower(replace(headers[i], ' ', '')) <> lower(replace(header, ' ', ''))" if role in sheets.NOT_THE_KEY else ""
    fits = [f"list_filter(range(1, 7), lambda i: headers[i] <> '' AND (contains(lower(replace(headers[i], ' ', '')), '{h}') OR contains('{h}', lower(replace(headers[i], ' ', '')))){free})[1]" for h in hints]
    return f"coalesce({', '.join(fits)})"


@query(f"""WITH {_SHEETS_SQL}, placed AS (SELECT sheet, header_row, i AS key_i, {', '.join(f'{_at(r)} AS at_{r}' for r in ('order_number', 'book_date', 'book_amount', 'customer', 'voucher_number', 'quantity', 'currency'))} FROM found)
SELECT p.sheet, CAST(row AS BIGINT) AS row, regexp_replace(regexp_replace(upper(cells[key_i]), '([0-9])[IL]$', '\\11'), '([0-9])O$', '\\10') AS business_id, CASE WHEN regexp_matches(cells[at_order_number], '[0-9A-Za-z]') THEN upper(cells[at_order_number]) END AS order_number,
  cells[at_book_date] AS book_date, CAST(replace(cells[at_book_amount], ',', '') AS DOUBLE) AS book_amount, cells[at_customer] AS customer, cells[at_voucher_number] AS voucher_number, CAST(cells[at_quantity] AS DOUBLE) AS quantity, upper(cells[at_currency]) AS currency
FROM cells c JOIN placed p ON c.sheet = p.sheet AND c.row > p.header_row WHERE regexp_matches(cells[key_i], '[0-9A-Za-z]')""")
def sheet_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    got = sheets.records(cells, sheets.find_headers(cells))
    return got.select("sheet", "row", "business_id", "order_number", F.date_format("book_date", "yyyy-MM-dd").alias("book_date"), "book_amount", "customer", "voucher_number", "quantity", "currency")


# ---- identifiers in texts

_LETTER = """CASE o_orderkey % 8 WHEN 0 THEN '订单号：SO25-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || ' 备注' WHEN 1 THEN 'see kjht25-' || (1000 + o_orderkey % 9000) || ' and HT25-' || (1000 + o_orderkey % 9000)
 WHEN 2 THEN '销售订单号 po2025_' || (1000 + o_custkey % 9000) || '; 合同编号 = ht25-' || (100 + o_custkey % 900) || 'l' WHEN 3 THEN '发票号: ' || (10000000 + o_orderkey) || ', INV25-' || (1000 + o_custkey % 7) || ', inv25-' || (1000 + o_custkey % 7)
 WHEN 4 THEN '业务编号=S025-' || (1000 + o_orderkey % 9000) WHEN 5 THEN 'BANK2025' || o_custkey || ' for SO25-002I, SA25-' || (1000 + o_orderkey % 5) WHEN 6 THEN '合同索引号DO24' || (1000 + o_custkey % 4000) || ' so25' || (100 + o_orderkey % 900) || 'O' ELSE o_orderpriority END"""
_LABELLED = [ids.label_pattern(*x) for x in ids.LABELS]


def _sql_ids(c: str) -> str:
    found = ", ".join(f"regexp_extract_all({c}, '{p}', 1)" for p in [*_LABELLED, *ids.BARE])
    fixed = "regexp_replace(regexp_replace(regexp_replace(upper(x), '(^|[^A-Z])S0([0-9]{2}[-_]?[0-9]{3,6})($|[^0-9A-Z])', '\\1SO\\2\\3'), '^([A-Z]{1,8}[0-9]{2}[-_]?[0-9]*)[IL]$', '\\11'), '^([A-Z]{1,8}[0-9]{2}[-_]?[0-9]*)O$', '\\10')"
    return f"list_transform(flatten([{found}]), lambda x: {fixed})"


_IDS_SQL = f"""texts AS (SELECT o_orderkey, {_LETTER} AS t FROM orders), raw AS (SELECT o_orderkey, t, {_sql_ids('t')} AS l FROM texts),
once AS (SELECT o_orderkey, t, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM raw), got AS (SELECT o_orderkey, t, list_filter(l, lambda x: len(list_filter(l, lambda y: length(y) > length(x) AND suffix(y, x))) = 0) AS l FROM once)"""


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.expr(_LETTER.replace("VARCHAR", "STRING")).alias("t"))


@query(f"WITH {_IDS_SQL} SELECT o_orderkey AS doc_id, array_to_string(l, ',') AS ids FROM got")
def free_text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), F.array_join(ids.ids_in_free_text(F.col("t")), ",").alias("ids"))


@query(f"""WITH {_IDS_SQL} SELECT o_orderkey AS doc_id, list_filter(l, lambda x: regexp_matches(x, '^(SO|PO)'))[1] AS order_no, list_filter(l, lambda x: regexp_matches(x, '^(EXKJ|EX|KJ)?HT|^CT'))[1] AS contract_no,
nullif(regexp_extract(t, '发票号码?\\s*[:=：＝]?\\s*([0-9]{{8,20}})', 1), '') AS invoice_no FROM got""")
def page_key_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), ids.page_keys(F.col("t")).alias("k")).select("doc_id", "k.*")


@query(f"""WITH {_IDS_SQL}, f AS (SELECT g.o_orderkey, l, CASE o_orderkey % 3 WHEN 0 THEN 'SO25-' || (o_custkey + 1000) WHEN 1 THEN 'net ' || o_custkey || ' days' ELSE CAST(o_orderkey + 10000000 AS VARCHAR) END AS doc FROM got g JOIN orders USING (o_orderkey)),
w AS (SELECT o_orderkey, list_concat(CASE WHEN regexp_matches(doc, '^[A-Z]{{1,10}}[0-9]{{2,6}}[-_]?[0-9]{{0,8}}$') OR regexp_matches(doc, '^[0-9]{{8,20}}$') THEN [doc] ELSE [] END, regexp_extract_all(doc, 'SO[0-9]{{2,4}}[-_]?[0-9]{{3,6}}'), l) AS l FROM f)
SELECT o_orderkey AS doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS keys FROM w""")
def document_key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents with a number of their own, or a phrase in its place, and a remark."""
    k, own = F.col("o_orderkey"), F.col("o_custkey")
    number = F.when(k % 3 == 0, F.concat(F.lit("SO25-"), (own + 1000).cast("string"))).when(k % 3 == 1, F.concat(F.lit("net "), own.cast("string"), F.lit(" days"))).otherwise((k + 10000000).cast("string"))
    fields = F.create_map(F.lit("documentNo"), number, F.lit("remarks"), F.col("t"))
    return _letters(spark, sf_dir).select(k.alias("doc_id"), F.array_join(ids.document_keys(fields), ",").alias("keys"))


# ---- line evidence

_ORDER_LINES = """ol AS (SELECT l_orderkey AS g, l_linenumber AS id, min(l_partkey) AS p, min(l_suppkey) AS s, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2),
o AS (SELECT g, id, CASE WHEN p % 3 > 0 THEN 'C' || (p % 5) END AS c, CASE WHEN s % 3 > 0 THEN 'M' || (s % 4) END AS m, 'G' || (p % 7) AS d, q FROM ol),
src AS (SELECT g, role, id, CASE WHEN (p + n) % 4 > 0 AND p % 3 > 0 THEN 'C' || ((p + CASE WHEN p % 11 = 0 THEN 1 ELSE 0 END) % 5) END AS c, CASE WHEN (s + n) % 5 > 1 AND s % 3 > 0 THEN 'M' || (s % 4) END AS m, CASE WHEN (p + s) % 6 > 0 THEN 'G' || (p % 7) END AS d, CASE WHEN p % 13 = 0 THEN NULL ELSE q + CASE WHEN p % 17 = n THEN 1 ELSE 0 END END AS q
  FROM ol, (VALUES ('receipt', 0), ('invoice', 1)) r(role, n) WHERE (p + n) % 10 > 0)"""
_BOUND = f"""WITH {_ORDER_LINES}, met AS (SELECT src.g, src.role, src.id, src.c, src.m, src.d, src.q, list(o.id ORDER BY o.id) FILTER (WHERE o.c = src.c) AS hc, list(o.id ORDER BY o.id) FILTER (WHERE o.m = src.m) AS hm, list(o.id ORDER BY o.id) FILTER (WHERE o.d = src.d) AS hd, count(o.c) AS nc, count(o.m) AS nm, count(*) AS n, min(o.id) AS least FROM src JOIN o ON o.g = src.g GROUP BY ALL),
b AS (SELECT *, CASE WHEN hc IS NOT NULL THEN CASE WHEN len(hc) > 1 THEN 'TIED' ELSE 'ITEM_CODE' END WHEN c IS NOT NULL AND nc > 0 THEN 'STRONG_ITEM_CODE_CONFLICT' WHEN hm IS NOT NULL THEN CASE WHEN len(hm) > 1 THEN 'TIED' ELSE 'MODEL' END WHEN m IS NOT NULL AND nm > 0 THEN 'STRONG_MODEL_CONFLICT' WHEN hd IS NOT NULL THEN CASE WHEN len(hd) > 1 THEN 'TIED' ELSE 'GOODS' END WHEN n = 1 THEN 'SOLE_LINE' ELSE 'UNBOUND' END AS basis FROM met),
bound AS (SELECT *, CASE WHEN basis IN ('STRONG_ITEM_CODE_CONFLICT', 'STRONG_MODEL_CONFLICT', 'UNBOUND') THEN [] WHEN basis = 'SOLE_LINE' THEN [least] WHEN hc IS NOT NULL THEN hc WHEN hm IS NOT NULL THEN hm ELSE hd END AS ids FROM b)"""


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("business_id"), F.col("l_linenumber").alias("order_line_id")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.sum("l_quantity").cast("long").alias("q"))


def _bound_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ol = _order_lines(spark, sf_dir)
    p, s, n = F.col("p"), F.col("s"), F.col("n")
    say = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    orders = ol.select("business_id", "order_line_id", F.when(p % 3 > 0, say("C", p % 5)).alias("item_code"), F.when(s % 3 > 0, say("M", s % 4)).alias("model"), say("G", p % 7).alias("goods"), F.col("q").alias("quantity"))
    role = F.explode(F.array(F.struct(F.lit("receipt").alias("role"), F.lit(0).alias("n")), F.struct(F.lit("invoice").alias("role"), F.lit(1).alias("n")))).alias("r")
    src = ol.select("*", role).select("*", "r.role", "r.n").where((p + n) % 10 > 0)
    source = src.select(
        "business_id", "role", F.col("order_line_id").alias("source_id"), F.when(((p + n) % 4 > 0) & (p % 3 > 0), say("C", (p + F.when(p % 11 == 0, 1).otherwise(0)) % 5)).alias("item_code"),
        F.when(((s + n) % 5 > 1) & (s % 3 > 0), say("M", s % 4)).alias("model"), F.when((p + s) % 6 > 0, say("G", p % 7)).alias("goods"), F.when(p % 13 != 0, F.col("q") + F.when(p % 17 == n, 1).otherwise(0)).alias("quantity"),
    )
    return allocation.bind_by_evidence(source, orders), orders


@query(_BOUND + " SELECT g AS business_id, role, id AS source_id, array_to_string(ids, ',') AS order_lines, basis FROM bound")
def evidence_line_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound, _ = _bound_lines(spark, sf_dir)
    return bound.select("business_id", "role", "source_id", F.array_join(F.col("order_line_ids").cast("array<string>"), ",").alias("order_lines"), "basis")


@query(_BOUND + """, e AS (SELECT g, role, q, basis = 'TIED' AS tied, unnest(ids) AS id FROM bound),
t AS (SELECT g, id, bool_or(tied) AS amb, count(*) FILTER (WHERE role = 'receipt' AND NOT tied) AS nr, count(*) FILTER (WHERE role = 'invoice' AND NOT tied) AS ni, CASE WHEN count(*) FILTER (WHERE role = 'receipt' AND NOT tied AND q IS NULL) = 0 THEN sum(q) FILTER (WHERE role = 'receipt' AND NOT tied) END AS r, CASE WHEN count(*) FILTER (WHERE role = 'invoice' AND NOT tied AND q IS NULL) = 0 THEN sum(q) FILTER (WHERE role = 'invoice' AND NOT tied) END AS i FROM e GROUP BY 1, 2),
w AS (SELECT o.g, o.id, o.q, r, i, coalesce(amb, false) AS amb, coalesce(nr, 0) = 0 OR coalesce(ni, 0) = 0 AS roles FROM o LEFT JOIN t ON t.g = o.g AND t.id = o.id),
x AS (SELECT *, CASE WHEN amb THEN 'AMBIGUOUS_LINE_ASSIGNMENT' WHEN roles THEN 'LINE_ROLE_EVIDENCE_MISSING' WHEN r IS NULL OR i IS NULL THEN 'LINE_QUANTITY_EVIDENCE_MISSING' ELSE array_to_string(list_filter([CASE WHEN r < q OR i < q THEN 'QUANTITY_SHORTAGE' END, CASE WHEN r > q OR i > q THEN 'QUANTITY_OVERAGE' END, CASE WHEN r <> i THEN 'RECEIPT_INVOICE_QUANTITY_MISMATCH' END], lambda z: z IS NOT NULL), ',') END AS reasons FROM w)
SELECT g AS business_id, id AS order_line_id, CAST(r AS BIGINT) AS received, CAST(i AS BIGINT) AS invoiced, CASE WHEN amb OR roles OR r IS NULL OR i IS NULL THEN 'REVIEW' WHEN reasons = '' THEN 'PASS' ELSE 'FAIL' END AS quantity_result, reasons FROM x""")
def evidence_line_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = allocation.line_evidence(*_bound_lines(spark, sf_dir))
    return got.select("business_id", "order_line_id", "received", "invoiced", "quantity_result", F.array_join("reasons", ",").alias("reasons"))


# ---- groups whose keys are cut off, or the only ones of their job

_KEYS = """k AS (SELECT o_orderkey AS d, o_custkey AS job, 'SO25-' || (o_orderkey + 1000000) AS key FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, o_custkey, left('SO25-' || (o_orderkey + 1000000), 11) FROM orders WHERE o_orderkey % 5 = 1 UNION ALL SELECT o_orderkey, o_custkey, 'HT25-' || (o_custkey + 50000) FROM orders WHERE o_orderkey % 3 = 0),
i AS (SELECT DISTINCT key, replace(key, '-', '') AS c FROM k), j AS (SELECT DISTINCT job, key, replace(key, '-', '') AS c FROM k),
m AS (SELECT a.key AS x, b.key AS y FROM (SELECT job, key, c, unnest(range(2, length(c))) AS n FROM j) b JOIN j a ON a.job = b.job AND a.c = left(b.c, b.n)
  UNION SELECT x, y FROM (SELECT job, min(CASE WHEN key LIKE 'SO%' THEN key END) AS x, min(CASE WHEN key LIKE 'HT%' THEN key END) AS y, count(DISTINCT CASE WHEN key LIKE 'SO%' THEN key END) AS a, count(DISTINCT CASE WHEN key LIKE 'HT%' THEN key END) AS b FROM k GROUP BY 1) WHERE a = 1 AND b = 1),
e AS (SELECT x, y FROM m UNION SELECT y, x FROM m UNION SELECT a.key, b.key FROM k a JOIN k b ON a.d = b.d AND a.key <> b.key),
r(a, b) AS (SELECT key, key FROM i UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
g AS (SELECT a, arg_max(b, (b LIKE 'SO%', length(b), b)) AS grp FROM r GROUP BY 1)"""


@query(f"WITH RECURSIVE {_KEYS} SELECT DISTINCT d AS doc_id, grp AS \"group\" FROM k JOIN g ON g.a = k.key")
def merged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, job = F.col("o_orderkey"), F.col("o_custkey")
    so = F.concat(F.lit("SO25-"), (k + 1000000).cast("string"))
    keys = F.array_compact(F.array(F.when(k % 3 > 0, so), F.when(k % 5 == 1, F.left(so, F.lit(11))), F.when(k % 3 == 0, F.concat(F.lit("HT25-"), (job + 50000).cast("string")))))
    own = C.table(spark, sf_dir, "orders").select(k.alias("doc_id"), job.alias("job"), F.explode(keys).alias("key"))
    return entities.business_groups(own, merges=entities.key_merges(own, job="job"))


# ---- assertions

_OBLIGED = """t AS (SELECT o_orderkey AS k, o_orderpriority[1] <> '5' AS has, CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_totalprice < 40000 THEN 'MISSING' WHEN o_totalprice < 120000 THEN 'AMBIGUOUS' ELSE 'CLEAR' END AS dim,
  list_filter([CASE WHEN o_custkey % 7 = 1 THEN 'STAND_READY_SERVICE_UNCLEAR' END, CASE WHEN o_custkey % 7 = 2 THEN 'PAYMENT_UNCLEAR' END, CASE WHEN o_custkey % 11 = 3 THEN 'own_obligation' END, CASE WHEN o_custkey % 13 = 3 THEN 'CONTRACT_MISSING' END], lambda x: x IS NOT NULL) AS codes, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'WARNING' END AS st FROM orders)"""
_ISSUES = "[" + ", ".join(f"'{c}'" for c in assertions.OBLIGATION_ISSUES) + "]"


@query(f"""WITH {_OBLIGED}, u AS (SELECT *, NOT has OR dim IS NOT DISTINCT FROM 'MISSING' OR list_contains(codes, 'CONTRACT_MISSING') AS none, dim IS NOT DISTINCT FROM 'AMBIGUOUS' OR len(list_filter(codes, lambda c: list_contains({_ISSUES}, c) OR contains(upper(c), 'PERFORMANCE') OR contains(upper(c), 'OBLIGATION'))) > 0 AS unclear FROM t)
SELECT k AS chain_id, CASE WHEN none OR unclear THEN false WHEN dim = 'CLEAR' OR (dim IS NULL AND upper(st) IN ('PASS', 'OK')) THEN true END AS verdict, CASE WHEN none THEN coalesce(dim, 'MISSING') WHEN unclear THEN 'AMBIGUOUS' WHEN dim = 'CLEAR' OR (dim IS NULL AND upper(st) IN ('PASS', 'OK')) THEN 'CLEAR' END AS dimension FROM u""")
def performance_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = F.col("o_custkey"), F.col("o_totalprice")
    dim = F.when(c % 5 == 0, None).when(p < 40000, "MISSING").when(p < 120000, "AMBIGUOUS").otherwise("CLEAR")
    codes = F.array_compact(F.array(F.when(c % 7 == 1, "STAND_READY_SERVICE_UNCLEAR"), F.when(c % 7 == 2, "PAYMENT_UNCLEAR"), F.when(c % 11 == 3, "own_obligation"), F.when(c % 13 == 3, "CONTRACT_MISSING")))
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "WARNING")
    own = C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chain_id"), (F.substring("o_orderpriority", 1, 1) != "5").alias("has"), dim.alias("dim"), codes.alias("codes"), status.alias("status"))
    return own.select("chain_id", assertions.performance_obligation(F.col("has"), F.col("dim"), F.col("codes"), F.col("status")).alias("v")).select("chain_id", "v.*")


@query("""WITH d AS (SELECT l_orderkey AS g, l_partkey * 10 + l_linenumber AS id, ['payment', 'contract', 'receipt', 'order', 'invoice', 'delivery', 'other'][l_suppkey % 7 + 1] AS kind, CASE WHEN l_quantity > 10 THEN l_extendedprice END AS a FROM lineitem)
SELECT g AS business_id, arg_min(kind, (p, id)) AS file_type, CAST(arg_min(id, (p, id)) AS VARCHAR) AS file_index, arg_min(a IS NOT NULL, (p, id)) AS has_amount FROM (SELECT *, list_position(['order', 'invoice', 'payment', 'delivery', 'receipt'], kind) AS p FROM d) WHERE p > 0 GROUP BY 1""")
def price_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["payment", "contract", "receipt", "order", "invoice", "delivery", "other"]))
    ident = F.col("l_partkey") * 10 + F.col("l_linenumber")
    docs = C.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("business_id"), ident.alias("doc_id"), F.get(kinds, (F.col("l_suppkey") % 7).cast("int")).alias("doc_type"), ident.cast("string").alias("number"), F.when(F.col("l_quantity") > 10, F.col("l_extendedprice")).alias("amount"))
    return assertions.price_document(docs)


@query(f"""WITH c AS (SELECT l_orderkey AS k, {list(assertions.ESSENTIAL) + ['currency']}[l_partkey % 7 + 1] AS concept, CASE WHEN l_discount >= 0.09 THEN 'CONFLICT' WHEN l_tax >= 0.07 THEN 'MISSING_EVIDENCE' ELSE 'PASS' END AS r, CASE WHEN l_quantity > 47 THEN 'FAIL' WHEN l_quantity < 4 THEN 'REVIEW' ELSE 'PASS' END AS q FROM lineitem),
s AS (SELECT k, CASE WHEN concept <> 'currency' THEN r END AS s FROM c UNION ALL SELECT k, CASE q WHEN 'FAIL' THEN 'CONFLICT' WHEN 'REVIEW' THEN 'MISSING_EVIDENCE' END FROM c),
t AS (SELECT k, max(list_position({list(assertions.STATUSES)}, s)) AS p FROM s GROUP BY 1),
u AS (SELECT k, CASE WHEN coalesce(p, 1) = 1 AND o_totalprice > 200000 THEN 'PASS_WITH_WARNING' ELSE {list(assertions.STATUSES)}[greatest(coalesce(p, 1), 1)] END AS three, CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'P' THEN 'CONFLICT' ELSE 'NOT_TESTED' END AS cut FROM t JOIN orders ON o_orderkey = k)
SELECT k AS chain_id, three AS three_way_status, cut AS cutoff_status, CASE WHEN cut = 'CONFLICT' THEN 'CONFLICT' ELSE three END AS overall_status FROM u""")
def comparison_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = C.table(spark, sf_dir, "lineitem").withColumn("chain_id", F.col("l_orderkey"))
    names = F.array(*map(F.lit, [*assertions.ESSENTIAL, "currency"]))
    concepts = line.select("chain_id", F.get(names, (F.col("l_partkey") % 7).cast("int")).alias("concept"), F.when(F.col("l_discount") >= 0.09, "CONFLICT").when(F.col("l_tax") >= 0.07, "MISSING_EVIDENCE").otherwise("PASS").alias("result"))
    lines = line.select("chain_id", F.when(F.col("l_quantity") > 47, "FAIL").when(F.col("l_quantity") < 4, "REVIEW").otherwise("PASS").alias("quantity_result"), F.lit("NOT_TESTED").alias("amount_result"), F.lit("PASS").alias("unit_result"))
    orders = C.table(spark, sf_dir, "orders").withColumn("chain_id", F.col("o_orderkey"))
    cutoffs = orders.select("chain_id", F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "P", "FAIL").alias("status"))
    return assertions.comparison_status(concepts, lines, orders.where("o_totalprice > 200000").select("chain_id"), cutoffs)


# ---- fields out of running text

_NOTE = """CASE o_orderkey % 6 WHEN 0 THEN '价税合计：￥' || format('{:,.2f}', o_totalprice) || ' on ' || strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN 'Grand Total 0, grand total: ' || printf('%.2f', o_totalprice) || '; 2020/2/31, 1/31/2020' WHEN 2 THEN '不含税金额 ' || printf('%.2f', o_totalprice) || ' 税率13% ' || year(o_orderdate) || '年3月7日'
 WHEN 3 THEN 'amount: ' || printf('%.2f', o_totalprice) WHEN 4 THEN '总金额 -5 合计金额: 7' ELSE 'nothing said' END"""


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    plain, day = F.format_string("%.2f", p), F.to_date("o_orderdate")
    say = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    note = (
        F.when(k % 6 == 0, say("价税合计：￥", F.format_number(p, 2), " on ", F.date_format(day, "yyyy-MM-dd"))).when(k % 6 == 1, say("Grand Total 0, grand total: ", plain, "; 2020/2/31, 1/31/2020"))
        .when(k % 6 == 2, say("不含税金额 ", plain, " 税率13% ", F.year(day).cast("string"), "年3月7日")).when(k % 6 == 3, say("amount: ", plain)).when(k % 6 == 4, say("总金额 -5 合计金额: 7")).otherwise("nothing said")
    )
    return C.table(spark, sf_dir, "orders").select(k.alias("doc_id"), "o_custkey", "o_totalprice", note.alias("text"))


_PICKED = lambda labels: "list_filter(list_transform(flatten([" + ", ".join(f"regexp_extract_all(text, '(?i)\\Q{x}\\E\\s*[:：]?\\s*[¥￥$]?\\s*({amounts.AMOUNT_IN_TEXT})', 1)" for x in labels) + "]), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda x: x > 0)[1]"


@query(f"""WITH n AS (SELECT o_orderkey AS doc_id, {_NOTE} AS text, CASE WHEN o_custkey % 5 = 0 THEN o_totalprice END AS total, CASE WHEN o_custkey % 3 = 0 THEN 9.0 WHEN o_custkey % 3 = 1 THEN 0.0 END AS tax, CASE WHEN o_custkey % 2 = 0 THEN 0.13 END AS rate, CASE WHEN o_custkey % 7 > 0 THEN 2.0 END AS qty FROM orders),
p AS (SELECT *, {_PICKED(amounts.TOTAL_LABELS)} AS told, {_PICKED(amounts.NET_LABELS)} AS net FROM n)
SELECT doc_id, CASE WHEN total > 0 THEN total WHEN told IS NOT NULL THEN told WHEN net IS NOT NULL AND tax > 0 THEN net + tax WHEN net IS NOT NULL AND rate IS NOT NULL THEN net * (1 + rate) WHEN qty > 0 THEN qty * 5.0 END AS amount,
  CASE WHEN total > 0 THEN 'FIELD' WHEN told IS NOT NULL THEN 'LABEL' WHEN net IS NOT NULL AND tax > 0 THEN 'NET_AND_TAX' WHEN net IS NOT NULL AND rate IS NOT NULL THEN 'NET_AT_RATE' WHEN qty > 0 THEN 'QUANTITY_TIMES_PRICE' END AS basis FROM p""")
def stated_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    total = F.when(c % 5 == 0, F.col("o_totalprice"))
    made = amounts.total_with_basis(F.col("text"), total, F.lit(None).cast("double"), F.when(c % 3 == 0, 9.0).when(c % 3 == 1, 0.0), F.when(c % 2 == 0, 0.13), F.when(c % 7 > 0, 2.0), F.lit(5.0))
    return _notes(spark, sf_dir).select("doc_id", made.alias("t")).select("doc_id", "t.amount", "t.basis")


@query(f"""WITH n AS (SELECT o_orderkey AS doc_id, {_NOTE} AS text FROM orders), d AS (SELECT doc_id, regexp_extract_all(text, '{dates.DATE_IN_TEXT}') AS l FROM n),
p AS (SELECT doc_id, list_filter(list_transform(l, lambda x: CASE WHEN contains(x, '年') THEN TRY_CAST(replace(replace(replace(x, '年', '-'), '月', '-'), '日', '') AS DATE) WHEN regexp_matches(x, '^[0-9]{{4}}') THEN TRY_CAST(replace(x, '/', '-') AS DATE) ELSE CAST(try_strptime(replace(x, '/', '-'), '%m-%d-%Y') AS DATE) END), lambda x: x IS NOT NULL) AS l FROM d)
SELECT doc_id, array_to_string(list_transform(l, lambda x: strftime(x, '%Y-%m-%d')), ',') AS dates FROM p""")
def dates_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.transform(dates.all_dates(F.col("text")), lambda d: d.cast("string"))
    return _notes(spark, sf_dir).select("doc_id", F.array_join(found, ",").alias("dates"))


_FILE = """CASE o_orderkey % 5 WHEN 0 THEN 'SO25-' || (1000 + o_custkey % 9000) || '_0' || (1 + o_custkey % 7) || '_scan' WHEN 1 THEN 'HT25-' || (1000 + o_custkey % 9000) || '-' || (1 + o_custkey % 6) || '-x' WHEN 2 THEN 'scan_01_' || o_custkey WHEN 3 THEN 'INV25-' || (1000 + o_custkey) || ' 验收' ELSE o_orderpriority END"""
_SUFFIX_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(n), '{p}') THEN '{k}'" for k, p in clauses.SUFFIXES) + " ELSE 'other' END"


@query(f"""WITH f AS (SELECT o_orderkey, {_FILE} AS n, CASE WHEN o_totalprice > 300000 THEN 'memo' ELSE 'other' END AS k FROM orders)
SELECT o_orderkey AS doc_id, CASE WHEN k = 'other' AND regexp_matches(n, '(SO|HT|INV)[0-9]{{2,4}}[-_]?[0-9]{{3,6}}') THEN {_SUFFIX_SQL} ELSE k END AS doc_type FROM f""")
def light_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = C.table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_FILE).alias("n"), F.when(F.col("o_totalprice") > 300000, "memo").otherwise("other").alias("k"))
    return own.select(F.col("o_orderkey").alias("doc_id"), clauses.light_type(F.col("n"), F.col("k"), ids.ids_in_free_text(F.col("n"))).alias("doc_type"))


@query("""WITH old AS (SELECT event_id AS exception_id, 'f' || user_id AS file_name, event_type AS reason FROM events WHERE value > 20), new AS (SELECT event_id AS exception_id, 'f' || user_id AS file_name, 'again' AS reason FROM events WHERE value <= 40)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE exception_id NOT IN (SELECT exception_id FROM new) AND file_name NOT IN (SELECT 'f' || user_id FROM events WHERE event_type = 'purchase')""")
def scope_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.table(spark, sf_dir, "events")
    own = lambda rows, reason: rows.select(F.col("event_id").alias("exception_id"), F.concat(F.lit("f"), F.col("user_id")).alias("file_name"), reason.alias("reason"))
    accepted = e.where("event_type = 'purchase'").select(F.concat(F.lit("f"), F.col("user_id")).alias("file_name"))
    return entities.merge_exceptions(own(e.where("value > 20"), F.col("event_type")), own(e.where("value <= 40"), F.lit("again")), accepted)


@query("""SELECT vec_id, CASE WHEN label % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE label % 5 <> 1""")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector store with the rows of some labels put in anew and those of others taken out."""
    v = C.table(spark, sf_dir, "embeddings")
    put = files.upsert(v, v.where("label % 3 = 0").withColumn("label", (F.col("label") + 100).cast("int")), "vec_id")
    return files.delete(put, v.where("label % 5 = 1"), "vec_id").select("vec_id", "label")


@query("""WITH o AS (SELECT concat('book', CAST(o_custkey % 200 AS VARCHAR), '.xlsx') AS file, * FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY file) AS n FROM o)
SELECT file, 'orders' AS sheet, CAST(i + 1 AS INTEGER) AS "row", concat(CAST(o_orderkey AS VARCHAR), '|', o_orderstatus, '|', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '|', o_orderpriority) AS cells FROM n
UNION ALL SELECT DISTINCT file, 'orders', 1, 'o_orderkey|o_orderstatus|day|o_orderpriority' FROM o
UNION ALL SELECT file, 'paper', CAST(i + 21 AS INTEGER), concat('|', CAST(i AS VARCHAR), '|', CAST(o_orderkey AS VARCHAR), '|', CAST(o_custkey AS VARCHAR)) FROM n WHERE i <= 16 UNION ALL SELECT DISTINCT file, 'paper', 45, concat('|rows: ', CAST(least(n, 16) AS VARCHAR), ' of ', CAST(n AS VARCHAR)) FROM n""")
def workbook_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders in two hundred workbooks, each with a list and an official paper, written and read again."""
    orders = C.table(spark, sf_dir, "orders").withColumns({"book": F.concat(F.lit("book"), (F.col("o_custkey") % 200).cast("string"), F.lit(".xlsx")), "day": F.to_date("o_orderdate")})
    listed = B.sheet(orders.select("book", "o_orderkey", "o_orderstatus", "day", "o_orderpriority"), "book", "orders", 0, "o_orderkey")
    numbered = orders.select("book", F.row_number().over(W.partitionBy("book").orderBy("o_orderkey")).alias("sample_no"), F.col("o_orderkey").alias("voucher"), F.col("o_custkey").alias("customer"))
    path = f"{shared_dir(spark)}/ledgerloom/workbooks-{uuid.uuid4().hex}"
    B.write_workbooks(listed.unionByName(B.paper(numbered, "book", "paper", "sample_no")), path)
    back = B.read_workbooks(spark, path)
    return back.select(F.regexp_extract("file", "[^/]+$", 0).alias("file"), "sheet", "row", F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), "|").alias("cells"))
