"""Queries on fields, tables and dates that stand in running text.

The texts are documents written out from the order tables, by one expression that both engines know; the SQL reads them
by the rules, not by what they were made from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import dates as D
from ledgerloom.operators import boxes as B
from ledgerloom.operators import grids as G
from ledgerloom.operators import textfields as X
from ledgerloom.plans import canonical as C
from ledgerloom.plans.registry import query

_YMD = "concat(CAST(year({d}) AS STRING), '{a}', CAST(month({d}) AS STRING), '{b}', CAST(day({d}) AS STRING), '{c}')"
_CN, _SLASH, _DASH = _YMD.format(d="{d}", a="年", b="月", c="日"), _YMD.format(d="{d}", a="/", b="/", c=""), _YMD.format(d="{d}", a="-", b="-", c="")
_SUM = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"
_NOTE = f"""concat(CASE o_orderstatus WHEN 'F' THEN concat('采购订单号：PO-', CAST(o_orderkey AS STRING)) WHEN 'O' THEN concat('业务编号 SO_', CAST(o_orderkey AS STRING), '  合同号: HT', CAST(o_custkey AS STRING)) ELSE concat('Invoice No: INV-', CAST(o_orderkey AS STRING)) END, chr(10),
CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN concat('订单日期：', {_CN.format(d='o_orderdate')}) WHEN '2' THEN concat('Invoice Date ', {_SLASH.format(d='o_orderdate')}) WHEN '3' THEN concat('签收日期: ', {_DASH.format(d='o_orderdate')}) ELSE concat('入账日期 ', {_DASH.format(d='o_orderdate')}, ' 日期 不详') END, chr(10),
'供应商名称: 第', CAST(o_custkey AS STRING), '号 公司', chr(10), CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '4') THEN concat('价税合计 人民币：¥ ', {_SUM}) ELSE concat('Total  Amount $', {_SUM}, ' 税额: 12.5 税率：13%') END, chr(10), '折扣 5 % 实收数量 共：', CAST(o_custkey AS STRING), ' 件')"""


def _sql_pattern(field: str) -> str:
    kind, labels = next((k, v) for (f, k), v in X.LABELS.items() if f == field)
    return f"(?i)(?:{X.label_pattern([x for x in labels if x not in X.ALONE])}){X.KINDS[kind]}".replace("'", "''")


_DATE = "CAST(make_date(CAST(regexp_extract({c}, '([0-9]{{4}})', 1) AS INT), CAST(regexp_extract({c}, '[0-9]{{4}}.([0-9]{{1,2}})', 1) AS INT), CAST(regexp_extract({c}, '[0-9]{{4}}.[0-9]{{1,2}}.([0-9]{{1,2}})', 1) AS INT)) AS VARCHAR)"


def _sql_value(field: str) -> str:
    kind, found = next(k for (f, k) in X.LABELS if f == field), f"nullif(trim(regexp_extract(text, '{_sql_pattern(field)}', 1)), '')"
    if kind == "date":
        return f"CASE WHEN {found} IS NOT NULL THEN {_DATE.format(c=found)} END"
    return f"replace({found}, ',', '')" if kind in ("amount", "number") else f"replace({found}, ' ', '')" if kind == "discount" else found


_FIELDS = sorted({f for f, _ in X.LABELS})


@query(f"""WITH t AS (SELECT o_orderkey AS doc_id, {_NOTE} AS text FROM orders), v AS (SELECT doc_id, {', '.join(f'{_sql_value(f)} AS "{f}"' for f in _FIELDS)} FROM t),
d AS (SELECT * REPLACE (coalesce("documentNo", "orderNo") AS "documentNo", coalesce("documentDate", "deliveryDate") AS "documentDate"), "documentNo" AS "invoiceNo" FROM v)
SELECT doc_id, field, value FROM (UNPIVOT d ON COLUMNS(* EXCLUDE doc_id) INTO NAME field VALUE value)""")
def text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled fields of a note of each order."""
    notes = C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(_NOTE).alias("text"))
    return X.text_fields(notes).select("doc_id", F.explode("fields").alias("field", "value"))


# an order's lines as a table: cells in two layouts, with a column that only looks like the quantity
_CELLS = "concat('| ', CAST(l_linenumber AS STRING), ' | ', CASE WHEN l_orderkey % 2 = 0 THEN concat(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING), ' | ', CAST(CAST(l_quantity AS INT) AS STRING), ' 件') ELSE concat('0 | ', CAST(CAST(l_quantity AS INT) AS STRING), ' | ', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)) END, ' | ', CAST(CAST(round(l_discount * 100) AS INT) AS STRING), '% | ', CAST(CAST(round(l_tax * 100) AS INT) AS STRING), '% |')"
_TOP = "concat('# 订单 ', CAST(k AS STRING), chr(10), CASE WHEN k % 2 = 0 THEN '| 行 | 基础不含税单价 | 数量 | 商业折扣 | 税率 |' ELSE '| 行 | 差异数量 | 实收数量 | 基础不含税单价 | 商业折扣 | 税率 |' END, chr(10), '| --- | --- | --- | --- | --- |', chr(10))"


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = C.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.expr(_CELLS).alias("s"))
    own = lines.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list("s")), "\n").alias("body"))  # an order's few lines
    return own.select(F.col("k").alias("doc_id"), F.expr(f"concat({_TOP}, body)").alias("text"))


_GRID = f"""t AS (SELECT k AS doc_id, concat({_TOP}, body) AS text FROM (SELECT l_orderkey AS k, string_agg({_CELLS}, chr(10) ORDER BY {_CELLS}) AS body FROM lineitem GROUP BY 1)),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t), c AS (SELECT doc_id, i, list_transform(string_split(trim(s, '|'), '|'), lambda x: trim(x)) AS c FROM l WHERE starts_with(s, '|') AND NOT contains(s, '---')),
h AS (SELECT doc_id, i AS hi, c AS h FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1), r AS (SELECT doc_id, i, h, c FROM c JOIN h USING (doc_id) WHERE i > hi AND i <= hi + {{most}})"""
_AT = "c[list_position(list_transform(h, lambda x: contains(x, '{}')), true)]"
_NUMBER = "CAST(regexp_replace({}, '[^0-9.]', '', 'g') AS DOUBLE)"


@query(f"""WITH {_GRID.format(most=G.PRICE_ROWS)}, v AS (SELECT doc_id, i, {_NUMBER.format(_AT.format('数量'))} AS quantity, {_NUMBER.format(_AT.format('基础不含税单价'))} AS unit_price_excl_tax,
round({_NUMBER.format(_AT.format('商业折扣'))} / 100, 6) AS discount_rate, round({_NUMBER.format(_AT.format('税率'))} / 100, 6) AS vat_rate FROM r)
SELECT doc_id, quantity, unit_price_excl_tax, discount_rate, vat_rate FROM v WHERE quantity > 0 AND unit_price_excl_tax > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1""")
def price_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first priced row of each order's table. In one layout the first column named like a quantity holds zeros, so no
    row of it counts; the rules say so, and the SQL reads the same."""
    return G.price_tables(G.rows(_tables(spark, sf_dir)))


@query(f"""WITH {_GRID.format(most=G.DELIVERY_ROWS)}, v AS (SELECT doc_id, i, CAST(regexp_extract(c[coalesce(list_position(h, '实收数量'), list_position(h, '数量'))], '^[0-9]+', 0) AS DOUBLE) AS quantity FROM r)
SELECT doc_id, quantity FROM v WHERE quantity > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1""")
def delivery_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivered quantity in each order's table, not the column of differences."""
    return G.delivery_quantities(_tables(spark, sf_dir))


_SHIP = _CN.format(d="l_shipdate")
_LETTER = f"""CASE l_linenumber WHEN 1 THEN concat('货物于 ', {_SHIP}, ' 验收合格') WHEN 2 THEN concat('到货日：', {_SHIP}, '，验收期 7 日') WHEN 3 THEN concat('签收日期: ', {_SHIP}) WHEN 4 THEN concat('{{}}到货记录 2024-01-05 与 2023-12-31，', {_SHIP}) WHEN 5 THEN concat('入库 ', {_SHIP}) ELSE concat('发票 ', {_SHIP}) END""".replace("{}", "")
_T = D._TOKEN
_FOUND = "(SELECT CASE WHEN s <> '' THEN make_date(CAST(regexp_extract(s, '([0-9]+)', 1) AS INT), CAST(regexp_extract(s, '[0-9]+[^0-9]+([0-9]+)', 1) AS INT), CAST(regexp_extract(s, '[0-9]+[^0-9]+[0-9]+[^0-9]+([0-9]+)', 1) AS INT)) END FROM (SELECT {e} AS s))"


def _first_sql(patterns: tuple[str, ...]) -> str:
    return f"coalesce({', '.join(_FOUND.format(e=f"regexp_extract(text, '{p}', 1)") for p in patterns)})"


@query(f"""WITH t AS (SELECT DISTINCT l_orderkey, l_linenumber, {_LETTER} AS text FROM lineitem), x AS (SELECT *, {_first_sql(D.ACCEPTED)} AS acc, {_first_sql(D.ARRIVED)} AS arr, {_first_sql(D.RECEIVED)} AS rec,
coalesce({', '.join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in (*D.INSPECTION, '([0-9]+)[ ]*(?:天|日|days?)'))}) AS n, list_transform(regexp_extract_all(text, '{D.DATE_IN_TEXT}'), lambda s: {_FOUND.format(e='s').replace('(SELECT CASE', 'CASE').replace(' FROM (SELECT s AS s))', '')}) AS ds FROM t),
y AS (SELECT *, arr + CAST(n AS INT) AS calc, regexp_matches(text, '验收|签收|入库|到货') AS told, len(ds) >= 2 AND regexp_matches(text, '验收|期限届满|到货') AS several FROM x),
z AS (SELECT *, CASE WHEN acc IS NOT NULL THEN 'acceptance_completion' WHEN calc IS NOT NULL THEN 'arrival_plus_inspection_period' WHEN rec IS NOT NULL THEN 'receipt_labeled' WHEN told AND several THEN 'latest_of_multiple_dates' WHEN told AND len(ds) > 0 THEN 'first_date_fallback' END AS source FROM y)
SELECT l_orderkey, l_linenumber, text, CAST(coalesce(arr, CASE source WHEN 'receipt_labeled' THEN rec WHEN 'latest_of_multiple_dates' THEN list_min(ds) END) AS DATE) AS delivery_date, CAST(CASE source WHEN 'acceptance_completion' THEN acc WHEN 'arrival_plus_inspection_period' THEN calc WHEN 'latest_of_multiple_dates' THEN list_max(ds) END AS DATE) AS acceptance_date,
CAST(CASE source WHEN 'acceptance_completion' THEN acc WHEN 'arrival_plus_inspection_period' THEN calc WHEN 'receipt_labeled' THEN rec WHEN 'latest_of_multiple_dates' THEN list_max(ds) WHEN 'first_date_fallback' THEN ds[1] END AS DATE) AS receipt_date, source FROM z""")
def receipt_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates that a letter on each line tells of."""
    letters = C.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_LETTER).alias("text")).distinct()
    return letters.withColumn("d", D.receipt_dates(F.col("text"))).select("l_orderkey", "l_linenumber", "text", "d.*")


_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
# a page for each order: its number whole, in two boxes or with more words in one; its sum in two boxes
_PAGE = f"""CASE o_orderstatus WHEN 'F' THEN array(named_struct('t', '订单号：', 'x', 0, 'y', 0), named_struct('t', 'PO-', 'x', 45, 'y', 1), named_struct('t', CAST(o_orderkey AS STRING), 'x', 70, 'y', 0)) WHEN 'O' THEN array(named_struct('t', concat('订单号：PO-', CAST(o_orderkey AS STRING), ' 客户'), 'x', 0, 'y', 0))
ELSE array(named_struct('t', '客户', 'x', 0, 'y', 0), named_struct('t', concat('ＰＯ－', CAST(o_orderkey AS STRING)), 'x', 50, 'y', 20)) END"""
_TEXTS = f"SELECT o_orderkey AS doc_id, unnest(list_concat({_PAGE.replace('array(', 'list_value(').replace('named_struct(', 'struct_pack(').replace(chr(39) + 't' + chr(39) + ', ', 't := ').replace(chr(39) + 'x' + chr(39) + ', ', 'x := ').replace(chr(39) + 'y' + chr(39) + ', ', 'y := ')}, list_value(struct_pack(t := concat('合计 ¥', split_part({_SUM}, '.', 1)), x := 0, y := 60), struct_pack(t := concat('.', split_part({_SUM}, '.', 2)), x := 100, y := 61)))) AS b FROM orders"


@query(f"""WITH b AS (SELECT doc_id, b.t AS raw, CAST(b.x AS DOUBLE) AS x0, CAST(b.y AS DOUBLE) AS y0, b.x + 20.0 AS x1, b.y + 10.0 AS y1 FROM ({_TEXTS})),
p AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY floor(y0 / 5)) AS line, regexp_replace(lower(translate(raw, '{_WIDE}', '{_NARROW}')), '[\\s,，¥￥$]+', '', 'g') AS t FROM b),
q AS (SELECT *, row_number() OVER w AS place, coalesce(sum(length(t)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY line, x0)),
d AS (SELECT doc_id, string_agg(t, '' ORDER BY place) AS all_ FROM q GROUP BY 1), v AS (SELECT o_orderkey AS doc_id, 'orderNo' AS field, concat('po-', CAST(o_orderkey AS VARCHAR)) AS v FROM orders UNION ALL SELECT o_orderkey, 'totalAmount', {_SUM} FROM orders),
f AS (SELECT doc_id, field, v, instr(all_, v) - 1 AS s FROM v JOIN d USING (doc_id) WHERE contains(all_, v)), r AS (SELECT f.*, q.* EXCLUDE doc_id, x0 + (x1 - x0) * greatest(s - at_, 0) / length(t) AS l, x1 - (x1 - x0) * greatest(at_ + length(t) - s - length(v), 0) / length(t) AS r FROM f JOIN q ON q.doc_id = f.doc_id AND at_ < s + length(v) AND at_ + length(t) > s)
SELECT doc_id, field, 0 AS page, min_by(line, place) AS line, CAST(min(place) AS INTEGER) AS "first", CAST(max(place) AS INTEGER) AS "last", min(at_) = min(s) AND max(at_ + length(t)) = min(s + length(v)) AS exact, round(min(l), 6) AS x0, min(y0) AS y0, round(max(r), 6) AS x1, CAST(max(y1) AS DOUBLE) AS y1 FROM r GROUP BY 1, 2""")
def box_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each order's number and sum stand on its page."""
    orders = C.table(spark, sf_dir, "orders")
    total = f"array(named_struct('t', concat('合计 ¥', split_part({_SUM}, '.', 1)), 'x', 0, 'y', 60), named_struct('t', concat('.', split_part({_SUM}, '.', 2)), 'x', 100, 'y', 61))"
    b = orders.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.expr(f"concat({_PAGE}, {total})")).alias("b"))
    made = b.select("doc_id", F.lit(0).alias("page"), F.col("b.t").alias("text"), F.col("b.x").cast("double").alias("x0"), F.col("b.y").cast("double").alias("y0"), (F.col("b.x") + 20.0).alias("x1"), (F.col("b.y") + 10.0).alias("y1"))
    key, no, total_of = F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("PO-"), F.col("o_orderkey").cast("string")), F.expr(_SUM)
    values = orders.select(key, F.explode(F.array(F.struct(F.lit("orderNo").alias("field"), no.alias("value")), F.struct(F.lit("totalAmount").alias("field"), total_of.alias("value")))).alias("e")).select("doc_id", "e.*")
    got = B.value_boxes(values, made)
    return got.withColumns({"x0": F.round("x0", 6), "x1": F.round("x1", 6)})


_RECT = "SELECT l_suppkey AS doc_id, 0 AS page, l_orderkey * 10 + l_linenumber AS box, CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(dayofyear(l_shipdate) AS DOUBLE) AS y0, l_partkey % 500 + l_quantity AS x1, dayofyear(l_shipdate) + 5.0 * l_linenumber AS y1 FROM lineitem"


@query(f"""WITH r AS ({_RECT}), p AS (SELECT a.doc_id, a.page, a.box AS "left", b.box AS "right", (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS s, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS u
FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1) SELECT doc_id, page, "left", "right", round(s / (u - s), 9) AS iou FROM p WHERE s / (u - s) >= 0.3""")
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each supplier as rectangles, and which of them overlap by three tenths."""
    rect = C.table(spark, sf_dir, "lineitem").selectExpr(*_RECT.removeprefix("SELECT ").removesuffix(" FROM lineitem").split(", "))
    return B.overlaps(rect, rect, 0.3, cell=32.0).withColumn("iou", F.round("iou", 9))
