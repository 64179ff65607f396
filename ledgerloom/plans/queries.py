"""Queries over the order tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import out
from ledgerloom.operators import allocation, amounts, cutoff, ledger, matching
from ledgerloom.plans import canonical as C
from ledgerloom.plans.registry import query

_LINES = """
lines AS (
  SELECT l_orderkey AS business_id, l_orderkey || '-' || l_linenumber AS order_line_id, l_linenumber AS line_no, l_partkey AS item_code, l_suppkey AS source_file,
         CAST(l_shipdate AS DATE) AS ship_date, CAST(l_quantity AS DECIMAL(18,4)) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
         CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * 10000 / l_quantity) / 10000 AS DECIMAL(18,4)) AS price, CAST(l_discount AS DECIMAL(9,6)) AS discount, CAST(l_tax AS DECIMAL(9,6)) AS tax
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) AS rn FROM lineitem) WHERE rn = 1)"""

_RECALC = (
    _LINES
    + """,
net AS (SELECT *, CAST(round(CAST(qty * price AS DECIMAL(28,6)), 2) AS DECIMAL(18,2)) AS gross_list, CAST(round(CAST(CAST(qty * price AS DECIMAL(28,6)) AS DECIMAL(22,6)) * CAST(1 - discount AS DECIMAL(9,6)), 2) AS DECIMAL(18,2)) AS net FROM lines),
recalc AS (SELECT *, CAST(round(net * tax, 2) AS DECIMAL(18,2)) AS vat, CASE WHEN tax > 0 THEN 'DOMESTIC' ELSE 'EXPORT' END AS basis FROM net)"""
)

_BOOKED = (
    _RECALC
    + """,
b0 AS (SELECT *, net + vat AS total, CAST(CASE WHEN business_id % 5 = 2 THEN round(net * CAST(1.03 AS DECIMAL(3,2)), 2) ELSE net END AS DECIMAL(18,2)) AS bn, CAST(CASE WHEN business_id % 5 = 3 THEN vat + 1 ELSE vat END AS DECIMAL(18,2)) AS bv FROM recalc),
b1 AS (SELECT *, CAST(bn + bv + CASE WHEN business_id % 5 = 1 THEN CAST(0.02 AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS bt FROM b0),
booked AS (SELECT business_id, order_line_id, qty, price, discount, tax, gross_list, net, vat, total, basis, CASE WHEN business_id % 5 <> 4 THEN bn END AS book_net, CASE WHEN business_id % 5 <> 4 THEN bv END AS book_vat, CASE WHEN business_id % 5 <> 4 THEN bt END AS book_total FROM b1),
layers AS (SELECT *, book_total - total AS total_diff, book_net - net AS net_diff, book_vat - vat AS vat_diff FROM booked)"""
)

DATES_SQL = """
control AS (SELECT l_orderkey AS business_id, max(CAST(l_shipdate AS DATE)) AS control_date FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
dates AS (SELECT o_orderkey AS business_id, CAST(o_orderdate AS DATE) AS posting_date, control_date FROM orders LEFT JOIN control ON business_id = o_orderkey)"""


@query("WITH" + _RECALC + " SELECT order_line_id, CAST(gross_list AS DOUBLE) AS gross_list, CAST(net AS DOUBLE) AS net, CAST(vat AS DOUBLE) AS vat, CAST(net + vat AS DOUBLE) AS total, basis FROM recalc")
def amount_recalc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = amounts.recompute(C.order_lines(spark, sf_dir))
    return df.select("order_line_id", *(out(F.col(c)).alias(c) for c in ("gross_list", "net", "vat", "total")), "basis")


@query("WITH" + _BOOKED + """ SELECT order_line_id, CAST(total_diff AS DOUBLE) AS total_diff, CAST(net_diff AS DOUBLE) AS net_diff, CAST(vat_diff AS DOUBLE) AS vat_diff,
  abs(total_diff) <= 0.02 AS total_ok, abs(net_diff) <= 0.02 AS net_ok, abs(vat_diff) <= 0.02 AS vat_ok FROM layers""")
def amount_layer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = amounts.layers(C.booked_lines(spark, sf_dir))
    return df.select("order_line_id", *(out(F.col(f"{c}_diff")).alias(f"{c}_diff") for c in ("total", "net", "vat")), "total_ok", "net_ok", "vat_ok")


_DIAGNOSED = _BOOKED + """,
w AS (SELECT *, CAST(qty AS DOUBLE) AS q, CAST(price AS DOUBLE) AS p, CAST(discount AS DOUBLE) AS d, CAST(coalesce(book_net, book_total - vat) AS DOUBLE) AS bn FROM layers),
x AS (SELECT *, abs(bn / q / greatest(1 - d, 1e-9) - p) / greatest(abs(p), 1e-9) AS gap, 1 - bn / (q * p) AS off FROM w),
y AS (SELECT *, CASE WHEN q IS NULL OR p IS NULL OR q = 0 OR p = 0 OR bn IS NULL THEN 'AMOUNT_ENTRY_ERROR'
    WHEN d > 1e-12 AND off > -0.001 AND off < 0.5 AND abs(off - d) >= 0.002 AND abs(off - d) <= 0.05 AND gap <= 0.0001 THEN 'COMMERCIAL_DISCOUNT_ERROR'
    WHEN gap > 1e-9 THEN 'UNIT_PRICE_ENTRY_ERROR' ELSE 'COMMERCIAL_DISCOUNT_ERROR' END AS which FROM x),
diagnosed AS (SELECT *, CASE WHEN total_diff IS NULL THEN 'WARNING' WHEN abs(total_diff) <= 0.02 THEN 'PASS' ELSE 'FAIL' END AS test_status,
  CASE WHEN total_diff IS NULL OR abs(total_diff) <= 0.02 THEN 'NONE' WHEN abs(net_diff) <= 0.02 AND abs(vat_diff) > 0.02 THEN 'OUTPUT_VAT_ENTRY_ERROR'
    WHEN abs(net_diff) > 0.02 AND abs(vat_diff) > 0.02 THEN which WHEN abs(net_diff) > 0.02 AND vat = 0 THEN which WHEN abs(net_diff) > 0.02 THEN 'AMOUNT_ENTRY_ERROR' ELSE 'LEDGER_BASIS_MISMATCH' END AS issue_type,
  CASE WHEN total_diff IS NULL OR abs(total_diff) <= 0.02 THEN 'NONE' WHEN total_diff > 0 THEN 'BOOK_OVERSTATED' ELSE 'BOOK_UNDERSTATED' END AS direction FROM y)"""


def _diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amounts.diagnose(amounts.layers(C.booked_lines(spark, sf_dir)))


@query("WITH" + _DIAGNOSED + " SELECT order_line_id, test_status, issue_type, direction FROM diagnosed")
def amount_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diagnosed(spark, sf_dir).select("order_line_id", "test_status", "issue_type", "direction")


@query("WITH" + _DIAGNOSED + """ SELECT issue_type, count(*) AS n, count(*) FILTER (WHERE test_status = 'PASS') AS n_pass, count(*) FILTER (WHERE test_status = 'FAIL') AS n_fail,
  count(*) FILTER (WHERE test_status = 'WARNING') AS n_warning, CAST(sum(abs(total_diff)) AS DOUBLE) AS total_abs_diff FROM diagnosed GROUP BY issue_type""")
def batch_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("test_status") == s)
    return _diagnosed(spark, sf_dir).groupBy("issue_type").agg(F.count("*").alias("n"), n("PASS").alias("n_pass"), n("FAIL").alias("n_fail"), n("WARNING").alias("n_warning"), out(F.sum(F.abs("total_diff"))).alias("total_abs_diff"))


@query("WITH" + _BOOKED + """, e AS (SELECT *, CAST(round(CAST(book_total AS DOUBLE) / (1 + CAST(tax AS DOUBLE)), 2) AS DECIMAL(18,2)) AS even_net FROM layers)
SELECT order_line_id, CAST(even_net AS DOUBLE) AS even_net, CAST(book_total - even_net AS DOUBLE) AS even_vat, CAST(book_total - net AS DOUBLE) AS locked_vat,
  CASE WHEN abs(book_total - total) <= 0.02 THEN 'NONE' WHEN abs(even_net - net) + abs(book_total - even_net - vat) <= abs(book_total - net - vat) THEN 'PROPORTIONAL' ELSE 'VAT_ONLY' END AS hypothesis
FROM e WHERE book_total IS NOT NULL""")
def amount_two_hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = amounts.two_hypotheses(C.booked_lines(spark, sf_dir).where("book_total IS NOT NULL"))
    return df.select("order_line_id", *(out(F.col(c)).alias(c) for c in ("even_net", "even_vat", "locked_vat")), "hypothesis")


@query("WITH" + _BOOKED + """ SELECT order_line_id, CASE WHEN book_total IS NULL AND book_net IS NOT NULL THEN 'MISSING_TOTAL' WHEN abs(book_net + book_vat - book_total) > 0.01 THEN 'RECONCILIATION_FAILED' END AS reason
FROM booked WHERE abs(book_net + book_vat - book_total) > 0.01 OR (book_total IS NULL AND book_net IS NOT NULL)""")
def ambiguous_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amounts.ambiguous(C.booked_lines(spark, sf_dir), "book_net", "book_vat", "book_total").where("reason IS NOT NULL").select("order_line_id", "reason")


def _cutoff_sql(key: str, crossed: str = "false", more: str = "") -> str:
    return (
        "WITH" + DATES_SQL + f""", k AS (SELECT *, {key.format(d='control_date')} AS control_period, {key.format(d='posting_date')} AS posting_period, {crossed} AS crossed FROM dates),
c AS (SELECT *, CAST(datediff('day', control_date, posting_date) AS BIGINT) AS deviation_days,
  CASE WHEN control_date IS NULL OR posting_date IS NULL THEN 'WARNING' WHEN crossed OR control_period <> posting_period THEN 'FAIL' ELSE 'PASS' END AS cutoff_status,
  CASE WHEN control_date IS NULL OR posting_date IS NULL THEN 'MISSING_DATE' WHEN crossed THEN 'PERIOD_END_CROSSED' WHEN control_period = posting_period THEN 'SAME_PERIOD' WHEN posting_date < control_date THEN 'EARLY' ELSE 'LATE' END AS cutoff_reason FROM k)
"""
        + (more or "SELECT business_id, deviation_days, control_period, posting_period, cutoff_status, cutoff_reason FROM c")
    )


_CUT = ("business_id", "deviation_days", "control_period", "posting_period", "cutoff_status", "cutoff_reason")
_END = "DATE '1998-12-31'"
_WEEK = "CAST(floor(datediff('day', make_date(year({d}), 1, 1), {d}) / 7.0) AS INT)"
_P445 = "'FY' || year({d}) || '-P' || lpad(CAST(CASE WHEN " + _WEEK + " >= 52 THEN 12 ELSE (" + _WEEK + " // 13) * 3 + CASE WHEN " + _WEEK + " % 13 < 4 THEN 1 WHEN " + _WEEK + " % 13 < 8 THEN 2 ELSE 3 END END AS VARCHAR), 2, '0')"


def period_end() -> Column:
    """The reporting date of the queries."""
    return F.expr(_END)


@query(_cutoff_sql("strftime({d}, '%Y-%m')"))
def cutoff_natural_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.check_cutoff(C.ledger_dates(spark, sf_dir)).select(*_CUT)


@query(_cutoff_sql(_P445))
def cutoff_445(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.check_cutoff(C.ledger_dates(spark, sf_dir), calendar="445").select(*_CUT)


@query(_cutoff_sql("strftime({d}, '%Y-%m')", f"(control_date <= {_END}) <> (posting_date <= {_END})"))
def cutoff_period_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.check_cutoff(C.ledger_dates(spark, sf_dir), period_end=F.expr(_END)).select(*_CUT)


@query(_cutoff_sql("strftime({d}, '%Y-%m')", f"(control_date <= {_END}) <> (posting_date <= {_END})", """, r AS (SELECT *, CASE WHEN deviation_days IS NULL THEN 'unknown' WHEN deviation_days = 0 THEN 'd0' WHEN abs(deviation_days) <= 7 THEN 'd1_7' WHEN abs(deviation_days) <= 30 THEN 'd8_30' ELSE 'd31_plus' END AS interval,
  CASE WHEN cutoff_status = 'FAIL' AND deviation_days < 0 THEN 'early' WHEN cutoff_status = 'FAIL' AND deviation_days > 0 THEN 'late' WHEN cutoff_reason = 'PERIOD_END_CROSSED' THEN 'period_end_cross' ELSE 'in_period' END AS direction FROM c)
SELECT business_id, direction, interval, CASE WHEN direction = 'in_period' AND cutoff_status IN ('PASS', 'WARNING') THEN 'low' WHEN cutoff_reason = 'PERIOD_END_CROSSED' THEN 'high' WHEN direction = 'early' THEN CASE WHEN interval = 'd31_plus' THEN 'high' ELSE 'medium' END
  WHEN direction = 'late' THEN CASE WHEN interval IN ('d8_30', 'd31_plus') THEN 'high' ELSE 'medium' END ELSE 'medium' END AS risk_level FROM r"""))
def cutoff_risk_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.route_risk(cutoff.check_cutoff(C.ledger_dates(spark, sf_dir), period_end=F.expr(_END))).select("business_id", "direction", "interval", "risk_level")


@query("WITH" + DATES_SQL + f""" SELECT business_id, CASE WHEN control_date IS NULL THEN 'WARNING' WHEN (control_date <= {_END}) = (posting_date <= {_END}) THEN 'PASS' ELSE 'FAIL' END AS assertion_status,
  CASE WHEN control_date IS NULL THEN NULL ELSE (control_date <= {_END}) = (posting_date <= {_END}) END AS in_period FROM dates""")
def period_assertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.period_assertion(C.ledger_dates(spark, sf_dir), F.expr(_END)).select("business_id", "assertion_status", "in_period")


@query("""WITH s AS (SELECT l_orderkey AS business_id, min(CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END) AS receipt_date, max(CASE WHEN l_returnflag <> 'R' THEN CAST(l_shipdate AS DATE) END) AS invoice_date FROM lineitem GROUP BY 1)
SELECT o_orderkey AS business_id, CASE WHEN receipt_date < CAST(o_orderdate AS DATE) OR invoice_date < receipt_date THEN 'FAIL' WHEN receipt_date IS NULL OR invoice_date IS NULL THEN 'REVIEW' ELSE 'PASS' END AS chronology
FROM orders LEFT JOIN s ON business_id = o_orderkey""")
def date_chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship = F.to_date("l_shipdate")
    s = C.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("business_id")).agg(F.min(F.when(F.col("l_linestatus") == "F", ship)).alias("receipt_date"), F.max(F.when(F.col("l_returnflag") != "R", ship)).alias("invoice_date"))
    o = C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("business_id"), F.to_date("o_orderdate").alias("order_date"))
    return cutoff.chronology(o.join(s, "business_id", "left"), ["order_date", "receipt_date", "invoice_date"]).select("business_id", "chronology")


_SPREAD = "CASE WHEN greatest({a}) > 0 THEN (greatest({v}) - least({v})) / greatest({a}) ELSE 0 END"


def _verdict_sql(values: str, tolerance: float) -> str:
    spread = _SPREAD.format(v=values, a=", ".join(f"abs({x.strip()})" for x in values.split(",")))
    return f"CASE WHEN greatest({values}) - least({values}) <= 1e-9 THEN 'EQUAL' WHEN {spread} <= {tolerance} THEN 'SOFT' ELSE 'HARD' END"


THREE_WAY_SQL = "WITH" + _LINES + f""",
o AS (SELECT business_id, CAST(sum(qty) AS DOUBLE) AS oq, CAST(sum(amount) AS DOUBLE) AS oa FROM lines GROUP BY 1),
s AS (SELECT l_orderkey AS business_id, CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS DECIMAL(18,4)) END) AS DOUBLE) AS rq, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS DECIMAL(18,4)) END) AS DOUBLE) AS iq,
  CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS ra, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS ia FROM lineitem GROUP BY 1),
j AS (SELECT o.*, rq, iq, ra, ia, coalesce(oa, 0) AS a1, coalesce(ra, 0) AS a2, coalesce(ia, 0) AS a3, CASE WHEN oq > 0 THEN oq END AS q1, CASE WHEN rq > 0 THEN rq END AS q2, CASE WHEN iq > 0 THEN iq END AS q3 FROM o JOIN s USING (business_id)),
v AS (SELECT *, CASE WHEN a2 > 0 THEN {_verdict_sql('a1, a2, a3', 0.02)} WHEN a1 <= 0 OR a3 <= 0 THEN 'HARD' ELSE {_verdict_sql('a1, a3', 0.02)} END AS amount_verdict,
  CASE WHEN (q1 IS NOT NULL)::INT + (q2 IS NOT NULL)::INT + (q3 IS NOT NULL)::INT < 2 THEN 'NOT_TESTED' ELSE {_verdict_sql('q1, q2, q3', 0.01)} END AS quantity_verdict,
  rq IS NOT NULL AND iq IS NOT NULL AS party_ok FROM j),
w AS (SELECT *, NOT party_ok OR amount_verdict = 'HARD' OR quantity_verdict = 'HARD' AS hard, amount_verdict = 'SOFT' OR quantity_verdict = 'SOFT' AS soft FROM v),
m AS (SELECT business_id, oq AS order_qty, rq AS receipt_qty, iq AS invoice_qty, oa AS order_amount, ra AS receipt_amount, ia AS invoice_amount, amount_verdict, quantity_verdict, party_ok,
  CASE WHEN hard THEN 'FAIL' WHEN soft THEN 'WARNING' ELSE 'PASS' END AS status, CASE WHEN hard THEN 'HOLD_REVIEW' WHEN soft THEN 'PASS_WITH_WARNING' ELSE 'AUTO_PASS' END AS decision FROM w)
"""


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    party = F.concat(F.lit("Party "), F.col("business_id"), F.lit(" Co., Ltd."))
    cols = ["business_id", "role", "qty", "amount", "party"]
    docs = C.order_lines(spark, sf_dir).withColumn("role", F.lit("order")).withColumn("party", party).select(*cols)
    docs = docs.unionByName(C.source_lines(spark, sf_dir).withColumn("party", F.concat(F.lit("PARTY-"), F.col("business_id"))).select(*cols))
    return matching.three_way(docs).drop("order_party", "receipt_party", "invoice_party")


@query(THREE_WAY_SQL + "SELECT * FROM m")
def three_way_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir)


@query(THREE_WAY_SQL + "SELECT status, decision, count(*) AS n, count(*) FILTER (WHERE amount_verdict = 'HARD') AS n_amount_hard, count(*) FILTER (WHERE quantity_verdict = 'NOT_TESTED') AS n_untested FROM m GROUP BY 1, 2")
def desk_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir).groupBy("status", "decision").agg(F.count("*").alias("n"), F.count_if(F.col("amount_verdict") == "HARD").alias("n_amount_hard"), F.count_if(F.col("quantity_verdict") == "NOT_TESTED").alias("n_untested"))


_ALLOC = "WITH" + _LINES + """,
src AS (SELECT *, 'receipt' AS role FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT *, 'invoice' AS role FROM lineitem WHERE l_returnflag <> 'R'),
mark AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey, l_linenumber, role ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) > 1 AS dup FROM src),
grp AS (SELECT l_orderkey AS business_id, bool_or(dup) AS any_dup FROM mark GROUP BY 1),
sums AS (SELECT l_orderkey AS business_id, l_linenumber AS line_no, coalesce(sum(CAST(l_quantity AS DECIMAL(18,4))) FILTER (WHERE role = 'receipt'), 0) AS r, coalesce(sum(CAST(l_quantity AS DECIMAL(18,4))) FILTER (WHERE role = 'invoice'), 0) AS i,
  coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE role = 'receipt'), 0) AS ra, coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE role = 'invoice'), 0) AS ia,
  bool_or(role = 'receipt') AS rs, bool_or(role = 'invoice') AS inv FROM mark WHERE NOT dup GROUP BY 1, 2),
a0 AS (SELECT l.business_id, order_line_id, qty AS q, amount AS a, coalesce(r, 0) AS r, coalesce(i, 0) AS i, coalesce(ra, 0) AS ra, coalesce(ia, 0) AS ia, coalesce(rs, false) AS rs, coalesce(inv, false) AS inv, coalesce(any_dup, false) AS d
  FROM lines l LEFT JOIN sums USING (business_id, line_no) LEFT JOIN grp USING (business_id)),
a1 AS (SELECT *, list_filter([CASE WHEN r > q THEN 'OVER_RECEIPT' END, CASE WHEN q > 0 AND r < q THEN 'PARTIAL_FULFILLMENT' END, CASE WHEN i > r THEN 'OVER_INVOICE_QTY' END, CASE WHEN r > 0 AND i < r THEN 'PARTIAL_INVOICE' END,
  CASE WHEN rs AND ra > a THEN 'OVER_RECEIPT_AMT' END, CASE WHEN rs AND ra > 0 AND ra < a THEN 'PARTIAL_RECEIPT_AMT' END, CASE WHEN inv AND ia > a THEN 'OVER_INVOICE_AMT' END, CASE WHEN inv AND ia > 0 AND ia < a THEN 'PARTIAL_INVOICE_AMT' END, CASE WHEN d THEN 'DUPLICATE_SOURCE_LINE' END], lambda x: x IS NOT NULL) AS f FROM a0),
alloc AS (SELECT *, CASE WHEN list_has_any(f, ['OVER_RECEIPT', 'OVER_INVOICE_QTY', 'OVER_RECEIPT_AMT', 'OVER_INVOICE_AMT', 'DUPLICATE_SOURCE_LINE']) THEN 'RED' WHEN len(f) > 0 THEN 'YELLOW' WHEN q = r AND r = i THEN 'GREEN' ELSE 'YELLOW' END AS light FROM a1)
"""


def allocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = C.order_lines(spark, sf_dir)
    # these lines carry the order and its line number, so the first key of the cascade binds each of them
    src = C.source_lines(spark, sf_dir).withColumn("order_line_id", F.concat_ws("-", "order_ref", "line_no")).withColumn("bind_status", F.lit("UNIQUE"))
    marked = allocation.mark_duplicate_lines(src, ["business_id", "source_file", "line_no", "role"], list(C.FIRST_LINE))
    return allocation.allocate(orders, marked)


@query(_ALLOC + "SELECT order_line_id, CAST(q AS DOUBLE) AS ordered_qty, CAST(r AS DOUBLE) AS received_qty, CAST(i AS DOUBLE) AS invoiced_qty, CAST(ra AS DOUBLE) AS received_amount, CAST(ia AS DOUBLE) AS invoiced_amount, array_to_string(f, ',') AS flags, light FROM alloc")
def one_to_many_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = allocated(spark, sf_dir)
    return df.select("order_line_id", *(out(F.col(c)).alias(c) for c in ("ordered_qty", "received_qty", "invoiced_qty", "received_amount", "invoiced_amount")), F.array_join("flags", ",").alias("flags"), "light")


@query(_ALLOC + """SELECT business_id, count(*) AS n_lines, CAST(sum(q) AS DOUBLE) AS ordered_qty, CAST(sum(r) AS DOUBLE) AS received_qty, CAST(sum(i) AS DOUBLE) AS invoiced_qty, CAST(sum(a) AS DOUBLE) AS order_amount,
  CASE max(CASE light WHEN 'RED' THEN 3 WHEN 'YELLOW' THEN 2 ELSE 1 END) WHEN 3 THEN 'RED' WHEN 2 THEN 'YELLOW' ELSE 'GREEN' END AS light FROM alloc GROUP BY 1""")
def allocation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = allocation.allocation_totals(allocated(spark, sf_dir))
    return t.select("business_id", "n_lines", *(out(F.col(c)).alias(c) for c in ("ordered_qty", "received_qty", "invoiced_qty", "order_amount")), "light")


@query("WITH" + _LINES + """,
o AS (SELECT l.*, CASE WHEN item_code % 5 = 0 THEN p_brand END AS model, p_name AS goods FROM lines l JOIN part ON p_partkey = item_code),
s AS (SELECT l_orderkey AS business_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_shipdate, l_quantity, l_extendedprice) AS source_id,
   CASE WHEN l_suppkey % 3 = 0 THEN l_linenumber END AS line_no, CASE WHEN l_suppkey % 3 = 1 THEN l_partkey END AS item_code, CASE WHEN l_partkey % 5 = 0 THEN p_brand END AS model, p_name AS goods
   FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'F'),
g AS (SELECT s.source_id, count(o.order_line_id) AS n, min(o.order_line_id) AS id, count(*) FILTER (WHERE s.line_no = o.line_no) AS n1, min(o.order_line_id) FILTER (WHERE s.line_no = o.line_no) AS i1,
   count(*) FILTER (WHERE s.item_code = o.item_code) AS n2, min(o.order_line_id) FILTER (WHERE s.item_code = o.item_code) AS i2, count(*) FILTER (WHERE s.model = o.model) AS n3, min(o.order_line_id) FILTER (WHERE s.model = o.model) AS i3,
   count(*) FILTER (WHERE s.goods = o.goods) AS n4, min(o.order_line_id) FILTER (WHERE s.goods = o.goods) AS i4, any_value(s.model) AS model, count(o.model) AS models FROM s LEFT JOIN o ON s.business_id = o.business_id GROUP BY 1)
SELECT source_id, CASE WHEN n1 = 1 THEN i1 WHEN n2 = 1 THEN i2 WHEN n3 = 1 THEN i3 WHEN model IS NOT NULL AND models > 0 THEN NULL WHEN n4 = 1 THEN i4 WHEN n = 1 THEN id END AS order_line_id,
  CAST(CASE WHEN n1 = 1 THEN 1 WHEN n2 = 1 THEN 2 WHEN n3 = 1 THEN 3 WHEN model IS NOT NULL AND models > 0 THEN NULL WHEN n4 = 1 THEN 4 WHEN n = 1 THEN 5 END AS BIGINT) AS bind_rank,
  CASE WHEN n1 = 1 OR n2 = 1 OR n3 = 1 THEN 'UNIQUE' WHEN model IS NOT NULL AND models > 0 THEN 'STRONG_MODEL_CONFLICT' WHEN n4 = 1 OR n = 1 THEN 'UNIQUE' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNBOUND' END AS bind_status FROM g""")
def line_binding_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = C.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), "p_brand", F.col("p_name").alias("goods"))
    model = F.when(F.col("pk") % 5 == 0, F.col("p_brand")).alias("model")
    orders = C.order_lines(spark, sf_dir).join(part, F.col("item_code") == F.col("pk")).select("business_id", "order_line_id", "order_ref", "line_no", "item_code", model, "goods")
    li = C.table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").join(part, F.col("l_partkey") == F.col("pk"))
    rn = F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").orderBy("l_shipdate", "l_quantity", "l_extendedprice"))
    src = li.select(F.col("l_orderkey").alias("business_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rn).alias("source_id"), F.col("l_orderkey").alias("order_ref"), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_linenumber")).alias("line_no"), F.when(F.col("l_suppkey") % 3 == 1, F.col("l_partkey")).alias("item_code"), model, "goods")
    return allocation.bind_lines(src, orders).select("source_id", "order_line_id", "bind_rank", "bind_status")


@query("""WITH k AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN [] WHEN event_id % 7 = 1 THEN ['so-' || (user_id + 10000000)] ELSE ['SO ' || user_id * 3, 'so-' || user_id] END AS keys FROM events),
p AS (SELECT event_id, pos, regexp_replace(upper(keys[pos]), '\\s', '', 'g') AS n FROM (SELECT event_id, keys, unnest(range(1, len(keys) + 1)) AS pos FROM k)),
t AS (SELECT event_id, pos, n AS key FROM p UNION SELECT event_id, pos, replace(n, '-', '') FROM p),
i AS (SELECT key, min(o_orderkey) AS order_key FROM (SELECT o_orderkey, 'SO-' || o_custkey AS key FROM orders UNION ALL SELECT o_orderkey, 'SO' || o_custkey FROM orders) GROUP BY 1),
h AS (SELECT t.event_id, pos, order_key, i.key FROM t JOIN i USING (key)),
f AS (SELECT event_id, pos, order_key, key FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY pos, order_key, key) AS rn FROM h) WHERE rn = 1)
SELECT k.event_id, f.key AS match_key, f.order_key, CASE WHEN f.key IS NOT NULL THEN 'MATCHED' WHEN len(keys) > 0 THEN 'NOT_FOUND' ELSE 'MISSING_DOCUMENT_INDEX' END AS match_status FROM k LEFT JOIN f USING (event_id)""")
def ledger_lookup_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    keys = F.when(F.col("event_id") % 7 == 0, F.expr("cast(array() as array<string>)")).when(F.col("event_id") % 7 == 1, F.array(F.concat(F.lit("so-"), (F.col("user_id") + 10000000).cast("string")))).otherwise(F.array(F.concat(F.lit("SO "), (F.col("user_id") * 3).cast("string")), F.concat(F.lit("so-"), user)))
    docs = C.table(spark, sf_dir, "events").select("event_id", keys.alias("keys"))
    book = C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_no"), F.to_date("o_orderdate").alias("posting_date"), F.array(F.concat(F.lit("SO-"), F.col("o_custkey").cast("string"))).alias("keys"))
    found = ledger.lookup(docs, ledger.ledger_index(book), "event_id")
    return found.select("event_id", F.col("key").alias("match_key"), F.col("row.row_no").alias("order_key"), "match_status")


@query("""WITH r AS (SELECT unnest(['invoice', 'order', 'receipt']) AS role), p AS (SELECT o_orderkey AS k, 'order' AS role FROM orders UNION SELECT l_orderkey, 'receipt' FROM lineitem WHERE l_linestatus = 'F' UNION SELECT l_orderkey, 'invoice' FROM lineitem WHERE l_returnflag <> 'R')
SELECT o_orderkey AS business_id, r.role FROM orders, r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k = o_orderkey AND p.role = r.role)""")
def missing_required_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("business_id"))
    have = orders.withColumn("role", F.lit("order")).unionByName(C.source_lines(spark, sf_dir).select("business_id", "role"))
    required = spark.range(3).select(F.element_at(F.array(F.lit("order"), F.lit("receipt"), F.lit("invoice")), (F.col("id") + 1).cast("int")).alias("role"))
    return ledger.missing_required(orders, have, required, "business_id", "role")


@query(_ALLOC.replace("WITH", "WITH RECURSIVE", 0) + f""", totals AS (SELECT business_id, CASE max(CASE light WHEN 'RED' THEN 3 WHEN 'YELLOW' THEN 2 ELSE 1 END) WHEN 3 THEN 'RED' WHEN 2 THEN 'YELLOW' ELSE 'GREEN' END AS light FROM alloc GROUP BY 1),
{DATES_SQL}, k AS (SELECT business_id, CASE WHEN control_date IS NULL OR posting_date IS NULL THEN 'WARNING' WHEN (control_date <= {_END}) <> (posting_date <= {_END}) OR strftime(control_date, '%Y-%m') <> strftime(posting_date, '%Y-%m') THEN 'FAIL' ELSE 'PASS' END AS cutoff_status FROM dates),
{THREE_WAY_SQL.split('WITH', 1)[1].split('o AS (SELECT business_id', 1)[1].join(['o AS (SELECT business_id', ''])}
SELECT business_id, light, decision, cutoff_status FROM totals JOIN m USING (business_id) JOIN k USING (business_id)""")
def audit_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: light, decision and cut-off status of each order."""
    totals = allocation.allocation_totals(allocated(spark, sf_dir)).select("business_id", "light")
    cut = cutoff.check_cutoff(C.ledger_dates(spark, sf_dir), period_end=F.expr(_END)).select("business_id", "cutoff_status")
    return totals.join(matched(spark, sf_dir).select("business_id", "decision"), "business_id").join(cut, "business_id").select("business_id", "light", "decision", "cutoff_status")
