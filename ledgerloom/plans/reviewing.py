"""Queries on clauses, evidence, reviews, working papers, stored tables and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import assertions, clauses, cutoff, decisions, evidence, ledger, matching, reviews
from ledgerloom.operators import catalogue as K
from ledgerloom.plans import canonical as C
from ledgerloom.plans.queries import DATES_SQL, matched, period_end
from ledgerloom.plans.registry import query
from ledgerloom.plans.stash import shared_dir, stash
from ledgerloom.sources import files
from ledgerloom.streaming import feeds

# ---- wording: texts with a clause put in by the document's number

_CLAUSES = [
    "合同采用随行就市结算", "随行就市, 按市场指数", "原材料价格波动时双方协商后调整价格", "给予返利", "不包含任何返利", "返利 5 % 按采购额计, 现金兑现", "开票前卖方有权调整价格", "货到付款", "货到付款, 签收后 30 日内", "应及时结清",
    "首款及尾款比例另行通知", "by D/P", "D/P at sight", "installation: the buyer may request assistance", "提供驻场服务", "不包含驻场, 是否驻场", "FOB, goods handed over to the carrier", "CIF with handover condition at 到港", "DAP area designated by the Buyer", "tooling arrangement to be agreed", "plain words only",
]
_PUT = f"[{', '.join(repr(c) for c in _CLAUSES)}]"


def _worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = F.element_at(F.array(*map(F.lit, _CLAUSES)), (F.col("doc_id") % len(_CLAUSES) + 1).cast("int"))
    return C.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", "text", put).alias("text"))


def _sql_fires(r: dict) -> str:
    has = lambda p: "regexp_matches(text, '(?i)" + p.replace("'", "''") + "')"
    hit = lambda p: f"({has(p[0])} AND NOT {has(p[1])})" if isinstance(p, tuple) else has(p)
    some = lambda ps: "(" + " OR ".join(hit(p) for p in ps) + ")"
    parts = [has(p) for p in r.get("all", ())] + ([some(r["any"])] if "any" in r else []) + [f"NOT {has(p)}" for p in r.get("unless", ())]
    if "longer" in r:
        parts.append(f"length(regexp_replace(text, '\\s+', '', 'g')) >= {r['longer']}")
    if "unless_both" in r:
        parts.append(f"NOT ({some(r['unless_both'][0])} AND {some(r['unless_both'][1])})")
    if "either" in r:
        every, none, other = r["either"]
        parts.append(f"(({' AND '.join(has(p) for p in every)} AND NOT {some(none)}) OR {some(other)})")
    return " AND ".join(parts)


_ISSUES = f"""w AS (SELECT doc_id, concat_ws(chr(10), text, ({_PUT})[doc_id % {len(_CLAUSES)} + 1]) AS text FROM documents),
issues AS ({' UNION ALL '.join(f"SELECT doc_id, {i} AS place, '{r['code']}' AS issue_code, '{clauses.DIMENSIONS[r['dim']]}' AS dimension FROM w WHERE {_sql_fires(r)}" for i, r in enumerate(clauses.RULES))})"""


@query(f"WITH {_ISSUES} SELECT doc_id, place, issue_code, dimension FROM issues")
def clause_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses.clause_issues(_worded(spark, sf_dir))


@query(f"""WITH {_ISSUES}, d AS (SELECT doc_id, doc_id % 9 <> 0 AS c, unnest([{', '.join(repr(x) for x in clauses.DIMENSIONS.values())}]) AS dimension FROM w)
SELECT d.doc_id, d.dimension, CASE WHEN NOT c THEN 'MISSING' WHEN EXISTS (SELECT 1 FROM issues i WHERE i.doc_id = d.doc_id AND i.dimension = d.dimension) THEN 'AMBIGUOUS' ELSE 'CLEAR' END AS status FROM d""")
def clause_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _worded(spark, sf_dir)
    return clauses.dimension_statuses(docs, clauses.clause_issues(docs), F.col("doc_id") % 9 != 0)


_NAME = "CASE doc_id % 8 WHEN 0 THEN 'SO-' || doc_id || '.pdf' WHEN 1 THEN '增值税发票' || doc_id WHEN 2 THEN '发货签收' || doc_id WHEN 3 THEN '发货' || doc_id WHEN 4 THEN 'bank ' || doc_id WHEN 5 THEN 'HT_' || doc_id ELSE 'scan' || doc_id END"
_BODY = "concat_ws(' ', text, CASE doc_id % 8 WHEN 6 THEN CASE doc_id // 8 % 4 WHEN 0 THEN '价税合计' WHEN 1 THEN '承运人' WHEN 2 THEN '承运人 签收人' ELSE '甲方' END END)"


@query(f"""WITH d AS (SELECT doc_id, {_NAME} AS n, {_BODY.replace('//', '//')} AS t FROM documents)
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'order' WHEN 1 THEN 'invoice' WHEN 2 THEN 'receipt' WHEN 3 THEN 'delivery' WHEN 4 THEN 'payment' WHEN 5 THEN 'contract' WHEN 6 THEN CASE doc_id // 8 % 4 WHEN 0 THEN 'invoice' WHEN 1 THEN 'delivery' WHEN 2 THEN 'receipt' ELSE 'contract' END ELSE CASE WHEN doc_id % 3 = 0 THEN 'payment' ELSE 'other' END END AS doc_type FROM d""")
def keyword_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C.table(spark, sf_dir, "documents").select("doc_id", F.expr(_NAME).alias("n"), F.expr(_BODY.replace("doc_id // 8", "doc_id div 8")).alias("t"), F.when(F.col("doc_id") % 3 == 0, "payment").otherwise("memo").alias("hint"))
    return d.select("doc_id", clauses.document_type(F.col("n"), F.col("t"), F.col("hint")).alias("doc_type"))


_CARDS = {
    "en": {"identity": ["The ", "and "], "required": [[" of ", " to "], [" the "]], "strong": [" is "], "contrary": [" der ", " de "]},
    "de": {"identity": ["Der ", "sch"], "required": [[" der "], [" und ", " ist "]], "strong": [" die "], "contrary": [" the "]},
    "es": {"identity": ["ción", "mente"], "required": [[" de "], [" que ", " y "]], "strong": [" la "], "contrary": [" the "]},
    "fr": {"identity": ["eau", "eux"], "required": [[" de ", " le "], [" et ", " que "]], "strong": [" la "], "contrary": [" the "], "need": 1},
}


def _card_sql() -> str:
    rows = []
    for n, c in _CARDS.items():
        has = lambda w: f"CAST(contains(t, '{w}') AS INT)"
        req = " + ".join(f"CAST(({' OR '.join(f"contains(t, '{w}')" for w in g)}) AS INT)" for g in c["required"])
        rows.append(f"SELECT doc_id, '{n}' AS card, 3 * ({' + '.join(map(has, c['identity']))}) + 2 * ({req}) + {' + '.join(map(has, c['strong']))} - 2 * ({' + '.join(map(has, c['contrary']))}) AS score, {req} >= {c.get('need', 2)} AS enough FROM d")
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(rows)}) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, card) AS INTEGER) AS place, card, score, enough FROM s QUALIFY place <= 3"


@query(_card_sql())
def page_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses.score_cards(C.table(spark, sf_dir, "documents"), _CARDS, "doc_id")


_TERMS = ["Buyer nominates the vessel and pays ocean freight", "seller pays ocean; for buyer's benefit", "seller arranges; recharged to buyer", "risk on board; seller pays freight", "received for shipment", "seller only", "no recharge"]


@query(f"""WITH d AS (SELECT o_orderkey AS k, (['FOB', 'CFR', 'CIF', 'DAP'])[o_orderkey // 7 % 4 + 1] AS code, o_orderkey % 7 AS f, o_orderkey % 11 <> 0 AS p FROM orders)
SELECT k AS chain_id, CASE WHEN NOT p THEN 'insufficient_evidence' WHEN code IN ('FOB', 'CFR', 'CIF') AND f = 4 THEN 'insufficient_evidence' WHEN code = 'CIF' AND f = 5 THEN 'insufficient_evidence' WHEN code = 'FOB' AND f = 1 THEN 'major_conflict' WHEN code = 'FOB' AND f = 2 THEN 'standard_modified' WHEN code = 'FOB' AND f = 0 THEN 'standard_consistent'
  WHEN code = 'CFR' AND f = 3 THEN 'standard_consistent' WHEN code = 'DAP' THEN 'standard_consistent' ELSE 'insufficient_evidence' END AS status FROM d""")
def trade_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    own = C.table(spark, sf_dir, "orders").select(k.alias("chain_id"), pick(["FOB", "CFR", "CIF", "DAP"], F.floor(k / 7) % 4).alias("code"), pick(_TERMS, k % 7).alias("text"), F.when(k % 11 != 0, "Port").alias("place"))
    return own.select("chain_id", clauses.trade_status(F.col("code"), F.col("place"), F.lit(None).cast("string"), clauses.trade_facts(F.col("text"))).alias("status"))


@query("""WITH v AS (SELECT user_id AS doc_id, CASE WHEN event_id % 400 = 0 THEN 'cif Port' ELSE 'FOB Port ' || event_id END AS v, CASE WHEN user_id % 3 = 0 THEN 0.5 END AS c FROM events), g AS (SELECT doc_id, min(upper(split_part(v, ' ', 1))) AS lo, max(upper(split_part(v, ' ', 1))) AS hi, max(coalesce(c, 1.0)) AS c FROM v GROUP BY 1)
SELECT doc_id, CASE WHEN lo = hi THEN lo END AS code, CASE WHEN lo = hi AND c >= 0.9 THEN 'OK' ELSE 'UNRELIABLE' END AS availability FROM g""")
def trade_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 400 == 0, "cif Port").otherwise(F.concat(F.lit("FOB Port "), F.col("event_id")))
    return clauses.trade_slot(e.select(F.col("user_id").alias("doc_id"), value.alias("value"), F.when(F.col("user_id") % 3 == 0, 0.5).alias("confidence")))


# ---- evidence: fields of order, receipt and invoice documents


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a chain's documents: numbers, parties, amounts, units and tax numbers, written in different ways."""
    o = C.table(spark, sf_dir, "orders")
    k, name = F.col("o_orderkey"), F.concat(F.lit("Party "), F.col("o_custkey").cast("string"), F.lit(" Co., Ltd."))
    amount = F.format_string("%.2f", "o_totalprice")
    rows = [
        ("orderNo", F.concat(F.lit("SO-"), k), F.lit(True)), ("relatedOrderNo", F.when(k % 5 == 0, F.concat(F.lit("so "), k)).when(k % 5 == 1, F.concat(F.lit("SO-"), k + 1)).otherwise(F.concat(F.lit("SO-"), k)), k % 9 != 0),
        ("buyerName", name, F.lit(True)), ("customerName", F.when(k % 4 == 0, F.upper(name)).when(k % 4 == 1, F.replace(name, F.lit(","), F.lit("，"))).otherwise(name), F.lit(True)),
        ("buyerTaxId", F.concat(F.lit("TX"), F.col("o_custkey")), F.lit(True)), ("customerTaxId", F.concat(F.lit("TX"), F.col("o_custkey") + F.when(k % 17 == 0, 1).otherwise(0)), F.lit(True)),
        ("totalAmount", amount, F.lit(True)), ("grossAmount", F.when(k % 3 == 0, F.concat(amount, F.lit("0"))).when(k % 3 == 1, F.format_string("%.2f", F.col("o_totalprice") + 1)).otherwise(amount), F.lit(True)),
        ("unit", F.lit("pcs"), F.lit(True)), ("goodsUnit", F.when(k % 2 == 0, "件").otherwise("kg"), F.lit(True)),
    ]
    return o.select(k.alias("chain_id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field_key"), v.cast("string").alias("value"), u.alias("usable")) for f, v, u in rows))).alias("n")).select("chain_id", "n.*")


_COMPACT = "lower(regexp_replace(v, '[\\s,，。；;：:、·•()（）\\[\\]【】{}<>《》\\-_/\\\\]+', '', 'g'))"


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, 'Party ' || o_custkey || ' Co., Ltd.' AS name, printf('%.2f', o_totalprice) AS amount, printf('%.2f', o_totalprice + 1) AS more FROM orders),
f AS (SELECT k, 'order_reference' AS concept, 'text' AS kind, false AS tax, 'SO-' || k AS v, true AS u FROM o
  UNION ALL SELECT k, 'order_reference', 'text', false, CASE k % 5 WHEN 0 THEN 'so ' || k WHEN 1 THEN 'SO-' || (k + 1) ELSE 'SO-' || k END, k % 9 <> 0 FROM o
  UNION ALL SELECT k, 'buyer_identity', 'text', false, name, true FROM o UNION ALL SELECT k, 'buyer_identity', 'text', false, CASE k % 4 WHEN 0 THEN upper(name) WHEN 1 THEN replace(name, ',', '，') ELSE name END, true FROM o
  UNION ALL SELECT k, 'buyer_identity', 'text', true, 'TX' || c, true FROM o UNION ALL SELECT k, 'buyer_identity', 'text', true, 'TX' || (c + CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END), true FROM o
  UNION ALL SELECT k, 'gross_amount', 'number', false, amount, true FROM o UNION ALL SELECT k, 'gross_amount', 'number', false, CASE k % 3 WHEN 0 THEN amount || '0' WHEN 1 THEN more ELSE amount END, true FROM o
  UNION ALL SELECT k, 'unit', 'unit', false, 'pcs', true FROM o UNION ALL SELECT k, 'unit', 'unit', false, CASE WHEN k % 2 = 0 THEN '件' ELSE 'kg' END, true FROM o),
n AS (SELECT *, lower(trim(v)) AS raw, nullif(CASE kind WHEN 'number' THEN regexp_replace(CAST(CAST(v AS DECIMAL(28, 6)) AS VARCHAR), '\\.?0+$', '') WHEN 'unit' THEN CASE WHEN COMPACT IN ('pcs', 'pc', 'piece', 'pieces', '个') THEN '件' ELSE COMPACT END ELSE COMPACT END, '') AS n FROM f),
g AS (SELECT k, concept, count(*) FILTER (WHERE u AND NOT tax) AS usable, count(*) FILTER (WHERE u AND NOT tax AND n IS NULL) AS invalid, count(DISTINCT n) FILTER (WHERE u AND NOT tax) AS ways, count(DISTINCT raw) FILTER (WHERE u AND NOT tax) AS raws, count(DISTINCT n) FILTER (WHERE u AND tax) AS taxes FROM n GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN taxes > 1 THEN 'TAX' WHEN usable < 2 THEN 'MISSING_EVIDENCE' WHEN invalid = 0 AND ways = 1 AND raws = 1 THEN 'EXACT_EQUAL' WHEN invalid = 0 AND ways = 1 THEN 'NORMALIZED_EQUAL' ELSE 'CONTRADICTS' END AS rel FROM g)
SELECT k AS chain_id, concept, CASE rel WHEN 'TAX' THEN 'CONTRADICTS' ELSE rel END AS relation, CASE WHEN rel = 'MISSING_EVIDENCE' THEN 'CANDIDATE' WHEN rel IN ('CONTRADICTS', 'TAX') THEN 'CONFLICT' ELSE 'CONFIRMED' END AS status,
  CASE rel WHEN 'TAX' THEN 'TAX_ID_CONFLICT' WHEN 'MISSING_EVIDENCE' THEN 'DECISION_EVIDENCE_MISSING' WHEN 'EXACT_EQUAL' THEN 'RAW_VALUE_EQUAL' WHEN 'NORMALIZED_EQUAL' THEN 'NORMALIZED_VALUE_EQUAL' ELSE CASE concept WHEN 'order_reference' THEN 'IDENTIFIER_MISMATCH' ELSE 'DETERMINISTIC_VALUE_CONFLICT' END END AS reason FROM r""".replace("COMPACT", _COMPACT))
def concept_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.resolve_concepts(_nodes(spark, sf_dir))


_FIELDS = "CASE field_key WHEN 'documentNo' THEN split_part(text, ' ', 2) WHEN 'totalAmount' THEN CASE WHEN doc_id % 2 = 0 THEN '-5' ELSE '5' END ELSE 'absent value' END"


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" total 5 -5")).alias("text"))
    fields = docs.select("doc_id", F.explode(F.array(F.lit("documentNo"), F.lit("totalAmount"), F.lit("receiptDate"))).alias("field_key"), "text").withColumn("value", F.expr(_FIELDS)).drop("text")
    return evidence.locate(fields, docs)


_LOCATED = f"""d AS (SELECT doc_id, coalesce(text, '') || ' total 5 -5' AS text FROM documents), f AS (SELECT doc_id, text, unnest(['documentNo', 'totalAmount', 'receiptDate']) AS field_key FROM d), v AS (SELECT *, {_FIELDS} AS value FROM f),
l AS (SELECT doc_id, field_key, value, CASE WHEN length(trim(value)) > 0 THEN instr(lower(text), lower(trim(value))) ELSE 0 END AS p FROM v)"""


@query(f"WITH {_LOCATED} SELECT doc_id, field_key, value, CAST(CASE WHEN p > 0 THEN p - 1 END AS INTEGER) AS char_start, CASE WHEN p > 0 THEN 'ANCHORED' ELSE 'UNLOCATED' END AS anchor_status, 'ev_' || sha256(doc_id || '|' || field_key || '|' || trim(value) || '|' || p)[1:16] AS evidence_id FROM l")
def field_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir).select("doc_id", "field_key", "value", "char_start", "anchor_status", "evidence_id")


@query(f"WITH {_LOCATED} SELECT doc_id, field_key, CASE WHEN p = 0 THEN 'UNLOCATED' WHEN doc_id % 10 = 0 THEN 'ROLE_CONFLICT' WHEN field_key = 'totalAmount' AND NOT coalesce(TRY_CAST(replace(value, ',', '') AS DOUBLE) >= 0, false) THEN 'NEEDS_REVIEW' WHEN field_key = 'receiptDate' AND TRY_CAST(value AS DATE) IS NULL THEN 'NEEDS_REVIEW' ELSE 'SYSTEM_VERIFIED' END AS gate FROM l")
def field_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.gate(_located(spark, sf_dir), F.col("doc_id") % 10 != 0).select("doc_id", "field_key", "gate")


@query("""WITH c AS (SELECT doc_id, unnest(range(0, 4)) AS i, coalesce(text, '') AS text FROM documents), x AS (SELECT *, CASE i WHEN 0 THEN 'A' ELSE 'B' END AS code, CASE WHEN i = 2 THEN 0.5 ELSE 0.9 END AS conf, CASE i WHEN 3 THEN 'not in any of these texts' ELSE substr(text, 3, 40) END AS ex FROM c)
SELECT doc_id, i AS claim, CASE WHEN i = 0 AND doc_id % 2 = 0 THEN 'code_not_allowed' WHEN i = 2 THEN 'confidence_below_gate' WHEN length(trim(ex)) < 6 OR NOT contains(regexp_replace(text, '\\s+', '', 'g'), regexp_replace(ex, '\\s+', '', 'g')) THEN 'excerpt_not_in_source' END AS reject_reason FROM x""")
def claim_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("claim")
    c = C.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("claim"), F.coalesce("text", F.lit("")).alias("text"))
    code = F.when((i == 0) & (F.col("doc_id") % 2 == 0), "Z").otherwise("B")
    claims = c.select("doc_id", "claim", "text", code.alias("issue_code"), F.lit("").alias("file_name"), F.when(i == 2, 0.5).otherwise(0.9).alias("confidence"), F.when(i == 3, "not in any of these texts").otherwise(F.substring("text", 3, 40)).alias("excerpt"))
    return evidence.verify_claims(claims, codes=["A", "B"]).select("doc_id", "claim", "reject_reason")


@query("""WITH s AS (SELECT l_orderkey AS doc_id, sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(28,6))) AS s, bool_and(l_quantity > 1) AS ok FROM lineitem GROUP BY 1)
SELECT o_orderkey AS doc_id, coalesce(ok AND s = CASE WHEN o_orderkey % 2 = 0 THEN s ELSE CAST(o_totalprice AS DECIMAL(28,6)) END, false) AS derived FROM orders LEFT JOIN s ON doc_id = o_orderkey""")
def derived_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = C.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("value"), (F.col("l_quantity") > 1).alias("usable"))
    own = li.groupBy("doc_id").agg(F.sum("value").alias("s"))
    headers = C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").cast("decimal(28,6)").alias("t")).join(own, "doc_id", "left")
    return evidence.derived_sum(li, headers.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("s").cast("decimal(28,6)")).otherwise(F.col("t")).alias("total")))


# ---- reviews


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cutoff.check_cutoff(C.ledger_dates(spark, sf_dir), period_end=period_end())
    text = lambda c: F.col(c).cast("string")
    late = cut.where("cutoff_status = 'FAIL'").select(text("business_id").alias("chain_id"), F.lit("CUTOFF").alias("event_type"), F.when(F.col("cutoff_reason") == "PERIOD_END_CROSSED", "BLOCKING").otherwise("REVIEW").alias("severity"), F.col("cutoff_reason").alias("reason"), F.lit("cutoff").alias("source_ref"))
    late = stash(late, "late")  # told twice below
    hard = matched(spark, sf_dir).where("status = 'FAIL'").select(text("business_id").alias("chain_id"), F.lit("THREE_WAY").alias("event_type"), F.lit("BLOCKING").alias("severity"), F.concat_ws("/", "amount_verdict", "quantity_verdict").alias("reason"), F.lit("match").alias("source_ref"))
    orders = C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("business_id"))
    required = spark.range(2).select(F.when(F.col("id") == 0, "receipt").otherwise("invoice").alias("role"))
    gaps = ledger.missing_required(orders, C.source_lines(spark, sf_dir).select("business_id", "role"), required, "business_id", "role")
    lacking = gaps.select(text("business_id").alias("chain_id"), F.lit("MISSING_DOCUMENT").alias("event_type"), F.lit("REVIEW").alias("severity"), F.col("role").alias("reason"), F.col("role").alias("source_ref"))
    again = late.where("severity = 'REVIEW'").withColumn("reason", F.lit("LOOKED_AT_AGAIN"))
    return reviews.events([late, hard, lacking, again])


_EVENTS = DATES_SQL + """,
cut AS (SELECT business_id, control_date IS NOT NULL AND (control_date <= DATE '1998-12-31') <> (posting_date <= DATE '1998-12-31') AS crossed, strftime(control_date, '%Y-%m') AS cm, strftime(posting_date, '%Y-%m') AS pm, control_date IS NULL AS none FROM dates),
raw AS (SELECT 3 AS f, CAST(business_id AS VARCHAR) AS chain_id, 'CUTOFF' AS event_type, 'REVIEW' AS severity, 'LOOKED_AT_AGAIN' AS reason, 'cutoff' AS source_ref FROM cut WHERE NOT none AND NOT crossed AND cm <> pm
  UNION ALL SELECT 0, CAST(business_id AS VARCHAR), 'CUTOFF', 'BLOCKING', 'PERIOD_END_CROSSED', 'cutoff' FROM cut WHERE crossed
  UNION ALL SELECT 1, CAST(business_id AS VARCHAR), 'THREE_WAY', 'BLOCKING', amount_verdict || '/' || quantity_verdict, 'match' FROM m WHERE status = 'FAIL'
  UNION ALL SELECT 2, CAST(o_orderkey AS VARCHAR), 'MISSING_DOCUMENT', 'REVIEW', role, role FROM orders, (SELECT unnest(['receipt', 'invoice']) AS role) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND CASE role WHEN 'receipt' THEN l_linestatus = 'F' ELSE l_returnflag <> 'R' END)),
ev AS (SELECT 'ev_' || sha256(event_type || '|' || chain_id || '|' || source_ref)[1:16] AS event_id, CASE severity WHEN 'BLOCKING' THEN 0 ELSE 1 END AS severity_rank, chain_id, event_type, severity, reason, source_ref FROM raw)
"""


def _with_match(sql: str) -> str:
    from ledgerloom.plans.queries import THREE_WAY_SQL

    return f"{THREE_WAY_SQL.rstrip()}, {_EVENTS.lstrip()} {sql}"


@query(_with_match("SELECT * FROM ev"))
def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir)


@query(_with_match("SELECT count(*) AS open, count(*) FILTER (WHERE severity = 'BLOCKING') AS blocking, count(*) FILTER (WHERE severity = 'SAMPLE') AS sample, count(*) FILTER (WHERE severity = 'REVIEW') AS review, count(*) FILTER (WHERE event_type = 'MISSING_DOCUMENT') AS missing FROM ev"))
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.event_summary(_events(spark, sf_dir))


@query(_with_match("SELECT * FROM ev WHERE NOT (CAST(chain_id AS BIGINT) % 3 = 0 AND event_type = 'MISSING_DOCUMENT')"))
def open_review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events left after decisions: those on missing documents of every third chain fit, those on matches are out of date."""
    made = stash(_events(spark, sf_dir), "events")  # the log is made from the events, too
    third = F.col("chain_id").cast("long") % 3 == 0
    log = made.where(third).select("event_id", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("OPEN").alias("state")), F.struct(F.lit(2).alias("seq"), F.lit("RESOLVED").alias("state")))).alias("d"), F.when(F.col("event_type") == "MISSING_DOCUMENT", F.col("reason")).otherwise("older").alias("reason"))
    return reviews.open_events(made, log.select("event_id", "d.seq", "d.state", "reason"))


@query("""WITH o AS (SELECT o_orderkey AS k, 'old' AS note, o_totalprice AS amount, CASE WHEN o_orderkey % 3 = 0 THEN 'VERIFIED' ELSE 'PROPOSED' END AS status FROM orders WHERE o_orderkey % 2 = 0),
n AS (SELECT o_orderkey AS k, 'new' AS note, o_totalprice + 1 AS amount, 'PROPOSED' AS status FROM orders WHERE o_orderkey % 5 < 3)
SELECT coalesce(o.k, n.k) AS relation_id, CASE WHEN n.k IS NULL THEN o.note ELSE n.note END AS note, CASE WHEN n.k IS NULL OR o.status = 'VERIFIED' THEN o.amount ELSE n.amount END AS amount, CASE WHEN n.k IS NULL OR o.status = 'VERIFIED' THEN o.status ELSE n.status END AS status FROM o FULL JOIN n ON o.k = n.k""")
def relation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New proposals merged into a store: decided relations stay, but for their note."""
    o = C.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    old = o.where(k % 2 == 0).select(k.alias("relation_id"), F.lit("old").alias("note"), F.col("o_totalprice").alias("amount"), F.when(k % 3 == 0, "VERIFIED").otherwise("PROPOSED").alias("status"))
    new = o.where(k % 5 < 3).select(k.alias("relation_id"), F.lit("new").alias("note"), (F.col("o_totalprice") + 1).alias("amount"), F.lit("PROPOSED").alias("status"))
    return reviews.upsert(old, new, "relation_id", F.col("status") == "VERIFIED", ["note"])


@query("""WITH n AS (SELECT o_orderkey AS d, 'order' AS r, 1 AS p, 'K' || o_custkey AS k FROM orders UNION SELECT -o_orderkey - 1, 'invoice', 4, 'K' || o_custkey FROM orders WHERE o_orderkey % 2 = 0),
h AS (SELECT k, min(CAST(d AS VARCHAR)) AS d FROM n WHERE r = 'order' GROUP BY 1) SELECT h.d AS from_id, CAST(n.d AS VARCHAR) AS to_id, 'order_invoice' AS rel_type, k AS shared_key, 'rel_' || sha256(least(h.d, CAST(n.d AS VARCHAR)) || '|' || greatest(h.d, CAST(n.d AS VARCHAR)) || '|order_invoice|' || k)[1:16] AS relation_id FROM n JOIN h USING (k) WHERE r = 'invoice'""")
def relation_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = C.table(spark, sf_dir, "orders")
    key = F.concat(F.lit("K"), F.col("o_custkey").cast("string")).alias("key")
    nodes = o.select(F.col("o_orderkey").alias("doc_id"), F.lit("order").alias("role"), key).unionByName(o.where("o_orderkey % 2 = 0").select((-F.col("o_orderkey") - 1).alias("doc_id"), F.lit("invoice").alias("role"), key))
    return reviews.propose_relations(nodes)


@query("""WITH v AS (SELECT event_id AS doc_id, event_type AS field_key, CAST(user_id AS VARCHAR) AS value FROM events),
l AS (SELECT event_id AS doc_id, event_type AS field_key, CASE event_id % 4 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'REJECT' WHEN 2 THEN 'ACCEPT' END AS a, CASE WHEN event_id % 4 = 2 THEN 'by hand' END AS h FROM events WHERE event_id % 4 < 3)
SELECT v.doc_id, v.field_key, CASE WHEN a = 'ACCEPT' THEN coalesce(h, value) WHEN a = 'REJECT' THEN NULL ELSE value END AS value, CASE a WHEN 'ACCEPT' THEN 'ACCEPTED' WHEN 'REJECT' THEN 'REJECTED' ELSE 'UNRESOLVED' END AS status FROM v LEFT JOIN l USING (doc_id, field_key)""")
def field_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.table(spark, sf_dir, "events")
    k = F.col("event_id")
    values = e.select(k.alias("doc_id"), F.col("event_type").alias("field_key"), F.col("user_id").cast("string").alias("value"))
    act = F.when(k % 4 == 1, "REJECT").otherwise("ACCEPT")
    log = e.where(k % 4 < 3).select(k.alias("doc_id"), F.col("event_type").alias("field_key"), F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("REJECT").alias("action")), F.struct(F.lit(2).alias("seq"), act.alias("action")))).alias("d"), F.when(k % 4 == 2, "by hand").alias("value"))
    return reviews.overlay(values, log.select("doc_id", "field_key", "d.seq", "d.action", "value"), ["doc_id", "field_key"])


@query("""WITH s AS (SELECT unnest(['order', 'receipt', 'invoice', 'payment']) AS slot), p AS (SELECT l_orderkey AS k, 'receipt' AS slot, bool_or(l_linestatus = 'F') AS sure FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, 'invoice', bool_or(l_returnflag <> 'R') FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderkey, 'order', true FROM orders)
SELECT o_orderkey AS chain_id, s.slot, CASE WHEN sure IS NULL THEN 'missing' WHEN sure THEN 'present' ELSE 'uncertain' END AS status FROM orders CROSS JOIN s LEFT JOIN p ON p.k = o_orderkey AND p.slot = s.slot""")
def slot_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = C.table(spark, sf_dir, "lineitem")
    orders = C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chain_id"))
    have = li.select(F.col("l_orderkey").alias("chain_id"), F.explode(F.array(F.struct(F.lit("receipt").alias("slot"), (F.col("l_linestatus") == "F").alias("sure")), F.struct(F.lit("invoice").alias("slot"), (F.col("l_returnflag") != "R").alias("sure")))).alias("s")).select("chain_id", "s.*")
    return reviews.slot_matrix(orders, have.unionByName(orders.select("chain_id", F.lit("order").alias("slot"), F.lit(True).alias("sure"))), ["order", "receipt", "invoice", "payment"])


def _desk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = C.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chain_id")).agg(F.count("*").alias("docs"), F.count_if(F.col("l_linestatus") == "F").alias("receipts"), F.count_if(F.col("l_tax") == 0).alias("ambiguous"))
    k = F.col("chain_id")
    own = C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chain_id"), "o_orderstatus").join(lines, "chain_id", "left")
    return own.select("chain_id", "docs", F.when(F.col("ambiguous") > 1, 1).otherwise(0).alias("ambiguous"), F.when(F.col("receipts") == 0, 1).otherwise(0).alias("missing_docs"), (k % 11 == 0).cast("int").alias("uncertain_docs"), (k % 13 == 0).cast("int").alias("missing_fields"), (k % 17 != 0).alias("tested"), (F.col("o_orderstatus") == "P").alias("failed"), (k % 2 == 0).alias("concluded"))


_DESK = """d AS (SELECT o_orderkey AS chain_id, o_orderstatus, n, r, a FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS r, count(*) FILTER (WHERE l_tax = 0) AS a FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
desk AS (SELECT chain_id, o_orderstatus, n, CASE WHEN n IS NULL THEN 'wait_docs' WHEN a > 1 THEN 'amount_ambiguity' WHEN r = 0 THEN 'missing_docs' WHEN chain_id % 11 = 0 THEN 'docs_uncertain' WHEN chain_id % 13 = 0 THEN 'missing_fields' WHEN chain_id % 17 = 0 THEN 'not_tested' WHEN o_orderstatus = 'P' THEN 'tests_failed' WHEN chain_id % 2 = 1 THEN 'unconfirmed' ELSE 'done' END AS reason FROM d)"""


@query(f"WITH {_DESK} SELECT chain_id, reason, CASE WHEN reason = 'wait_docs' THEN 'wait' WHEN reason IN ('amount_ambiguity', 'missing_docs', 'tests_failed') THEN 'red' WHEN reason = 'done' THEN 'green' ELSE 'yellow' END AS light FROM desk")
def desk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.desk_status(_desk(spark, sf_dir)).select("chain_id", "light", "reason")


@query(f"WITH {_DESK} SELECT reason, count(*) AS n FROM desk GROUP BY 1")
def desk_lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.desk_status(_desk(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_orderkey AS k, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n, CASE WHEN o_orderstatus = 'F' THEN 'FAIL' ELSE 'PASS' END AS s FROM orders)
SELECT k AS business_id, CASE WHEN n = 0 THEN 'NO_DOCUMENTS' WHEN s = 'FAIL' AND k % 3 <> 0 THEN 'FAILED' WHEN k % 5 = 0 THEN 'NOT_CONCLUDED' END AS blocker, NOT (n = 0 OR (s = 'FAIL' AND k % 3 <> 0) OR k % 5 = 0) AS ready FROM c""")
def export_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = C.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("business_id")).agg(F.count("*").alias("docs"))
    orders = C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("business_id"), F.when(F.col("o_orderstatus") == "F", "FAIL").otherwise("PASS").alias("status"))
    k = F.col("business_id")
    chains = orders.join(lines, "business_id").withColumns({"released": k % 3 == 0, "concluded": k % 5 != 0})
    return reviews.export_readiness(orders, chains)


@query("""SELECT k AS chain_id, unnest(CASE s WHEN 'fields' THEN ['fields', 'evidence', 'tests', 'conclusion', 'workbook'] WHEN 'tests' THEN ['tests', 'conclusion', 'workbook'] ELSE ['conclusion', 'workbook'] END) AS stage FROM (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'fields' WHEN 1 THEN 'tests' ELSE 'conclusion' END AS s FROM orders)""")
def invalidation_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return reviews.invalidated(C.table(spark, sf_dir, "orders").select(k.alias("chain_id"), F.when(k % 3 == 0, "fields").when(k % 3 == 1, "tests").otherwise("conclusion").alias("stage")))


@query(_with_match("""SELECT CAST(d.business_id AS VARCHAR) AS business_id, 'V' || d.business_id AS voucher_no, 'Customer ' || o_custkey AS customer, strftime(d.posting_date, '%Y-%m-%d') AS posting_date, coalesce(strftime(d.control_date, '%Y-%m-%d'), '') AS receipt_date,
  coalesce(CAST(datediff('day', d.control_date, d.posting_date) AS VARCHAR), '') AS deviation_days, coalesce(m.status, '') AS match_status, coalesce(m.decision, '') AS match_decision FROM dates d JOIN orders ON o_orderkey = d.business_id LEFT JOIN m ON m.business_id = d.business_id"""))
def working_paper_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cutoff.route_risk(cutoff.check_cutoff(C.ledger_dates(spark, sf_dir), period_end=period_end()))
    m = matched(spark, sf_dir).select("business_id", F.col("status").alias("match_status"), F.col("decision").alias("match_decision"), "party_ok", "order_amount", "receipt_amount", "invoice_amount")
    df = cut.join(m, "business_id", "left").withColumns({"voucher_no": F.concat(F.lit("V"), F.col("business_id")), "customer": F.concat(F.lit("Customer "), F.col("party_id")), "receipt_date": F.col("control_date"), "booked_amount": F.col("book_amount")})
    spread = matching.spread(F.col("order_amount"), F.col("receipt_amount"), F.col("invoice_amount"))
    rows = reviews.paper_rows(df.withColumn("amount_spread_pct", F.round(spread * 100, 2)))
    return rows.select("business_id", "voucher_no", "customer", "posting_date", "receipt_date", "deviation_days", "match_status", "match_decision")


@query("""WITH v AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 3 > 0 END AS a, o_orderkey % 5 > 0 AS b, o_orderkey % 7 = 0 AS w FROM orders) SELECT k AS chain_id, CASE WHEN NOT coalesce(a, true) OR NOT b THEN false WHEN w OR a IS NULL THEN NULL ELSE true END AS verdict FROM v""")
def programme_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    a, b = F.when(k % 4 != 0, k % 3 > 0), k % 5 > 0
    return C.table(spark, sf_dir, "orders").select(k.alias("chain_id"), reviews.row_verdict([a, b], (k % 7 == 0).cast("int"), F.lit(0)).alias("verdict"))


@query("""WITH s AS (SELECT l_linestatus AS dimension, CASE WHEN l_returnflag = 'R' THEN 'FAIL' WHEN l_returnflag = 'A' THEN 'SKIPPED' WHEN l_tax = 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM lineitem)
SELECT dimension, count(*) FILTER (WHERE status <> 'SKIPPED') AS tested, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'WARNING') AS warned, count(*) FILTER (WHERE status = 'SKIPPED') AS skipped FROM s GROUP BY 1""")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_returnflag") == "A", "SKIPPED").when(F.col("l_tax") == 0, "WARNING").otherwise("PASS")
    return reviews.coverage_counts(C.table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("dimension"), status.alias("status")))


_CONTROL = "CASE l_linenumber % 3 WHEN 0 THEN 'customer_receipt' WHEN 1 THEN 'on_board' ELSE 'note' END"


@query(f"""WITH c AS (SELECT l_orderkey AS d, {_CONTROL} AS e, CAST(l_shipdate AS DATE) AS t, l_discount AS c FROM lineitem), r AS (SELECT *, CASE e WHEN 'customer_receipt' THEN 2 ELSE 4 END AS p FROM c WHERE e <> 'note'),
b AS (SELECT *, rank() OVER (PARTITION BY d ORDER BY p, c DESC) AS k FROM r) SELECT d AS doc_id, CASE WHEN min(t) = max(t) THEN strftime(min(t), '%Y-%m-%d') END AS date FROM b WHERE k = 1 GROUP BY 1""")
def control_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = C.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr(_CONTROL).alias("event"), F.to_date("l_shipdate").alias("date"), F.col("l_discount").alias("confidence"))
    return reviews.control_date(li).withColumn("date", F.col("date").cast("string"))


@query(f"""WITH c AS (SELECT l_orderkey AS d, {_CONTROL} AS e, CAST(l_shipdate AS DATE) AS t FROM lineitem), g AS (SELECT d, min(t) FILTER (WHERE e = 'on_board') AS lo, max(t) FILTER (WHERE e = 'on_board') AS hi FROM c GROUP BY 1)
SELECT d AS doc_id, CASE WHEN lo IS NULL THEN 'unresolved' WHEN lo = hi THEN 'supported' ELSE 'conflict' END AS result, CASE WHEN lo = hi THEN strftime(lo, '%Y-%m-%d') END AS date FROM g""")
def control_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = C.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr(_CONTROL).alias("event"), F.to_date("l_shipdate").alias("date"))
    return reviews.assess_control(li).withColumn("date", F.col("date").cast("string"))


# ---- stored tables and streams


def _own(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"


@query("""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS posting_date, 'SO' || o_orderkey AS biz_id, round(o_totalprice, 2) AS amount FROM orders""")
def ledger_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger written as CSV under Chinese headers, read, mapped and projected."""
    path = _own(spark, "ledger") + ".csv"
    o = C.table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy/M/d").alias(" 记账日期 "), F.concat(F.lit("so "), F.col("o_orderkey")).alias("业务编号"), F.format_string("%,.2f", "o_totalprice").alias("金额"))
    o.write.option("header", True).csv(path)
    raw = files.read_ledger(spark, path)
    return files.project_ledger(raw, files.map_columns(raw.columns)).withColumns({"id": F.substring("biz_id", 3, 20).cast("long"), "posting_date": F.col("posting_date").cast("string")})


@query("""WITH o AS (SELECT doc_id, sha256('f' || doc_id || ':' || md5(coalesce(text, '')))[1:32] AS fp FROM documents) SELECT 'f' || doc_id AS file_name, CASE WHEN doc_id % 5 = 0 THEN sha256('f' || doc_id || ':' || md5(coalesce(text, '') || '!'))[1:32] ELSE fp END AS fingerprint, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE 'old' END AS version FROM o JOIN documents USING (doc_id)""")
def upload_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads by name and content: every third is sent again, every fifth with another content."""
    d = C.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id")).alias("file_name"), F.coalesce("text", F.lit("")).alias("content"))
    old = files.uploads(d.withColumn("version", F.lit("old")))
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    new = files.uploads(d.where("doc_id % 3 = 0 OR doc_id % 5 = 0").withColumn("content", changed).withColumn("version", F.lit("new")))
    return files.append_uploads(old, new).select("file_name", "fingerprint", "version")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 3 HOUR <= (SELECT max(ts) FROM events) GROUP BY 1, 2")
def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream and counted by the hour; windows are written once the watermark has passed them."""
    folder, out = _own(spark, "feed"), _own(spark, "counts")
    C.table(spark, sf_dir, "events").write.parquet(folder)
    stream = feeds.read_events(spark, folder, C.table(spark, sf_dir, "events").schema)
    feeds.run_to_table(feeds.windowed_counts(stream), out, _own(spark, "at"))
    return spark.read.parquet(out).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


# ---- rules and programmes as tables; the last rule is one that a user has added as a row

_ADDED = ("large_sums_are_seen", "amount_test", "order_amount", "order_amount < 400000", "WARNING")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = C.table(spark, sf_dir, "lineitem")
    q, a = F.col("l_quantity").cast("decimal(18,2)"), F.col("l_extendedprice").cast("decimal(18,2)")
    is_receipt, is_invoice = F.col("l_linestatus") == "F", F.col("l_returnflag") != "R"
    own = li.groupBy(F.col("l_orderkey").alias("business_id")).agg(
        F.sum(q).alias("order_quantity"), F.sum(F.when(is_receipt, q)).alias("receipt_quantity"), F.sum(F.when(is_invoice, q)).alias("invoice_quantity"), F.sum(F.when(is_invoice, a)).alias("invoice_amount"),
        F.count_if(is_receipt).alias("receipt_count"), F.count_if(is_invoice).alias("invoice_count"), F.max(F.when(is_receipt, F.to_date("l_shipdate"))).alias("receipt_date"), F.count_if(F.col("l_shipdate").isNull()).alias("foreign_count"),
    )
    orders = C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("business_id"), F.lit(1).alias("order_count"), F.col("o_totalprice").cast("decimal(18,2)").alias("order_amount"), F.to_date("o_orderdate").alias("posting_date"), "o_orderpriority")
    return orders.join(own, "business_id", "left")


@query("""WITH l AS (SELECT l_orderkey, sum(CAST(l_quantity AS DECIMAL(18,2))) AS oq, sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (WHERE l_linestatus = 'F') AS rq, sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (WHERE l_returnflag <> 'R') AS iq, sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag <> 'R') AS ia,
count(*) FILTER (WHERE l_linestatus = 'F') AS rc, count(*) FILTER (WHERE l_returnflag <> 'R') AS ic, max(CAST(l_shipdate AS DATE)) FILTER (WHERE l_linestatus = 'F') AS rd, count(*) FILTER (WHERE l_shipdate IS NULL) AS fc FROM lineitem GROUP BY 1),
f AS (SELECT o_orderkey AS business_id, o_orderpriority, CAST(o_totalprice AS DECIMAL(18,2)) AS oa, CAST(o_orderdate AS DATE) AS pd, l.* FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
w AS (SELECT *, CASE WHEN rc IS NULL THEN 3 WHEN rc > 0 AND ic > 0 THEN 4 ELSE 2 END AS docs, CASE WHEN fc IS NULL THEN 3 WHEN fc = 0 THEN 4 ELSE 1 END AS gate,
least(CASE WHEN oq IS NULL OR rq IS NULL THEN 3 WHEN abs(oq - rq) <= 0.01 * greatest(abs(oq), abs(rq)) THEN 4 ELSE 1 END, CASE WHEN rq IS NULL OR iq IS NULL THEN 3 WHEN abs(rq - iq) <= 0.01 * greatest(abs(rq), abs(iq)) THEN 4 ELSE 1 END, CASE WHEN oa IS NULL OR ia IS NULL THEN 3 WHEN abs(oa - ia) <= 0.02 * greatest(abs(oa), abs(ia)) THEN 4 ELSE 1 END) AS tri,
CASE WHEN rd IS NULL OR pd IS NULL THEN 3 WHEN year(rd) = year(pd) THEN 4 ELSE 1 END AS cut, CASE WHEN oa IS NULL THEN 3 WHEN oa < 400000 THEN 4 ELSE 2 END AS amt FROM f),
p AS (SELECT business_id, o_orderpriority, unnest([struct_pack(n := 'evidence_chain', s := least(docs, CASE WHEN oa IS NOT NULL AND pd IS NOT NULL THEN 4 ELSE 2 END)), struct_pack(n := 'relations_gate4', s := gate), struct_pack(n := 'three_way', s := tri), struct_pack(n := 'three_way_cutoff', s := cut), struct_pack(n := 'amount_test', s := amt), struct_pack(n := 'contract_terms', s := 3)]) AS p FROM w),
m(goal, assertion, progs) AS (VALUES ('gospd01010', 'occurrence', 'evidence_chain,relations_gate4,three_way'), ('gospd01010', 'accuracy', 'amount_test,three_way'), ('gospd01010', 'cutoff', 'three_way_cutoff'), ('gospd01010', 'contract_clarity', 'contract_terms'), ('gospd01030', 'cutoff', 'evidence_chain,relations_gate4,three_way_cutoff'), ('gospd01030', 'occurrence_sample', 'evidence_chain,relations_gate4'), ('gospd01030', 'ar_period', 'three_way_cutoff'))
SELECT business_id, goal, assertion, ['FAIL', 'WARNING', 'NOT_TESTED', 'PASS'][min(p.s)] AS status, coalesce(string_agg(p.n, ',' ORDER BY p.n) FILTER (WHERE p.s = 3), '') AS untested
FROM p JOIN m ON list_contains(string_split(progs, ','), p.n) AND (goal = 'gospd01010' OR o_orderpriority IN ('1-URGENT', '2-HIGH')) GROUP BY 1, 2, 3""")
def programme_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's assertions under its goals, by the rules there are and one more that is given as a row."""
    facts = _facts(spark, sf_dir)
    added = spark.createDataFrame([_ADDED], "rule_id string, programme string, needs string, passes string, otherwise string")
    results = K.evaluate(facts, ["business_id"], [*K.RULES, *K.rules_of(added)])
    also = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.array(F.lit("gospd01010"), F.lit("gospd01030"))).otherwise(F.array(F.lit("gospd01010")))
    goals = facts.select("business_id", F.explode(also).alias("goal"))
    return K.programme_matrix(goals, results, ["business_id"]).drop("cannot_claim")


# ---- decisions on the lines' events, and what follows from them

_DECIDED = """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS chain_id, ['DECIDE_ADVISORY', 'REVIEW_FIELD', 'DECIDE_FINDING', 'REVIEW_SAMPLE', 'REVIEW_EVIDENCE', 'REVIEW_SAMPLE', 'DECIDE_ADVISORY'][l_linenumber] AS action_kind, CASE WHEN l_shipdate < TIMESTAMP '1996-01-01' AND l_linenumber = 5 THEN 'MISSING_DOCUMENT' ELSE 'OTHER' END AS event_type,
CASE l_returnflag WHEN 'A' THEN 'ACCEPT_AI' WHEN 'R' THEN CASE WHEN l_linenumber <= 2 THEN 'MANUAL_VALUE' ELSE 'AUDIT_FAIL' END ELSE CASE WHEN l_linenumber IN (4, 6) THEN 'FALSE_NEGATIVE' ELSE 'DOCUMENT_ISSUE' END END AS decision, CASE WHEN l_discount > 0.02 THEN 'seen' ELSE '' END AS reason,
CASE WHEN l_tax > 0.01 THEN CAST(l_partkey AS VARCHAR) END AS value, CASE WHEN l_tax < 0.07 THEN concat('f', CAST(l_orderkey AS VARCHAR)) END AS file_name, l_quantity FROM lineitem"""


@query(f"""WITH d AS ({_DECIDED}), one AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY l_quantity, decision, reason, value, file_name) = 1),
p AS (SELECT *, value IS NOT NULL AND decision = 'MANUAL_VALUE' AS puts, CASE WHEN decision IN ('AUDIT_FAIL', 'FALSE_NEGATIVE', 'DOCUMENT_ISSUE') AND reason = '' THEN 'REASON_MISSING' WHEN decision = 'MANUAL_VALUE' AND value IS NULL THEN 'VALUE_MISSING' WHEN event_type = 'MISSING_DOCUMENT' THEN 'UPLOAD_NEEDED'
WHEN NOT CASE action_kind WHEN 'DECIDE_ADVISORY' THEN decision IN ('ACCEPT_AI', 'OVERRIDE', 'MANUAL_VALUE') WHEN 'REVIEW_FIELD' THEN decision IN ('ACCEPT_AI', 'OVERRIDE', 'MANUAL_VALUE') WHEN 'DECIDE_FINDING' THEN decision IN ('AUDIT_FAIL', 'DOCUMENT_ISSUE') WHEN 'REVIEW_EVIDENCE' THEN decision = 'DOCUMENT_ISSUE' ELSE decision IN ('CORRECT', 'FALSE_NEGATIVE', 'ACCEPT_AI', 'AUDIT_FAIL', 'DOCUMENT_ISSUE') END THEN 'NOT_ALLOWED'
WHEN value IS NOT NULL AND decision = 'MANUAL_VALUE' AND file_name IS NULL THEN 'NO_PLACE' END AS problem FROM one)
SELECT 'record' AS kind, CAST(id AS VARCHAR) AS id, coalesce(problem, 'RESOLVED') AS what FROM p UNION ALL SELECT 'finding', concat('qf:', CAST(id AS VARCHAR)), reason FROM p WHERE problem IS NULL AND action_kind = 'REVIEW_SAMPLE' AND decision IN ('FALSE_NEGATIVE', 'AUDIT_FAIL')
UNION ALL SELECT 'value', file_name, value FROM p WHERE problem IS NULL AND puts UNION ALL SELECT 'advice', concat('c', CAST(id AS VARCHAR)), CASE WHEN decision = 'ACCEPT_AI' THEN 'VERIFIED' ELSE 'REJECTED' END FROM p WHERE problem IS NULL AND action_kind = 'DECIDE_ADVISORY'
UNION ALL SELECT DISTINCT 'stale', CAST(chain_id AS VARCHAR), unnest(CASE WHEN action_kind = 'REVIEW_SAMPLE' AND decision IN ('FALSE_NEGATIVE', 'AUDIT_FAIL') THEN ['conclusion', 'workbook'] WHEN puts AND action_kind = 'REVIEW_FIELD' THEN ['fields', 'evidence', 'tests', 'conclusion', 'workbook'] ELSE ['tests', 'conclusion', 'workbook'] END) FROM p WHERE problem IS NULL AND (puts OR action_kind <> 'DECIDE_ADVISORY' OR decision = 'ACCEPT_AI') AND (puts OR action_kind <> 'REVIEW_FIELD')""")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision on an event of every line: what is recorded, found, put, advised and stale."""
    kinds = F.array(*map(F.lit, ["DECIDE_ADVISORY", "REVIEW_FIELD", "DECIDE_FINDING", "REVIEW_SAMPLE", "REVIEW_EVIDENCE", "REVIEW_SAMPLE", "DECIDE_ADVISORY"]))
    flag, n = F.col("l_returnflag"), F.col("l_linenumber")
    li = C.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + n).alias("id"), F.col("l_orderkey").alias("chain_id"), F.get(kinds, n - 1).alias("action_kind"), F.when((F.col("l_shipdate") < "1996-01-01") & (n == 5), "MISSING_DOCUMENT").otherwise("OTHER").alias("event_type"),
        F.when(flag == "A", "ACCEPT_AI").when(flag == "R", F.when(n <= 2, "MANUAL_VALUE").otherwise("AUDIT_FAIL")).when(n.isin(4, 6), "FALSE_NEGATIVE").otherwise("DOCUMENT_ISSUE").alias("decision"), F.when(F.col("l_discount") > 0.02, "seen").otherwise("").alias("reason"),
        F.when(F.col("l_tax") > 0.01, F.col("l_partkey").cast("string")).alias("value"), F.when(F.col("l_tax") < 0.07, F.concat(F.lit("f"), F.col("l_orderkey").cast("string"))).alias("file_name"), "l_quantity",
    )
    # event_type settles what the SQL's order leaves open, so a run does not depend on how rows are stored
    nulls_last = F.struct(F.col("l_quantity").isNull().alias("c"), "l_quantity", "decision", "reason", F.col("value").isNull().alias("a"), "value", F.col("file_name").isNull().alias("b"), "file_name", "event_type")
    one = li.groupBy("id").agg(F.min_by(F.struct("chain_id", "action_kind", "event_type", "decision", "reason", "value", "file_name"), nulls_last).alias("o")).select(F.col("id").cast("string").alias("event_id"), "o.*")
    of = F.when(F.col("action_kind").isin("DECIDE_ADVISORY"), F.concat(F.lit("advisory:c"), "event_id")).otherwise("rule")
    events = one.select("event_id", "chain_id", "event_type", "action_kind", of.alias("source_ref"), "file_name", F.lit("quantity").alias("field_name"), F.lit("a").alias("observed"), F.lit("b").alias("suggested"), F.when(F.col("action_kind") != "REVIEW_FIELD", F.array(F.lit("tests"))).alias("invalidates"))
    made = decisions.effects(events, one.select("event_id", F.lit(1).alias("seq"), "decision", "reason", F.lit("me").alias("operator"), "value"))
    row = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), F.col(a).cast("string").alias("id"), b.alias("what"))
    out = row(made.records, "record", "event_id", F.coalesce("problem", "state")).unionByName(row(made.findings, "finding", "finding_id", F.col("reason"))).unionByName(row(made.values, "value", "file_name", F.col("value")))
    return out.unionByName(row(made.advice, "advice", "candidate_id", F.col("status"))).unionByName(row(made.stale, "stale", "chain_id", F.col("stage")))


_ALLOCATED = "SELECT o_orderkey AS business_id, CASE o_orderstatus WHEN 'F' THEN '销售商品并提供安装' WHEN 'O' THEN '交付货物' END AS contract, CASE o_orderpriority WHEN '1-URGENT' THEN 'REBATE_TERM_AMBIGUOUS' WHEN '2-HIGH' THEN 'CONTRACT_MISSING' END AS code, CASE WHEN o_totalprice > 300000 THEN false WHEN o_totalprice > 50000 THEN true END AS price, CASE o_orderpriority WHEN '1-URGENT' THEN 'PASS' WHEN '3-MEDIUM' THEN 'FAIL' WHEN '5-LOW' THEN 'WARNING' END AS amount, CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS gaps FROM orders"


@query(f"""WITH a AS ({_ALLOCATED}), l AS (SELECT l_orderkey, l_partkey * 10 + l_linenumber AS id, ['payment', 'contract', 'receipt', 'order', 'invoice', 'delivery', 'other'][l_suppkey % 7 + 1] AS kind, CASE WHEN l_quantity > 10 THEN l_extendedprice END AS amount FROM lineitem),
b AS (SELECT * FROM l WHERE kind NOT IN ('contract', 'other') QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY list_position(['order', 'invoice', 'payment', 'delivery', 'receipt'], kind), id, amount IS NOT NULL) = 1)
SELECT business_id, CASE WHEN kind IS NULL THEN 'Not applicable 不适用' ELSE 'Applicable 适用' END AS applicable, coalesce(CASE kind WHEN 'order' THEN '销售订单' WHEN 'invoice' THEN '增值税发票/商业发票' WHEN 'payment' THEN '银行回款单' WHEN 'delivery' THEN '销售发货单' WHEN 'receipt' THEN '客户签收/验收单' END, '') AS file_type, coalesce(CAST(id AS VARCHAR), '') AS file_index, coalesce(b.amount IS NOT NULL, false) AS has_amount,
coalesce(contract = '销售商品并提供安装', false) AS several, coalesce(code = 'REBATE_TERM_AMBIGUOUS', false) AS variable, CASE WHEN gaps > 0 OR price = false OR a.amount = 'FAIL' THEN false WHEN price AND (a.amount IS NULL OR a.amount = 'PASS') THEN true END AS all_steps FROM a LEFT JOIN b ON l_orderkey = business_id""")
def price_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that bears out each order's price, and the assertions on its allocation."""
    kinds = F.array(*map(F.lit, ["payment", "contract", "receipt", "order", "invoice", "delivery", "other"]))
    ident = F.col("l_partkey") * 10 + F.col("l_linenumber")
    docs = C.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("business_id"), ident.alias("doc_id"), F.get(kinds, (F.col("l_suppkey") % 7).cast("int")).alias("doc_type"), ident.cast("string").alias("number"), F.when(F.col("l_quantity") > 10, F.col("l_extendedprice")).alias("amount"))
    docs = docs.groupBy("business_id", "doc_type", "doc_id").agg(F.min_by(F.struct("number", "amount"), F.col("amount").isNotNull()).alias("d")).select("business_id", "doc_type", "doc_id", "d.*")
    own = C.table(spark, sf_dir, "orders").selectExpr(*_split_columns(_ALLOCATED))
    codes = F.array_compact(F.array("code"))
    made = own.select("business_id", assertions.allocation_criteria(F.col("contract"), codes).alias("c"), assertions.allocation_steps(F.col("price"), F.col("amount"), F.col("gaps")).alias("all_steps"))
    return assertions.other_files(own, docs).join(made, "business_id").select("business_id", "applicable", "file_type", "file_index", "has_amount", "c.several", "c.variable", "all_steps")


def _split_columns(select: str) -> list[str]:
    """The columns of a SELECT whose expressions hold no commas."""
    return select.removeprefix("SELECT ").rpartition(" FROM ")[0].split(", ")
