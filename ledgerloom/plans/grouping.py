"""Queries on entities, duplicates, ranking, pages and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import dates, ids, numbers
from ledgerloom.operators import dedupe, entities, ranking, segmentation
from ledgerloom.plans import canonical as C
from ledgerloom.plans.registry import query

# ---- identifiers, numbers and dates in text

_MESSY = "CASE o_orderkey % 6 WHEN 0 THEN ' so' || o_orderkey || '-' || o_custkey || 'I' WHEN 1 THEN 'S0' || (o_orderkey + 10) || 'O' || o_custkey WHEN 2 THEN 'po_' || o_orderkey || 'l' WHEN 3 THEN 'ht 20' || o_custkey || 'O' WHEN 4 THEN 'x' || o_orderkey ELSE CAST(o_orderkey AS {s}) END"
_NORMAL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper({c}), '\\s', '', 'g'), '^S0([0-9][0-9])', 'SO\\1'), '([0-9])[IL]$', '\\11'), '([0-9])O([0-9]|$)', '\\10\\2', 'g'), '([0-9])O([0-9]|$)', '\\10\\2', 'g')"


@query(f"""WITH m AS (SELECT o_orderkey AS id, {_MESSY.format(s='VARCHAR')} AS raw FROM orders), n AS (SELECT id, {_NORMAL.format(c='raw')} AS normal FROM m)
SELECT id, normal, regexp_replace(normal, '[-_\\s]', '', 'g') AS compact, length(normal) >= 6 AND regexp_matches(normal, '^[A-Z]{{2,4}}[-_]?[0-9]{{2,}}([-_][0-9]+)*$') AS looks FROM n""")
def biz_id_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_MESSY.format(s="STRING")).alias("raw"))
    return raw.select("id", ids.normalize_id(F.col("raw")).alias("normal"), ids.compact_id(F.col("raw")).alias("compact"), ids.looks_like_id(F.col("raw")).alias("looks"))


_WRITTEN = """CASE o_orderkey % 7 WHEN 0 THEN printf('%.2f', o_totalprice) WHEN 1 THEN replace(printf('%.2f', o_totalprice), '.', ',') WHEN 2 THEN '1.234.' || (100 + o_orderkey % 900)
 WHEN 3 THEN '12,345.' || (o_orderkey % 100) WHEN 4 THEN '9.876,' || (10 + o_orderkey % 90) WHEN 5 THEN 'total ' || o_custkey || '.5 yuan' ELSE 'none' END"""


@query(f"""WITH w AS (SELECT o_orderkey AS id, o_orderkey % 7 AS k, {_WRITTEN} AS raw FROM orders),
n AS (SELECT *, regexp_replace(regexp_extract(raw, '-?[0-9][0-9.,]*'), '[.,]+$', '') AS t FROM w)
SELECT id, TRY_CAST(CASE k WHEN 1 THEN CASE WHEN regexp_matches(t, '^-?[0-9]{{1,6}},[0-9]{{1,2}}$') THEN replace(t, ',', '.') ELSE replace(t, ',', '') END WHEN 2 THEN replace(t, '.', '') WHEN 3 THEN replace(t, ',', '') WHEN 4 THEN replace(replace(t, '.', ''), ',', '.') WHEN 6 THEN NULL ELSE t END AS DOUBLE) AS number FROM n""")
def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_WRITTEN).alias("raw"))
    return raw.select("id", numbers.parse_number(F.col("raw")).alias("number"))


_SIGNED = """concat('signed on ', CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%-m/%-d') WHEN 2 THEN strftime(o_orderdate, '%Y%m%d') WHEN 3 THEN strftime(o_orderdate, '%-m/%-d/%Y') ELSE strftime(o_orderdate, '%Y年%-m月%-d日') END, ' by both')"""
_YEAR_FIRST, _EIGHT, _YEAR_LAST = r"([12][0-9]{3})\s*[-/.年]\s*([0-9]{1,2})\s*[-/.月]\s*([0-9]{1,2})", "(?:^|[^0-9])([12][0-9]{3})([01][0-9])([0-3][0-9])(?:[^0-9]|$)", "(?:^|[^0-9])([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([12][0-9]{3})"
_MADE = "(CASE WHEN regexp_matches(text, '{p}') THEN TRY_CAST(concat_ws('-', regexp_extract(text, '{p}', {y}), lpad(regexp_extract(text, '{p}', {m}), 2, '0'), lpad(regexp_extract(text, '{p}', {d}), 2, '0')) AS DATE) END)"


@query(f"""WITH t AS (SELECT o_orderkey AS id, {_SIGNED} AS text, CASE WHEN o_orderkey % 2 = 0 THEN concat('within ', CAST(o_orderkey % 97 AS VARCHAR), ' days') ELSE 'at sight' END AS terms FROM orders)
SELECT id, CAST(coalesce({_MADE.format(p=_YEAR_FIRST, y=1, m=2, d=3)}, {_MADE.format(p=_EIGHT, y=1, m=2, d=3)}, {_MADE.format(p=_YEAR_LAST, y=3, m=1, d=2)}) AS VARCHAR) AS found, TRY_CAST(regexp_extract(terms, '([0-9]+)\\s*(?:天|日|days?)', 1) AS BIGINT) AS days FROM t""")
def date_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in five ways are read back as the date; payment days out of descriptions of terms."""
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 5
    written = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy/M/d")).when(k == 2, F.date_format(d, "yyyyMMdd")).when(k == 3, F.date_format(d, "M/d/yyyy")).otherwise(F.date_format(d, "yyyy年M月d日"))
    terms = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("within "), (F.col("o_orderkey") % 97).cast("string"), F.lit(" days"))).otherwise(F.lit("at sight"))
    own = C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("signed on "), written, F.lit(" by both")).alias("text"), terms.alias("terms"))
    return own.select("id", dates.parse_date(F.col("text")).cast("string").alias("found"), dates.payment_days(F.col("terms")).cast("long").alias("days"))


# ---- entities: the population is every seventh order; its aliases are its number and its customer's invoice series


def _named(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return orders.select(name("SO-", k + 100000).alias("business_id"), F.array(name("PO-", k + 200000)).alias("order_numbers"), F.array(name("INV-", F.col("o_custkey") + 3000000)).alias("invoice_numbers"))


def _population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(C.table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0"))


_POPULATION = """pop AS (SELECT 'SO-' || (o_orderkey + 100000) AS business_id, 'PO-' || (o_orderkey + 200000) AS po, 'INV-' || (o_custkey + 3000000) AS inv FROM orders WHERE o_orderkey % 7 = 0),
idx AS (SELECT alias, min(kind) AS kind, min(value) AS value, min(owner) AS owner, count(DISTINCT owner) AS owners FROM (
  SELECT business_id AS owner, 'business_id' AS kind, business_id AS value, replace(business_id, '-', '') AS alias FROM pop
  UNION ALL SELECT business_id, 'order_number', po, replace(po, '-', '') FROM pop UNION ALL SELECT business_id, 'invoice_number', inv, replace(inv, '-', '') FROM pop) GROUP BY 1)"""


@query("WITH " + _POPULATION.replace(" WHERE o_orderkey % 7 = 0", "") + " SELECT alias, kind, value, owner, owners FROM idx WHERE owners > 1")
def alias_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all orders."""
    return entities.alias_index(_named(C.table(spark, sf_dir, "orders"))).where("owners > 1")


# events as documents: what they declare, and a text that names something
_TEXT = """CASE event_id % 6 WHEN 0 THEN 're SO ' || (event_id + 100000) || ' see below' WHEN 1 THEN 'paid PO_' || (event_id + 200000) || '.' WHEN 2 THEN 'for inv-' || (user_id + 3000000) WHEN 3 THEN 'SO-' || (event_id + 100000) || ' and INV' || (user_id + 3000000) WHEN 4 THEN 'SO-1' || (event_id % 1000 + 10000) || 'X' ELSE 'nothing' END"""
_TOLD = "CASE WHEN event_id % 10 = 0 THEN 'so' || (event_id * 7 % 15000 + 100000) END"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = C.table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.expr(_TEXT).alias("text"), F.expr(_TOLD).alias("told"))
    return own.select("doc_id", F.array_compact(F.array(entities.alias(F.col("told")))).alias("exact"), entities.tokens_as_aliases(F.col("text")).alias("found"))


# every run of up to four neighbouring tokens, each once, in order; and the word itself or with a character less
_RUNS = "list_transform([regexp_split_to_array(p, '[-_\\s]+')], lambda ts: flatten(list_transform(range(1, len(ts) + 1), lambda i: list_transform(range(1, least(4, len(ts) - i + 1) + 1), lambda n: array_to_string(ts[i:i + n - 1], '')))))[1]"
_FORMS = "list_distinct(list_concat([{w}], list_transform(range(1, length({w}) + 1), lambda i: left({w}, i - 1) || substr({w}, i + 1))))"
_DETECTED = f"""doc AS (SELECT event_id, {_TEXT} AS text, {_TOLD} AS told FROM events),
runs AS (SELECT event_id, told, flatten(list_transform(regexp_extract_all(upper(text), '[A-Z0-9]+(?:[-_\\s]+[A-Z0-9]+)*'), lambda p: {_RUNS})) AS l FROM doc),
words AS (SELECT event_id, told, list_filter(l, lambda x, i: list_position(l, x) = i) AS found FROM runs),
each AS (SELECT event_id, unnest(found) AS d FROM words), lettered AS (SELECT DISTINCT event_id, d, regexp_extract(d, '^[A-Z]+') AS letters FROM each WHERE regexp_matches(d, '^[A-Z]')),
forms AS (SELECT event_id, d, letters, unnest({_FORMS.format(w='d')}) AS form FROM lettered), known AS (SELECT alias, regexp_extract(alias, '^[A-Z]+') AS letters, unnest({_FORMS.format(w='alias')}) AS form FROM idx WHERE regexp_matches(alias, '^[A-Z]')),
sim AS (SELECT DISTINCT event_id, d, alias FROM forms JOIN known USING (form, letters) WHERE levenshtein(d, alias) <= 1),
ev AS (SELECT event_id, regexp_replace(upper(trim(told)), '[-_\\s]', '', 'g') AS alias, true AS told FROM doc WHERE told IS NOT NULL UNION ALL SELECT event_id, d, false FROM each),
got AS (SELECT event_id, min(owner) AS a, max(owner) AS b, max(owners) AS most, min(owners) AS least FROM ev JOIN idx USING (alias) WHERE told OR CASE WHEN regexp_matches(alias, '[A-Z]') THEN length(alias) >= 4 ELSE length(alias) >= 8 AND kind = 'invoice_number' END GROUP BY 1),
near AS (SELECT DISTINCT event_id FROM sim),
res AS (SELECT words.event_id AS doc_id, found, CASE WHEN a IS NULL THEN CASE WHEN near.event_id IS NOT NULL THEN 'SIMILAR_CANDIDATE' ELSE 'UNASSIGNED' END WHEN a = b AND most = 1 THEN 'MATCHED' WHEN least = 1 THEN 'CONFLICT' ELSE 'AMBIGUOUS_ALIAS' END AS status,
  CASE WHEN a = b AND most = 1 THEN a END AS business_id FROM words LEFT JOIN got USING (event_id) LEFT JOIN near USING (event_id))"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.resolve(_documents(spark, sf_dir), entities.alias_index(_population(spark, sf_dir)))


@query(f"WITH {_POPULATION}, {_DETECTED} SELECT doc_id, status, business_id FROM res")
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


@query(f"WITH {_POPULATION}, {_DETECTED} SELECT event_id AS doc_id, d AS detected, alias FROM sim")
def alias_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.similar(_documents(spark, sf_dir), entities.alias_index(_population(spark, sf_dir)))


@query(f"""WITH {_POPULATION}, {_DETECTED}, fam AS (SELECT DISTINCT regexp_extract(business_id, '^[A-Z]+') AS prefix FROM pop)
SELECT doc_id, status, business_id, CASE WHEN status = 'MATCHED' THEN 'IN_SAMPLE' WHEN status IN ('CONFLICT', 'AMBIGUOUS_ALIAS') THEN 'MIXED_SCOPE' WHEN fam.prefix IS NOT NULL THEN 'OUT_OF_SAMPLE' ELSE 'UNRESOLVED' END AS scope
FROM res LEFT JOIN fam ON fam.prefix = regexp_extract(coalesce(found[1], ''), '^[A-Z]{{2,}}')""")
def sample_scope_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", F.regexp_extract(F.coalesce(F.get("found", F.lit(0)), F.lit("")), "^[A-Z]{2,}", 0).alias("prefix"))
    families = _population(spark, sf_dir).select(F.regexp_extract("business_id", "^[A-Z]+", 0).alias("prefix"))
    return entities.sample_scope(_resolved(spark, sf_dir).join(docs, "doc_id"), families).select("doc_id", "status", "business_id", "scope")


# orders that share references: three in a row share one, and every tenth order shares its customer's
def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    refs = F.array_compact(F.array(F.concat(F.lit("HT-"), F.floor(k / 3).cast("string")), F.when(k % 10 == 1, F.concat(F.lit("SO-"), F.col("o_custkey").cast("string")))))
    return C.table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.explode(refs).alias("ref"))


_REFS = """refs AS (SELECT o_orderkey AS d, 'HT-' || (o_orderkey // 3) AS r FROM orders UNION ALL SELECT o_orderkey, 'SO-' || o_custkey FROM orders WHERE o_orderkey % 10 = 1)"""
_ROUNDS = 12


def _inherit_sql() -> str:
    steps = ["k0 AS (SELECT o_orderkey AS d, 'B' || o_custkey AS b, 'MATCHED' AS s FROM orders WHERE o_orderkey % 50 = 0)"]
    for i in range(_ROUNDS):
        steps.append(f"w{i} AS MATERIALIZED (SELECT r, min(b) AS lo, max(b) AS hi FROM refs JOIN k{i} USING (d) WHERE b IS NOT NULL GROUP BY r)")
        steps.append(f"k{i + 1} AS MATERIALIZED (SELECT * FROM k{i} UNION ALL SELECT d, CASE WHEN min(lo) = max(hi) THEN min(lo) END, CASE WHEN min(lo) = max(hi) THEN 'INHERITED' ELSE 'CONFLICT' END FROM refs JOIN w{i} USING (r) WHERE d NOT IN (SELECT d FROM k{i}) GROUP BY d)")
    return f"WITH {_REFS}, {', '.join(steps)} SELECT d AS doc_id, b AS business_id, s AS status FROM k{_ROUNDS}"


@query(_inherit_sql())
def reference_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = C.table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("B"), F.col("o_custkey").cast("string")).alias("business_id"))
    return entities.inherit(anchors, _references(spark, sf_dir))


@query(f"""WITH RECURSIVE {_REFS}, e AS (SELECT DISTINCT a.d AS x, b.d AS y FROM refs a JOIN refs b USING (r)), reach AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
best AS (SELECT x, max(lpad(CASE WHEN starts_with(r, 'SO') THEN '1' ELSE '0' END, 1, '0') || lpad(CAST(length(r) AS VARCHAR), 4, '0') || r) AS b FROM reach JOIN refs ON refs.d = y GROUP BY x)
SELECT x AS doc_id, substr(b, 6) AS "group" FROM best""")
def business_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.business_groups(_references(spark, sf_dir), key="ref")


@query("""SELECT o_orderkey AS chain_id, o_orderkey % 7 = 0 AS in_population FROM orders""")
def population_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = C.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("so "), (F.col("o_orderkey") + 100000).cast("string")).alias("chain_id"))
    return entities.in_population(chains, _population(spark, sf_dir)).select(F.col("k").alias("chain_id"), "in_population")


# ---- duplicates, best rows, profiles, samples


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = C.table(spark, sf_dir, "orders"), C.table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'")
    text = lambda *c: F.concat_ws("-", *c)
    contracts = o.select(F.lit("contract").alias("doc_type"), text(F.lit("HT"), "o_custkey", F.year("o_orderdate")).alias("number"), F.concat(F.lit("c"), F.col("o_orderkey")).alias("file_name"), F.lit(None).cast("string").alias("invoice_ref"))
    orders = o.select(F.lit("order"), text(F.lit("SO"), "o_orderkey"), F.concat(F.lit("o"), F.col("o_orderkey")), F.when(F.col("o_orderkey") % 4 == 0, text(F.lit("INV"), "o_orderkey", F.lit(1))))
    invoices = li.select(F.lit("invoice"), text(F.lit("INV"), "l_orderkey", "l_linenumber"), text(F.lit("i"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), F.lit(None))
    return contracts.union(orders).union(invoices)


_NUMBERED = """docs AS (SELECT 'contract' AS t, 'HT-' || o_custkey || '-' || year(o_orderdate) AS n, 'c' || o_orderkey AS f, NULL AS ref FROM orders UNION ALL SELECT 'order', 'SO-' || o_orderkey, 'o' || o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'INV-' || o_orderkey || '-1' END FROM orders
  UNION ALL SELECT 'invoice', 'INV-' || l_orderkey || '-' || l_linenumber, 'i-' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber, NULL FROM lineitem WHERE l_returnflag <> 'R')"""


@query(f"""WITH {_NUMBERED} SELECT t || '_no:' || n AS finding_id, CASE t WHEN 'invoice' THEN 'DUPLICATE_INVOICE_NO' WHEN 'contract' THEN 'MULTI_VERSION_CONTRACT' ELSE 'MULTI_VERSION_ORDER' END AS issue_type,
  CASE t WHEN 'invoice' THEN 'FAIL_SIGNAL' ELSE 'WARNING' END AS severity, t || '_no' AS kind, n AS number, count(*) AS files, min(f) AS first_file FROM docs GROUP BY t, n HAVING count(*) >= 2""")
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.duplicate_findings(_numbered(spark, sf_dir))


@query(f"WITH {_NUMBERED.replace('docs AS', 'docs AS MATERIALIZED')}, i AS (SELECT DISTINCT n FROM docs WHERE t = 'invoice') SELECT f AS file_name, ref AS reference FROM docs JOIN i ON i.n = docs.ref WHERE t <> 'invoice'")
def cross_doc_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.cross_references(_numbered(spark, sf_dir)).select("file_name", "reference")


@query(f"WITH {_NUMBERED}, f AS (SELECT t FROM docs GROUP BY t, n HAVING count(*) >= 2) SELECT count(*) AS total, count(*) AS duplicates, count(*) FILTER (WHERE t = 'invoice') AS fail_signals, count(*) FILTER (WHERE t <> 'invoice') AS multi_version FROM f")
def duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.findings_summary(dedupe.duplicate_findings(_numbered(spark, sf_dir)))


@query("""WITH d AS (SELECT source, doc_id, n_chars // 500 AS s FROM documents)
SELECT source, first(doc_id ORDER BY s DESC, doc_id) AS first_best, first(doc_id ORDER BY s DESC, doc_id DESC) AS last_best, min(doc_id) AS plain FROM d GROUP BY source""")
def best_doc_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best document of each source under the three rules for ties."""
    d = C.table(spark, sf_dir, "documents").select("source", "doc_id", F.floor(F.col("n_chars") / 500).alias("s"))
    made = [ranking.best_of(d.withColumn("v", F.col("doc_id")), ["source"], "s", "doc_id", "v", tie).withColumnRenamed("v", name) for name, tie in (("first_best", "first"), ("last_best", "last"), ("plain", "plain"))]
    return made[0].join(made[1], "source").join(made[2], "source")


@query("""WITH r AS (SELECT l_orderkey, l_suppkey % 3 = 0 AS p, CAST(l_shipdate AS DATE) AS d, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 AS i FROM lineitem WHERE l_linestatus = 'F')
SELECT l_orderkey AS business_id, first(i ORDER BY p DESC, d DESC, i DESC) AS receipt FROM r GROUP BY 1""")
def latest_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100
    r = C.table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("business_id"), (F.col("l_suppkey") % 3 == 0).alias("p"), F.to_date("l_shipdate").alias("d"), i.cast("long").alias("receipt"))
    return ranking.latest(r, "business_id", "p", "d", "receipt")


@query("""WITH s AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 3 WHEN l_linestatus = 'O' THEN 2 ELSE 1 END) AS w FROM lineitem GROUP BY 1)
SELECT l_orderkey AS business_id, CASE w WHEN 3 THEN 'FAIL' WHEN 2 THEN 'WARNING' ELSE 'PASS' END AS status FROM s""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_linestatus") == "O", "WARNING").otherwise("PASS")
    return C.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("business_id")).agg(ranking.worst_status(status).alias("status"))


def _profile_sql() -> str:
    cols = {"c_custkey": 2, "c_name": 3, "c_nationkey": 0, "c_mktsegment": 0}
    rows = " UNION ALL ".join(f"SELECT '{c}' AS c, {t} AS tier, upper(regexp_replace(CAST({c} AS VARCHAR), '\\s', '', 'g')) AS v FROM customer" for c, t in cols.items())
    return f"""WITH v AS ({rows}), g AS (SELECT c, tier, count(*) AS n, count(v) AS u, count(DISTINCT v) AS d, bool_and(regexp_matches(v, '^[0-9]+(\\.0+)?$')) AS digits, sum(length(v)) AS l FROM v GROUP BY 1, 2),
r AS (SELECT *, u / n AS f, d / u AS q, l / u AS a FROM g), x AS (SELECT *, tier = 0 AND u >= 2 AND f >= 0.8 AND q >= 0.98 AND NOT digits AND a <= 40 AS byv, f >= 0.5 AND (tier = 3 OR (tier = 2 AND q >= 0.9)) AS byn FROM r)
SELECT c AS "column", tier, round(f, 3) AS fill_ratio, round(q, 3) AS unique_ratio, digits AS numeric, round(a, 3) AS average_length, round(tier * 100 + q * 20 + f * 10 + CASE WHEN byv THEN 40 ELSE 0 END, 3) AS score, byv OR byn AS accepted FROM x"""


@query(_profile_sql())
def key_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = C.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return dedupe.key_profile(own, {"c_custkey": 2, "c_name": 3})


@query("""WITH c AS (SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS d, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
s AS (SELECT CAST(o_orderkey AS VARCHAR) AS chain_id, o_totalprice / (SELECT max(o_totalprice) FROM orders) + CASE WHEN abs(datediff('day', DATE '1998-12-31', d)) <= 7 THEN 1.0::DOUBLE - abs(datediff('day', DATE '1998-12-31', d)) / 8.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN n >= 4 THEN least(n / 10.0::DOUBLE, 0.8::DOUBLE) ELSE 0.0::DOUBLE END AS score FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, sha256('job|seed|risk|' || chain_id)) AS k, count(*) OVER () AS total FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY sha256('job|seed|random|' || chain_id)) AS j FROM r WHERE k > ceil(total * 0.05))
SELECT chain_id, 'RISK' AS route, round(score, 6) AS risk_score, 'qs_' || sha256('job|seed|' || chain_id)[1:16] AS selection_id FROM r WHERE k <= ceil(total * 0.05)
UNION ALL SELECT chain_id, 'RANDOM', 0.0, 'qs_' || sha256('job|seed|' || chain_id)[1:16] FROM o WHERE j <= ceil(total * 0.02)""")
def quality_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = C.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    orders = C.table(spark, sf_dir, "orders")
    most = F.lit(orders.agg(F.max("o_totalprice")).first()[0])
    own = orders.join(lines, "o_orderkey", "left")
    score = ranking.risk_score(F.col("o_totalprice"), most, F.datediff(F.to_date("o_orderdate"), F.lit("1998-12-31").cast("date")), F.coalesce("n", F.lit(0)))
    return ranking.quality_sample(own.select(F.col("o_orderkey").alias("chain_id"), score.alias("score")), 0.05, 0.02, "seed", "job")


@query("""WITH c AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders),
t AS (SELECT o_custkey, unnest(['O' || o_orderkey, 'Y' || year(d)]) AS a, d, o_orderkey FROM c), f AS (SELECT o_custkey, a, min(strftime(d, '%Y-%m-%d') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || CASE WHEN a[1] = 'O' THEN '0' ELSE '1' END) AS k FROM t GROUP BY 1, 2)
SELECT o_custkey AS customer, min(arg) AS first_order, string_agg(a, ',' ORDER BY k) AS aliases FROM (SELECT f.*, (SELECT arg_min(o_orderkey, (d, o_orderkey)) FROM c WHERE c.o_custkey = f.o_custkey) AS arg FROM f) GROUP BY 1""")
def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one customer merged: scalars of the first, aliases in the order of the rows."""
    d = F.to_date("o_orderdate")
    o = C.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.struct(d.alias("d"), F.col("o_orderkey").alias("k")).alias("at"), F.col("o_orderkey").alias("first_order"), F.array(F.concat(F.lit("O"), F.col("o_orderkey")), F.concat(F.lit("Y"), F.year(d))).alias("aliases"))
    return dedupe.merge_rows(o, "customer", "at", ["first_order"], ["aliases"]).select("customer", "first_order", F.array_join("aliases", ",").alias("aliases"))


# ---- pages and paragraphs


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as pages of files: titles, numbers and blanks by the lengths of their texts."""
    n = F.coalesce(F.length("text"), F.lit(0))
    return C.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("page"), F.when(n % 5 == 0, F.col("role")).alias("title"), F.when(n % 3 == 0, F.concat(F.lit("I"), (n % 2).cast("string"))).alias("invoice_no"), F.when(n % 4 == 0, F.concat(F.lit("SO"), (n % 7).cast("string"))).alias("order_no"), (n % 2 == 0).alias("recognised"), (n % 9 > 0).alias("legible"), (n < 60).alias("blank"))


@query()
def page_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold with a memory that every unit starts anew; held against a plain version in the tests."""
    return segmentation.segment_pages(_pages(spark, sf_dir))


@query("""WITH p AS (SELECT DISTINCT conv_id, turn FROM conversations), u AS (SELECT conv_id, CASE WHEN turn % 4 = 3 THEN turn + 100 ELSE turn END AS turn FROM p WHERE turn % 5 <> 4 UNION ALL SELECT conv_id, turn FROM p WHERE turn % 6 = 0),
n AS (SELECT conv_id, turn, count(*) AS n FROM u GROUP BY 1, 2), b AS (SELECT coalesce(p.conv_id, n.conv_id) AS f, p.turn AS w, n.n FROM p FULL JOIN n ON p.conv_id = n.conv_id AND p.turn = n.turn)
SELECT f AS file, count(*) FILTER (WHERE n IS NULL) AS missing, count(*) FILTER (WHERE w IS NULL) AS unknown, count(*) FILTER (WHERE n > 1) AS repeated FROM b GROUP BY 1""")
def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("page")).distinct()
    moved = p.where("page % 5 <> 4").withColumn("page", F.when(F.col("page") % 4 == 3, F.col("page") + 100).otherwise(F.col("page")))
    return segmentation.page_coverage(p, moved.unionByName(p.where("page % 6 = 0")))


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 1) AS p FROM documents),
u AS (SELECT doc_id, unnest(range(0, len(p))) AS seq, p FROM l) SELECT doc_id, CAST(seq AS INTEGER) AS seq, p[seq + 1] AS paragraph, sha1(doc_id || ':' || seq || ':' || p[seq + 1])[1:16] AS paragraph_id FROM u""")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.paragraphs(C.table(spark, sf_dir, "documents"))


@query("""WITH l AS (SELECT doc_id, i, CASE WHEN i % 7 = 3 THEN '## ' || p[i + 1] ELSE p[i + 1] END AS s FROM (SELECT doc_id, p, unnest(range(0, len(p))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))),
n AS (SELECT *, starts_with(s, '#') AS head, count(*) FILTER (WHERE starts_with(s, '#')) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l),
b AS (SELECT doc_id, section, max(CASE WHEN head THEN trim(regexp_replace(s, '^[# ]+', '')) END) AS title, regexp_replace(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE NOT head), ''), '^\\s+|\\s+$', '', 'g') AS body FROM n GROUP BY 1, 2)
SELECT doc_id, section, coalesce(nullif(title, ''), CAST(doc_id AS VARCHAR)) AS title, trim(body) AS body FROM b WHERE length(trim(body)) >= 12""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with every seventh line made a heading, cut at the headings."""
    lines = F.array_join(F.transform(F.split("text", r"\n"), lambda x, i: F.when(i % 7 == 3, F.concat(F.lit("## "), x)).otherwise(x)), "\n")
    return segmentation.sections(C.table(spark, sf_dir, "documents").select("doc_id", lines.alias("text")))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</(?:p|div|tr|h[1-6]|li|td|th)>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '[#*`]+', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \\t]+', ' ', 'g'), '\\n{2,}', chr(10), 'g')) AS text FROM pages""")
def page_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "pages").select("page_id", segmentation.visible_text(F.col("html")).alias("text"))
