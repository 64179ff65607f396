"""Field values and their evidence: where a value stands, whether it may be used, and whether documents agree on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import parse_number
from ledgerloom.functions.text import compact

# The concepts that documents are compared on, the fields that state them, and how these are normalised.
CONCEPTS = {
    "order_reference": (("orderNo", "salesOrderNo", "purchaseOrderNo", "relatedOrderNo"), "text"),
    "seller_identity": (("sellerName", "supplierName", "vendorName", "shipperName"), "text"),
    "buyer_identity": (("buyerName", "customerName", "consigneeName", "receiverName"), "text"),
    "seller_address": (("sellerAddress", "supplierAddress", "shipperAddress"), "text"),
    "buyer_address": (("buyerAddress", "customerAddress", "deliveryAddress", "consigneeAddress"), "text"),
    "goods_identity": (("goodsName", "productName", "itemName", "cargoName"), "text"),
    "model": (("model", "specification", "specModel", "goodsModel"), "text"),
    "quantity": (("quantity", "orderQuantity", "receiptQuantity", "invoiceQuantity", "acceptedQuantity"), "number"),
    "unit": (("unit", "quantityUnit", "goodsUnit"), "unit"),
    "currency": (("currency", "currencyCode"), "currency"),
    "gross_amount": (("totalAmount", "grossAmount", "amountWithTax", "totalWithTax"), "number"),
}
TAX_FIELDS = {"seller_identity": ("sellerTaxId", "supplierTaxId", "vendorTaxId"), "buyer_identity": ("buyerTaxId", "customerTaxId", "consigneeTaxId")}
UNITS = {"臺": "台", "pcs": "件", "pc": "件", "piece": "件", "pieces": "件", "个": "件", "公斤": "kg"}
CURRENCIES = {"RMB": "CNY", "人民币": "CNY", "￥": "CNY", "¥": "CNY", "CN¥": "CNY", "US$": "USD", "$": "USD"}


def _lookup(c: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c], c)


def normalized(value: Column, kind: Column) -> Column:
    """The value as its concept compares it: text, number, unit or currency."""
    number = F.regexp_replace(parse_number(value).cast("decimal(28,6)").cast("string"), r"\.?0+$", "")
    return F.when(kind == "number", number).when(kind == "unit", _lookup(compact(value), UNITS)).when(kind == "currency", _lookup(F.upper(F.trim(value)), CURRENCIES)).otherwise(compact(value))


def resolve_concepts(nodes: DataFrame, chain: str = "chain_id", field: str = "field_key", value: str = "value", usable: str = "usable") -> DataFrame:
    """(chain, concept, relation, status, reason): how the located values of a concept compare within a business.

    EXACT_EQUAL, NORMALIZED_EQUAL or CONTRADICTS among two or more usable values, else MISSING_EVIDENCE. Different tax
    numbers of a party contradict whatever the names say. Values are counted as least and largest, so a group of any size
    is a few values. Chains without values of a concept have no row for it.
    """
    rows = [(f, c, k, False) for c, (fields, k) in CONCEPTS.items() for f in fields] + [(f, c, "text", True) for c, fields in TAX_FIELDS.items() for f in fields]
    # the fields above, whatever the input
    known = F.broadcast(nodes.sparkSession.createDataFrame(rows, "field string, concept string, kind string, tax boolean"))
    own = nodes.select(F.col(chain).alias("chain"), F.col(field).alias("field"), F.col(value).cast("string").alias("v"), F.coalesce(F.col(usable), F.lit(False)).alias("u")).join(known, "field")
    own = own.select("chain", "concept", "tax", "u", F.lower(F.trim("v")).alias("raw"), F.nullif(normalized(F.col("v"), F.col("kind")), F.lit("")).alias("n"))
    use = F.col("u") & ~F.col("tax")
    if_ = lambda c: F.when(use, F.col(c))
    tax = F.when(F.col("u") & F.col("tax"), F.col("n"))
    got = own.groupBy("chain", "concept").agg(
        F.count_if(~F.col("tax")).alias("nodes"), F.count_if(use).alias("usable"), F.count_if(use & F.col("n").isNull()).alias("invalid"),
        F.min(if_("n")).alias("a"), F.max(if_("n")).alias("b"), F.min(if_("raw")).alias("ra"), F.max(if_("raw")).alias("rb"), F.min(tax).alias("ta"), F.max(tax).alias("tb"),
    ).where("nodes > 0")
    same = (F.col("invalid") == 0) & (F.col("a") == F.col("b"))
    taxed = F.coalesce(F.col("ta") != F.col("tb"), F.lit(False))
    few, exact = F.col("usable") < 2, F.col("ra") == F.col("rb")
    relation = F.when(taxed, "CONTRADICTS").when(few, "MISSING_EVIDENCE").when(same & exact, "EXACT_EQUAL").when(same, "NORMALIZED_EQUAL").otherwise("CONTRADICTS")
    reason = F.when(taxed, "TAX_ID_CONFLICT").when(few, "DECISION_EVIDENCE_MISSING").when(same & exact, "RAW_VALUE_EQUAL").when(same, "NORMALIZED_VALUE_EQUAL").when(F.col("concept") == "order_reference", "IDENTIFIER_MISMATCH").otherwise("DETERMINISTIC_VALUE_CONFLICT")
    status = F.when(relation == "MISSING_EVIDENCE", "CANDIDATE").when(relation == "CONTRADICTS", "CONFLICT").otherwise("CONFIRMED")
    return got.select(F.col("chain").alias(chain), "concept", relation.alias("relation"), status.alias("status"), reason.alias("reason"))


def locate(fields: DataFrame, texts: DataFrame, doc: str = "doc_id", field: str = "field_key", value: str = "value", text: str = "text") -> DataFrame:
    """(doc, field, value, char_start, char_end, anchor_status, usable, evidence_id): where the value first stands in its
    document, from 0, whatever the case. A blank value has no place."""
    v = F.trim(F.col(value).cast("string"))
    at = F.when(F.length(v) > 0, F.instr(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lower(v))).otherwise(F.lit(0))
    out = fields.select(doc, field, value).join(texts.select(doc, text), doc, "left").withColumn("__at", F.coalesce(at, F.lit(0)))
    there = F.col("__at") > 0
    mark = F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat_ws("|", F.col(doc).cast("string"), F.col(field), v, F.col("__at").cast("string")), 256), 1, 16))
    return out.select(doc, field, value, F.when(there, F.col("__at") - 1).alias("char_start"), F.when(there, F.col("__at") - 1 + F.length(v)).alias("char_end"), F.when(there, "ANCHORED").otherwise("UNLOCATED").alias("anchor_status"), there.alias("usable"), mark.alias("evidence_id"))


NUMERIC = ("quantity", "orderQuantity", "receiptQuantity", "invoiceQuantity", "amount", "totalAmount", "taxAmount", "unitPrice")
DATES = ("orderDate", "contractDate", "receiptDate", "invoiceDate", "postingDate", "acceptanceDate", "documentDate")


def typed_valid(field: Column, value: Column) -> Column:
    """Whether a value is of its field's type: numbers of 0 or more, days of the calendar; anything but blank else."""
    v = F.trim(value.cast("string"))
    number = F.regexp_replace(v, "[,¥￥]", "").try_cast("decimal(38,10)") >= 0
    part = lambda i: F.regexp_extract(v, r"([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})", i)
    day = F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd").isNotNull()
    return F.coalesce(F.length(v) > 0, F.lit(False)) & F.when(field.isin(*NUMERIC), F.coalesce(number, F.lit(False))).when(field.isin(*DATES), F.coalesce(day, F.lit(False))).otherwise(True)


def gate(located: DataFrame, role_fits: Column, field: str = "field_key", value: str = "value") -> DataFrame:
    """Adds gate: SYSTEM_VERIFIED, ROLE_CONFLICT, UNLOCATED or NEEDS_REVIEW."""
    usable = F.coalesce(F.col("usable"), F.lit(False))
    verdict = F.when(~usable, F.when(F.col("anchor_status") == "UNLOCATED", "UNLOCATED").otherwise("NEEDS_REVIEW")).when(~role_fits, "ROLE_CONFLICT").when(~typed_valid(F.col(field), F.col(value)), "NEEDS_REVIEW").otherwise("SYSTEM_VERIFIED")
    return located.withColumn("gate", verdict)


def derived_sum(lines: DataFrame, headers: DataFrame, doc: str = "doc_id", value: str = "value", usable: str = "usable", total: str = "total") -> DataFrame:
    """(doc, derived): whether every line of a document is located and has an amount, and these add up to the header's."""
    v = F.col(value).cast("decimal(28,6)")
    sums = lines.groupBy(doc).agg(F.sum(v).alias("__s"), F.bool_and(v.isNotNull() & F.coalesce(F.col(usable), F.lit(False))).alias("__ok"))
    return headers.join(sums, doc, "left").select(doc, F.coalesce(F.col("__ok") & (F.col("__s") == F.col(total).cast("decimal(28,6)")), F.lit(False)).alias("derived"))


def excerpt_in_text(excerpt: Column, text: Column, least: int = 6) -> Column:
    """Whether an excerpt of so many characters stands in a text, white space aside."""
    squeeze = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    return (F.length(F.trim(F.coalesce(excerpt, F.lit("")))) >= least) & F.contains(squeeze(text), squeeze(excerpt))


def verify_claims(claims: DataFrame, text: str = "text", codes: list[str] | None = None, files: DataFrame | None = None, least: float = 0.85, need_excerpt: bool = True) -> DataFrame:
    """Adds accepted and reject_reason to claims (issue_code, file_name, confidence, excerpt, and the source's text): a code
    or file that is not allowed, a confidence below the gate if one is given, an excerpt that the source does not have."""
    code, conf = F.trim(F.coalesce(F.col("issue_code"), F.lit(""))), F.col("confidence").try_cast("double")
    bad_code = (code != "") & ~code.isin(*codes) if codes is not None else F.lit(False)
    out, bad_file = claims, F.lit(False)
    if files is not None:
        known = files.select(F.col("file_name").alias("__file")).distinct().withColumn("__known", F.lit(True))
        out = claims.join(known, F.trim(F.col("file_name")) == F.col("__file"), "left")
        bad_file = (F.coalesce(F.trim(F.col("file_name")), F.lit("")) != "") & F.col("__known").isNull()
    quoted = excerpt_in_text(F.col("excerpt"), F.col(text))
    bad_quote = ~quoted if need_excerpt else (F.coalesce(F.trim(F.col("excerpt")), F.lit("")) != "") & ~quoted
    reason = F.when(bad_code, "code_not_allowed").when(bad_file, "file_not_in_whitelist").when(F.coalesce(conf < least, F.lit(False)), "confidence_below_gate").when(bad_quote, "excerpt_not_in_source")
    return out.withColumn("reject_reason", reason).withColumn("accepted", F.col("reject_reason").isNull()).select(*claims.columns, "accepted", "reject_reason")


def all_or_none(proposals: DataFrame, payload: str, valid: Column) -> DataFrame:
    """The rows of payloads whose every row is valid: one bad candidate rejects its whole payload."""
    good = proposals.groupBy(payload).agg(F.bool_and(F.coalesce(valid, F.lit(False))).alias("__ok")).where("__ok").select(payload)
    return proposals.join(good, payload, "left_semi")


def semantic_status(proposals: DataFrame, evidence: DataFrame, deterministic: DataFrame, key: str = "proposal_id") -> DataFrame:
    """(proposal, status): what a proposed agreement of evidence is worth. proposals: (proposal, concept, chain_id,
    evidence_id, excerpt, dimension, counter); evidence: (evidence_id, doc_id, text); deterministic: (chain_id, concept,
    status). Fewer than two valid located quotes REJECT it; a deterministic conflict stands; it is CONFIRMED with two
    dimensions and two documents and nothing against it, else a CANDIDATE."""
    met = proposals.join(evidence, "evidence_id", "left").withColumn("__ok", F.coalesce(F.col("doc_id").isNotNull() & excerpt_in_text(F.col("excerpt"), F.col("text"), 1), F.lit(False)))
    conflicts = deterministic.where("status = 'CONFLICT'").select("chain_id", "concept").distinct().withColumn("__conflict", F.lit(True))
    met = met.join(conflicts, ["chain_id", "concept"], "left")
    ok = lambda c: F.count_distinct(F.when(F.col("__ok"), F.col(c)))
    got = met.groupBy(key).agg(ok("evidence_id").alias("e"), ok("doc_id").alias("d"), ok("dimension").alias("m"), F.bool_or(F.coalesce(F.col("counter"), F.lit(False))).alias("c"), F.bool_or(F.coalesce("__conflict", F.lit(False))).alias("x"))
    return got.select(key, F.when(F.col("e") < 2, "REJECTED").when(F.col("x"), "CONFLICT").when((F.col("m") >= 2) & (F.col("d") >= 2) & ~F.col("c"), "CONFIRMED").otherwise("CANDIDATE").alias("status"))
