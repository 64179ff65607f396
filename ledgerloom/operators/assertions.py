"""Assertions on contracts and prices, and the status of a chain's comparisons, as expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Issues that concern what a contract promises, and words that name more of them.
OBLIGATION_ISSUES = (
    "PERFORMANCE_OBLIGATION_BOUNDARY_UNCLEAR", "SOFTWARE_SERVICE_BOUNDARY_UNCLEAR", "TOOLING_AND_GOODS_BOUNDARY_UNCLEAR",
    "STAND_READY_SERVICE_UNCLEAR", "CONTRACT_MISSING", "EVIDENCE_PACK_MISSING",
)
# Documents that bear out a price, the best first.
PRICE_DOCUMENTS = ("order", "invoice", "payment", "delivery", "receipt")
# Statuses of comparisons, the mildest first, and the concepts that decide a three-way match.
STATUSES = ("PASS", "PASS_WITH_WARNING", "MISSING_EVIDENCE", "CONFLICT")
ESSENTIAL = ("order_reference", "seller_identity", "buyer_identity", "goods_identity", "quantity", "gross_amount")


def obligation_issues(codes: Column) -> Column:
    return F.filter(codes, lambda c: c.isin(*OBLIGATION_ISSUES) | F.upper(c).rlike("PERFORMANCE|OBLIGATION"))


def performance_obligation(has_contract: Column, dimension: Column, codes: Column, status: Column) -> Column:
    """struct<verdict boolean, dimension string>: whether a contract's obligations are distinct.

    Without a contract they are not; nor where their dimension is AMBIGUOUS or an issue concerns them. A CLEAR dimension
    is a yes whatever the other dimensions say. Where no dimension is given, the status of the whole contract counts: PASS
    is a yes, anything else is open (null).
    """
    none = ~F.coalesce(has_contract, F.lit(False)) | F.coalesce(dimension == "MISSING", F.lit(False)) | F.array_contains(codes, "CONTRACT_MISSING")
    unclear = F.coalesce(dimension == "AMBIGUOUS", F.lit(False)) | (F.size(obligation_issues(codes)) > 0)
    made = lambda verdict, d: F.struct(F.lit(verdict).cast("boolean").alias("verdict"), d.cast("string").alias("dimension"))
    return (
        F.when(none, made(False, F.coalesce(dimension, F.lit("MISSING"))))
        .when(unclear, made(False, F.lit("AMBIGUOUS")))
        .when((dimension == "CLEAR") | (dimension.isNull() & (F.upper(F.trim(status)).isin("PASS", "OK", "通过"))), made(True, F.lit("CLEAR")))
        .otherwise(made(None, F.lit(None)))
    )


def price_document(docs: DataFrame, group: str = "business_id", kind: str = "doc_type", number: str = "number", amount: str = "amount", order: str = "doc_id") -> DataFrame:
    """(group, file_type, file_index, has_amount): the best document of each group that bears out its price, the first of
    its kind. Groups without one have no row."""
    place = F.array_position(F.array(*map(F.lit, PRICE_DOCUMENTS)), F.col(kind))
    best = docs.where(F.col(kind).isin(*PRICE_DOCUMENTS)).groupBy(group).agg(F.min_by(F.struct(F.col(kind).alias("file_type"), F.col(number).alias("file_index"), F.col(amount).isNotNull().alias("has_amount")), F.struct(place, F.col(order))).alias("b"))
    return best.select(group, "b.*")


def worst(status: Column) -> Column:
    """The gravest of a group's statuses, as an aggregate; PASS if there is none, unknown ones aside."""
    at = F.array_position(F.array(*map(F.lit, STATUSES)), status)
    return F.coalesce(F.max_by(F.when(at > 0, status), F.when(at > 0, at)), F.lit("PASS"))


def comparison_status(concepts: DataFrame, lines: DataFrame, issues: DataFrame, cutoffs: DataFrame, chain: str = "chain_id") -> DataFrame:
    """(chain, three_way_status, cutoff_status, overall_status) of every chain that has a concept.

    concepts: (chain, concept, result), of which the essential ones decide; lines: (chain, quantity_result, amount_result,
    unit_result), a FAIL is a CONFLICT and an open quantity MISSING_EVIDENCE; issues: (chain), which turn a PASS into
    PASS_WITH_WARNING; cutoffs: (chain, status), FAIL being a CONFLICT, PASS a PASS, anything else NOT_TESTED.
    """
    fail = (F.col("quantity_result") == "FAIL") | (F.col("amount_result") == "FAIL") | (F.col("unit_result") == "FAIL")
    told = concepts.select(chain, F.when(F.col("concept").isin(*ESSENTIAL), F.col("result")).alias("s"))
    told = told.unionByName(lines.select(chain, F.when(fail, "CONFLICT").when(F.col("quantity_result") == "REVIEW", "MISSING_EVIDENCE").alias("s")))
    chains = concepts.select(chain).distinct()
    three = chains.join(told.groupBy(chain).agg(worst(F.col("s")).alias("three")), chain)
    wide = three.join(issues.select(chain).distinct().withColumn("warned", F.lit(True)), chain, "left").join(cutoffs.groupBy(chain).agg(F.max("status").alias("cut")), chain, "left")
    three_way = F.when((F.col("three") == "PASS") & F.coalesce("warned", F.lit(False)), "PASS_WITH_WARNING").otherwise(F.col("three"))
    cut = F.when(F.upper("cut") == "FAIL", "CONFLICT").when(F.upper("cut") == "PASS", "PASS").otherwise("NOT_TESTED")
    return wide.select(chain, three_way.alias("three_way_status"), cut.alias("cutoff_status"), F.when(cut == "CONFLICT", "CONFLICT").otherwise(three_way).alias("overall_status"))


# What a paper calls the documents that bear out a price, and whether there is one.
DOCUMENT_LABELS = {"order": "销售订单", "invoice": "增值税发票/商业发票", "payment": "银行回款单", "delivery": "销售发货单", "receipt": "客户签收/验收单"}
APPLICABLE, NOT_APPLICABLE = "Applicable 适用", "Not applicable 不适用"
# Words of goods and of services in a contract, issues that make a price variable, and what a paper says.
GOODS, SERVICES = ("销售", "交付", "商品", "货物", "产品"), ("安装", "调试", "培训", "技术支持", "服务", "驻场", "维保")
VARIABLE_ISSUES = ("VARIABLE_CONSIDERATION_UNRESOLVED", "REBATE_TERM_AMBIGUOUS", "CONSIDERATION_FORMULA_AMBIGUOUS")
CRITERIA_NOT_MET = "Criteria not met不满足标准"


def other_files(businesses: DataFrame, docs: DataFrame, group: str = "business_id", **names: str) -> DataFrame:
    """(group, applicable, file_type, file_index, has_amount) of every business: the document that bears out its price under
    the paper's names, or that there is none."""
    best = businesses.select(group).distinct().join(price_document(docs, group, **names), group, "left")
    label = F.create_map(*(F.lit(x) for kv in DOCUMENT_LABELS.items() for x in kv))
    return best.select(group, F.when(F.col("file_type").isNotNull(), APPLICABLE).otherwise(NOT_APPLICABLE).alias("applicable"), F.coalesce(F.try_element_at(label, "file_type"), F.lit("")).alias("file_type"), F.coalesce(F.col("file_index").cast("string"), F.lit("")).alias("file_index"), F.coalesce("has_amount", F.lit(False)).alias("has_amount"))


def allocation_criteria(contract: Column, codes: Column) -> Column:
    """struct<met, label, several, variable>: whether a discount may be allocated to some obligations only. That takes
    evidence of three kinds that no document here gives, so the criteria are not met; several says that the contract tells
    of goods and services both, variable that an issue makes its price variable: both are to be looked at by a person."""
    holds = lambda words: F.coalesce(contract.rlike("|".join(words)), F.lit(False))
    variable = F.coalesce(F.arrays_overlap(codes, F.array(*map(F.lit, VARIABLE_ISSUES))), F.lit(False))
    return F.struct(F.lit(False).alias("met"), F.lit(CRITERIA_NOT_MET).alias("label"), (holds(GOODS) & holds(SERVICES)).alias("several"), variable.alias("variable"))


def allocation_steps(price: Column, amount_status: Column, gaps: Column) -> Column:
    """Whether all steps of the allocation's test found nothing: no with a gap, a wrong price or a failed amount; yes with a
    right price and an amount that passed or was not asked for; else open."""
    no = (gaps > 0) | F.coalesce(~price, F.lit(False)) | F.coalesce(amount_status == "FAIL", F.lit(False))
    yes = F.coalesce(price, F.lit(False)) & (amount_status.isNull() | amount_status.isin("PASS", "SKIPPED"))
    return F.when(no, False).when(yes, True)
