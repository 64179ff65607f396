"""Rules on the wording of contracts, and the type of a document or page by its words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = {"price": "交易对价", "payment": "支付条款", "performance": "履约义务", "transfer": "运输及控制权转移", "general": "综合"}

# What a clause says (every pattern of `all`, at least one of `any`) and what would make it clear (`unless`).
# Patterns ignore case.
RULES: list[dict] = [
    {"code": "CONSIDERATION_FORMULA_AMBIGUOUS", "dim": "price", "all": ["随行就市"], "unless": ["市场指数|价格指数|基准指数|调整公式|计算公式"]},
    {"code": "VARIABLE_CONSIDERATION_UNRESOLVED", "dim": "price", "any": ["(原材料|材料成本|成本).{0,30}(协商|商议).{0,20}(调价|调整|价格)", "协商.{0,10}调整.{0,10}产品价格"], "unless": ["市场指数|价格指数|基准指数|调整公式|计算公式|变动阈值"]},
    # the windows reach 28 characters before the word, whatever the length of the negation
    {"code": "REBATE_TERM_AMBIGUOUS", "dim": "price", "all": ["返利"], "unless": ["(不包含|不涉及|不承担|不存在|不属于).{0,25}返利|(不含|不得|无需|不另).{0,26}返利|(无|未).{0,27}返利"], "unless_both": (["返利.{0,80}[0-9]+(\\.[0-9]+)?\\s*%.{0,80}(采购|销售|回款|订单)", "[0-9]+(\\.[0-9]+)?\\s*%.{0,40}返利"], ["返利.{0,60}(兑现|抵扣|现金|结算方式)"])},
    {"code": "UNILATERAL_PRICE_ADJUSTMENT", "dim": "price", "any": ["(开票前|开具发票前).{0,40}(有权|可以|可).{0,20}(调整|变更).{0,20}(价格|价款)", "未提出异议.{0,12}视为接受"]},
    {"code": "PAYMENT_DUE_DATE_UNDEFINED", "dim": "payment", "all": ["货到付款"], "unless": ["(货到|到货|签收|验收).{0,30}[0-9]+\\s*(个)?(自然|日历|工作)?[日天]", "[0-9]+\\s*(个)?(自然|日历|工作)?[日天].{0,20}(付款|支付|结清)"]},
    {"code": "PAYMENT_PERIOD_AMBIGUOUS", "dim": "payment", "any": ["及时结清|及时清偿|及时付清|及时支付", "适当顺延|酌情顺延"]},
    {"code": "INSTALLMENT_TERM_UNDEFINED", "dim": "payment", "all": ["(首款|预付款|定金).{0,80}(尾款|余款)|(分期|首期|尾款).{0,40}(支付|付款)"], "either": (["另行通知|后续通知|待通知|另行确定|后续确定", "首款|尾款|预付款"], ["[0-9]+\\s*%"], ["(比例|金额|日期|节点).{0,40}(另行通知|后续通知|待通知)"])},
    {"code": "DP_TENOR_UNDEFINED", "dim": "payment", "all": ["\\bD\\s*/\\s*P\\b|\\bDP\\b.{0,20}basis|付款交单"], "unless": ["即期|远期|sight|usance|[0-9]+\\s*(banking|银行)?\\s*days?\\b|[0-9]+\\s*个?(银行)?日"]},
    {"code": "PAYMENT_TERMS_MISSING", "dim": "payment", "longer": 180, "unless": ["付款|支付|结清|结算|账期|货款|信用证|发票.{0,12}(后|前).{0,12}(付|支付)|\\bL\\s*/?\\s*C\\b|D\\s*/\\s*P|payment|payable|invoice"]},
    {"code": "PERFORMANCE_OBLIGATION_BOUNDARY_UNCLEAR", "dim": "performance", "all": ["installation|commissioning|familiarization|培训|安装|调试", "may request assistance|arrange any such assistance|可以要求|双方.*安排.*协助|另行.*安排.*(安装|调试|培训|assistance)"], "unless": ["No installation|不含安装|不承担安装|不包含安装"], "unless_both": (["sole promised output|唯一主要履约义务是交付"], ["incident|附随|不单独"])},
    {"code": "SOFTWARE_SERVICE_BOUNDARY_UNCLEAR", "dim": "performance", "any": ["may submit requests concerning updates|updates?,?\\s*adjustments? or technical support", ("功能升级|持续技术支持|持续.{0,4}支持", "(不包含|不含|不承担).{0,40}(持续技术支持|功能升级|持续.{0,4}支持)")], "unless": ["No .{0,40}feature-upgrade|不包含.{0,40}升级|仅承担标准缺陷"]},
    {"code": "TOOLING_AND_GOODS_BOUNDARY_UNCLEAR", "dim": "performance", "all": ["\\btooling\\b|模具", "tooling (design|arrangement|ownership)|trial production|试制|模具.{0,20}(交付|验收|所有权|归属)|separate accept"], "unless": ["production tool|生产工具|不出售|不交付给买方|tooling remains with|模具属于卖方|不属于交付标的"]},
    {"code": "STAND_READY_SERVICE_UNCLEAR", "dim": "performance", "any": [("是否驻场|(驻场人员|待命服务|专项改善).{0,48}(另行|书面确认|协商确定|按项目)|(提供|安排|负责|包含).{0,12}(驻场|待命)", "(不包含|不含|不承担|不涉及).{0,16}(固定)?(驻场|待命)"), ("(shall provide|will provide|includes?|undertake).{0,40}stand[-\\s]?ready", "No .{0,60}stand[-\\s]?ready|does not create a stand[-\\s]?ready|not included.{0,40}stand[-\\s]?ready")]},
    {"code": "CONTROL_TRANSFER_TRIGGER_CONFLICT", "dim": "transfer", "all": ["\\bFOB\\b", "handed over to the carrier|carrier takes cha|码头.{0,10}承运人.{0,10}接管|接管即完成交付|takes charge"]},
    {"code": "CIF_CONTROL_POINT_AMBIGUOUS", "dim": "transfer", "all": ["\\bCIF\\b", "handover condition|destination port|到港|目的港交接|confirmed by reference to the shipping documents and the handover"], "unless": ["control transfer occur when the goods are loaded on board|装船时转移|loaded on board.{0,40}control"]},
    {"code": "DAP_DELIVERY_PLACE_UNDEFINED", "dim": "transfer", "all": ["\\bDAP\\b", "area designated by the Buyer|买方指定区域|买方指定地点|Buyer.?s (site|location)|买方地点"], "unless_both": (["DAP.{0,80}([0-9]+|Warehouse|仓库|Industrial|Road|Street|路|号)"], ["Incoterms|置于买方处置|placed at the Buyer"])},
]

#: Words without one of which a rule cannot hold; in lower case. They are looked for before any pattern.
NEEDS = {
    "CONSIDERATION_FORMULA_AMBIGUOUS": ["随行就市"],
    "VARIABLE_CONSIDERATION_UNRESOLVED": ["协商", "商议"],
    "REBATE_TERM_AMBIGUOUS": ["返利"],
    "UNILATERAL_PRICE_ADJUSTMENT": ["开票前", "开具发票前", "未提出异议"],
    "PAYMENT_DUE_DATE_UNDEFINED": ["货到付款"],
    "PAYMENT_PERIOD_AMBIGUOUS": ["及时", "顺延"],
    "INSTALLMENT_TERM_UNDEFINED": ["首款", "预付款", "定金", "分期", "首期", "尾款"],
    "DP_TENOR_UNDEFINED": ["/", "dp", "付款交单"],
    "PERFORMANCE_OBLIGATION_BOUNDARY_UNCLEAR": ["installation", "commissioning", "familiarization", "培训", "安装", "调试"],
    "SOFTWARE_SERVICE_BOUNDARY_UNCLEAR": ["may submit requests concerning updates", "technical support", "功能升级", "持续"],
    "TOOLING_AND_GOODS_BOUNDARY_UNCLEAR": ["tooling", "模具"],
    "STAND_READY_SERVICE_UNCLEAR": ["驻场", "待命", "专项改善", "stand"],
    "CONTROL_TRANSFER_TRIGGER_CONFLICT": ["fob"],
    "CIF_CONTROL_POINT_AMBIGUOUS": ["cif"],
    "DAP_DELIVERY_PLACE_UNDEFINED": ["dap"],
}


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def fires(rule: dict, text: Column, low: Column | None = None) -> Column:
    """Whether a rule of RULES holds for a text; low is the text in lower case."""
    has = lambda p: text.rlike(f"(?i){p}")
    hit = lambda p: has(p[0]) & ~has(p[1]) if isinstance(p, tuple) else has(p)
    low = F.lower(text) if low is None else low
    out = _any([F.contains(low, F.lit(w)) for w in NEEDS[rule["code"]]]) if rule["code"] in NEEDS else F.lit(True)
    for p in rule.get("all", ()):
        out = out & has(p)
    if "any" in rule:
        out = out & _any([hit(p) for p in rule["any"]])
    if "longer" in rule:
        out = out & (F.length(text) >= rule["longer"]) & (F.length(F.translate(text, " \t\n\x0b\f\r", "")) >= rule["longer"])
    for p in rule.get("unless", ()):
        out = out & ~has(p)
    if "unless_both" in rule:
        a, b = rule["unless_both"]
        out = out & ~(_any([has(p) for p in a]) & _any([has(p) for p in b]))
    if "either" in rule:
        every, none, other = rule["either"]
        first = reduce(lambda x, y: x & y, [has(p) for p in every]) & ~_any([has(p) for p in none])
        out = out & (first | _any([has(p) for p in other]))
    return out


def clause_issues(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, place, issue_code, dimension): the rules that hold for each text, in their order. One pass, no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = lambda s: F.array_compact(F.array(*(F.when(fires(r, s["t"], s["low"]), F.struct(F.lit(i).alias("place"), F.lit(r["code"]).alias("issue_code"), F.lit(DIMENSIONS[r["dim"]]).alias("dimension"))) for i, r in enumerate(RULES))))
    # the lambda's argument is worked out once, not for each rule
    once = F.get(F.transform(F.array(F.struct(t.alias("t"), F.lower(t).alias("low"))), found), F.lit(0))
    return docs.select(doc, F.explode(once).alias("i")).select(doc, "i.place", "i.issue_code", "i.dimension")


def dimension_statuses(docs: DataFrame, issues: DataFrame, has_contract: Column, doc: str = "doc_id") -> DataFrame:
    """(doc, dimension, status): AMBIGUOUS with an issue, else CLEAR; MISSING without a contract."""
    seen = issues.select(doc, "dimension").distinct().withColumn("__i", F.lit(True))
    every = docs.select(doc, has_contract.alias("__c"), F.explode(F.array(*map(F.lit, DIMENSIONS.values()))).alias("dimension"))
    return every.join(seen, [doc, "dimension"], "left").select(doc, "dimension", F.when(~F.col("__c"), "MISSING").when(F.col("__i"), "AMBIGUOUS").otherwise("CLEAR").alias("status"))


def contract_status(has_contract: Column, issues: Column) -> Column:
    """WARNING for a missing contract or any issue; wording alone never fails a contract."""
    return F.when(~has_contract | (issues > 0), "WARNING").otherwise("PASS")


# Words that tell the type of a document, in the order of their precedence.
IN_TEXT = [
    ("invoice", "发票代码|发票号码|价税合计|增值税|电子发票|专用发票|普通发票|开票日期|税率|税额", None),
    ("payment", "银行流水|回款金额|收款账号|付款人名称", None),
    ("delivery", "发货单号|出库日期|承运人", "签收人|验收人|签收日期"),
    ("receipt", "签收人|验收人|收货日期|入库单号|签收日期", None),
    ("order", "订单编号|采购方|供应商|订单日期", None),
    ("contract", "合同编号|甲方|乙方|签订日期|付款条款", None),
]
IN_NAME = [
    ("invoice", "发票|税票|invoice|inv|fp", None),
    ("payment", "回款|银行流水|收款凭证|收款单|bank|payment", None),
    ("delivery", "发货单|出库单|delivery note", None),
    ("delivery", "发货", "签收|验收"),
    ("receipt", "签收|验收|入库|收货|receipt|warehouse", None),
    ("order", "订单|order|采购单|(^|[^a-z0-9])(so|po)([^a-z0-9]|$)", None),
    ("contract", "合同|contract|协议|agreement|(^|[^a-z0-9])ht([^a-z0-9]|$)", None),
]
TYPES = ("contract", "order", "delivery", "receipt", "invoice", "payment", "other")


def document_type(name: Column, text: Column, hint: Column) -> Column:
    """By the file's name, else by words of the text, else as hinted, else other."""
    low, body, told = F.lower(F.coalesce(name, F.lit(""))), F.coalesce(text, F.lit("")), F.lower(F.trim(F.coalesce(hint, F.lit(""))))
    by = lambda c, rules: F.coalesce(*(F.when(c.rlike(p) & (~c.rlike(no) if no else F.lit(True)), kind) for kind, p, no in rules))
    return F.coalesce(by(low, IN_NAME), by(body, IN_TEXT), F.when(told.isin(*TYPES), told), F.lit("other"))


# What the numbered parts and words of a file's name say of its type, in the order in which they are tried.
SUFFIXES = (
    ("contract", "[_-]0?1[_-]|合同|contract"), ("order", "[_-]0?2[_-]|订单|order"), ("delivery", "[_-]0?3[_-]|发货|delivery"),
    ("receipt", "[_-]0?4[_-]|签收|验收|receipt"), ("invoice", "[_-]0?5[_-]|发票|invoice"), ("payment", "[_-]0?6[_-]|回款|payment|银行"),
)


def light_type(name: Column, kind: Column, ids: Column) -> Column:
    """The type of a document that has been found to be no other: by the numbered part of its name, if that holds an
    identifier."""
    low = F.lower(F.coalesce(name, F.lit("")))
    by_name = F.coalesce(*(F.when(low.rlike(p), k) for k, p in SUFFIXES), F.lit("other"))
    return F.when((kind == "other") & (F.size(ids) > 0), by_name).otherwise(kind)


def score_cards(pages: DataFrame, cards: dict[str, dict], key: str = "page_id", text: str = "text", keep: int = 3) -> DataFrame:
    """(key, place, card, score, enough): the `keep` best cards of each page, ties by name.

    A card is {"identity": [...], "required": [[...], ...], "strong": [...], "contrary": [...], "need": n}: 3 for each
    identity word the page holds, 2 for each required group with one, 1 for each strong word, -2 for each contrary one.
    enough: as many required groups as needed. Cards are configuration: an expression over the text, no join.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    has = lambda w: F.contains(t, F.lit(w)).cast("int")
    total = lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0))

    def made(name: str, c: dict) -> Column:
        required = [_any([F.contains(t, F.lit(w)) for w in g]).cast("int") for g in c.get("required", ())]
        score = total([has(w) for w in c.get("identity", ())]) * 3 + total(required) * 2 + total([has(w) for w in c.get("strong", ())]) - total([has(w) for w in c.get("contrary", ())]) * 2
        return F.struct((-score).alias("m"), F.lit(name).alias("card"), score.alias("score"), (total(required) >= c.get("need", 2)).alias("enough"))

    best = F.slice(F.array_sort(F.array(*(made(n, c) for n, c in sorted(cards.items())))), 1, keep)
    return pages.select(key, F.posexplode(best).alias("place", "c")).select(key, (F.col("place") + 1).alias("place"), "c.card", "c.score", "c.enough")


def trade_facts(text: Column) -> dict[str, Column]:
    """Facts on carriage, insurance, delivery and risk that a text states."""
    has = lambda p: text.rlike(f"(?i){p}")
    recharge = has("重收费|debit note|recharge(d|s)? to|recharge 100") & ~has("\\bno recharge\\b")
    nominated = has("Buyer nominates the vessel and pays ocean")
    buyer_pays = has("buyer( nominates the vessel and)? pays ocean|Freight Collect|买方承担海运")
    seller_pays = has("seller pays ocean|finally bears ocean|seller pays freight|Freight Prepaid|卖方承担海运")
    return {
        "has_recharge": recharge,
        "arranger": F.when(has("buyer nominates|买方指定"), "buyer").when(has("seller arranges|卖方订舱|seller shall insure|seller pays ocean"), "seller").otherwise("unknown"),
        "payer": F.when(nominated, "buyer").when(recharge, "seller").when(buyer_pays, "buyer").when(seller_pays, "seller").otherwise("unknown"),
        "burden": F.when(nominated | recharge | buyer_pays, "buyer").when(seller_pays, "seller").otherwise("unknown"),
        "insurance": F.when(has("insured:\\s*seller only|beneficiary:\\s*seller|seller only"), "seller_for_self").when(has("for buyer's benefit|insured:\\s*buyer|beneficiary:\\s*buyer|claim payable to buyer"), "seller_for_buyer").otherwise("unknown"),
        "delivery_event": F.when(has("not unloaded|remain on truck|未卸货"), "arrived_ready_for_unload").when(has("shipped on board|loaded on board|已装船"), "on_board").when(has("received for shipment|container terminal"), "carrier_received"),
        "risk_event": F.when(has("risk transfers when goods are loaded on board|risk on board|risk transfers on board|装船时"), "on_board"),
        "container_no_onboard": has("received for shipment|container terminal|\\bCY\\b") & ~has("shipped on board|已装船"),
    }


def trade_status(code: Column, place: Column, version: Column, f: dict[str, Column]) -> Column:
    """Whether the named trade term fits the facts: standard_consistent, standard_modified, major_conflict or
    insufficient_evidence."""
    missing = code.isNull() | (place.isNull() & version.isNull())
    sea_box = code.isin("FOB", "CFR", "CIF") & f["container_no_onboard"]
    for_buyer = f["insurance"] == "seller_for_buyer"
    return (
        F.when(missing | sea_box | ((code == "CIF") & (f["insurance"] == "seller_for_self")), "insufficient_evidence")
        .when((code == "FOB") & (f["burden"] == "seller") & for_buyer & ~f["has_recharge"], "major_conflict")
        .when((code == "FOB") & f["has_recharge"] & (f["payer"] == "seller"), "standard_modified")
        .when((code == "FOB") & (f["arranger"] == "buyer") & f["burden"].isin("buyer", "unknown"), F.when(for_buyer & ~f["has_recharge"], "major_conflict").otherwise("standard_consistent"))
        .when((code == "CFR") & (f["burden"] == "seller") & (f["risk_event"] == "on_board"), "standard_consistent")
        .when(code == "DAP", F.when(f["delivery_event"] == "unloaded", "standard_modified").otherwise("standard_consistent"))
        .otherwise("insufficient_evidence")
    )


def trade_slot(candidates: DataFrame, doc: str = "doc_id", value: str = "value", confidence: str = "confidence", least: float = 0.90) -> DataFrame:
    """(doc, code, availability) from (doc, value, confidence): one code only is usable, UNRELIABLE if its best mention is
    unsure; several codes are UNRELIABLE."""
    code = F.upper(F.split(F.trim(F.col(value)), r"\s+")[0])
    own = candidates.select(doc, code.alias("code"), F.coalesce(F.col(confidence), F.lit(1.0)).alias("c")).where("code <> ''")
    got = own.groupBy(doc).agg(F.min("code").alias("lo"), F.max("code").alias("hi"), F.max("c").alias("c"))
    one = F.col("lo") == F.col("hi")
    return got.select(doc, F.when(one, F.col("lo")).alias("code"), F.when(one & (F.col("c") >= least), "OK").otherwise("UNRELIABLE").alias("availability"))
