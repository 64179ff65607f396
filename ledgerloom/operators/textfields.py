"""Fields of running text by labels: rules as a table, all candidates with their places, one pick a field.

A rule is (label, field, kind, priority). All labels are looked for at once, the longest first where several begin at one
place; what follows a label is read by the rule's kind. A label that ends another one ("日期" in "订单日期") is read there,
too. Candidates of a field that overlap are settled in the order of their places: one that begins inside an accepted one
goes. Of the rest the first of the best priority is the field's value.

Defined cases: null texts have no candidates; null documents are left out; equal rows give equal candidates; a label
without a value of its kind gives nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import parse_date

# What stands before a field's value. A blank in a label stands for any white space, also none.
LABELS: dict[tuple[str, str], tuple[str, ...]] = {
    ("documentNo", "code"): ("发票号码", "发票号", "采购订单号", "订单号", "入库单号", "Invoice No", "Invoice Number", "PO No", "PO Number"),
    ("documentDate", "date"): ("开票日期", "发票日期", "订单日期", "单据日期", "日期", "Invoice Date"),
    ("totalAmount", "amount"): ("订单价税合计", "价税合计", "含税总金额", "合计金额", "总金额", "金额合计", "Total Amount", "Grand Total", "合 计", "合同总价", "总价", "总价(含税)"),
    ("amount", "amount"): ("合计（不含税）", "合计不含税", "折后不含税金额", "折后不含税", "未税金额", "不含税金额合计", "不含税金额", "未税小计"),
    ("taxAmount", "amount"): ("税额", "Tax Amount"),
    ("taxRate", "percent"): ("税率",),
    ("discountRate", "discount"): ("折扣率", "折扣"),
    ("discountAmount", "amount"): ("折扣额", "优惠金额"),
    ("quantity", "number"): ("实收数量", "合格数量", "发运数量", "发货数量", "交货数量", "装船数量", "提单数量", "本批发货数量", "Quantity", "数量"),
    ("unitPrice", "amount"): ("未税单价", "单价", "Unit Price"),
    ("supplierName", "line"): ("销售方名称", "供应商名称", "供应商", "Supplier"),
    ("buyerName", "line"): ("购买方名称", "购方名称", "购买方", "买方名称", "买方", "Buyer"),
    ("orderNo", "code"): ("业务编号", "订单号", "采购订单号", "销售订单"),
    ("deliveryDate", "date"): ("签收日期", "入库日期", "验收日期", "收货日期", "交货日期"),
    ("postingDate", "date"): ("入账日期", "记账日期", "过账日期", "Posting Date"),
    ("contractNo", "code3"): ("合同编号", "合同号", "合同索引号"),
    ("transportTerms", "terms"): ("运输方式", "运输条款", "交货地点", "运费承担", "贸易术语"),
}
# Labels that count only where no Chinese character stands before them.
ALONE = ("数量",)
# Phrases that are a field's value without a label; the group is the value.
PHRASES: dict[str, tuple[str, ...]] = {
    "quantity": (r"([0-9]{2,})\s*件\s+[0-9,]+(?:\.[0-9]{1,2})?", r"(?:MAT|SKU|物料)[^\r\n]{0,48}?([0-9]{2,})\s*件"),
    "paymentTerms": (r"((?:(?:增值税)?发票)?开具之日起\s*[0-9]+\s*[日天]内[^\r\n。；]{0,40})", r"((?:签收后|验收后|票到|开票后)\s*[0-9]+\s*[日天][^\r\n。；]{0,24})", r"(电汇[^\r\n。；]{0,40}支付[^\r\n。；]{0,20})"),
    "transportTerms": (r"((?:FOB|CIF|CFR|CIP|DDP|EXW)\s+[^\r\n]{0,40})", r"(运费由(?:卖方|买方|甲方|乙方)承担[^\r\n]{0,40})"),
    "controlTransferTerms": (r"((?:货物)?控制权转移[^。\r\n；;]{8,30})",),
}
# What a header row of a detail table holds; three of them make one, and no amount is read in it.
HEADER = ("项目名称", "规格型号", "单位", "数量", "单价", "税率")

_SIGN, _CURRENCY = r"\s*[:：]?\s*", r"(?:\s*(?:人民币|RMB|CNY))?"
#: How a value of each kind is written after its label.
KINDS = {
    "code": _SIGN + r"([A-Z0-9][A-Z0-9_-]{3,})",
    "code3": _SIGN + r"([A-Z0-9][A-Z0-9_-]{2,})",
    "date": _SIGN + r"([0-9]{4}[年./-][0-9]{1,2}[月./-][0-9]{1,2}日?)",
    "amount": _CURRENCY + _SIGN + r"[¥￥$]?\s*([0-9,]+(?:\.[0-9]{1,2})?)",
    "percent": _SIGN + r"([0-9]+(?:\.[0-9]+)?)\s*%?",
    "discount": _SIGN + r"([0-9]+(?:\.[0-9]+)?\s*(?:%|折))",
    "number": r"\s*(?:为|共|合计)?" + _SIGN + r"([0-9,]+(?:\.[0-9]+)?)",
    "line": _SIGN + r"([^\r\n]+)",
    "terms": _SIGN + r"([^\r\n]{4,80})",
}
PHRASE_PRIORITY, LABEL_PRIORITY, LATER_PRIORITY = 0, 1, 2

Rule = tuple[str, str, str, int]


def rules() -> list[Rule]:
    return [(label, field, kind, LABEL_PRIORITY) for (field, kind), labels in LABELS.items() for label in labels]


def phrase_rules() -> list[Rule]:
    """A quantity in pieces goes before a labelled one, terms in running text after."""
    return [(p, field, "phrase", PHRASE_PRIORITY if field == "quantity" else LATER_PRIORITY) for field, ps in PHRASES.items() for p in ps]


def _plain(label: str) -> str:
    return re.sub(r"\s+", "", label).lower()


def label_pattern(labels: Sequence[str]) -> str:
    """One pattern for all labels, longer ones first."""
    one = lambda x: ("(?<![一-鿿])" if x in ALONE else "") + r"\s*".join(map(re.escape, x.split()))
    return "|".join(one(x) for x in sorted(set(labels), key=lambda x: (-len(x), x)))


def _in_header(text: str, at: int) -> bool:
    low = text.lower()
    begin, end = low.rfind("<tr", 0, at), low.find("</tr>", at)
    if begin < 0 or end < 0 or low.find("</tr>", begin, at) >= 0:
        begin, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
    row = text[begin : end if end >= 0 else None]
    return bool(re.search("<t[dh]>", row, re.I)) and sum(t in row for t in HEADER) >= 3


def candidates(docs: DataFrame, more: Sequence[Rule] = (), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, field, label, priority, start, end, value), places in code points from 0, value trimmed, end exclusive; more:
    further rules beside the fixed ones (kind "phrase": the label is a pattern whose group is the value)."""
    labelled = [r for r in (*rules(), *more) if r[2] != "phrase"]
    phrases = [(re.compile(p, re.I), p, field, prio) for p, field, kind, prio in (*phrase_rules(), *more) if kind == "phrase"]
    look = re.compile(label_pattern([r[0] for r in labelled]), re.I)
    kinds = {k: re.compile(v, re.I) for k, v in KINDS.items()}
    by_label: dict[str, list[tuple[str, int, str, str, int]]] = {}
    for long in {_plain(r[0]) for r in labelled}:  # a rule is read wherever its label ends one that was found
        for label, field, kind, prio in labelled:
            if long == _plain(label) or (long.endswith(_plain(label)) and label not in ALONE):
                by_label.setdefault(long, []).append((label, len(_plain(label)), field, kind, prio))
    own = docs.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(doc, F.col(text).alias("text"))
    names = [doc, "field", "label", "priority", "start", "end", "value"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

    def found(t: str) -> list[tuple]:
        out, tables = [], "<td>" in t.lower() or "<th>" in t.lower()
        for m in look.finditer(t):
            for label, n, field, kind, prio in by_label[_plain(m[0])]:
                v = kinds[kind].match(t, m.end())
                if v and v[1].strip() and not (kind == "amount" and tables and _in_header(t, m.start())):
                    out.append((field, label, prio, m.end() - max(n, len(label)) if n < len(_plain(m[0])) else m.start(), v.end(1), v[1].strip()))
        for p, name, field, prio in phrases:
            out += [(field, name, prio, m.start(1), m.end(1), m[1].strip()) for m in p.finditer(t) if m[1].strip()]
        out.sort(key=lambda c: (c[0], c[3], c[2], -c[4], c[1], c[5]))
        kept: list[tuple] = []
        for c in out:
            if not (kept and kept[-1][0] == c[0] and c[3] < kept[-1][4]):
                kept.append(c)
        return kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i in range(batch.num_rows):
                new = found(batch.column(1)[i].as_py())
                rows += new
                at += [i] * len(new)
            cols = [pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cols], names)

    return own.mapInArrow(run, f"`{doc}` {own.schema[doc].dataType.simpleString()}, field string, label string, priority int, start long, end long, value string")


def picked(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, field, value): the first candidate of the best priority. Amounts and numbers lose their commas, dates that are
    dates become yyyy-MM-dd and others go, rates lose blanks."""
    best = found.groupBy(doc, "field").agg(F.min(F.struct("priority", "start", "end", "value")).alias("c")).select(doc, "field", F.col("c.value").alias("value"))
    numbers = [f for f, k in LABELS if k in ("amount", "number")]
    dates = [f for f, k in LABELS if k == "date"]
    value = F.when(F.col("field").isin(numbers), F.replace("value", F.lit(","))).when(F.col("field").isin(dates), parse_date(F.col("value")).cast("string")).when(F.col("field") == "discountRate", F.replace("value", F.lit(" "))).otherwise(F.col("value"))
    return best.withColumn("value", value).where(F.col("value").isNotNull() & (F.col("value") != ""))


# A field without a value of its own has that of another.
DEFAULTS = {"invoiceNo": ("documentNo",), "documentNo": ("documentNo", "orderNo"), "documentDate": ("documentDate", "deliveryDate"), "settlementTerms": ("paymentTerms",)}


def text_fields(docs: DataFrame, more: Sequence[Rule] = (), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, fields map<string, string>) of every document that has a field."""
    got = picked(candidates(docs, more, doc, text), doc).groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("m"))  # a row for each field
    filled: list[Column] = [F.struct(F.lit(name).alias("key"), F.coalesce(*(F.col("m")[f] for f in given)).alias("value")) for name, given in DEFAULTS.items()]
    more_of = F.map_from_entries(F.filter(F.array(*filled), lambda e: e["value"].isNotNull()))
    return got.select(doc, F.map_concat(F.map_filter("m", lambda k, v: ~k.isin(list(DEFAULTS))), more_of).alias("fields"))
