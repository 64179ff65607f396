"""Business identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_id(c: Column) -> Column:
    """Upper case without white space; S0 before digits is SO; a trailing I or L is 1 and an O among digits 0, as readers
    of scans mistake them."""
    t = F.upper(F.regexp_replace(c.cast("string"), r"\s", ""))
    t = F.regexp_replace(t, r"^S0(?=[0-9]{2})", "SO")
    t = F.regexp_replace(t, r"(?<=[0-9])[IL]$", "1")
    return F.regexp_replace(t, r"(?<=[0-9])O(?=[0-9]|$)", "0")


def compact_id(c: Column) -> Column:
    return F.regexp_replace(normalize_id(c), r"[-_\s]", "")


def looks_like_id(c: Column) -> Column:
    """Two to four letters, then digits that dashes may group, six characters at the least."""
    t = normalize_id(c)
    return (F.length(t) >= 6) & t.rlike(r"^[A-Z]{2,4}[-_]?[0-9]{2,}(?:[-_][0-9]+)*$")


#: What identifiers look like in running text.
ID_PATTERN = r"\b(?:SO|PO|HT|CT|SA|YW|INV)[-_]?[0-9]{2,}(?:[-_][0-9]+)*\b"


def ids_in_text(c: Column) -> Column:
    """The identifiers of a text in their order, each once, without those that end a longer one."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.upper(c), F.lit(ID_PATTERN), F.lit(0)), normalize_id))
    return F.filter(found, lambda x: ~F.exists(found, lambda y: F.endswith(y, x) & (F.length(y) > F.length(x))))


# Labels before an identifier (whether a colon must follow), in the order in which they are looked for.
LABELS = (("订单", True), ("订单号", True), ("业务编号", True), ("销售订单号", False), ("发票号", True), ("合同索引号", False), ("合同编号", True))
# Identifiers without a label, in the order in which they are looked for.
BARE = (
    r"(?i)(SO[0-9]{2,4}[-_]?[0-9]{3,6}[IlO]?)",
    r"(?i)((?:EXKJ|EX|KJ)?HT[0-9]{2,4}[-_]?[0-9]{3,6}[IlO]?)",
    r"(?i)(PO[0-9]{2,4}[-_]?[0-9]{3,6}[IlO]?)",
    r"(?i)(INV[0-9]{2,4}[-_]?[0-9]{3,6})",
    r"(?i)(SA[0-9]{2,4}[-_]?[0-9]{3,6})",
    r"(?i)(DO[0-9]{2,4}[-_]?[0-9]{3,6})",
    r"(?i)(BANK[0-9]{2,8}[-_]?[0-9]{0,8})",
)
# Fields that may be an identifier as a whole, and fields that only hold some.
WHOLE_FIELDS, TEXT_FIELDS = ("documentNo", "invoiceNo", "contractNo", "orderNo", "warehouseNo"), ("remarks", "paymentTerms", "projectName")


def label_pattern(label: str, colon: bool) -> str:
    return rf"{label}\s*[:=：＝]{'' if colon else '?'}\s*([A-Za-z0-9\-_]+)"


def scanned_id(c: Column) -> Column:
    """An identifier as read from a text: upper case without white space; S0 before an order's digits is SO, a last I or L
    after letters, two digits and more is 1, a last O there is 0."""
    t = F.upper(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s", ""))
    t = F.regexp_replace(t, r"(?<![A-Z])S0([0-9]{2}[-_]?[0-9]{3,6})(?![0-9A-Z])", "SO$1")
    last = lambda t, letters, digit: F.when(t.rlike(rf"^[A-Z]{{1,8}}[0-9]{{2}}[-_]?[0-9]*[{letters}]$"), F.concat(F.left(t, F.length(t) - 1), F.lit(digit))).otherwise(t)
    return last(last(t, "IL", "1"), "O", "0")


def shaped_as_id(c: Column) -> Column:
    """Whether a whole value is an identifier: letters and digits with one dash at the most, or the digits of an invoice."""
    raw = F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    t = scanned_id(c)
    return (F.length(t) <= 40) & (t.rlike(r"^[A-Z]{1,10}[0-9]{2,6}[-_]?[0-9]{0,8}$") | raw.rlike(r"^[A-Z]{1,10}[0-9]{2,6}[-_]?[0-9]{0,8}[IL]$") | t.rlike(r"^[0-9]{8,20}$"))


def ids_in_free_text(c: Column) -> Column:
    """The identifiers of a text: labelled ones, label by label, then bare ones, pattern by pattern; each once, and none
    that ends a longer one."""
    patterns = [*(label_pattern(*x) for x in LABELS), *BARE]
    found = F.concat(*(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(1)) for p in patterns))
    ids = F.filter(F.array_distinct(F.transform(found, scanned_id)), lambda x: x != "")
    return F.filter(ids, lambda x: ~F.exists(ids, lambda y: F.endswith(y, x) & (F.length(y) > F.length(x))))


def document_keys(fields: Column) -> Column:
    """The identifiers of a document's fields (a map): fields that may be one as a whole, then those that hold some in
    their text."""
    parts = []
    for name in WHOLE_FIELDS + TEXT_FIELDS:
        value = F.trim(F.coalesce(fields[name], F.lit("")))
        if name in WHOLE_FIELDS:
            parts.append(F.when(shaped_as_id(value), F.array(scanned_id(value))).otherwise(F.array().cast("array<string>")))
        parts.append(ids_in_free_text(value))
    return F.array_distinct(F.concat(*parts))


def page_keys(c: Column) -> Column:
    """What a page's text is about: its first order number (SO or PO), its first contract number (HT or CT), and the digits
    of its invoice."""
    ids = ids_in_free_text(c)
    first = lambda pattern: F.get(F.filter(ids, lambda x: x.rlike(pattern)), F.lit(0))
    invoice = F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"发票号码?\s*[:=：＝]?\s*([0-9]{8,20})", 1), F.lit(""))
    return F.struct(first("^(SO|PO)").alias("order_no"), first("^(EXKJ|EX|KJ)?HT|^CT").alias("contract_no"), invoice.alias("invoice_no"))
