"""Tables inside text: Markdown and HTML tables as rows of cells, and prices and quantities looked up in them.

rows() reads every table of a text into (doc, table, row, line, header, cells): tables and rows are numbered from 0 in the
order of the text. In HTML a cell that spans rows or columns stands in each of them. Only texts that have a table's marks
go to Python, one at a time; everything after that is joins and aggregates over short rows.

Defined cases: null texts have no tables; a Markdown row has the cells it has, however many its header has; a rule line
(| --- |) is no row; a table in a cell is read as part of the text of its own rows; a tag that is not closed ends with
the next of its kind or the table; an empty table has no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import ascii_digits, parse_discount, parse_number, parse_percent

# The most that a cell may span, as HTML states it.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

_TAG = re.compile(r"<(/?)(table|tr|t[dh]|br)\b([^<>]*)>", re.I)
_MARKUP = re.compile(r"<[^<>]*>")
_RULE = re.compile(r"^\|?\s*:?-{3,}")


def _span(attributes: str, name: str, most: int) -> int:
    m = re.search(rf"\b{name}\s*=\s*[\"']?\s*([0-9]{{1,6}})", attributes, re.I)
    return max(1, min(most, int(m[1]))) if m else 1


def _html_tables(text: str) -> Iterator[tuple[int, list[tuple[bool, list[str]]]]]:
    """(place, rows) of each table, in the order in which tables end."""
    stack: list[dict] = []

    def close_cell(t: dict, at: int) -> None:
        if t["cell"] is not None:
            begin, head, across, down = t["cell"]
            words = " ".join(html.unescape(_MARKUP.sub(" ", text[begin:at])).split())
            row, left, col = t["row"], t["left"], len(t["row"])
            for _ in range(across):
                while col in left:  # a cell from above stands here
                    row.append(left[col][1])
                    col += 1
                row.append(words)
                t["fresh"][col] = [down - 1, words]
                col += 1
            t["head"] &= head
            t["cell"] = None

    def close_row(t: dict, at: int) -> None:
        close_cell(t, at)
        if t["open"]:
            while len(t["row"]) in t["left"]:
                t["row"].append(t["left"][len(t["row"])][1])
            for col, (n, _) in list(t["left"].items()):
                if n <= 1:
                    del t["left"][col]
                else:
                    t["left"][col][0] -= 1
            t["left"].update({c: v for c, v in t["fresh"].items() if v[0]})
            if t["row"]:
                t["rows"].append((t["head"], t["row"]))
        t |= {"row": [], "fresh": {}, "head": True, "open": False}

    for m in _TAG.finditer(text):
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag == "table" and not closing:
            stack.append({"at": m.start(), "rows": [], "row": [], "left": {}, "fresh": {}, "head": True, "open": False, "cell": None})
        elif stack and tag == "table":
            t = stack.pop()
            close_row(t, m.start())
            yield t["at"], t["rows"]
        elif stack and tag == "tr":
            close_row(stack[-1], m.start())
            stack[-1]["open"] = not closing
        elif stack and tag in ("td", "th"):
            close_cell(stack[-1], m.start())
            if not closing:
                stack[-1]["open"] = True
                stack[-1]["cell"] = (m.end(), tag == "th", _span(attributes, "colspan", MOST_COLUMNS), _span(attributes, "rowspan", MOST_ROWS))
    for t in stack:
        close_row(t, len(text))
        yield t["at"], t["rows"]


def _markdown_tables(text: str) -> Iterator[tuple[int, list[tuple[int, bool, list[str]]]]]:
    at, number, begin, rows = 0, 0, 0, []
    for line in text.splitlines(keepends=True):
        plain = line.strip()
        if plain.startswith("|") and len(plain) > 1:
            if not rows:
                begin = at
            if _RULE.match(plain):
                rows = [(n, True, c) for n, _, c in rows] or [(number, False, [])]
            else:
                rows.append((number, False, [c.strip() for c in plain.strip("|").split("|")]))
        elif rows:
            yield begin, [r for r in rows if r[2]]
            rows = []
        at, number = at + len(line), number + 1
    if rows:
        yield begin, [r for r in rows if r[2]]


def rows(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, table, row, line, header, cells): line is the row's line in the text for Markdown, null for HTML; header says
    that a rule line follows, or that all cells are th."""
    own = docs.where(F.col(doc).isNotNull() & F.col(text).rlike(r"(?i)(?m)^\s*\||<table\b")).select(doc, F.col(text).alias("text"))
    names = [doc, "table", "row", "line", "header", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i in range(batch.num_rows):
                t = batch.column(1)[i].as_py()
                tables = [(p, [(None, h, c) for h, c in r]) for p, r in _html_tables(t)] + list(_markdown_tables(t))
                for n, (_, own_rows) in enumerate(sorted(tables, key=lambda x: x[0])):
                    out += [(n, j, *r) for j, r in enumerate(own_rows)]
                at += [i] * (len(out) - len(at))
            types = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[j] for r in out], t) for j, t in enumerate(types))], names)

    return own.mapInArrow(run, f"`{doc}` {own.schema[doc].dataType.simpleString()}, table int, row int, line int, header boolean, cells array<string>")


def cells(made: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, table, row, col, cell) of rows()."""
    return made.select(doc, "table", "row", F.posexplode("cells").alias("col", "cell"))


def _place(names: Column, test) -> Column:  # noqa: ANN001
    """The first column, from 1, whose name passes; null if none does."""
    return F.nullif(F.array_position(F.transform(names, test), True), F.lit(0).cast("long")).cast("int")


def _holding(word: str):  # noqa: ANN202
    return lambda name: F.contains(name, F.lit(word))


def _below(made: DataFrame, heads: DataFrame, doc: str, most: int) -> DataFrame:
    """Each document's rows under its chosen header row, in the same table, up to `most` lines down. heads: (doc, h struct
    with table, row, line)."""
    own = made.join(heads, doc).where((F.col("table") == F.col("h.table")) & (F.col("row") > F.col("h.row")))
    return own.where(F.coalesce(F.col("line") - F.col("h.line"), F.col("row") - F.col("h.row")) <= most)


# Columns of a price table, rows looked at below its header, and the rate where none is stated.
BASE_PRICE, PRICE, DISCOUNT, QUANTITY, RATE, AFTER = "基础不含税单价", "单价", "折扣", "数量", "税率", "折后"
PRICE_ROWS, USUAL_RATE = 9, 0.13


def price_tables(made: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, quantity, unit_price_excl_tax, discount_rate, vat_rate) of the first price table's first row with a quantity
    and a price: columns are found by their names. made: rows()."""
    has = lambda name: F.exists("cells", lambda c: F.contains(c, F.lit(name)))
    names = F.col("h.cells")
    heads = made.where(has(BASE_PRICE) & has(DISCOUNT)).groupBy(doc).agg(F.min(F.struct("table", "row", "line", "cells")).alias("h"))
    first = lambda *words: F.coalesce(*(_place(names, _holding(w)) for w in words))
    plain = _place(names, lambda c: (c == QUANTITY) | (F.endswith(c, F.lit(QUANTITY)) & ~F.contains(c, F.lit("折")) & ~F.contains(c, F.lit("实收"))))
    quantity = F.when(F.contains(F.get(names, first(QUANTITY) - 1), F.lit(AFTER)), plain).otherwise(first(QUANTITY))
    heads = heads.select(doc, "h", quantity.alias("q"), first(BASE_PRICE, PRICE).alias("p"), first("商业折扣", DISCOUNT).alias("d"), first(RATE).alias("v"))
    cell = lambda at: F.get("cells", F.col(at) - 1)
    rate = parse_percent(cell("v"))
    own = _below(made, heads, doc, PRICE_ROWS).where(F.size("cells") >= 4).select(
        doc, "row", parse_number(F.regexp_replace(cell("q"), r"[^0-9.]", "")).alias("quantity"), parse_number(cell("p")).alias("unit_price_excl_tax"),
        F.coalesce(parse_discount(cell("d")), F.lit(0.0)).alias("discount_rate"), F.coalesce(rate, F.lit(USUAL_RATE)).alias("vat_rate"),
    )
    kept = own.where("quantity > 0 AND unit_price_excl_tax > 0")
    return kept.groupBy(doc).agg(F.min(F.struct("row", "quantity", "unit_price_excl_tax", "discount_rate", "vat_rate")).alias("r")).select(doc, "r.quantity", "r.unit_price_excl_tax", "r.discount_rate", "r.vat_rate")


# Names of a delivered quantity, the best first; what names a difference; rows looked at below a header.
DELIVERED = ("实收数量", "合格数量", "发运数量", "发货数量", "交货数量", "装船数量", "提单数量", "数量")
DIFFERENCE, DELIVERY_ROWS = "差异", 11
_UNITS = r"(?i)(?:台|支|个|件|箱|套|千克|公斤|kg|pcs?)$"


def _delivered(word: str):  # noqa: ANN202
    """The barest name must be the whole name."""
    return lambda name: ~F.contains(name, F.lit(DIFFERENCE)) & ((name == word) if word == DELIVERED[-1] else F.contains(name, F.lit(word)))


def quantity_token(c: Column) -> Column:
    """A quantity's digits: full-width ones as ASCII, two groups parted by a blank as one number, commas between thousands
    and a unit at the end left out; null if it does not begin with a digit."""
    t = F.trim(F.translate(ascii_digits(c), "，", ","))
    pair = F.regexp_extract(t, r"^([0-9]{1,3})\s+([0-9]{1,3})(?:\.[0-9]+)?$", 1)
    other = F.regexp_extract(t, r"^([0-9]{1,3})\s+([0-9]{1,3})(?:\.[0-9]+)?$", 2)
    whole = F.when(t.rlike(r"^[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?$"), F.replace(t, F.lit(","))).otherwise(t)
    return F.when(pair != "", F.concat(pair, other)).otherwise(F.nullif(F.regexp_extract(F.regexp_replace(whole, _UNITS, ""), r"^([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")))


def delivery_quantities(docs: DataFrame, made: DataFrame | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, quantity): the first positive quantity below the first header row that leads to one, in its best column; else
    the first one after a label. Documents without any have no row. made: rows() of docs, if they are at hand."""
    made = rows(docs, doc, text) if made is None else made
    heads = made.withColumn("q", F.coalesce(*(_place(F.col("cells"), _delivered(n)) for n in DELIVERED))).where("q IS NOT NULL AND size(cells) >= 2").select(doc, F.struct("table", "row", "line").alias("h"), "q")
    found = _below(made, heads, doc, DELIVERY_ROWS).withColumn("n", quantity_token(F.get("cells", F.col("q") - 1)).cast("double")).where("n > 0")
    tabled = found.groupBy(doc).agg(F.min(F.struct("h", "row", "n")).alias("r")).select(doc, F.col("r.n").alias("tabled"))
    after = F.coalesce(*(F.nullif(F.regexp_extract(text, rf"{n}\s*[:：]?\s*([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")) for n in DELIVERED[:-1])).cast("double")
    own = docs.where(F.col(doc).isNotNull()).select(doc, after.alias("after")).join(tabled, doc, "left")
    return own.select(doc, F.coalesce("tabled", "after").alias("quantity")).where("quantity IS NOT NULL")
