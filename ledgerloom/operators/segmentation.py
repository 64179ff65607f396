"""Pages into units, texts into paragraphs and sections, and coverage of pages by units."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def segment_pages(pages: DataFrame, file: str = "file", page: str = "page") -> DataFrame:
    """(file, page, unit, reason): the units of each file, numbered from 0; reason is why the page's unit began.

    pages: (file, page, title, invoice_no, order_no, recognised, legible, blank). A unit begins where a page's title
    differs from the unit's, else where the invoice number at its head does, else where its order number does on a
    titled or legible recognised page. Blank pages stay with what goes before. A unit remembers the last title, and the
    first numbers, since it began; that memory starts anew with every unit, which a window cannot express. So the pages
    are sorted within partitions and folded in one pass that holds one unit's memory, however long a file is.
    """
    names = ["title", "invoice_no", "order_no", "recognised", "legible", "blank"]
    own = pages.select(F.col(file).cast("string").alias("file"), F.col(page).cast("long").alias("page"), *(F.nullif(F.col(n), F.lit("")).alias(n) for n in names[:3]), *(F.coalesce(F.col(n), F.lit(False)).alias(n) for n in names[3:]))
    own = own.repartition("file").sortWithinPartitions("file", "page", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, unit, reason, title, invoice, order = None, 0, "", None, None, None
        untyped = True
        for batch in batches:
            units, reasons = [], []
            for f, _, t, i, o, seen, legible, blank in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts = f != now
                why = "source_document_start"
                if not starts and not blank:
                    if t and t != title:
                        starts, why = True, "title_transition"
                    elif i and invoice and i != invoice:
                        starts, why = True, "invoice_no_change"
                    elif o and order and o != order and (t or (seen and legible)):
                        starts, why = True, "order_no_change"
                if starts:
                    unit = 0 if f != now else unit + 1
                    keep = order if why == "invoice_no_change" and not o else None
                    now, reason, title, invoice, order, untyped = f, why, t, i, o or keep, not seen and not t
                elif not blank:
                    if seen and untyped:
                        title, untyped = t, False
                    invoice, order = invoice or i, order or o
                units.append(unit)
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.int64()), pa.array(reasons, pa.string())], ["file", "page", "unit", "reason"])

    return own.mapInArrow(run, "file string, page long, unit long, reason string")


def page_coverage(pages: DataFrame, units: DataFrame, file: str = "file", page: str = "page") -> DataFrame:
    """(file, missing, unknown, repeated): pages that no unit has, that only units have, and that several places have."""
    want = pages.select(F.col(file).alias("file"), F.col(page).alias("page")).distinct().withColumn("want", F.lit(1))
    have = units.select(F.col(file).alias("file"), F.col(page).alias("page")).groupBy("file", "page").agg(F.count("*").alias("n"))
    both = want.join(have, ["file", "page"], "full")
    return both.groupBy("file").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("want").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("repeated"))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """(key, seq, paragraph, paragraph_id): the non-blank lines of a text in order; the id is a hash of name, place and text."""
    lines = F.filter(F.transform(F.split(F.col(text), r"\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    out = docs.select(key, F.posexplode(lines).alias("seq", "paragraph"))
    mark = F.sha1(F.concat_ws(":", F.col(key).cast("string"), F.col("seq").cast("string"), "paragraph"))
    return out.withColumn("paragraph_id", F.substring(mark, 1, 16))


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """(key, section, title, body): a line that starts with # opens a section; what stands before is one named by the key.
    Bodies shorter than `least` are left out."""
    lines = docs.select(F.col(key), F.posexplode(F.split(F.col(text), r"\n")).alias("line", "s"))
    head = F.startswith("s", F.lit("#"))
    lines = lines.withColumn("section", F.sum(F.when(head, 1).otherwise(0)).over(W.partitionBy(key).orderBy("line")))
    made = lines.groupBy(key, "section").agg(F.max(F.when(head, F.trim(F.regexp_replace("s", "^[# ]+", "")))).alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~head, F.struct("line", "s")))), lambda x: x["s"]), "\n").alias("body"))
    made = made.withColumn("body", F.trim(F.regexp_replace("body", r"^\s+|\s+$", ""))).where(F.length("body") >= least)
    return made.select(key, "section", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col(key).cast("string")).alias("title"), "body")


def visible_text(html: Column) -> Column:
    """Text without scripts, styles and tags, with line breaks where blocks end and the common references decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<br\s*/?>", "\n"), r"(?i)</(?:p|div|tr|h[1-6]|li|td|th)>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"[#*`]+", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{2,}", "\n"))
