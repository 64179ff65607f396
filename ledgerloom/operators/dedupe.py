"""Duplicate documents, references across documents, and profiles of key columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.ids import normalize_id


def duplicate_findings(docs: DataFrame, kind: str = "doc_type", number: str = "number", file: str = "file_name") -> DataFrame:
    """(finding_id, issue_type, severity, kind, number, files, first_file): a row for each number that several documents of
    a type have; an invoice's is a signal of failure. duplicate_members() has the documents."""
    n = normalize_id(F.col(number))
    own = docs.select(F.col(kind).alias("t"), n.alias("number"), F.col(file).alias("file")).where("number <> ''")
    found = own.groupBy("t", "number").agg(F.count("*").alias("files"), F.min("file").alias("first_file")).where("files >= 2")
    name = F.concat(F.coalesce("t", F.lit("doc")), F.lit("_no"))
    issue = F.when(F.col("t") == "invoice", "DUPLICATE_INVOICE_NO").when(F.col("t") == "contract", "MULTI_VERSION_CONTRACT").when(F.col("t") == "order", "MULTI_VERSION_ORDER").otherwise("DUPLICATE_ID")
    return found.select(F.concat_ws(":", name, "number").alias("finding_id"), issue.alias("issue_type"), F.when(F.col("t") == "invoice", "FAIL_SIGNAL").otherwise("WARNING").alias("severity"), name.alias("kind"), "number", "files", "first_file")


def duplicate_members(docs: DataFrame, findings: DataFrame, kind: str = "doc_type", number: str = "number") -> DataFrame:
    """The documents of the findings, with finding_id."""
    name = F.concat_ws(":", F.concat(F.coalesce(F.col(kind), F.lit("doc")), F.lit("_no")), normalize_id(F.col(number)))
    return docs.withColumn("finding_id", name).join(findings.select("finding_id"), "finding_id", "left_semi")


def cross_references(docs: DataFrame, kind: str = "doc_type", number: str = "number", invoice_ref: str = "invoice_ref") -> DataFrame:
    """Documents other than invoices that name the number of an invoice that is there."""
    invoices = docs.where(F.col(kind) == "invoice").select(normalize_id(F.col(number)).alias("__n")).where("__n <> ''").distinct()
    return docs.where(F.coalesce(F.col(kind) != "invoice", F.lit(True))).withColumn("__n", normalize_id(F.col(invoice_ref))).join(invoices, "__n", "left_semi").withColumnRenamed("__n", "reference")


def findings_summary(findings: DataFrame) -> DataFrame:
    """One row: total, duplicates, fail_signals, multi_version."""
    return findings.agg(F.count("*").alias("total"), F.count_if(F.col("issue_type") != "CROSS_DOC_INVOICE_REF").alias("duplicates"), F.count_if(F.col("severity") == "FAIL_SIGNAL").alias("fail_signals"), F.count_if(F.startswith("issue_type", F.lit("MULTI_"))).alias("multi_version"))


def usable_key(c: Column) -> Column:
    """Whether a value can be a key: of 80 characters at the most, on one line, with a letter or digit, no word for nothing."""
    t = normalize_id(c)
    return F.coalesce((F.length(t) <= 80) & ~c.cast("string").rlike(r"[\n\r]") & t.rlike(r"[\p{L}\p{N}]") & ~F.lower(t).isin("none", "nan", "null", "-"), F.lit(False))


def key_profile(df: DataFrame, tiers: dict[str, int]) -> DataFrame:
    """(column, tier, fill_ratio, unique_ratio, numeric, average_length, score, accepted): how well each column would do as
    the key. tiers: what the headers say (3 strong, 2 secondary, -1 barred, else 0).

    The table is read once: each row gives a (column, value) pair for each column, which are counted by value first.
    """
    names = df.columns
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column"), F.when(usable_key(F.col(n)), normalize_id(F.col(n))).alias("v")) for n in names))).alias("p")).select("p.column", "p.v")
    by_value = pairs.groupBy("column", "v").agg(F.count("*").alias("n"))
    got = by_value.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("usable"), F.count("v").alias("distinct"),
        F.bool_and(F.coalesce(F.col("v").rlike(r"^[0-9]+(?:\.0+)?$"), F.lit(True))).alias("digits"), F.sum(F.length("v") * F.col("n")).alias("chars"),
    )
    tier = F.coalesce(F.create_map(*(x for n in names for x in (F.lit(n), F.lit(tiers.get(n, 0)))))[F.col("column")], F.lit(0))
    fill, unique = F.col("usable") / F.col("rows"), F.when(F.col("usable") > 0, F.col("distinct") / F.col("usable")).otherwise(0.0)
    length = F.when(F.col("usable") > 0, F.col("chars") / F.col("usable")).otherwise(0.0)
    numeric = (F.col("usable") > 0) & F.col("digits")
    by_name = (fill >= 0.5) & (F.col("usable") > 0) & ((tier == 3) | ((tier == 2) & (unique >= 0.9)))
    by_values = (tier == 0) & (F.col("usable") >= 2) & (fill >= 0.8) & (unique >= 0.98) & ~numeric & (length <= 40)
    score = tier * 100 + unique * 20 + fill * 10 + F.when(by_values, 40).otherwise(0)
    return got.select("column", tier.alias("tier"), F.round(fill, 3).alias("fill_ratio"), F.round(unique, 3).alias("unique_ratio"), numeric.alias("numeric"), F.round(length, 3).alias("average_length"), F.round(score, 3).alias("score"), (by_name | by_values).alias("accepted"))


def merge_rows(df: DataFrame, key: str, order: str, scalars: list[str], arrays: list[str]) -> DataFrame:
    """One row for each compact key: scalars of its first row, arrays joined in the order of the rows, each value once."""
    first = F.min_by(F.struct(*scalars), order).alias("__f") if scalars else None
    lists = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(a), F.array().cast(df.schema[a].dataType)).alias("a")))), lambda x: x["a"]))).alias(a) for a in arrays]
    out = df.groupBy(key).agg(*([first] if scalars else []), *lists)
    return out.select(key, *(F.col(f"__f.{s}").alias(s) for s in scalars), *arrays)
