"""Reading ledgers, voucher folders and batches, and writing tables and working papers.

Paths may be in any store that Spark reads; the executors read everything. Of a spreadsheet the driver sees the header.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What the columns of a ledger may be called, best first.
SYNONYMS = {
    "posting_date": ("入账日期", "记账日期", "过账日期", "凭证日期", "日期", "posting date", "posting_date", "date"),
    "biz_id": ("业务编号", "订单编号", "订单号", "合同编号", "单据编号", "business id", "biz_id", "order no", "order_no"),
    "amount": ("入账金额", "金额", "贷方金额", "借方金额", "amount", "credit", "debit"),
}


def plain_name(name: str) -> str:
    return re.sub(r"[\s_\-()（）]+", "", name.lstrip("﻿")).lower()


def map_columns(columns: Iterable[str], remembered: dict[str, str] | None = None) -> dict[str, str]:
    """{field: column}: a remembered choice first, else the column that equals the best synonym but for spaces, dashes and
    case. A column serves one field only."""
    left, out = list(columns), {}
    for field, names in SYNONYMS.items():
        chosen = (remembered or {}).get(field)
        if chosen not in left:
            plain = {plain_name(c): c for c in reversed(left)}
            hits = [plain[plain_name(n)] for n in sorted(names, key=lambda n: -len(n)) if plain_name(n) in plain]
            chosen = hits[0] if hits else None
        if chosen:
            out[field] = chosen
            left.remove(chosen)
    return out


def read_ledger(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A ledger from CSV (UTF-8, with or without a mark in front) or a sheet of a workbook, by place or name: all columns as
    text, headers trimmed, rows that are blank throughout left out. Another kind of file is an error."""
    low = path.lower()
    if low.endswith(".csv"):
        df = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)
    elif low.endswith(".xlsx"):
        from ledgerloom.sources.workbooks import read_workbooks

        rows = read_workbooks(spark, path).where(F.col("place") == sheet if isinstance(sheet, int) else F.col("sheet") == sheet)
        head = rows.orderBy("row").limit(1).collect()  # the header
        size = rows.agg(F.max(F.size("cells")).alias("n")).first()["n"] or 0
        names = [*(head[0]["cells"] if head else []), *[None] * size][:size]
        body = rows.where(F.col("row") > head[0]["row"]) if head else rows
        df = body.select(*(F.get("cells", F.lit(i)).alias((c or "").strip() or f"column{i + 1}") for i, c in enumerate(names)))
    else:
        raise ValueError(f"neither a CSV file nor a spreadsheet: {path}")
    df = df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))
    return df.where(F.coalesce(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in df.columns)).isNotNull())


def project_ledger(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(posting_date, biz_id, amount) by a mapping, which must have the date."""
    if "posting_date" not in mapping:
        raise ValueError("no column for the posting date")
    from ledgerloom.functions.dates import parse_date
    from ledgerloom.functions.ids import normalize_id
    from ledgerloom.functions.numbers import parse_number

    col = lambda f: F.col(f"`{mapping[f]}`") if f in mapping else F.lit(None).cast("string")
    return df.select(parse_date(col("posting_date")).alias("posting_date"), normalize_id(col("biz_id")).alias("biz_id"), parse_number(col("amount")).alias("amount"))


def looks_like_dates(df: DataFrame, column: str, rows: int = 100, share: float = 0.3) -> bool:
    """Whether over the share of the first non-blank values are dates. The look at a few rows is the feature."""
    from ledgerloom.functions.dates import parse_date

    some = df.select(F.trim(F.col(f"`{column}`").cast("string")).alias("v")).where("v <> ''").limit(rows)
    got = some.agg(F.avg(F.when(parse_date(F.col("v")).isNotNull(), 1.0).otherwise(0.0)).alias("x")).first()["x"]
    return got is not None and got > share


def read_voucher_packs(spark: SparkSession, root: str, pattern: str = r"(SO[0-9]{2}-[0-9]{4})") -> DataFrame:
    """(business_id, file_name, raw_text) of the Markdown documents in folders named by a business."""
    df = spark.read.text(root, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    path = F.col("_metadata.file_path")
    out = df.select(F.regexp_extract(path, pattern + r"[^/]*/[^/]*$", 1).alias("business_id"), F.url_decode(F.col("_metadata.file_name")).alias("file_name"), F.col("value").alias("raw_text"))
    return out.where("business_id <> ''")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """A batch of cut-off requests, one JSON object a line; the schema is the files' own."""
    return spark.read.json(path)


def uploads(files: DataFrame, name: str = "file_name", content: str = "content") -> DataFrame:
    """Adds fingerprint: the first 32 hex digits of the SHA-256 of name and content's MD5."""
    return files.withColumn("fingerprint", F.substring(F.sha2(F.concat_ws(":", F.col(name), F.md5(content)), 256), 1, 32))


def append_uploads(old: DataFrame, new: DataFrame, name: str = "file_name") -> DataFrame:
    """Old and new uploads: one with a known fingerprint is the old row; a known name with another content is replaced;
    others stay. Of several new rows of a name the one with the largest fingerprint counts."""
    fresh = new.join(old.select("fingerprint"), "fingerprint", "left_anti")
    fresh = fresh.groupBy(name).agg(F.max_by(F.struct(*new.columns), "fingerprint").alias("r")).select("r.*")
    return old.join(fresh.select(name), name, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def replace_by(df: DataFrame, path: str, column: str) -> None:
    """Writes a table partitioned by a column so that only the partitions that df has are replaced."""
    df.write.mode("overwrite").partitionBy(column).option("partitionOverwriteMode", "dynamic").parquet(path)


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A store's rows with some put in by key: a known key's row is replaced. Of several new rows of a key any one counts."""
    return delete(table, rows, key).unionByName(rows.select(*table.columns).dropDuplicates([key]))


def delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A store's rows without those of some keys."""
    return table.join(gone.select(key).distinct(), key, "left_anti").select(*table.columns)


def fetch(table: DataFrame, wanted: DataFrame, key: str, place: str) -> DataFrame:
    """The rows of the wanted keys, with their place."""
    return table.join(wanted.select(key, place), key)


def write_paper(rows: DataFrame, path: str, append: bool = False) -> None:
    """The working paper as CSV with headers."""
    rows.write.mode("append" if append else "overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """A folder of Parquet for each sheet."""
    for name, df in sheets.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def log_decisions(decisions: DataFrame, path: str) -> None:
    """Appends to the log of human decisions."""
    decisions.write.mode("append").json(path)


def recent_decisions(log: DataFrame, n: int = 50, at: str = "created_at") -> DataFrame:
    """The newest decisions; the limit is the feature."""
    return log.orderBy(F.desc(at)).limit(n)


def input_fingerprint(files: DataFrame, keys: list[str], name: str = "file_name", fingerprint: str = "fingerprint") -> DataFrame:
    """(keys, input_fingerprint): the same for the same set of files, in any order."""
    return files.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", name, fingerprint))), "|"), 256).alias("input_fingerprint"))
