"""Lookup of documents in a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ledgerloom.functions.ids import compact_id, normalize_id


def ledger_index(ledger: DataFrame, keys: str = "keys", order: str = "row_no", date: str = "posting_date") -> DataFrame:
    """(key, row_no, posting_date, row...): the first row of each key, which is registered as written and compact. Rows
    without a date do not count."""
    row = F.struct(F.col(order).alias("row_no"), *(F.col(c) for c in ledger.columns if c not in (keys, order)))
    dated = ledger.where(F.col(date).isNotNull()).select(row.alias("row"), F.explode(keys).alias("raw"))
    both = F.array_distinct(F.array(normalize_id(F.col("raw")), compact_id(F.col("raw"))))
    return dated.select("row", F.explode(both).alias("key")).where(F.length("key") > 0).groupBy("key").agg(F.min_by("row", "row.row_no").alias("row"))


def lookup(docs: DataFrame, index: DataFrame, doc_id: str = "doc_id", keys: str = "keys") -> DataFrame:
    """For each document the ledger row of the first of its keys that has one: key, row and match_status (MATCHED, or
    NOT_FOUND, or MISSING_DOCUMENT_INDEX for a document without keys)."""
    asked = docs.select(doc_id, F.posexplode_outer(keys).alias("pos", "raw"))
    tried = asked.select(doc_id, "pos", "raw", F.explode_outer(F.array_distinct(F.array(normalize_id(F.col("raw")), compact_id(F.col("raw"))))).alias("key"))
    hit = F.struct("pos", F.col("row.row_no").alias("row_no"), "key", "row")
    found = tried.join(index, "key", "left").groupBy(doc_id).agg(F.count("raw").alias("n_keys"), F.min(F.when(F.col("row").isNotNull(), hit)).alias("hit"))
    status = F.when(F.col("hit").isNotNull(), "MATCHED").when(F.col("n_keys") > 0, "NOT_FOUND").otherwise("MISSING_DOCUMENT_INDEX")
    return found.select(doc_id, F.col("hit.key").alias("key"), F.col("hit.row").alias("row"), status.alias("match_status"))


def apply_overrides(matched: DataFrame, overrides: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows chosen by hand take the place of found ones; of several choices the last counts. overrides: (doc_id, seq, row)."""
    last = overrides.groupBy(doc_id).agg(F.max_by("row", "seq").alias("__row"))
    out = matched.join(last, doc_id, "left").withColumn("match_status", F.when(F.col("__row").isNotNull(), "MANUAL").otherwise(F.col("match_status")))
    return out.withColumn("row", F.coalesce("__row", "row")).drop("__row")


#: Items that may be required of every subject.
MOST_REQUIRED = 1000


def missing_required(subjects: DataFrame, present: DataFrame, required: DataFrame, subject: str, item: str) -> DataFrame:
    """(subject, item) that are required but not present. required is a short list of items, MOST_REQUIRED at the most."""
    items = [r[0] for r in required.select(item).distinct().limit(MOST_REQUIRED + 1).collect()]
    if len(items) > MOST_REQUIRED:
        raise ValueError(f"more than {MOST_REQUIRED} required items")
    kind = required.schema[item].dataType
    wanted = subjects.select(subject).distinct().withColumn(item, F.explode(F.array(*(F.lit(i).cast(kind) for i in items)).cast(ArrayType(kind))))
    return wanted.join(present.select(subject, item).distinct(), [subject, item], "left_anti")
