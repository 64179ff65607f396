"""Contiguous shards of near equal bytes, in DataFrame operations only (operator 13).

The rows stand in one global order: by id (null first), then by size, checksum and place in the input. A first scan keeps
of every text no more than its size and checksum; these narrow rows are sorted by range and stored. Runs of at most RUN
rows within a stored partition have totals of bytes; the totals, summed in order, give each run its place, and a running
sum within the run gives each row its own. A row belongs to the shard in whose share of all bytes its middle lies, so a
shard's bytes differ from the target by half a row at either end, whatever the rows' sizes. Rows that agree in every
column are parted by their place in the input, so no key makes a task that holds them all.

The law is "bytes": shards move when rows are added, so `grown_shard` is null.

Defined cases: a null text has no bytes and, like any text, one more for its end; null ids come first; rows with one id are
rows of their own; with fewer rows than shards, or a row larger than a shard's share, shards stay empty; an empty table
gives no rows; other columns are not read, and write_shards() keeps them (a column named like the shard's is an error).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.plans.stash import small, stash

SHARDS = 16
#: Rows that a running sum goes over; their totals are one row each. No effect on results.
RUN = 1 << 18

_BITS = 33  # of monotonically_increasing_id() within a partition
_KEY = ("id", "size", "crc")


def _narrow(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc")]


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """(id, size, crc, row, before): each row with its place from 0 in the global order, and the bytes before it."""
    # the texts are scanned once: sampling for the sort reads the narrow rows
    own = stash(docs.select(*_narrow(id_col, text_col)), "sizes").withColumn("tie", F.monotonically_increasing_id())
    kept = stash(own.orderBy(*_KEY, "tie").select(*_KEY).withColumn("at", F.monotonically_increasing_id()), "sorted")
    part, inner = F.shiftright("at", _BITS), F.col("at").bitwiseAND(F.lit((1 << _BITS) - 1))
    kept = kept.withColumns({"part": part, "inner": inner}).withColumn("run", F.floor(F.col("inner") / run))
    totals = kept.groupBy("part", "run").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = W.orderBy("part", "run").rowsBetween(W.unboundedPreceding, -1)  # a row for each run
    zero = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    starts = stash(totals.select("part", "run", zero("bytes").alias("bytes"), zero("rows").alias("first")), "runs")
    within = F.coalesce(F.sum("size").over(W.partitionBy("part", "run").orderBy("inner").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return kept.withColumn("within", within).join(small(starts), ["part", "run"]).select(*_KEY, (F.col("first") + F.col("inner") - F.col("run") * run).alias("row"), (F.col("bytes") + F.col("within")).alias("before"))


def assigned(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """(id, size, crc, row, before, shard, slot), stored; a shard's slots are gapless from 0."""
    all_rows = placed(docs, id_col, text_col, run)
    total = F.broadcast(all_rows.agg(F.max(F.col("before") + F.col("size")).alias("total")))  # one row
    middle = (2 * F.col("before") + F.col("size")) * shards
    own = stash(all_rows.join(total).select(*_KEY, "row", "before", F.floor(middle / (2 * F.col("total"))).cast("int").alias("shard")), "shards")
    first = F.broadcast(own.groupBy("shard").agg(F.min("row").alias("__first")))  # a row for each shard
    return own.join(first, "shard").select(*_KEY, "row", "before", "shard", (F.col("row") - F.col("__first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> None:
    """Writes the whole rows as Parquet, a folder for each shard, in one scan: a row's shard follows from its key and the
    first keys of the shards (a row each). Rows of one key that lie across a cut all go to the later shard."""
    if "shard" in docs.columns:
        raise ValueError("the table has a column named shard")
    rows = assigned(docs, shards, id_col, text_col, run)
    cuts = rows.where("slot = 0").select("shard", *_KEY).orderBy("shard").collect()
    types = {f.name: f.dataType for f in rows.schema}
    key = F.struct(*_narrow(id_col, text_col))
    reached = [F.when(key >= F.struct(*(F.lit(c[k]).cast(types[k]).alias(k) for k in _KEY)), c["shard"]) for c in cuts]
    docs.withColumn("shard", F.greatest(F.lit(0), F.lit(0), *reached)).write.partitionBy("shard").parquet(path)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assigned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a string's UTF-8 bytes, after the checksum's definition: polynomial EDB88320,
    bits reflected, all ones before and after."""
    byte = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    bits = "list_reduce(range(8), lambda x, y: xor(x // 2, (x % 2) * 3988292384), xor(a, b))"
    return f"xor(list_reduce({byte}, lambda a, b: {bits}, 4294967295), 4294967295)"


OP13_SQL = f"""
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, CAST({crc32_sql("coalesce(text, '')")} AS BIGINT) AS text_crc32 FROM documents),
p AS (SELECT *, row_number() OVER o AS "row", sum(size) OVER (o ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM d WINDOW o AS (ORDER BY doc_id NULLS FIRST, size, text_crc32)),
s AS (SELECT *, CAST(((2 * before + size) * 16) // (2 * total) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST("row" - min("row") OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
