"""The engine's tables, projected from the order tables.

Every projection names a total order for its "first" rows, so results do not depend on how rows are stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import MONEY, QUANTITY, RATE

FIRST_LINE = ("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each order and line number: the least by FIRST_LINE (a minimum of structs, so tasks reduce their own
    rows first)."""
    li = table(spark, sf_dir, "lineitem")
    first = F.min(F.struct(*FIRST_LINE, "l_discount", "l_tax"))
    li = li.groupBy("l_orderkey", "l_linenumber").agg(first.alias("f"))
    price = (F.col("f.l_extendedprice").cast(MONEY) / F.col("f.l_quantity").cast(QUANTITY)).cast("decimal(18,4)")
    return li.select(
        F.col("l_orderkey").alias("business_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("order_line_id"), F.col("l_orderkey").alias("order_ref"), F.col("l_linenumber").alias("line_no"),
        F.col("f.l_partkey").alias("item_code"), F.col("f.l_suppkey").alias("source_file"), F.to_date("f.l_shipdate").alias("ship_date"), F.col("f.l_quantity").cast(QUANTITY).alias("qty"), F.col("f.l_extendedprice").cast(MONEY).alias("amount"),
        price.alias("price"), F.col("f.l_discount").cast(RATE).alias("discount"), F.col("f.l_tax").cast(RATE).alias("tax"),
    )


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipt lines (line status F) and invoice lines (not returned), in one table with their role."""
    li = table(spark, sf_dir, "lineitem")
    roles = F.array_compact(F.array(F.when(F.col("l_linestatus") == "F", "receipt"), F.when(F.col("l_returnflag") != "R", "invoice")))
    return li.select(
        F.col("l_orderkey").alias("business_id"), F.explode(roles).alias("role"), F.col("l_orderkey").alias("order_ref"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("item_code"), F.col("l_suppkey").alias("source_file"),
        F.to_date("l_shipdate").alias("ship_date"), F.col("l_quantity").cast(QUANTITY).alias("qty"), F.col("l_extendedprice").cast(MONEY).alias("amount"), *(F.col(c) for c in FIRST_LINE),
    )


def ledger_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order its posting date and amount, and the date of its last receipt, if any."""
    receipts = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("business_id")).agg(F.max(F.to_date("l_shipdate")).alias("control_date"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("business_id"), F.to_date("o_orderdate").alias("posting_date"), F.col("o_totalprice").cast(MONEY).alias("book_amount"), F.col("o_custkey").alias("party_id"))
    return orders.join(receipts, "business_id", "left")


def booked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with what the ledger has for them. The order tables have no such book, so errors are put in by the
    order's number: exact; total two hundredths off; net 3 % off; VAT off by one; nothing booked."""
    from ledgerloom.operators.amounts import recompute

    own = recompute(order_lines(spark, sf_dir))
    kind = F.col("business_id") % 5
    net = F.when(kind == 2, F.round(F.col("net") * F.lit("1.03").cast("decimal(3,2)"), 2)).otherwise(F.col("net")).cast(MONEY)
    vat = F.when(kind == 3, F.col("vat") + 1).otherwise(F.col("vat")).cast(MONEY)
    total = (net + vat + F.when(kind == 1, F.lit("0.02").cast(MONEY)).otherwise(F.lit("0.00").cast(MONEY))).cast(MONEY)
    booked = kind != 4
    return own.withColumns({"book_net": F.when(booked, net), "book_vat": F.when(booked, vat), "book_total": F.when(booked, total)})
