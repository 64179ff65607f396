"""Binding of receipt and invoice lines to order lines, and what an order line has received and been invoiced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("line_no", "item_code", "model", "goods")


def bind_lines(source: DataFrame, orders: DataFrame, group: str = "business_id") -> DataFrame:
    """The order line of each source line, or why there is none.

    source: (group, source_id, order_ref, line_no, item_code, model, goods); orders: (group, order_line_id, order_ref and
    the same keys). Candidates are the group's order lines, only those of the referenced order if it is there. Line
    number, item code, model and goods name are tried in turn; one must match exactly one candidate. A model that does
    not single one out stops the search if any candidate has a model; at the end a sole candidate is taken.
    Adds order_line_id, bind_rank (1 to 6) and bind_status (UNIQUE, STRONG_MODEL_CONFLICT, AMBIGUOUS, UNBOUND).

    A source line meets only its own group's order lines, and is reduced to counts in the same shuffle.
    """
    o = orders.select(group, F.col("order_line_id"), F.col("order_ref").alias("o_ref"), *(F.col(k).alias(f"o_{k}") for k in KEYS))
    met = source.join(o, group, "left")
    ref = F.col("order_ref") == F.col("o_ref")
    there = F.col("order_line_id").isNotNull()
    counts, names = [], {}
    for scope, inside in (("r", there & ref), ("a", there)):
        names[scope] = {}
        for k in KEYS:
            hit = inside & (F.col(k) == F.col(f"o_{k}"))
            counts += [F.count_if(hit).alias(f"{scope}_{k}"), F.min(F.when(hit, F.col("order_line_id"))).alias(f"{scope}_{k}_id")]
        counts += [F.count_if(inside).alias(f"{scope}_n"), F.min(F.when(inside, F.col("order_line_id"))).alias(f"{scope}_id"), F.count_if(inside & F.col("o_model").isNotNull()).alias(f"{scope}_models")]
    got = met.groupBy(*source.columns).agg(*counts)
    scoped = lambda c: F.when(F.col("r_n") > 0, F.col(f"r_{c}")).otherwise(F.col(f"a_{c}"))
    shift = F.when(F.col("r_n") > 0, 0).otherwise(1)
    one = {k: F.col(k).isNotNull() & (scoped(k) == 1) for k in KEYS}
    conflict = F.col("model").isNotNull() & (scoped("models") > 0)
    alone = scoped("n") == 1
    pick = lambda of, alone_value, none: F.when(one["line_no"], of("line_no", 1)).when(one["item_code"], of("item_code", 2)).when(one["model"], of("model", 3)).when(conflict, none).when(one["goods"], of("goods", 4)).when(alone, alone_value).otherwise(none)
    bound = pick(lambda k, _: scoped(f"{k}_id"), scoped("id"), F.lit(None))
    rank = pick(lambda _, n: n + shift, 5 + shift, F.lit(None))
    out = got.select(*source.columns, bound.alias("order_line_id"), rank.cast("long").alias("bind_rank"), (conflict & bound.isNull()).alias("__c"), F.col("a_n").alias("__n"))
    status = F.when(F.col("order_line_id").isNotNull(), "UNIQUE").when(F.col("__c"), "STRONG_MODEL_CONFLICT").when(F.col("__n") > 1, "AMBIGUOUS").otherwise("UNBOUND")
    return out.withColumn("bind_status", status).drop("__c", "__n")


def mark_duplicate_lines(bound: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds duplicate: among bound lines, every line but the first of its key. Lines without an order line never are."""
    rn = F.row_number().over(W.partitionBy(*key, F.col("order_line_id").isNull()).orderBy(*order))
    return bound.withColumn("duplicate", F.col("order_line_id").isNotNull() & (rn > 1))


def _flags(complete: Column) -> tuple[Column, Column]:
    q, r, i = F.col("ordered_qty"), F.col("received_qty"), F.col("invoiced_qty")
    a, ra, ia = F.col("order_amount"), F.col("received_amount"), F.col("invoiced_amount")
    none = F.col("qty_missing")
    flag = lambda when, name: F.when(when, F.lit(name))
    r_amt, i_amt = a.isNotNull() & F.col("received_amount_seen"), a.isNotNull() & F.col("invoiced_amount_seen")
    flags = F.array_compact(F.array(
        flag(none, "QUANTITY_EVIDENCE_MISSING"), flag(~none & (r > q), "OVER_RECEIPT"), flag(~none & (q > 0) & (r < q), "PARTIAL_FULFILLMENT"),
        flag(~none & (i > r), "OVER_INVOICE_QTY"), flag(~none & (r > 0) & (i < r), "PARTIAL_INVOICE"),
        flag(r_amt & (ra > a), "OVER_RECEIPT_AMT"), flag(r_amt & (ra > 0) & (ra < a), "PARTIAL_RECEIPT_AMT"),
        flag(i_amt & (ia > a), "OVER_INVOICE_AMT"), flag(i_amt & (ia > 0) & (ia < a), "PARTIAL_INVOICE_AMT"),
        flag(F.col("any_duplicate"), "DUPLICATE_SOURCE_LINE"), flag(F.col("any_ambiguous"), "AMBIGUOUS_LINK"),
        flag(F.col("any_unbound") & ~F.col("any_ambiguous"), "UNBOUND"), flag(F.col("any_conflict"), "STRONG_MODEL_CONFLICT"),
    ))
    has = lambda *names: F.arrays_overlap(flags, F.array(*map(F.lit, names)))
    hard = has("OVER_RECEIPT", "OVER_INVOICE_QTY", "OVER_RECEIPT_AMT", "OVER_INVOICE_AMT", "DUPLICATE_SOURCE_LINE")
    part = has("PARTIAL_FULFILLMENT", "PARTIAL_INVOICE", "PARTIAL_RECEIPT_AMT", "PARTIAL_INVOICE_AMT")
    review = has("AMBIGUOUS_LINK", "UNBOUND", "STRONG_MODEL_CONFLICT", "QUANTITY_EVIDENCE_MISSING")
    claimed = ~hard & complete & part
    light = F.when(hard | claimed, "RED").when(part | review, "YELLOW").when((q == r) & (r == i), "GREEN").otherwise("YELLOW")
    return F.when(claimed, F.concat(flags, F.array(F.lit("SET_CLAIMED_INCOMPLETE")))).otherwise(flags), light


def allocate(orders: DataFrame, bound: DataFrame, group: str = "business_id", complete: Column | None = None) -> DataFrame:
    """One row for each order line: what was ordered, received and invoiced in quantity and amount, flags and a light.

    orders: (group, order_line_id, qty, amount); bound: the marked result of bind_lines with role, qty and amount. A
    duplicate, ambiguous, unbound or conflicting line anywhere in a group marks every row of it.
    """
    take = lambda role, c: F.sum(F.when(F.col("role") == role, F.coalesce(F.col(c), F.lit(0)))).alias(f"{role}_{c}")
    seen = lambda role: F.coalesce(F.bool_or((F.col("role") == role) & F.col("amount").isNotNull()), F.lit(False)).alias(f"{role}_seen")
    lines = bound.where(F.col("order_line_id").isNotNull() & ~F.col("duplicate")).groupBy(group, "order_line_id").agg(take("receipt", "qty"), take("invoice", "qty"), take("receipt", "amount"), take("invoice", "amount"), seen("receipt"), seen("invoice"), F.bool_or(F.col("qty").isNull()).alias("missing"))
    marks = bound.groupBy(group).agg(F.bool_or("duplicate").alias("any_duplicate"), *(F.bool_or(F.col("bind_status") == s).alias(n) for s, n in (("AMBIGUOUS", "any_ambiguous"), ("UNBOUND", "any_unbound"), ("STRONG_MODEL_CONFLICT", "any_conflict"))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(28,4)"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    wide = orders.select(group, "order_line_id", F.col("qty").alias("o_qty"), F.col("amount").alias("order_amount")).join(lines, [group, "order_line_id"], "left").join(marks, group, "left")
    wide = wide.select(
        group, "order_line_id", F.coalesce("o_qty", F.lit(0)).alias("ordered_qty"), "order_amount", zero("receipt_qty").alias("received_qty"), zero("invoice_qty").alias("invoiced_qty"), zero("receipt_amount").alias("received_amount"), zero("invoice_amount").alias("invoiced_amount"),
        no("receipt_seen").alias("received_amount_seen"), no("invoice_seen").alias("invoiced_amount_seen"), (F.col("o_qty").isNull() | no("missing")).alias("qty_missing"), *(no(c).alias(c) for c in ("any_duplicate", "any_ambiguous", "any_unbound", "any_conflict")),
    )
    flags, light = _flags(F.lit(False) if complete is None else complete)
    return wide.withColumns({"flags": flags, "light": light})


def allocation_totals(rows: DataFrame, group: str = "business_id") -> DataFrame:
    """Sums for each group and its worst light."""
    worst = F.max(F.when(F.col("light") == "RED", 3).when(F.col("light") == "YELLOW", 2).otherwise(1))
    sums = [F.sum(c).alias(c) for c in ("ordered_qty", "received_qty", "invoiced_qty", "order_amount", "received_amount", "invoiced_amount")]
    return rows.groupBy(group).agg(*sums, F.count("*").alias("n_lines"), worst.alias("w")).withColumn("light", F.element_at(F.array(F.lit("GREEN"), F.lit("YELLOW"), F.lit("RED")), F.col("w"))).drop("w")


def bind_by_evidence(source: DataFrame, orders: DataFrame, group: str = "business_id") -> DataFrame:
    """The order lines that each source line may stand for, by item code, then model, then goods name.

    source: (group, source_id, item_code, model, goods), keys normalised, null where unknown; orders: (group, order_line_id
    and the same keys). The first key that the source line has and order lines share decides: one such line is the match,
    several are a tie. An item code or model that no order line shares ends the search, if any order line has one at all.
    Without any shared key a sole order line is taken.
    Adds order_line_ids (all candidates, sorted) and basis: ITEM_CODE, MODEL, GOODS, SOLE_LINE, TIED, STRONG_ITEM_CODE_CONFLICT,
    STRONG_MODEL_CONFLICT or UNBOUND. Lines are compared within their group only.
    """
    keys = ("item_code", "model", "goods")
    o = orders.select(group, "order_line_id", *(F.col(k).alias(f"o_{k}") for k in keys))
    met = source.join(o, group, "left")
    there = F.col("order_line_id").isNotNull()
    hit = {k: there & (F.col(k) == F.col(f"o_{k}")) for k in keys}
    got = met.groupBy(*source.columns).agg(
        *(F.array_sort(F.collect_list(F.when(hit[k], F.col("order_line_id")))).alias(f"h_{k}") for k in keys),
        *(F.count_if(there & F.col(f"o_{k}").isNotNull()).alias(f"n_{k}") for k in keys[:2]),
        F.count_if(there).alias("n"), F.min("order_line_id").alias("least"),
    )
    none = F.array().cast(got.schema["h_goods"].dataType)
    found, strong = {k: F.size(f"h_{k}") > 0 for k in keys}, {k: F.col(k).isNotNull() & (F.col(f"n_{k}") > 0) for k in keys[:2]}
    sole = F.col("n") == 1
    pick = lambda of, clash, alone, nothing: F.when(found["item_code"], of("item_code")).when(strong["item_code"], clash("item_code")).when(found["model"], of("model")).when(strong["model"], clash("model")).when(found["goods"], of("goods")).when(sole, alone).otherwise(nothing)
    ids = pick(lambda k: F.col(f"h_{k}"), lambda _: none, F.array("least"), none)
    basis = pick(lambda k: F.when(F.size(f"h_{k}") > 1, "TIED").otherwise(F.lit(k.upper())), lambda k: F.lit(f"STRONG_{k.upper()}_CONFLICT"), F.lit("SOLE_LINE"), F.lit("UNBOUND"))
    return got.select(*source.columns, ids.alias("order_line_ids"), basis.alias("basis"))


def line_evidence(bound: DataFrame, orders: DataFrame, group: str = "business_id") -> DataFrame:
    """orders with received and invoiced (the quantities of the lines bound to them alone), quantity_result and reasons.

    A tied line, a role without lines and a missing quantity leave the result at REVIEW; else it is PASS where ordered,
    received and invoiced quantities are equal, and FAIL with what differs.
    bound: as bind_by_evidence() gives it, with role (receipt or invoice) and quantity; orders: (group, order_line_id,
    quantity).
    """
    each = bound.select(group, F.explode("order_line_ids").alias("order_line_id"), "role", F.col("quantity").alias("q"), (F.col("basis") == "TIED").alias("tied"))
    own = lambda role: (F.col("role") == role) & ~F.col("tied")
    total = lambda role: F.when(F.count_if(own(role) & F.col("q").isNull()) == 0, F.sum(F.when(own(role), F.col("q"))))
    got = each.groupBy(group, "order_line_id").agg(
        total("receipt").alias("received"), total("invoice").alias("invoiced"), F.bool_or("tied").alias("ambiguous"),
        F.count_if(own("receipt")).alias("receipts"), F.count_if(own("invoice")).alias("invoices"),
    )
    out = orders.join(got, [group, "order_line_id"], "left")
    n, r, i = F.col("quantity"), F.col("received"), F.col("invoiced")
    roles = (F.coalesce("receipts", F.lit(0)) == 0) | (F.coalesce("invoices", F.lit(0)) == 0)
    missing = n.isNull() | r.isNull() | i.isNull()
    differ = F.filter(
        F.array(F.when((r < n) | (i < n), "QUANTITY_SHORTAGE"), F.when((r > n) | (i > n), "QUANTITY_OVERAGE"), F.when(r != i, "RECEIPT_INVOICE_QUANTITY_MISMATCH")),
        lambda x: x.isNotNull(),
    )
    tied = F.coalesce("ambiguous", F.lit(False))
    reasons = F.when(tied, F.array(F.lit("AMBIGUOUS_LINE_ASSIGNMENT"))).when(roles, F.array(F.lit("LINE_ROLE_EVIDENCE_MISSING"))).when(missing, F.array(F.lit("LINE_QUANTITY_EVIDENCE_MISSING"))).otherwise(differ)
    result = F.when(tied | roles | missing, "REVIEW").when(F.size(reasons) == 0, "PASS").otherwise("FAIL")
    return out.select(*orders.columns, "received", "invoiced", result.alias("quantity_result"), reasons.alias("reasons"))
