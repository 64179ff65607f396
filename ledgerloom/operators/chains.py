"""A business's documents taken together: pricing, anchors, evidence components, amounts in doubt, and plans of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.text import compact, first_filled
from ledgerloom.operators.components import connected_components
from ledgerloom.plans.stash import stash

DEFAULT_VAT = "0.13"


def amount_with_basis(total: Column, net: Column, tax: Column) -> tuple[Column, Column]:
    """An amount and what it is: the total, net and tax together, or the net alone."""
    both = net.isNotNull() & tax.isNotNull()
    amount = F.coalesce(total, F.when(both, net + tax), net)
    return amount, F.when(total.isNotNull(), "TOTAL").when(both, "NET_PLUS_TAX").when(net.isNotNull(), "NET")


def receipt_date(acceptance: Column, document: Column, cutoff: Column, receipt: Column, delivery: Column) -> Column:
    return F.coalesce(acceptance, document, cutoff, receipt, delivery)


def readable(status: Column, accepted: Column, candidate: Column, raw: Column) -> tuple[Column, Column]:
    """What a field shows (accepted, else candidate, else as read) and what rules may read (accepted only)."""
    ok = F.when(status == "ACCEPTED", accepted)
    return first_filled(ok, F.when(status != "REJECTED", candidate), raw), ok


def _by_role(df: DataFrame, key: str, role: str, columns: list[str], roles: list[str], order: str) -> DataFrame:
    """The first value of each column for each role, in one grouping."""
    pick = lambda c, r: F.min_by(F.when(F.col(role) == r, F.col(c)), F.when((F.col(role) == r) & F.col(c).isNotNull(), F.col(order))).alias(f"{r}_{c}")
    return df.groupBy(key).agg(*(pick(c, r) for c in columns for r in roles))


def merge_pricing(docs: DataFrame, key: str = "business_id", role: str = "role", order: str = "pos", export: Column | None = None) -> DataFrame:
    """(key, quantity, quantity_source, price, discount, vat, vat_source) by authority from rows (key, role, pos, quantity,
    price, discount, vat): price and discount of order, contract, invoice; VAT of invoice, order, contract, else the
    default, 0 for exports; quantity of receipt, delivery, bill of lading, else of order, invoice, contract, which is marked
    as UNCONFIRMED."""
    roles = ["order", "contract", "invoice", "receipt", "delivery", "bol"]
    wide = _by_role(docs, key, role, ["quantity", "price", "discount", "vat"], roles, order)
    take = lambda c, rs: F.coalesce(*(F.col(f"{r}_{c}") for r in rs))
    moved, agreed = take("quantity", ["receipt", "delivery", "bol"]), take("quantity", ["order", "invoice", "contract"])
    vat = take("vat", ["invoice", "order", "contract"])
    out = F.lit(False) if export is None else F.coalesce(export, F.lit(False))
    zero, usual = F.lit("0").cast("decimal(9,6)"), F.lit(DEFAULT_VAT).cast("decimal(9,6)")
    return wide.select(
        key, F.coalesce(moved, agreed).alias("quantity"), F.when(moved.isNotNull(), "CONFIRMED").when(agreed.isNotNull(), "UNCONFIRMED").otherwise("MISSING").alias("quantity_source"),
        take("price", ["order", "contract", "invoice"]).alias("price"), F.coalesce(take("discount", ["order", "contract", "invoice"]), F.lit(0)).alias("discount"),
        F.when(out, zero).otherwise(F.coalesce(vat.cast("decimal(9,6)"), usual)).alias("vat"), F.when(out, "EXPORT").when(vat.isNotNull(), "DOCUMENT").otherwise("DEFAULT").alias("vat_source"),
    )


def contract_anchors(docs: DataFrame, key: str = "business_id", role: str = "role", number: str = "number", blob: str = "blob") -> DataFrame:
    """(key, number): businesses without an order and with exactly one contract, whose number every receipt and invoice
    holds, format aside; there the contract stands for the order."""
    contracts = docs.where(F.col(role) == "contract").groupBy(key).agg(F.count("*").alias("n"), F.min(number).alias("number")).where("n = 1 AND number IS NOT NULL")
    ordered = docs.where(F.col(role) == "order").select(key).distinct()
    evidence = docs.where(F.col(role).isin("receipt", "invoice")).select(key, compact(F.col(blob)).alias("__b"))
    met = evidence.join(contracts, key).groupBy(key).agg(F.bool_and(F.contains("__b", compact(F.col("number")))).alias("ok"), F.first("number").alias("number"))
    return met.where("ok").join(ordered, key, "left_anti").select(key, "number")


def per_invoice(invoices: DataFrame, anchors: DataFrame, cutoff_status: Column, key: str = "business_id") -> DataFrame:
    """(key, status, invoices, failed): each invoice against its business's anchor (customer, reference, and cut-off), the
    worst of them. invoices: (key, customer, reference, ...); anchors: (key, customer, reference)."""
    a = anchors.select(key, compact(F.col("customer")).alias("__c"), compact(F.col("reference")).alias("__r"))
    both = invoices.join(a, key, "left")
    bad = F.col("__r").isNull() | (compact(F.col("customer")) != F.col("__c")) | ~F.coalesce(F.contains(compact(F.col("reference")), F.col("__r")), F.lit(False))
    rank = F.when(bad | (cutoff_status == "FAIL"), 3).when(cutoff_status == "WARNING", 2).otherwise(1)
    got = both.groupBy(key).agg(F.max(rank).alias("__w"), F.count("*").alias("invoices"), F.count_if(rank == 3).alias("failed"))
    return got.select(key, F.element_at(F.array(F.lit("PASS"), F.lit("WARNING"), F.lit("FAIL")), F.col("__w")).alias("status"), "invoices", "failed")


def fulfilment_override(decision: Column, light: Column) -> Column:
    """The decision on a business after its lines are allocated: a red light holds it, a yellow one warns."""
    return F.when(light == "RED", "HOLD_REVIEW").when((light == "YELLOW") & (decision == "AUTO_PASS"), "PASS_WITH_WARNING").otherwise(decision)


def binding_view(keys: DataFrame, roles: list[str], confirmed: Column, group: str = "business_id", role: str = "role", key: str = "key") -> DataFrame:
    """(group, binding): MISSING_DOCUMENTS, NO_SHARED_KEY, HUMAN_CONFIRMED or SHARED_KEY. A key is shared if documents of all
    the roles have it; confirmed is over (group)."""
    by_key = keys.where(F.col(role).isin(roles)).groupBy(group, key).agg(F.count_distinct(role).alias("n"))
    shared = by_key.groupBy(group).agg(F.max(F.when(F.col(key).isNotNull(), F.col("n"))).alias("__n"))
    there = keys.groupBy(group).agg(F.count_distinct(F.when(F.col(role).isin(roles), F.col(role))).alias("__r"))
    both = there.join(shared, group, "left")
    return both.select(group, F.when(F.col("__r") < len(roles), "MISSING_DOCUMENTS").when(F.coalesce(confirmed, F.lit(False)), "HUMAN_CONFIRMED").when(F.coalesce("__n", F.lit(0)) < len(roles), "NO_SHARED_KEY").otherwise("SHARED_KEY").alias("binding"))


def evidence_components(nodes: DataFrame, anchors: DataFrame, group: str = "group", doc: str = "doc_id", key: str = "key") -> DataFrame:
    """(doc, component, score, main): documents of one group that share keys, directly or through others; a component's
    score is 1 for each document and 1 for each of its keys that an anchor (key) names; main: its group's best component.

    Documents meet at their keys, so n documents of a key are n edges, not all pairs.
    """
    own = nodes.where(F.col(key).isNotNull()).select(F.col(group).alias("g"), F.col(doc).alias("d"), F.col(key).alias("k")).distinct()
    own = stash(own.withColumns({"src": F.concat_ws("|", F.lit("d"), "g", F.col("d").cast("string")), "dst": F.concat_ws("|", F.lit("k"), "g", "k")}), "nodes")
    part = connected_components(own).withColumnRenamed("node", "src")
    known = anchors.select(F.col(key).alias("k")).distinct().withColumn("a", F.lit(1))
    overlap = own.join(known, "k", "left").groupBy("src", "g", "d").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"))
    placed = stash(overlap.join(part, "src"), "placed")
    score = placed.groupBy("g", "component").agg(F.sum(F.lit(1) + F.col("a")).alias("score"))
    best = score.groupBy("g").agg(F.max(F.struct("score", "component")).alias("b"))
    out = placed.join(score, ["g", "component"]).join(best, "g")
    return out.select(F.col("d").alias(doc), "component", "score", (F.col("component") == F.col("b.component")).alias("main"))


def line_gross(gross: Column, qty: Column, price: Column, discount: Column, tax: Column) -> tuple[Column, Column]:
    """A line's gross amount and the formula it comes from: as stated, else recomputed."""
    made = F.round(qty * price * (1 - F.coalesce(discount, F.lit(0))) * (1 + F.coalesce(tax, F.lit(0))), 2)
    trace = F.when(gross.isNotNull(), "stated").when(made.isNotNull(), F.concat_ws(" ", qty.cast("string"), F.lit("x"), price.cast("string"), F.lit("x (1 -"), F.coalesce(discount, F.lit(0)).cast("string"), F.lit(") x (1 +"), F.coalesce(tax, F.lit(0)).cast("string"), F.lit(")")))
    return F.coalesce(gross, made), trace


def ranked_candidates(df: DataFrame, keys: list[str], value: str, priority: str, position: str, most: int = 5) -> DataFrame:
    """Candidates of a field, each value once (of the best source), the best `most` of them (the feature's own limit)."""
    once = df.groupBy(*keys, value).agg(F.min(F.struct(priority, position)).alias("__o"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("__o", value))
    return once.select(*keys, rank.alias("rank"), value, F.col(f"__o.{priority}").alias(priority)).where(F.col("rank") <= most)


def amount_triggers(df: DataFrame) -> DataFrame:
    """Adds triggers, why an amount is in doubt: several competing candidates, parts that do not add up, one value in two
    roles, a competing number nearby, or no total. Columns: candidates (count of distinct plausible values), net, tax,
    total, quantity, nearby (count)."""
    n, t, s = (F.col(c).cast("decimal(18,2)") for c in ("net", "tax", "total"))
    q = F.col("quantity").cast("decimal(18,4)")
    flags = [(F.col("candidates") > 1, "MULTIPLE_CANDIDATES"), (F.abs(n + t - s) > F.lit("0.01").cast("decimal(18,2)"), "RECONCILIATION_FAILED"), ((q == s) | (q == n), "ROLE_COLLISION"), (F.col("nearby") > 0, "INTERFERENCE_NEARBY"), (s.isNull() & n.isNotNull(), "MISSING_TOTAL")]
    return df.withColumn("triggers", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(x)) for c, x in flags))))


def plausible(value: Column, current: Column, quantity: Column) -> Column:
    """Whether a number competes with the current amount: not the same, not a quantity, of its order of size."""
    return F.coalesce((F.abs(value - current) > 0.009) & (value > 0) & (value != F.coalesce(quantity, F.lit(-1))) & value.between(current / 100, current * 100), F.lit(False))


def merge_specialist(candidates: DataFrame, found: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Candidates with a specialist's readings: one within 0.009 of a candidate confirms it, others are added."""
    met = found.withColumn("__v", F.col(value)).drop(value).join(candidates, keys, "left").withColumn("__hit", F.coalesce(F.abs(F.col("__v") - F.col(value)) <= 0.009, F.lit(False)))
    hits = met.where("__hit").select(*keys, value).distinct().withColumn("confirmed", F.lit(True))
    new = met.groupBy(*keys, "__v").agg(F.bool_or("__hit").alias("h")).where("NOT h").select(*keys, F.col("__v").alias(value), F.lit(True).alias("confirmed"))
    return candidates.select(*keys, value).join(hits, [*keys, value], "left").select(*keys, value, F.coalesce("confirmed", F.lit(False)).alias("confirmed")).unionByName(new)


def nearest_label(text: Column, value: Column, labels: list[str], before: int = 64, after: int = 32) -> Column:
    """The label that stands nearest to a value's first place in a text, within a window around it; null without one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    at = F.instr(low, F.lower(value))
    start = F.greatest(at - before, F.lit(1))
    window = F.substring(low, start, at - start + F.length(value) + after)
    found = F.array(*(F.struct((F.abs(F.instr(window, F.lit(x.lower())) + start - 1 - at)).alias("d"), F.lit(x).alias("x"), (F.instr(window, F.lit(x.lower())) > 0).alias("ok")) for x in labels))
    return F.when(at > 0, F.get(F.array_sort(F.filter(found, lambda f: f["ok"])), F.lit(0))["x"])


def chronology_events(events: DataFrame, key: str = "business_id", label: str = "label", at: str = "date") -> DataFrame:
    """(key, events): the first date of each label, in the order of the dates. A key has as many entries as labels."""
    first = events.where(F.col(at).isNotNull()).groupBy(key, label).agg(F.min(at).alias("__d"))
    return first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("__d").alias("date"), F.col(label).alias("label")))).alias("events"))


def heading_sections(lines: DataFrame, heading: Column, key: str = "doc_id", at: str = "line") -> DataFrame:
    """(key, line, until): each heading's line and the line before the next one, or null at the end."""
    heads = lines.where(heading).select(key, at)
    return heads.withColumn("until", F.lead(at).over(W.partitionBy(key).orderBy(at)) - 1)


def cluster_files(units: DataFrame, file: str = "file", so: str = "order_no") -> DataFrame:
    """(file, mode, order_no): one chain for a file whose units name one order number at the most; else multi."""
    got = units.groupBy(file).agg(F.count_distinct(F.nullif(F.col(so), F.lit(""))).alias("n"), F.min(F.nullif(F.col(so), F.lit(""))).alias("first"))
    return got.select(file, F.when(F.col("n") > 1, "multi").otherwise("single").alias("mode"), F.when(F.col("n") <= 1, F.col("first")).alias(so))


def missing_fields(docs: DataFrame, required: dict[str, list[tuple[str, ...]]], doc: str = "doc_id", kind: str = "doc_type", filled: str = "filled") -> DataFrame:
    """(doc, missing): for each document the groups of its type's required fields of which none is filled. filled: the
    array of filled field keys; a group is a tuple of alternatives and is named by its first."""
    groups = F.create_map(*(x for t, gs in required.items() for x in (F.lit(t), F.array(*(F.array(*map(F.lit, g)) for g in gs)))))
    have = F.coalesce(F.col(filled), F.array().cast("array<string>"))
    lacking = F.transform(F.filter(groups[F.col(kind)], lambda g: ~F.arrays_overlap(g, have)), lambda g: g[0])
    return docs.select(doc, F.explode(lacking).alias("missing"))


def field_plan(*lists: Column) -> Column:
    """System's required, selected, custom and extra fields as one list, each field once, in that order."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(*(F.coalesce(x, empty) for x in lists))))


def plan_steps(goals: DataFrame, steps: dict[str, list[str]], order: list[str], job: str = "job_id", goal: str = "goal") -> DataFrame:
    """(job, steps): the union of the steps of a job's goals, in the canonical order."""
    known = F.create_map(*(x for g, s in steps.items() for x in (F.lit(g), F.array(*map(F.lit, s)))))
    each = goals.select(job, F.explode(known[F.col(goal)]).alias("s")).distinct()
    place = F.array_position(F.array(*map(F.lit, order)), F.col("s"))
    return each.groupBy(job).agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "s"))), lambda x: x["s"]).alias("steps"))


def shared_by_all(keys: DataFrame, group: str, doc: str, key: str) -> DataFrame:
    """(group, key) of the keys that every document of a group has."""
    n = keys.groupBy(group).agg(F.count_distinct(doc).alias("__n"))
    have = keys.where(F.col(key).isNotNull()).groupBy(group, key).agg(F.count_distinct(doc).alias("__h"))
    return have.join(n, group).where("__h = __n").select(group, key)


def batch_join(book: DataFrame, packs: DataFrame, requested: DataFrame | None, key: str = "business_id") -> DataFrame:
    """Ledger rows with their voucher packs; pack_status MISSING is kept for requested businesses only, or for all if no
    request is given."""
    have = packs.select(key).distinct().withColumn("__p", F.lit(True))
    out = book.join(have, key, "left").withColumn("pack_status", F.when(F.col("__p"), "FOUND").otherwise("MISSING")).drop("__p")
    if requested is not None:
        wanted = requested.select(key).distinct().withColumn("__w", F.lit(True))
        out = out.join(wanted, key, "left").where((F.col("pack_status") == "FOUND") | F.col("__w")).drop("__w")
    return out


def acknowledged(findings: DataFrame, acks: DataFrame, key: str = "finding_id") -> DataFrame:
    """Findings with genuine and reason of their last acknowledgement (key, seq, genuine, reason)."""
    last = acks.groupBy(key).agg(F.max_by(F.struct("genuine", "reason"), "seq").alias("a"))
    return findings.join(last, key, "left").select(*findings.columns, F.col("a.genuine").alias("genuine"), F.col("a.reason").alias("ack_reason"))


def formula_conflict(control: Column, period_end: Column, independent: Column) -> Column:
    """Whether the template's own test (control date after the period's end) contradicts an independent verdict."""
    label = F.when(control > period_end, False).when(control <= period_end, True)
    return label.isNotNull() & independent.isNotNull() & (label != independent)


def group_amount_conflict(low: Column, high: Column) -> Column:
    """An alert where amounts of a group differ by more than 0.02 and more than 2 %."""
    return F.coalesce(high - low > F.greatest(F.lit(0.02), F.abs(high) * 0.02), F.lit(False))


def notes(parts: list[Column]) -> Column:
    """Observations and pending items as one text, each once, in order."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*parts))), "；")


def summary_text(business: Column, status: Column, ordered: Column, received: Column, invoiced: Column) -> Column:
    """One sentence on a business, for readers."""
    num = lambda c: F.when(c.isNull(), "-").otherwise(F.format_string("%.2f", c.cast("double")))
    return F.concat(F.lit("Business "), business.cast("string"), F.lit(": "), F.lower(status), F.lit("; ordered "), num(ordered), F.lit(", received "), num(received), F.lit(", invoiced "), num(invoiced), F.lit("."))
