"""What follows from decisions on open events: records, findings, values, advice taken, and what is stale after them.

All decisions of a batch are looked at together, by joins: each against its event as it is now. A decision that may not be
taken says why and changes nothing. Of several decisions of one event the first that may be taken counts.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators.reviews import invalidated

# Choices that an event's kind of action allows, and those that need a reason.
ALLOWED = {
    "DECIDE_ADVISORY": ("ACCEPT_AI", "OVERRIDE", "MANUAL_VALUE"),
    "REVIEW_FIELD": ("ACCEPT_AI", "OVERRIDE", "MANUAL_VALUE"),
    "DECIDE_FINDING": ("AUDIT_FAIL", "DOCUMENT_ISSUE"),
    "REVIEW_EVIDENCE": ("DOCUMENT_ISSUE",),
    "REVIEW_SAMPLE": ("CORRECT", "FALSE_NEGATIVE", "ACCEPT_AI", "AUDIT_FAIL", "DOCUMENT_ISSUE"),
}
REASON_NEEDED = ("OVERRIDE", "AUDIT_FAIL", "DOCUMENT_ISSUE", "FALSE_NEGATIVE")
VALUE_GIVEN = ("OVERRIDE", "MANUAL_VALUE")
FINDING = ("FALSE_NEGATIVE", "AUDIT_FAIL")


class Effects(NamedTuple):
    """records (event_id, seq, decision, state, problem, before, after), of every decision; findings (finding_id, event_id,
    chain_id, reason, operator); values (file_name, field_name, value, event_id); advice (candidate_id, status, event_id);
    stale (chain_id, stage), all that depends on what was changed."""

    records: DataFrame
    findings: DataFrame
    values: DataFrame
    advice: DataFrame
    stale: DataFrame


def effects(events: DataFrame, decisions: DataFrame) -> Effects:
    """events: (event_id, chain_id, event_type, action_kind, source_ref, file_name, field_name, observed, suggested,
    invalidates array<string>); decisions: (event_id, seq, decision, reason, operator, value).

    A problem is, in this order: no such event; a reason that is needed and missing; a manual value that is missing; a
    missing document, which only an upload resolves; a choice that the event's action does not allow; a value without a
    place to be put; an event that an earlier decision has settled.
    """
    d = decisions.select("event_id", "seq", F.upper(F.coalesce("decision", F.lit(""))).alias("decision"), F.trim(F.coalesce("reason", F.lit(""))).alias("reason"), "operator", F.nullif(F.col("value"), F.lit("")).alias("value"))
    e = events.withColumn("known", F.lit(True))
    both = d.join(e, "event_id", "left")
    allowed = F.create_map(*(x for k, v in ALLOWED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    may = F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("action_kind")), F.col("decision")), F.lit(False))
    puts = F.col("decision").isin(*VALUE_GIVEN) & F.col("value").isNotNull()
    nowhere = puts & (F.coalesce("file_name", F.lit("")) == "") | puts & (F.coalesce("field_name", F.lit("")) == "")
    problem = (
        F.when(F.col("known").isNull(), "NO_EVENT")
        .when(F.col("decision").isin(*REASON_NEEDED) & (F.col("reason") == ""), "REASON_MISSING")
        .when((F.col("decision") == "MANUAL_VALUE") & F.col("value").isNull(), "VALUE_MISSING")
        .when(F.col("event_type") == "MISSING_DOCUMENT", "UPLOAD_NEEDED")
        .when(~may, "NOT_ALLOWED")
        .when(nowhere, "NO_PLACE")
    )
    told = both.withColumn("puts", puts).withColumn("problem", problem)
    first = F.min(F.when(F.col("problem").isNull(), F.col("seq"))).over(W.partitionBy("event_id"))
    told = told.withColumn("problem", F.when(F.col("problem").isNull() & (F.col("seq") > first), "SETTLED").otherwise(F.col("problem")))
    taken = told.where("problem IS NULL")
    state = F.when(F.col("problem").isNull(), "RESOLVED").otherwise("REFUSED")
    records = told.select("event_id", "seq", "decision", state.alias("state"), "problem", F.col("observed").alias("before"), F.when(F.col("problem").isNull(), F.coalesce("value", "suggested")).alias("after"))
    sampled = taken.where((F.col("action_kind") == "REVIEW_SAMPLE") & F.col("decision").isin(*FINDING))
    findings = sampled.select(F.concat(F.lit("qf:"), "event_id").alias("finding_id"), "event_id", "chain_id", "reason", "operator")
    values = taken.where("puts").select("file_name", "field_name", "value", "event_id")
    advised = taken.where((F.col("action_kind") == "DECIDE_ADVISORY") & F.startswith("source_ref", F.lit("advisory:")))
    advice = advised.select(F.substr("source_ref", F.lit(10)).alias("candidate_id"), F.when(F.col("decision") == "ACCEPT_AI", "VERIFIED").otherwise("REJECTED").alias("status"), "event_id")
    none = F.array().cast("array<string>")
    stages = (
        F.when((F.col("action_kind") == "REVIEW_SAMPLE") & F.col("decision").isin(*FINDING), F.array(F.lit("conclusion"), F.lit("workbook")))
        .when(F.col("puts"), F.when(F.size(F.coalesce("invalidates", none)) > 0, F.col("invalidates")).otherwise(F.array(F.lit("fields"))))
        .when((F.col("action_kind") == "DECIDE_ADVISORY") & (F.col("decision") != "ACCEPT_AI"), none)
        .otherwise(F.coalesce("invalidates", none))
    )
    stale = invalidated(taken.select("chain_id", F.explode(stages).alias("stage"))).where("stage IS NOT NULL")
    return Effects(records, findings, values, advice, stale)


def put_values(fields: DataFrame, values: DataFrame) -> DataFrame:
    """fields (file_name, field_name, value, status) with the values that were put: each accepted, and added where the file
    did not have the field. Of several values of one field that of the largest event id counts."""
    last = values.groupBy("file_name", "field_name").agg(F.max_by("value", "event_id").alias("__v"))
    both = fields.join(last, ["file_name", "field_name"], "full")
    return both.select("file_name", "field_name", F.coalesce("__v", "value").alias("value"), F.when(F.col("__v").isNotNull(), "ACCEPTED").otherwise(F.col("status")).alias("status"))
