"""Open issues, human decisions laid over them, the state of a desk, readiness for export, and working papers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("BLOCKING", "REVIEW", "SAMPLE", "INFO")


def event_id(*parts: Column) -> Column:
    return F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 16))


def events(producers: list[DataFrame]) -> DataFrame:
    """(event_id, severity_rank, chain_id, event_type, severity, reason, source_ref) of all producers (chain_id, event_type,
    severity, reason, source_ref); of rows with one id the last producer's stays, the largest of several there."""
    own = [p.select("chain_id", "event_type", "severity", "reason", "source_ref", F.lit(i).alias("__from")) for i, p in enumerate(producers)]
    rows = reduce(DataFrame.unionByName, own).withColumn("event_id", event_id(F.col("event_type"), F.col("chain_id"), F.col("source_ref")))
    kept = rows.groupBy("event_id").agg(F.max(F.struct("__from", "chain_id", "event_type", "severity", "reason", "source_ref")).alias("e"))
    rank = reduce(lambda c, s: c.when(F.col("e.severity") == s, SEVERITIES.index(s)), SEVERITIES[1:], F.when(F.col("e.severity") == SEVERITIES[0], 0)).otherwise(9)
    return kept.select("event_id", rank.alias("severity_rank"), "e.chain_id", "e.event_type", "e.severity", "e.reason", "e.source_ref")


def open_events(made: DataFrame, decisions: DataFrame) -> DataFrame:
    """Events without a resolution that still fits: a decision (event_id, seq, state, reason) counts while the reason it
    was taken on is the event's. The last decision of an event counts."""
    last = decisions.groupBy("event_id").agg(F.max_by(F.struct("state", "reason"), "seq").alias("d")).where("d.state = 'RESOLVED'").select("event_id", F.col("d.reason").alias("__r"))
    return made.join(last, (made["event_id"] == last["event_id"]) & made["reason"].eqNullSafe(last["__r"]), "left_anti")


def event_summary(made: DataFrame) -> DataFrame:
    """One row: open, blocking, sample, review, missing."""
    s = F.col("severity")
    return made.agg(F.count("*").alias("open"), F.count_if(s == "BLOCKING").alias("blocking"), F.count_if(s == "SAMPLE").alias("sample"), F.count_if(~s.isin("BLOCKING", "SAMPLE")).alias("review"), F.count_if(F.col("event_type") == "MISSING_DOCUMENT").alias("missing"))


def valid_decision(choice: Column, reason: Column, event_type: Column) -> Column:
    """Whether a decision may be taken: some choices need a reason, and a missing document cannot be waived."""
    told = F.length(F.trim(F.coalesce(reason, F.lit("")))) > 0
    needs = choice.isin("WAIVE", "FALSE_POSITIVE", "FALSE_NEGATIVE", "OVERRIDE")
    return (told | ~needs) & ~((choice == "WAIVE") & (event_type == "MISSING_DOCUMENT"))


def upsert(old: DataFrame, new: DataFrame, key: str, decided: Column, refreshed: list[str]) -> DataFrame:
    """Old and new rows by key: a decided old row stays but for its refreshed columns; else the new one counts. decided is
    over old's columns."""
    cols = old.columns
    a = old.withColumn("__d", F.coalesce(decided, F.lit(False))).select(F.col(key), F.struct(*cols, "__d").alias("o"))
    b = new.select(F.col(key), F.struct(*cols).alias("n"))
    both = a.join(b, key, "full")
    take = lambda c: F.when(F.col("n").isNull() | (F.coalesce(F.col("o.__d"), F.lit(False)) & F.lit(c not in refreshed)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return both.select(*(F.col(key) if c == key else take(c).alias(c) for c in cols))


def relation_id(left: Column, right: Column, kind: Column, shared: Column) -> Column:
    """The same for either order of the ends."""
    return F.concat(F.lit("rel_"), F.substring(F.sha2(F.concat_ws("|", F.least(left, right), F.greatest(left, right), kind, F.coalesce(shared, F.lit(""))), 256), 1, 16))


def propose_relations(nodes: DataFrame, doc: str = "doc_id", role: str = "role", key: str = "key") -> DataFrame:
    """(relation_id, from_id, to_id, rel_type, shared_key): documents of different roles that share a key, tied to the
    key's least document of its first role (order, contract, receipt, invoice, payment). A key of n documents gives n - 1
    relations, which link all of them, not all pairs."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("order", "contract", "delivery", "receipt", "invoice", "payment"))), F.col(role)), F.lit(9))
    own = nodes.select(F.col(doc).cast("string").alias("d"), F.col(role).alias("r"), F.col(key).alias("k"), rank.alias("n")).where("k IS NOT NULL AND k <> ''").distinct()
    hub = own.groupBy("k").agg(F.min(F.struct("n", "d", "r")).alias("h"))
    met = own.join(hub, "k").where((F.col("d") != F.col("h.d")) & (F.col("r") != F.col("h.r")))
    kind = F.concat_ws("_", F.col("h.r"), F.col("r"))
    return met.select(relation_id(F.col("h.d"), F.col("d"), kind, F.col("k")).alias("relation_id"), F.col("h.d").alias("from_id"), F.col("d").alias("to_id"), kind.alias("rel_type"), F.col("k").alias("shared_key"))


def overlay(values: DataFrame, log: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Values under a log of decisions (keys, seq, action, value): the last decision of a field counts. ACCEPT takes its
    value, or the candidate; REJECT leaves none; a candidate that came later never undoes an ACCEPT. Adds status."""
    last = log.groupBy(*keys).agg(F.max_by(F.struct("action", F.col(value).alias("v")), F.struct("seq", "action", value)).alias("d"))
    both = values.join(last, keys, "full")
    act = F.col("d.action")
    status = F.when(act == "ACCEPT", "ACCEPTED").when(act == "REJECT", "REJECTED").otherwise("UNRESOLVED")
    return both.select(*keys, F.when(act == "ACCEPT", F.coalesce(F.col("d.v"), F.col(value))).when(act == "REJECT", F.lit(None)).otherwise(F.col(value)).alias(value), status.alias("status"))


def reprocess(old: DataFrame, new: DataFrame, keys: list[str], value: str = "value", human: str = "human") -> DataFrame:
    """(keys, value, kept, conflict): values read anew, where a human's value stays; conflict: the new one differs from it."""
    o = old.select(*keys, F.col(value).alias("__o"), F.coalesce(F.col(human), F.lit(False)).alias("__h"))
    both = o.join(new.select(*keys, F.col(value).alias("__n")), keys, "full")
    h = F.coalesce(F.col("__h"), F.lit(False))
    return both.select(*keys, F.when(h, F.col("__o")).otherwise(F.col("__n")).alias(value), h.alias("kept"), (h & ~F.col("__o").eqNullSafe(F.col("__n"))).alias("conflict")).where(F.col("kept") | F.col(value).isNotNull())


def slot_matrix(chains: DataFrame, present: DataFrame, slots: list[str], chain: str = "chain_id", slot: str = "slot", sure: str = "sure") -> DataFrame:
    """(chain, slot, status): present, uncertain (only unsure documents), or missing, for every slot of every chain."""
    want = chains.select(chain).distinct().withColumn(slot, F.explode(F.array(*map(F.lit, slots))))
    have = present.groupBy(chain, slot).agg(F.bool_or(F.coalesce(F.col(sure), F.lit(False))).alias("__s"))
    return want.join(have, [chain, slot], "left").select(chain, slot, F.when(F.col("__s").isNull(), "missing").when(F.col("__s"), "present").otherwise("uncertain").alias("status"))


def desk_status(df: DataFrame) -> DataFrame:
    """Adds light and reason from docs (count), ambiguous, missing_docs, uncertain_docs, missing_fields (counts), failed,
    tested, concluded (booleans): the first that holds decides."""
    many = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    steps = [(~many("docs"), "wait", "wait_docs"), (many("ambiguous"), "red", "amount_ambiguity"), (many("missing_docs"), "red", "missing_docs"), (many("uncertain_docs"), "yellow", "docs_uncertain"), (many("missing_fields"), "yellow", "missing_fields"), (~yes("tested"), "yellow", "not_tested"), (yes("failed"), "red", "tests_failed"), (~yes("concluded"), "yellow", "unconfirmed")]
    ladder = lambda i, end: F.coalesce(*(F.when(s[0], s[i]) for s in steps), F.lit(end))
    return df.withColumns({"light": ladder(1, "green"), "reason": ladder(2, "done")})


def export_readiness(population: DataFrame, chains: DataFrame, business: str = "business_id") -> DataFrame:
    """(business, ready, blocker) of every sample: it needs documents and a confirmed conclusion, and no FAIL that was not
    released by hand; warnings and skipped tests do not block. chains: (business, docs, status, released, concluded)."""
    both = population.select(business).distinct().join(chains, business, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    blocker = F.when(F.coalesce(F.col("docs"), F.lit(0)) == 0, "NO_DOCUMENTS").when((F.col("status") == "FAIL") & ~yes("released"), "FAILED").when(~yes("concluded"), "NOT_CONCLUDED")
    return both.select(business, blocker.isNull().alias("ready"), blocker.alias("blocker"))


def stale(now: DataFrame, then: DataFrame, keys: list[str], facts: list[str]) -> DataFrame:
    """(keys, signature, stale): SHA-256 of each row's facts, and whether a stored signature differs or is missing."""
    mark = F.sha2(F.to_json(F.struct(*facts)), 256)
    return now.select(*keys, mark.alias("signature")).join(then.select(*keys, F.col("signature").alias("__then")), keys, "left").select(*keys, "signature", (~F.col("signature").eqNullSafe(F.col("__then"))).alias("stale"))


#: What a change in one stage makes stale.
DEPENDS = {"fields": ("evidence", "tests", "conclusion", "workbook"), "evidence": ("tests", "conclusion", "workbook"), "tests": ("conclusion", "workbook"), "conclusion": ("workbook",), "workbook": ()}


def invalidated(changes: DataFrame, chain: str = "chain_id", stage: str = "stage") -> DataFrame:
    """(chain, stage): the changed stages and all that depend on them."""
    closure = F.create_map(*(x for k, v in DEPENDS.items() for x in (F.lit(k), F.array(*map(F.lit, (k, *v))))))
    return changes.select(chain, F.explode(closure[F.col(stage)]).alias(stage)).distinct()


# The columns of the working paper, in order.
PAPER = ("business_id", "voucher_no", "customer", "contract_no", "posting_date", "booked_amount", "receipt_date", "payment_days", "due_date", "deviation_days", "cutoff_status", "risk_level", "issue", "basis", "conclusion", "match_status", "party_ok", "order_amount", "receipt_amount", "invoice_amount", "amount_spread_pct", "match_decision")


def paper_rows(df: DataFrame) -> DataFrame:
    """The working paper's columns as text; what the input does not have is left empty."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in PAPER))


def edited(rows: DataFrame, edits: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with an auditor's edits (key, seq, column, value) of the listed columns; the last edit of a cell counts."""
    last = edits.where(F.col("column").isin(columns)).groupBy(key).agg(*(F.max_by(F.when(F.col("column") == c, F.col("value")), F.when(F.col("column") == c, F.col("seq"))).alias(f"__{c}") for c in columns))
    return rows.join(last, key, "left").select(*((F.coalesce(f"__{c}", F.col(c)).alias(c) if c in columns else F.col(c)) for c in rows.columns))


# ---- assertions of the programmes


def enforceable(has_contract: Column, parties: Column, signed: Column, issues: Column) -> Column:
    """Step 1: true with a signed contract of named parties and clear terms; false without any contract; else open (null)."""
    return F.when(~has_contract, False).when(parties & signed & (issues == 0), True)


def revenue_amount_ok(status: Column) -> Column:
    return F.when(status == "PASS", True).when(status == "FAIL", False)


def control_transferred(receipt: Column, three_way: Column) -> Column:
    """True with a receipt date and a match that did not fail; false if it failed; open without a receipt."""
    return F.when(three_way == "FAIL", False).when(receipt.isNotNull() & three_way.isin("PASS", "WARNING"), True)


def receivable_period_ok(status: Column, revenue: Column) -> Column:
    """The receivable follows the revenue's period, and is open while that is."""
    return F.when(status == "FAIL", False).when((status == "PASS") & revenue, True)


def row_verdict(verdicts: list[Column], warnings: Column, gaps: Column) -> Column:
    """False if any assertion is; open with a warning, a gap or an open assertion; else true."""
    no = reduce(lambda a, b: a | b, [F.coalesce(~v, F.lit(False)) for v in verdicts])
    unsure = reduce(lambda a, b: a | b, [v.isNull() for v in verdicts])
    return F.when(no, False).when((warnings > 0) | (gaps > 0) | unsure, F.lit(None).cast("boolean")).otherwise(True)


def coverage_counts(status: DataFrame, dimension: str = "dimension", column: str = "status") -> DataFrame:
    """(dimension, tested, passed, failed, warned, skipped)."""
    s = F.col(column)
    return status.groupBy(dimension).agg(F.count_if(~s.isin("SKIPPED", "NOT_TESTED")).alias("tested"), *(F.count_if(s == v).alias(n) for v, n in (("PASS", "passed"), ("FAIL", "failed"), ("WARNING", "warned"), ("SKIPPED", "skipped"))))


def control_date(candidates: DataFrame, doc: str = "doc_id", event: str = "event", confidence: str = "confidence", date: str = "date", order: tuple[str, ...] = ("final_acceptance", "customer_receipt", "destination_arrived", "on_board", "carrier_received")) -> DataFrame:
    """(doc, date): that of the event with most authority, then of the surest reading; null if that leaves several dates."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(event))
    own = candidates.where((rank > 0) & F.col(date).isNotNull()).select(doc, F.struct(rank.alias("r"), (-F.coalesce(F.col(confidence), F.lit(0.0))).alias("c")).alias("o"), F.col(date).alias("d"))
    # dates of one order first: as many rows as a document has ranks
    by = own.groupBy(doc, "o").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    best = by.groupBy(doc).agg(F.min(F.struct("o", "lo", "hi")).alias("b"))
    return best.select(doc, F.when(F.col("b.lo") == F.col("b.hi"), F.col("b.lo")).alias("date"))


def assess_control(dates: DataFrame, doc: str = "doc_id", event: str = "event", date: str = "date", eligible: tuple[str, ...] = ("on_board",)) -> DataFrame:
    """(doc, result, date): supported by exactly one date of the eligible events, a conflict with several, else unresolved."""
    got = dates.where(F.col(event).isin(*eligible)).groupBy(doc).agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    out = dates.select(doc).distinct().join(got, doc, "left")
    one = F.col("lo") == F.col("hi")
    return out.select(doc, F.when(F.col("lo").isNull(), "unresolved").when(one, "supported").otherwise("conflict").alias("result"), F.when(one, F.col("lo")).alias("date"))
