from pyspark.sql import functions as F

from ledgerloom.operators import assertions, decisions

EVENTS = "event_id string, chain_id long, event_type string, action_kind string, source_ref string, file_name string, field_name string, observed string, suggested string, invalidates array<string>"


def test_effects_of_decisions(spark):
    events = spark.createDataFrame(
        [
            ("a", 1, "X", "DECIDE_ADVISORY", "advisory:c9", "f", "amount", "1", "2", ["tests"]), ("b", 2, "X", "REVIEW_FIELD", "rule", "f", "qty", "3", None, None), ("c", 3, "X", "REVIEW_SAMPLE", "qs", None, None, "PASS", None, None),
            ("d", 4, "MISSING_DOCUMENT", "REVIEW_EVIDENCE", "need", None, None, None, None, ["evidence"]), ("e", 5, "X", "DECIDE_FINDING", "rule", None, None, None, None, ["evidence"]), ("f", 6, "X", "DECIDE_ADVISORY", "advisory:c8", None, None, None, None, ["fields"]),
            ("g", 7, "X", "REVIEW_FIELD", "rule", "f", None, None, None, None), ("h", 8, "X", None, None, None, None, None, None, None),
        ],
        EVENTS,
    )
    told = [
        ("a", 1, "accept_ai", None, "me", None), ("b", 1, "MANUAL_VALUE", None, "me", ""), ("b", 2, "MANUAL_VALUE", None, "me", "7"), ("b", 3, "ACCEPT_AI", "x", "me", None), ("c", 1, "FALSE_NEGATIVE", " ", "me", None), ("c", 2, "FALSE_NEGATIVE", "missed", "me", None),
        ("d", 1, "DOCUMENT_ISSUE", "why", "me", None), ("e", 1, "AUDIT_FAIL", "bad", "me", None), ("f", 1, "OVERRIDE", "no", "me", None), ("g", 1, "MANUAL_VALUE", None, "me", "1"), ("h", 1, "ACCEPT_AI", None, "me", None), ("z", 1, "ACCEPT_AI", None, "me", None), ("z", 2, None, None, None, None),
    ]
    got = decisions.effects(events, spark.createDataFrame(told, "event_id string, seq int, decision string, reason string, operator string, value string"))
    assert {(r.event_id, r.seq): r.problem or r.state for r in got.records.collect()} == {
        ("a", 1): "RESOLVED", ("b", 1): "VALUE_MISSING", ("b", 2): "RESOLVED", ("b", 3): "SETTLED", ("c", 1): "REASON_MISSING", ("c", 2): "RESOLVED", ("d", 1): "UPLOAD_NEEDED", ("e", 1): "RESOLVED", ("f", 1): "RESOLVED",
        ("g", 1): "NO_PLACE", ("h", 1): "NOT_ALLOWED", ("z", 1): "NO_EVENT", ("z", 2): "NO_EVENT",
    }
    assert {(r.event_id, r.seq): (r.before, r.after) for r in got.records.where("state = 'RESOLVED'").collect()}["b", 2] == ("3", "7")
    assert [tuple(r) for r in got.findings.collect()] == [("qf:c", "c", 3, "missed", "me")]
    assert [tuple(r) for r in got.values.collect()] == [("f", "qty", "7", "b")]
    assert sorted(tuple(r) for r in got.advice.collect()) == [("c8", "REJECTED", "f"), ("c9", "VERIFIED", "a")]
    rest = ["conclusion", "workbook"]
    assert sorted(tuple(r) for r in got.stale.collect()) == sorted([(1, s) for s in ["tests", *rest]] + [(2, s) for s in ["fields", "evidence", "tests", *rest]] + [(3, s) for s in rest] + [(5, s) for s in ["evidence", "tests", *rest]])
    fields = spark.createDataFrame([("f", "qty", "3", "OPEN"), ("f", "amount", "1", "OPEN")], "file_name string, field_name string, value string, status string")
    assert sorted(tuple(r) for r in decisions.put_values(fields, got.values).collect()) == [("f", "amount", "1", "OPEN"), ("f", "qty", "7", "ACCEPTED")]
    assert sorted(tuple(r) for r in decisions.put_values(fields.limit(0), got.values).collect()) == [("f", "qty", "7", "ACCEPTED")]


def test_other_files_and_allocation(spark):
    docs = spark.createDataFrame([(1, 5, "receipt", "R", None), (1, 6, "invoice", "I", 9.0), (2, 1, "contract", "C", 1.0)], "business_id long, doc_id long, doc_type string, number string, amount double")
    got = sorted(tuple(r) for r in assertions.other_files(spark.createDataFrame([(1,), (2,), (2,), (3,)], "business_id long"), docs).collect())
    none = ("Not applicable 不适用", "", "", False)
    assert got == [(1, "Applicable 适用", "增值税发票/商业发票", "I", True), (2, *none), (3, *none)]
    df = spark.createDataFrame([("销售商品及安装", ["REBATE_TERM_AMBIGUOUS"]), ("销售", []), (None, None)], "t string, c array<string>")
    assert [tuple(r.a)[2:] for r in df.select(assertions.allocation_criteria(F.col("t"), F.col("c")).alias("a")).collect()] == [(True, True), (False, False), (False, False)]
    cases = [(True, "PASS", 0, True), (True, None, 0, True), (True, "PASS", 1, False), (False, "PASS", 0, False), (None, "FAIL", 0, False), (None, "PASS", 0, None), (True, "WARNING", 0, None), (True, "SKIPPED", 0, True)]
    df = spark.createDataFrame(cases, "p boolean, s string, g int, want boolean")
    assert all(r.got == r.want for r in df.select("want", assertions.allocation_steps(F.col("p"), F.col("s"), F.col("g")).alias("got")).collect())
