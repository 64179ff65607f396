import pytest

from ledgerloom.operators import catalogue as K


def test_rules_as_rows(spark):
    facts = spark.createDataFrame([(1, 5.0, 4.0), (2, 4.0, 5.0), (3, None, 5.0)], "k int, a double, status double")
    table = spark.createDataFrame([("r1", "p", "a", "a > status", "WARNING"), ("r2", "p", "", "a IS NULL OR a > 0", "FAIL"), ("r3", "q", "a, status", "a = 5", "FAIL")], "rule_id string, programme string, needs string, passes string, otherwise string")
    rules = K.rules_of(table)
    got = {(r.k, r.rule_id): r.status for r in K.evaluate(facts, ["k"], rules).collect()}
    assert got == {(1, "r1"): "PASS", (1, "r2"): "PASS", (1, "r3"): "PASS", (2, "r1"): "WARNING", (2, "r2"): "PASS", (2, "r3"): "FAIL", (3, "r1"): "NOT_TESTED", (3, "r2"): "PASS", (3, "r3"): "NOT_TESTED"}
    assert {(r.k, r.programme): r.status for r in K.programmes(K.evaluate(facts, ["k"], rules), ["k"]).collect()} == {(1, "p"): "PASS", (1, "q"): "PASS", (2, "p"): "WARNING", (2, "q"): "FAIL", (3, "p"): "NOT_TESTED", (3, "q"): "NOT_TESTED"}
    assert K.evaluate(facts.limit(0), ["k"], rules).count() == 0


@pytest.mark.parametrize("rule", [K.Rule("x", "p", "none", "true"), K.Rule("x", "p", "a", "a >"), K.Rule("x", "p", "a", "a > 0", "MAYBE"), K.Rule("x", "p", "a", "b.c")])
def test_a_rule_that_cannot_be_read_is_an_error(spark, rule):
    with pytest.raises(ValueError, match="rule x"):
        K.evaluate(spark.createDataFrame([(1, 2.0)], "k int, a double"), ["k"], [rule])


def test_matrix(spark):
    results = spark.createDataFrame([(1, "p", "PASS"), (1, "q", "WARNING"), (1, "q", "PASS"), (2, "p", "FAIL")], "k int, programme string, status string")
    goals = spark.createDataFrame([(1, "g"), (1, "g"), (1, "h"), (2, "g"), (3, "g"), (1, "none")], "k int, goal string")
    matrix = [("g", "a", ("p", "q"), "no"), ("g", "b", ("p",), "no"), ("h", "a", ("q", "r", "s"), "never")]
    got = sorted(tuple(r) for r in K.programme_matrix(goals, results, ["k"], matrix).collect())
    assert got == [
        (1, "g", "a", "WARNING", "", "no"), (1, "g", "b", "PASS", "", "no"), (1, "h", "a", "WARNING", "r,s", "never"), (2, "g", "a", "FAIL", "q", "no"), (2, "g", "b", "FAIL", "", "no"), (3, "g", "a", "NOT_TESTED", "p,q", "no"), (3, "g", "b", "NOT_TESTED", "p", "no"),
    ]
    assert len(K.programme_matrix(goals, results, ["k"]).collect()) == 0
