"""Small cases of what a business's documents give together."""

from pyspark.sql import functions as F

from ledgerloom.operators import chains, reviews


def test_pricing(spark):
    schema = "business_id string, role string, pos int, quantity double, price double, discount double, vat double"
    rows = [("a", "invoice", 1, 9.0, 5.0, None, 0.06), ("a", "order", 2, 8.0, 4.0, 0.1, 0.13), ("a", "receipt", 3, 7.0, None, None, None), ("b", "invoice", 1, 9.0, 5.0, None, None), ("c", "note", 1, 1.0, 1.0, 1.0, 1.0)]
    got = {r.business_id: (r.quantity, r.quantity_source, r.price, r.discount, float(r.vat), r.vat_source) for r in chains.merge_pricing(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": (7.0, "CONFIRMED", 4.0, 0.1, 0.06, "DOCUMENT"), "b": (9.0, "UNCONFIRMED", 5.0, 0.0, 0.13, "DEFAULT"), "c": (None, "MISSING", None, 0.0, 0.13, "DEFAULT")}
    abroad = chains.merge_pricing(spark.createDataFrame(rows, schema), export=F.col("business_id") == "b").where("business_id = 'b'").first()
    assert (float(abroad.vat), abroad.vat_source) == (0.0, "EXPORT")


def test_basis_and_gross(spark):
    d = spark.createDataFrame([(5.0, 4.0, 1.0), (None, 4.0, 1.0), (None, 4.0, None), (None, None, 1.0)], "t double, n double, x double")
    a, b = chains.amount_with_basis(F.col("t"), F.col("n"), F.col("x"))
    assert [tuple(r) for r in d.select(a, b).collect()] == [(5.0, "TOTAL"), (5.0, "NET_PLUS_TAX"), (4.0, "NET"), (None, None)]
    g, t = chains.line_gross(F.col("n").cast("double") * F.lit(None), F.lit(2), F.lit(10.0), F.lit(0.1), F.lit(0.5))
    assert tuple(d.select(g, t).first()) == (27.0, "2 x 10.0 x (1 - 0.1 ) x (1 + 0.5 )")


def test_readable(spark):
    d = spark.createDataFrame([("ACCEPTED", "a", "c", "r"), ("UNRESOLVED", "a", "c", "r"), ("REJECTED", None, "c", "r"), (None, None, None, " ")], "s string, a string, c string, r string")
    shown, rule = chains.readable(F.col("s"), F.col("a"), F.col("c"), F.col("r"))
    assert [tuple(r) for r in d.select(shown, rule).collect()] == [("a", "a"), ("c", None), ("r", None), (None, None)]


def test_components_and_shared(spark):
    nodes = spark.createDataFrame([("g", "1", "a"), ("g", "2", "a"), ("g", "2", "b"), ("g", "3", "c"), ("h", "4", "a"), ("h", "5", None)], "group string, doc_id string, key string")
    got = {r.doc_id: (r.score, r.main) for r in chains.evidence_components(nodes, spark.createDataFrame([("b",)], "key string")).collect()}
    assert got == {"1": (3, True), "2": (3, True), "3": (1, False), "4": (1, True)}
    assert chains.evidence_components(nodes.limit(0), nodes.select("key").limit(0)).count() == 0
    assert [r.key for r in chains.shared_by_all(nodes.where("doc_id < 3"), "group", "doc_id", "key").collect()] == ["a"]


def test_doubt(spark):
    d = spark.createDataFrame([(2, 10.0, 1.0, 11.5, None, 0), (1, 10.0, 1.0, 11.0, 11.0, 3), (0, 10.0, None, None, None, None)], "candidates int, net double, tax double, total double, quantity double, nearby int")
    assert [r.triggers for r in chains.amount_triggers(d).collect()] == [["MULTIPLE_CANDIDATES", "RECONCILIATION_FAILED"], ["ROLE_COLLISION", "INTERFERENCE_NEARBY"], ["MISSING_TOTAL"]]
    v = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 5.0)], "k int, value double")
    f = spark.createDataFrame([(1, 10.005), (1, 30.0), (3, 1.0)], "k int, value double")
    assert {tuple(r) for r in chains.merge_specialist(v, f, ["k"]).collect()} == {(1, 10.0, True), (1, 20.0, False), (2, 5.0, False), (1, 30.0, True), (3, 1.0, True)}


def test_plans(spark):
    d = spark.createDataFrame([(["a", "b"], None, ["b", "c"])], "x array<string>, y array<string>, z array<string>")
    assert d.select(chains.field_plan(F.col("x"), F.col("y"), F.col("z"))).first()[0] == ["a", "b", "c"]
    docs = spark.createDataFrame([(1, "t", ["b"]), (2, "t", None), (3, "u", [])], "doc_id int, doc_type string, filled array<string>")
    assert {tuple(r) for r in chains.missing_fields(docs, {"t": [("a", "b"), ("c",)]}).collect()} == {(1, "c"), (2, "a"), (2, "c")}


def test_assertions(spark):
    t, n = F.lit(True), F.lit(None).cast("boolean")
    cases = [(reviews.row_verdict([t, n], F.lit(0), F.lit(0)), None), (reviews.row_verdict([t, F.lit(False)], F.lit(5), F.lit(1)), False), (reviews.row_verdict([t, t], F.lit(0), F.lit(0)), True), (reviews.row_verdict([t], F.lit(0), F.lit(1)), None), (reviews.enforceable(F.lit(False), t, t, F.lit(0)), False), (reviews.enforceable(t, t, t, F.lit(2)), None), (reviews.control_transferred(F.lit("d"), F.lit("WARNING")), True), (reviews.control_transferred(F.lit(None), F.lit("PASS")), None), (reviews.receivable_period_ok(F.lit("PASS"), n), None), (chains.formula_conflict(F.lit("2025-01-02").cast("date"), F.lit("2024-12-31").cast("date"), t), True)]
    assert list(spark.range(1).select(*(c for c, _ in cases)).first()) == [w for _, w in cases]


def test_texts(spark):
    row = spark.range(1).select(chains.notes([F.lit("one"), F.lit(None).cast("string"), F.lit("two"), F.lit("one")]), chains.summary_text(F.lit(7), F.lit("FAIL"), F.lit(1), F.lit(2.5), F.lit(None).cast("double"))).first()
    assert tuple(row) == ("one；two", "Business 7: fail; ordered 1.00, received 2.50, invoiced -.")
