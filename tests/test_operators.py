"""Small cases that pin the operators' semantics, and plain versions of those that SQL cannot express."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, ids, numbers, text
from ledgerloom.operators import allocation, amounts, clauses, components, cutoff, dedupe, entities, evidence, ledger, matching, ranking, retrieval, reviews, segmentation
from ledgerloom.sources import files
from ledgerloom.streaming import feeds


def values(spark, xs, f, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_numbers(spark):
    assert values(spark, ["1,234.56", "1.234,56", "１２３．５", "12,5", "1,234", "1.234.567", "-7", "none", None, "", "¥1 200元"], numbers.parse_number) == [1234.56, 1234.56, 123.5, 12.5, 1234.0, 1234567.0, -7.0, None, None, None, 1200.0]
    assert values(spark, ["13%", "0.13", "13", "250", None], numbers.parse_percent) == [0.13, 0.13, 0.13, None, None]
    assert values(spark, ["9折", "85折", "5%"], numbers.parse_discount) == [0.1, 0.15, 0.05]
    assert [str(x) for x in values(spark, ["2.675", "1.005", "-0.125"], lambda c: numbers.r2(c.cast("decimal(18,4)")))] == ["2.68", "1.01", "-0.13"]


def test_dates(spark):
    got = values(spark, ["2024年3月5日", "on 2024-02-30", "20240305", "3/5/2024", "2024/12/1 x", "", None], dates.parse_date)
    assert [str(x) for x in got] == ["2024-03-05", "None", "2024-03-05", "2024-03-05", "2024-12-01", "None", "None"]
    assert str(values(spark, ["3/5/2024"], lambda c: dates.parse_date(c, True))[0]) == "2024-05-03"
    assert values(spark, ["2024-01-01", "2024-12-30", "2023-12-31", None], lambda c: dates.period_445(c.cast("date"))) == ["FY2024-P01", "FY2024-P12", "FY2023-P12", None]
    assert values(spark, ["货到 30 天", "net 45 days", "cash"], dates.payment_days) == [30, 45, None]


def test_ids(spark):
    assert values(spark, ["so 12I", "ht-1O2o", "x", None], ids.normalize_id) == ["SO121", "HT-1020", "X", None]
    assert values(spark, ["S025-001"], ids.normalize_id) == ["SO25-001"]
    assert values(spark, ["order SO-2024-001 and 2024-001"], ids.ids_in_text) == [["SO-2024-001"]]
    assert values(spark, ["SO-12345", "12345", "ABCDE-12"], ids.looks_like_id) == [True, False, False]


def test_text(spark):
    assert values(spark, ["ＡＢ（c）　d-e", None], text.compact) == ["abcde", ""]
    assert values(spark, ["ﬁ①", None], text.nfkc) == ["fi1", None]


def test_recompute_and_diagnose(spark):
    df = spark.createDataFrame([("3", "10.005", "0.1", "0.13", "30.52"), ("3", "10.005", "0.1", "0", "27.01"), (None, "1", "0", "0.1", "1"), ("2", "5", "1.5", "0.1", "0")], "qty string, price string, discount string, tax string, book string")
    out = amounts.recompute(df).select("gross_list", "net", "vat", "total", "basis").collect()
    assert [[str(x) for x in r] for r in out[:2]] == [["30.02", "27.01", "3.51", "30.52", "DOMESTIC"], ["30.02", "27.01", "0.00", "27.01", "EXPORT"]]
    assert out[2].net is None and str(out[3].net) == "0.00"
    d = amounts.diagnose(amounts.layers(amounts.recompute(df.withColumns({"book_total": F.col("book"), "book_net": F.lit(None).cast("string"), "book_vat": F.lit(None).cast("string")}))))
    assert [r.test_status for r in d.collect()][:2] == ["PASS", "PASS"]


@pytest.mark.parametrize(("amounts_", "verdict"), [((100.0, 100.0, 100.0), "EQUAL"), ((100.0, 99.0, 98.0), "SOFT"), ((100.0, 90.0, 100.0), "HARD"), ((100.0, None, 100.0), "EQUAL"), ((None, None, 100.0), "HARD"), ((0.0, 0.0, 0.0), "HARD")])
def test_amount_verdict(spark, amounts_, verdict):
    df = spark.createDataFrame([amounts_], "o double, r double, i double")
    assert df.select(matching.amount_verdict(F.col("o"), F.col("r"), F.col("i"))).first()[0] == verdict


def test_parties(spark):
    df = spark.createDataFrame([("上海甲（集团）有限公司", "上海甲集团", "上海甲集团有限公司", True), ("A Co., Ltd.", "a", "B", False), ("A", None, "A", False)], "a string, b string, c string, want boolean")
    assert all(r.got == r.want for r in df.select("want", F.coalesce(matching.parties_agree(F.col("a"), F.col("b"), F.col("c")), F.lit(False)).alias("got")).collect())


def test_binding(spark):
    orders = spark.createDataFrame([("g", "o1", "r1", "1", "A", "M1", "pump"), ("g", "o2", "r1", "2", "B", "M1", "pump"), ("g", "o3", "r2", "1", "C", None, "valve"), ("h", "o4", "r3", None, None, None, "x")], "business_id string, order_line_id string, order_ref string, line_no string, item_code string, model string, goods string")
    lines = [("g", "s1", "r1", "1", None, None, None, "o1", 1), ("g", "s2", None, None, "B", None, None, "o2", 3), ("g", "s3", None, None, None, "M1", "valve", None, None), ("g", "s4", None, None, None, None, "valve", "o3", 5), ("g", "s5", None, None, None, None, "pump", None, None), ("h", "s6", None, None, None, None, None, "o4", 6), ("k", "s7", None, "1", None, None, None, None, None)]
    src = spark.createDataFrame([x[:7] for x in lines], "business_id string, source_id string, order_ref string, line_no string, item_code string, model string, goods string")
    got = {r.source_id: (r.order_line_id, r.bind_rank, r.bind_status) for r in allocation.bind_lines(src, orders).collect()}
    for x in lines:
        assert got[x[1]][:2] == x[7:], x
    assert [got[s][2] for s in ("s3", "s5", "s7")] == ["STRONG_MODEL_CONFLICT", "AMBIGUOUS", "UNBOUND"]


def test_cutoff(spark):
    df = spark.createDataFrame([("2024-12-30", "2025-01-02"), ("2024-12-30", "2024-12-01"), ("2025-01-05", "2024-12-31"), (None, "2024-12-31")], "c string, p string").select(F.col("c").cast("date").alias("control_date"), F.col("p").cast("date").alias("posting_date"))
    end = F.lit("2024-12-31").cast("date")
    got = [(r.cutoff_status, r.cutoff_reason, r.deviation_days, r.direction, r.risk_level) for r in cutoff.route_risk(cutoff.check_cutoff(df, period_end=end)).collect()]
    assert got == [("FAIL", "PERIOD_END_CROSSED", 3, "late", "high"), ("PASS", "SAME_PERIOD", -29, "in_period", "low"), ("FAIL", "PERIOD_END_CROSSED", -5, "early", "high"), ("WARNING", "MISSING_DATE", None, "in_period", "low")]


def test_ledger(spark):
    book = spark.createDataFrame([(1, None, ["SO-1"]), (2, "2024-01-01", ["so 1", "x"]), (3, "2024-02-01", ["SO-1"])], "row_no int, posting_date string, keys array<string>")
    docs = spark.createDataFrame([(1, ["none", "SO1"]), (2, []), (3, ["z"]), (4, None)], "doc_id int, keys array<string>")
    got = {r.doc_id: (r.row.row_no if r.row else None, r.match_status) for r in ledger.lookup(docs, ledger.ledger_index(book)).collect()}
    assert got == {1: (2, "MATCHED"), 2: (None, "MISSING_DOCUMENT_INDEX"), 3: (None, "NOT_FOUND"), 4: (None, "MISSING_DOCUMENT_INDEX")}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(220)] + [(5, 5), (None, 3)] + [(1000, k) for k in range(1001, 1200)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {x: find(x) for e in edges if None not in e and e[0] != e[1] for x in e}
    assert components.connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def one_edit(a, b):
    return a == b or any(a[:i] + a[i + 1 :] in {b, *(b[:j] + b[j + 1 :] for j in range(len(b)) if j == i)} for i in range(len(a))) or any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_resolve_against_plain(spark):
    rnd = random.Random(8)
    pop = [(f"SO-{100 + i}", [f"PO-{500 + i // 2}"], [f"{20240000 + i}"]) for i in range(40)]
    index = {}
    for b, po, inv in pop:
        for v, k in [(b, "business_id"), (po[0], "order_number"), (inv[0], "invoice_number")]:
            index.setdefault(v.replace("-", ""), (k, set()))[1].add(b)
    docs = []
    for i in range(300):
        exact = [rnd.choice(list(index))] if rnd.random() < 0.3 else []
        found = [rnd.choice([*rnd.sample(list(index), 3), f"SO{rnd.randrange(60, 180)}", f"PO{rnd.randrange(480, 560)}9", "QQ1", "12"]) for _ in range(rnd.randrange(3))]
        docs.append((i, exact, found))
    want = {}
    for i, exact, found in docs:
        safe = lambda a: len(a) >= 4 if any(c.isalpha() for c in a) else len(a) >= 8 and index[a][0] == "invoice_number"
        hit = [index[a][1] for a in [*exact, *(f for f in found if f in index and safe(f))] if a in index]
        owners = set().union(*hit) if hit else set()
        letters = lambda a: "".join(c for c in a if c.isalpha())
        if len(owners) == 1:
            want[i] = "MATCHED"
        elif owners:
            want[i] = "CONFLICT" if any(len(h) == 1 for h in hit) else "AMBIGUOUS_ALIAS"
        else:
            want[i] = "SIMILAR_CANDIDATE" if any(letters(f) and letters(f) == letters(a) and one_edit(f, a) for f in found for a in index) else "UNASSIGNED"
    population = spark.createDataFrame(pop, "business_id string, order_numbers array<string>, invoice_numbers array<string>")
    got = entities.resolve(spark.createDataFrame(docs, "doc_id int, exact array<string>, found array<string>"), entities.alias_index(population))
    assert {r.doc_id: r.status for r in got.collect()} == want
    assert set(want.values()) == {"MATCHED", "CONFLICT", "AMBIGUOUS_ALIAS", "SIMILAR_CANDIDATE", "UNASSIGNED"}


def test_tokens_as_aliases(spark):
    got = values(spark, ["pay SO-12 34, x", None], entities.tokens_as_aliases)
    assert {"SO1234", "SO12", "PAYSO12", "X"} <= set(got[0]) and "34X" not in got[0] and got[1] is None


def test_inheritance(spark):
    refs = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "c"), (5, "d"), (6, "d"), (7, "e"), (8, None)], "doc_id int, ref string")
    anchors = spark.createDataFrame([(1, "X"), (4, "X"), (6, "Y")], "doc_id int, business_id string")
    got = {r.doc_id: (r.business_id, r.status) for r in entities.inherit(anchors, refs).collect()}
    assert got == {1: ("X", "MATCHED"), 2: ("X", "INHERITED"), 3: ("X", "INHERITED"), 4: ("X", "MATCHED"), 5: (None, "CONFLICT"), 6: ("Y", "MATCHED")}


def test_ranking(spark):
    rnd = random.Random(2)
    xs = [rnd.choice([None, *range(50)]) for _ in range(500)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x int").repartition(7)
    got = {r.i: r.rank for r in ranking.ranked(df, F.desc_nulls_last("x"), "i").collect()}
    order = sorted(range(500), key=lambda i: (xs[i] is None, -(xs[i] or 0), i))
    assert got == {i: n + 1 for n, i in enumerate(order)}
    assert ranking.ranked(df.limit(0), "x").count() == 0
    assert [ranking.sample_size(n, r) for n, r in ((0, 0.5), (10, 0), (10, 0.01), (10, 0.25), (3, 9.0))] == [0, 0, 1, 3, 3]
    d = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, 3.0), ("b", 4, None)], "k string, p int, s double").withColumn("v", F.col("p"))
    pick = lambda tie: {r.k: r.v for r in ranking.best_of(d, ["k"], "s", "p", "v", tie).collect()}
    assert [pick(t)["a"] for t in ("first", "last", "plain")] == [2, 3, 1] and pick("first")["b"] == 4


def test_duplicates(spark):
    docs = spark.createDataFrame([("invoice", "inv 1", "f1", None), ("invoice", "INV1", "f2", None), ("order", "S1", "f3", "inv1"), ("order", None, "f4", "INV9"), (None, "q1", "f5", "INV1"), ("contract", "h", "f6", None)], "doc_type string, number string, file_name string, invoice_ref string")
    found = dedupe.duplicate_findings(docs)
    assert [(r.finding_id, r.severity, r.files) for r in found.collect()] == [("invoice_no:INV1", "FAIL_SIGNAL", 2)]
    assert sorted(r.file_name for r in dedupe.duplicate_members(docs, found).collect()) == ["f1", "f2"]
    assert sorted(r.file_name for r in dedupe.cross_references(docs).collect()) == ["f3", "f5"]


def plain_units(pages):
    out, now = {}, None
    for f, p, t, i, o, seen, ok, blank in sorted(pages, key=lambda x: x[:2]):
        start = f != now
        why = "source_document_start"
        if not start and not blank:
            if t and t != state["t"]:
                start, why = True, "title_transition"
            elif i and state["i"] and i != state["i"]:
                start, why = True, "invoice_no_change"
            elif o and state["o"] and o != state["o"] and (t or (seen and ok)):
                start, why = True, "order_no_change"
        if start:
            n = 0 if f != now else n + 1
            order = o or (state["o"] if why == "invoice_no_change" else None)
            state, now, reason = {"t": t, "i": i, "o": order, "typed": bool(seen or t)}, f, why
        elif not blank:
            if seen and not state["typed"]:
                state.update(t=t, typed=True)
            state["i"], state["o"] = state["i"] or i, state["o"] or o
        out[f, p] = (n, reason)
    return out


def test_segments_against_plain(spark):
    rnd = random.Random(6)
    maybe = lambda xs: rnd.choice([None, "", *xs])
    pages = [(f"f{f}", p, maybe(["order", "invoice"]), maybe(["I1", "I2"]), maybe(["S1", "S2"]), rnd.random() < 0.5, rnd.random() < 0.7, rnd.random() < 0.1) for f in range(12) for p in range(rnd.randrange(1, 40))]
    df = spark.createDataFrame(pages, "file string, page long, title string, invoice_no string, order_no string, recognised boolean, legible boolean, blank boolean")
    got = {(r.file, r.page): (r.unit, r.reason) for r in segmentation.segment_pages(df).collect()}
    assert got == plain_units([(f, p, t or None, i or None, o or None, *r) for f, p, t, i, o, *r in pages])
    assert segmentation.segment_pages(df.limit(0)).count() == 0
    cover = segmentation.page_coverage(df, segmentation.segment_pages(df)).collect()
    assert all((r.missing, r.unknown, r.repeated) == (0, 0, 0) for r in cover)


def test_sections(spark):
    df = spark.createDataFrame([("d", "before the first\n# One\nbody of one here\nmore\n##\nno title but a body\n# Short\nx"), ("e", None)], "doc_id string, text string")
    got = [(r.title, r.body) for r in segmentation.sections(df).orderBy("section").collect()]
    assert got == [("d", "before the first"), ("One", "body of one here\nmore"), ("d", "no title but a body")]
    assert values(spark, ["<p>a&amp;b<br>c</p><script>x</script><td>d"], segmentation.visible_text) == ["a&b\nc\n d"]


def test_hash_embed(spark):
    texts = ["", None, "a", "ab", "Abc漢字 abc", "x" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.embedding for r in retrieval.hash_embed(df, "i", "t", 16).collect()}
    for i, t in enumerate(texts):
        v, low = [0.0] * 16, (t or "").lower()
        for n in (2, 3):
            for k in range(len(low) - n + 1):
                v[int.from_bytes(hashlib.md5(low[k : k + n].encode()).digest()[:4], "little") % 16] += 1
        norm = sum(x * x for x in v) ** 0.5 or 1.0
        assert got[i] == pytest.approx([x / norm for x in v])


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha gamma delta"), (3, "nothing here"), (4, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "bill"), (3, "")], "query_id int, text string")
    got = [(r.query_id, r["rank"], r.doc_id) for r in retrieval.bm25(docs, asked).orderBy("query_id", "rank").collect()]
    assert [g[0] for g in got] == [1, 1]
    more = spark.createDataFrame([("bill", "gamma")], "standard string, synonym string")
    assert (2, 1, 2) in [(r.query_id, r["rank"], r.doc_id) for r in retrieval.bm25(docs, asked, synonyms=more).collect()]
    lists = [spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "query_id int, rank int, doc_id string"), spark.createDataFrame([(1, 1, "b"), (1, 2, "c")], "query_id int, rank int, doc_id string")]
    assert [r.doc_id for r in retrieval.rrf(lists, 3).orderBy("rank").collect()] == ["b", "a", "c"]
    assert [r.doc_id for r in retrieval.first_list_wins(lists, 3).orderBy("rank").collect()] == ["a", "b", "c"]
    scores = spark.createDataFrame([(float(i), "useful") for i in range(5)] + [(0.5, "not_useful")] * 4, "score double, label string")
    cut = retrieval.learned_cutoff(scores)
    assert cut.first().cutoff is None and retrieval.filter_by_cutoff(scores, cut).count() == 9
    assert retrieval.learned_cutoff(scores.union(scores.limit(0).union(spark.createDataFrame([(0.5, "not_useful")], "score double, label string")))).first().cutoff == 1.25


def test_nearest(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)]) for i in range(700)] + [(900, None)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    asked = df.where("vec_id % 100 = 0").select((F.col("vec_id") + 1).alias("query_id"), F.col("embedding").alias("vec"))
    for size in (10**6, 64):
        got = sorted(tuple(r) for r in retrieval.nearest(df, asked, 5, block_bytes=size).collect())
        want = [(q + 1, n + 1, i, -s) for q in range(0, 700, 100) for n, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(v, rows[q][1])), i) for i, v in rows if v)[:5])]
        assert got == want
    assert retrieval.nearest(df, asked.limit(0)).count() == retrieval.nearest(df.limit(0), asked).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        retrieval.nearest(df, spark.createDataFrame([(1, [1.0])], "query_id int, vec array<double>")).count()


def test_clauses(spark):
    cases = [("合同采用随行就市结算, 账期另定", {"CONSIDERATION_FORMULA_AMBIGUOUS"}), ("随行就市, 按价格指数", set()), ("给予返利", {"REBATE_TERM_AMBIGUOUS"}), ("本合同不包含任何形式的返利", set()), ("返利 3% 按采购额, 现金兑现", set()), ("货到付款", {"PAYMENT_DUE_DATE_UNDEFINED"}), ("货到付款, 验收后30天", set()), ("首款与尾款另行通知", {"INSTALLMENT_TERM_UNDEFINED"}), ("首款30%, 尾款70%", set()), ("字" * 180, {"PAYMENT_TERMS_MISSING"}), ("FOB; CARRIER takes charge", {"CONTROL_TRANSFER_TRIGGER_CONFLICT"}), (None, set())]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id int, text string")
    got = {}
    for r in clauses.clause_issues(df).collect():
        got.setdefault(r.doc_id, set()).add(r.issue_code)
    for i, (t, want) in enumerate(cases):
        assert got.get(i, set()) == want, t
    kinds = spark.createDataFrame([("INV-3.pdf", None, None, "invoice"), ("发货签收.pdf", None, None, "receipt"), ("scan", "承运人 签收人", None, "receipt"), ("scan", "x", "payment", "payment"), (None, None, "odd", "other")], "n string, t string, h string, want string")
    assert all(r.got == r.want for r in kinds.select("want", clauses.document_type(F.col("n"), F.col("t"), F.col("h")).alias("got")).collect())


def test_evidence(spark):
    nodes = spark.createDataFrame([("a", "orderNo", "SO-1", True), ("a", "relatedOrderNo", "so 1", True), ("a", "quantity", "1,000", True), ("a", "receiptQuantity", "1000.0", True), ("a", "unit", "x", False), ("a", "buyerName", "P", True), ("a", "customerName", "p", True), ("a", "buyerTaxId", "1", True), ("a", "customerTaxId", "2", True), ("a", "other", "z", True)], "chain_id string, field_key string, value string, usable boolean")
    got = {r.concept: (r.relation, r.reason) for r in evidence.resolve_concepts(nodes).collect()}
    assert got == {"order_reference": ("NORMALIZED_EQUAL", "NORMALIZED_VALUE_EQUAL"), "quantity": ("NORMALIZED_EQUAL", "NORMALIZED_VALUE_EQUAL"), "unit": ("MISSING_EVIDENCE", "DECISION_EVIDENCE_MISSING"), "buyer_identity": ("CONTRADICTS", "TAX_ID_CONFLICT")}
    claims = spark.createDataFrame([("A", "f", 0.9, "quoted words", "some quoted  words"), ("Z", "f", 0.9, "quoted words", "quoted words"), ("A", "g", 0.9, "quoted words", "quoted words"), ("A", "f", 0.8, "quoted words", "quoted words"), ("A", "f", None, "short", "short"), (None, None, None, None, None)], "issue_code string, file_name string, confidence double, excerpt string, text string")
    allowed = spark.createDataFrame([("f",)], "file_name string")
    assert [r.reject_reason for r in evidence.verify_claims(claims, codes=["A"], files=allowed).orderBy(F.monotonically_increasing_id()).collect()].count(None) == 1
    assert evidence.all_or_none(spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "p int, v int"), "p", F.col("v") == 1).count() == 1
    typed = spark.createDataFrame([("quantity", "-1", False), ("quantity", "¥1,000", True), ("orderDate", "2024-02-30", False), ("orderDate", "2024年2月3日", True), ("x", "", False), ("x", "y", True), ("x", None, False)], "f string, v string, want boolean")
    assert all(r.got == r.want for r in typed.select("want", evidence.typed_valid(F.col("f"), F.col("v")).alias("got")).collect())


def test_proposals(spark):
    rows = [(1, "buyer", "c", "e1", "alpha", "name", False), (1, "buyer", "c", "e2", "beta", "address", False), (2, "buyer", "c", "e1", "alpha", "name", False), (2, "buyer", "c", "e2", "wrong", "name", False), (3, "unit", "c", "e1", "alpha", "a", False), (3, "unit", "c", "e2", "beta", "b", False), (4, "buyer", "c", "e1", "alpha", "a", True), (4, "buyer", "c", "e2", "beta", "b", False)]
    proposals = spark.createDataFrame(rows, "proposal_id int, concept string, chain_id string, evidence_id string, excerpt string, dimension string, counter boolean")
    known = spark.createDataFrame([("e1", 1, "x alpha"), ("e2", 2, "be ta")], "evidence_id string, doc_id int, text string")
    rules = spark.createDataFrame([("c", "unit", "CONFLICT")], "chain_id string, concept string, status string")
    assert {r.proposal_id: r.status for r in evidence.semantic_status(proposals, known, rules).collect()} == {1: "CONFIRMED", 2: "REJECTED", 3: "CONFLICT", 4: "CANDIDATE"}


def test_reviews(spark):
    old = spark.createDataFrame([(1, "a", "VERIFIED"), (2, "b", "PROPOSED"), (4, "d", None)], "id int, v string, status string")
    new = spark.createDataFrame([(1, "x", "PROPOSED"), (2, "y", "PROPOSED"), (3, "z", "PROPOSED")], "id int, v string, status string")
    assert {tuple(r) for r in reviews.upsert(old, new, "id", F.col("status") == "VERIFIED", []).collect()} == {(1, "a", "VERIFIED"), (2, "y", "PROPOSED"), (3, "z", "PROPOSED"), (4, "d", None)}
    log = spark.createDataFrame([(1, 1, "ACCEPT", None), (1, 2, "REJECT", None), (2, 1, "ACCEPT", "w"), (3, 1, "ACCEPT", "n")], "id int, seq int, action string, value string")
    got = {r.id: (r.value, r.status) for r in reviews.overlay(spark.createDataFrame([(1, "a"), (2, "b"), (5, "e")], "id int, value string"), log, ["id"]).collect()}
    assert got == {1: (None, "REJECTED"), 2: ("w", "ACCEPTED"), 3: ("n", "ACCEPTED"), 5: ("e", "UNRESOLVED")}
    again = reviews.reprocess(spark.createDataFrame([(1, "a", True), (2, "b", False)], "id int, value string, human boolean"), spark.createDataFrame([(1, "z"), (2, "c"), (3, "d")], "id int, value string"), ["id"])
    assert {tuple(r) for r in again.collect()} == {(1, "a", True, True), (2, "c", False, False), (3, "d", False, False)}
    rel = reviews.propose_relations(spark.createDataFrame([(1, "order", "k"), (2, "invoice", "k"), (3, "receipt", "k"), (4, "order", "k"), (5, "order", None)], "doc_id int, role string, key string"))
    assert {(r.from_id, r.to_id) for r in rel.collect()} == {("1", "2"), ("1", "3")}
    d = spark.createDataFrame([("WAIVE", "", "X", False), ("WAIVE", "r", "MISSING_DOCUMENT", False), ("WAIVE", "r", "X", True), ("CONFIRM", None, "X", True)], "c string, r string, t string, want boolean")
    assert all(r.got == r.want for r in d.select("want", reviews.valid_decision(F.col("c"), F.col("r"), F.col("t")).alias("got")).collect())
    rows = spark.createDataFrame([(1, "a", "b")], "id int, x string, y string")
    edits = spark.createDataFrame([(1, 1, "x", "c"), (1, 2, "x", "d"), (1, 3, "y", "no")], "id int, seq int, column string, value string")
    assert [tuple(r) for r in reviews.edited(rows, edits, "id", ["x"]).collect()] == [(1, "d", "b")]
    assert len(reviews.paper_rows(rows).columns) == 22


def test_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text('﻿ 记账日期 ,订单号,贷方金额\n2024-01-05,so 12,"1,200.50"\n,,\n', encoding="utf-8")
    raw = files.read_ledger(spark, f"{tmp_path}/l.csv")
    got = files.project_ledger(raw, files.map_columns(raw.columns)).collect()
    assert [(str(r.posting_date), r.biz_id, r.amount) for r in got] == [("2024-01-05", "SO12", 1200.5)]
    assert files.looks_like_dates(raw, "记账日期") and not files.looks_like_dates(raw, "订单号")
    assert files.map_columns(["a", "Posting-Date"]) == {"posting_date": "Posting-Date"}
    with pytest.raises(ValueError):
        files.read_ledger(spark, "x.pdf")
    (tmp_path / "packs/SO24-0001 x").mkdir(parents=True)
    (tmp_path / "packs/SO24-0001 x/发票.md").write_text("# t\nbody")
    assert [tuple(r) for r in files.read_voucher_packs(spark, f"{tmp_path}/packs").collect()] == [("SO24-0001", "发票.md", "# t\nbody")]
    t = spark.createDataFrame([("a", 1), ("b", 2)], "source_file string, v int")
    files.replace_by(t, f"{tmp_path}/t", "source_file")
    files.replace_by(t.where("v = 1").withColumn("v", F.lit(9)), f"{tmp_path}/t", "source_file")
    assert {(r.source_file, r.v) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {("a", 9), ("b", 2)}
    files.write_paper(reviews.paper_rows(t), f"{tmp_path}/p")
    files.write_paper(reviews.paper_rows(t), f"{tmp_path}/p", append=True)
    assert spark.read.option("header", True).csv(f"{tmp_path}/p").count() == 4


def test_streamed_uploads(spark, tmp_path):
    feed, schema = f"{tmp_path}/feed", "file_name string, content string"
    for name, rows in (("1", [("a", "x"), ("b", "y")]), ("2", [("a", "x"), ("b", "z"), ("c", "w")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        stream = feeds.read_events(spark, feed, spark.createDataFrame([], schema).schema)
        feeds.follow_uploads(stream, f"{tmp_path}/store", f"{tmp_path}/at")
        last = spark.read.parquet(f"{tmp_path}/store/v{int(name) - 1}")
    assert {(r.file_name, r.content) for r in last.collect()} == {("a", "x"), ("b", "z"), ("c", "w")}


def test_inheritance_does_not_stop_silently(spark):
    refs = spark.createDataFrame([(i, f"r{j}") for i in range(6) for j in (i, i + 1)], "doc_id long, ref string")
    anchors = spark.createDataFrame([(0, "B")], "doc_id long, business_id string")
    with pytest.raises(RuntimeError):
        entities.inherit(anchors, refs, most_rounds=2)
    assert entities.inherit(anchors, refs, most_rounds=5).count() == 6


def test_components_leave_one_step_of_their_edges(spark):
    import glob

    from ledgerloom.operators.components import connected_components

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/ledgerloom/"
    before = set(glob.glob(folder + "*"))
    got = connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")).collect()
    assert {r.node for r in got} == set(range(41)) and {r.component for r in got} == {0}
    assert len(set(glob.glob(folder + "*")) - before) == 1
