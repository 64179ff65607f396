import random

import pytest

from ledgerloom.operators import boxes

SCHEMA = "doc_id long, page int, box int, text string, x0 double, y0 double, x1 double, y1 double, cx int"


@pytest.mark.parametrize("cell", [3.0, 64.0, 1000.0])
def test_overlaps_equal_all_pairs(spark, cell):
    rng = random.Random(int(cell))

    def some(n):
        out = []
        for i in range(n):
            x, y = rng.uniform(-50, 200), rng.uniform(-50, 200)
            out.append((rng.choice([1, 2]), rng.choice([0, 1]), i, "t", x, y, x + rng.choice([0, 5, 60]), y + rng.choice([0, 8, 90]), 0))
        return [*out, (1, 0, n, None, None, 0.0, 1.0, 1.0, 0), (1, 0, n + 1, None, 0.0, 0.0, 64.0, 64.0, 0), (1, 0, n + 1, None, 0.0, 0.0, 64.0, 64.0, 0)]

    left, right = some(60), some(60)
    want = []
    for a in left:
        for b in right:
            if a[:2] == b[:2] and None not in (*a[4:8], *b[4:8]):
                w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
                if w > 0 and h > 0:
                    size = lambda r: (r[6] - r[4]) * (r[7] - r[5])
                    if (v := w * h / (size(a) + size(b) - w * h)) >= 0.001:
                        want.append((a[0], a[1], a[2], b[2], round(v, 9)))
    got = boxes.overlaps(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), 0.001, cell=cell).collect()
    assert sorted((r.doc_id, r.page, r.left, r.right, round(r.iou, 9)) for r in got) == sorted(want) and len(want) > 10
    assert boxes.overlaps(spark.createDataFrame([], SCHEMA), spark.createDataFrame(right, SCHEMA)).count() == 0


def test_values_in_runs_of_boxes(spark):
    rows = [
        (1, 0, "订单号：", 0, 0, 40, 10), (1, 0, "PO-", 45, 1, 60, 11), (1, 0, "77", 62, 0, 70, 10), (1, 0, "合计 ¥1,234", 0, 20, 110, 30), (1, 0, ".50", 112, 20, 130, 30), (1, 0, "购方 第一 公司 电话", 0, 40, 90, 50),
        (1, 1, "1234.50", 5, 5, 25, 15), (1, 1, "1234.50", 5, 25, 15, 35), (1, 1, None, 0, 0, 1, 1), (2, 0, "a.b(c", 0, 0, 50, 10), (2, 0, "other", 0, 20, 50, 30), (3, 0, "aa a", 0, 0, 30, 10),
    ]
    df = spark.createDataFrame([(d, p, i, t, *map(float, s), 0) for i, (d, p, t, *s) in enumerate(rows)], SCHEMA)
    asked = [(1, "no", "po-77"), (1, "sum", "1,234.50"), (1, "buyer", "第一公司"), (1, "none", "zzz"), (2, "odd", "B(C"), (2, "void", " "), (2, "nil", None), (3, "many", "a"), (9, "x", "a"), (1, "no", "po-77")]
    got = {(r.doc_id, r.field): tuple(r)[2:] for r in boxes.value_boxes(spark.createDataFrame(asked, "doc_id long, field string, value string"), df).collect()}
    assert got[1, "no"] == (0, 1, 2, 3, True, 45.0, 0.0, 70.0, 11.0)
    assert got[1, "sum"] == (1, 2, 2, 2, True, 5.0, 25.0, 15.0, 35.0)  # of two boxes that are the value the smaller one
    assert got[1, "buyer"] == (0, 3, 6, 6, False, 22.5, 40.0, 67.5, 50.0)  # its share of the box
    assert got[2, "odd"][:5] == (0, 1, 1, 1, False) and got[3, "many"][:4] == (0, 1, 1, 1) and set(got) == {(1, "no"), (1, "sum"), (1, "buyer"), (2, "odd"), (3, "many")}


def test_overlaps_are_told_in_code_that_is_compiled(spark):
    own = spark.range(20).selectExpr("id % 2 AS doc_id", "0 AS page", "id AS box", "1.0D AS x0", "1.0D AS y0", "id + 30.0D AS x1", "id + 30.0D AS y1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = boxes.overlaps(own, own, 0.3)._jdf.queryExecution().executedPlan()
        parts = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
    assert sizes and 0 < max(sizes) < 8000  # Java runs larger methods uncompiled
