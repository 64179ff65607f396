import math
import random

import pytest

from ledgerloom.llm import bitsliced as B


def plain(rows, queries, k=5):
    ok = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v)
    q = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = []
    for i in queries:
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for n, v in q if n == i for j, w in q if j != i and len(w) == len(v))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("block", "query"), [(16_384, 64), (70, 2)])
def test_against_every_product(spark, block, query):
    rnd = random.Random(11)
    rows = [(i, [rnd.choice([rnd.gauss(0, 1), 0.0, -0.5, 3.0]) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # ties at the boundary
    rows += [(400, None), (401, []), (402, [1.0, None] * 3), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (405, [1.0, 2.0]), (406, [2.0, 2.0]), (None, rows[0][1]), (450, [0.0] * 6)]
    rows += [(100, rows[3][1]), (60, rows[60][1]), (61, rows[62][1])]  # ids that are there twice
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, dim string")
    got = B.top_k(df, df.where("vec_id % 50 = 0 or vec_id = 405"), block_rows=block, query_rows=query)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == plain(rows, [*range(0, 451, 50), 405])


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(0, [1.0, 2.0])], schema)
    assert B.top_k(one, one).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0]), (3, [-1.0, 0.25])], schema)
    assert [tuple(r) for r in B.top_k(two, two.where("vec_id = 0")).collect()] == [(0, 1, 3, -256 * 256 + 512 * 64)]
    assert B.top_k(one.limit(0), one.limit(0)).count() == 0


def test_signed_digits():
    for x in range(-700, 700):
        d = B._digits(x)
        assert sum((-1 if m else 1) << p for p, m in d) == x
        assert all(b - a > 1 for (a, _), (b, _) in zip(d, d[1:]))
