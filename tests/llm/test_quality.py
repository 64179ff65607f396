import random
import zlib

import numpy as np

from ledgerloom.llm import quality as Q


def sample(n=400, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        good = i % 3 > 0
        w = [f"{rnd.choice('abcdefgh')}{rnd.randrange(10**4):x}{'' if good else '$$$'}" for _ in range(rnd.randrange(5, 200))]
        rows.append((i, (" ".join(w) + ".") if good else " ".join(w).upper(), int(good)))
    return rows


def test_held_out_accuracy(spark, tmp_path):
    rows = sample()
    spark.createDataFrame([(i, t, "en", "s") for i, t, _ in rows] + [(10**6, None, "", ""), (None, "", "", "")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, None) for i, _, q in rows] + [(5, None, 1), (7, 9, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Q.op5_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 2
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    held = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(by[i].held_out for i, _ in held) and not by[None].held_out
    assert np.mean([by[i].predicted == q for i, q in held]) > 0.97


def test_moments_and_density(spark):
    rows = sample(60)
    x = np.array([Q.features(t) for _, t, _ in rows])
    y = np.array([q for *_, q in rows])
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<double>, y int")
    m = Q.fit(df)
    for k in (0, 1):
        assert np.allclose(m.means[k], x[y == k].mean(0))
    logs = []
    for k in (0, 1):
        c = m.factors[k] @ m.factors[k].T
        d = x - m.means[k]
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(m.scores(x), 1 / (1 + np.exp(-(logs[1] - logs[0] + np.log(y.sum() / (len(y) - y.sum()))) / Q.D)), atol=1e-6)


def test_no_labels(spark):
    none = spark.createDataFrame([], "x array<double>, y int")
    assert Q.fit(none).scores(np.zeros((2, Q.D))).tolist() == [0.5, 0.5]
    one = spark.createDataFrame([([0.0] * Q.D, 1)], "x array<double>, y int")
    assert Q.fit(one).scores(np.zeros((1, Q.D))).tolist() == [1.0]


def test_reject_keeps_columns(spark):
    rows = sample(150)
    m = Q.fit(spark.createDataFrame([(Q.features(t), q) for _, t, q in rows], "x array<double>, y int"))
    df = spark.createDataFrame([(i, t, "k") for i, t, _ in rows] + [(None, None, None)], "doc_id long, text string, x string")
    out = Q.reject(df, m)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} - {None} == {i for i, _, q in rows if q}
