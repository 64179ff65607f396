import random
import struct
import zlib

import numpy as np
import pytest

import corpus_pipeline as pipeline
from ledgerloom.llm import packing, quality, simhash
from tests.llm.test_decontaminate import WORD, words
from tests.llm.test_packing import ids

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sample():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    item = text(16)
    rows, labels = [], []
    for i in range(260):
        good = i % 4 > 0
        lines = [text(rnd.randrange(30, 70)) for _ in range(3)]
        if i % 5 == 1:
            lines.insert(1, f"Page {i} of 99 printed by the archive")
        if i % 11 == 2:
            lines.append(f"{text(5)} {item} {text(5)}")
        rows.append((i, "\n".join(lines) if good else "\n".join(lines).upper().replace(" ", "!! ")))
        labels.append((i, int(good), 0))
    near = [(300 + i, rows[k][1] + f" tail{i}") for i, k in enumerate((1, 1, 3, 5, 7))]
    exact = [(400 + i, rows[9][1]) for i in range(4)]
    return [(i, t, "en", "s", len(t)) for i, t in [*rows, *near, *exact]] + [(500, None, None, None, None), (501, "", "en", "s", 0)], labels, [("b", item)]


def keeps(docs, labels):
    """Who passes the classifier: means and shrunk covariances of the labelled rows, by plain sums."""
    y = {i: q for i, q, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    x = {k: np.array([quality.features(t) for i, t, *_ in docs if y.get(i) == k]) for k in (0, 1)}
    cov = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    n = {k: len(v) for k, v in x.items()}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    unit = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    f = np.array([quality.features(t) for _, t, *_ in docs])
    logs = []
    for k in (0, 1):
        c = ((1 - quality.TO_POOLED) * cov[k] + quality.TO_POOLED * pooled) / np.outer(unit, unit)
        c = (1 - quality.TO_IDENTITY) * c + quality.TO_IDENTITY * max(np.trace(c) / quality.D, 1e-3) * np.eye(quality.D)
        d = (f - x[k].mean(0)) / unit
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    return [d for d, s in zip(docs, logs[1] - logs[0] + np.log(n[1] / n[0])) if s >= 0]


def without_lines(docs):
    count = {}
    for _, t, *_ in docs:
        for m in {tuple("<*>" if any(c.isdigit() for c in w) else w for w in line.split()) for line in (t or "").split("\n")}:
            count[m] = count.get(m, 0) + 1
    known = lambda line: (m := tuple("<*>" if any(c.isdigit() for c in w) else w for w in line.split())) and len(m) >= 3 and count[m] >= 10
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if not known(x)), *r) for i, t, *r in docs]


def one_of_each(docs):
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t, *_ in docs]
    root = list(range(len(docs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            same = (docs[a][1] or "") == (docs[b][1] or "") if not sets[a] or not sets[b] else len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            if same and (p := find(a)) != (q := find(b)):
                root[max(p, q)] = min(p, q)
    order = sorted(range(len(docs)), key=lambda k: docs[k][0])
    first = {}
    for k in order:
        first.setdefault(find(k), k)
    return [docs[k] for k in sorted(first.values())]


def cut(docs, items):
    out = []
    for i, t, *r in docs:
        while t and (w := words(t)):
            hit = {p for _, item in items for s in range(len(words(item)) - 9) for p0 in range(len(w) - 9) if w[p0 : p0 + 10] == words(item)[s : s + 10] for p in range(p0, p0 + 10)}
            if not hit:
                break
            at = [m.span() for m in WORD.finditer(t)]
            keep, done = [], 0
            for p in sorted(hit):
                if p - 1 not in hit:
                    keep.append(t[done : at[p][0]])
                if p + 1 not in hit:
                    done = at[p][1]
            t = "\n".join([*keep, t[done:]])
        out.append((i, t, *r))
    return out


def test_stages(spark, tmp_path):
    docs, labels, items = sample()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    now, df = docs, spark.createDataFrame(docs, SCHEMA)
    plain = {"quality_classifier": lambda d: keeps(d, labels), "line_dedup": without_lines, "near_dedup": one_of_each, "decontamination": lambda d: cut(d, items)}
    sizes = []
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns
        want = plain[name](now)
        got = [tuple(r) for r in out.collect()]
        assert sorted((r[:4] for r in got), key=str) == sorted((tuple(r[:4]) for r in want), key=str), name
        now, df = got, spark.createDataFrame(got, SCHEMA)
        sizes.append(len(got))
    assert sizes[0] < len(docs) and sizes[2] < sizes[1]
    assert all(r[4] == len(r[1]) for r in now if r[1] is not None)
    pieces = pipeline.run(spark, str(tmp_path)).collect()
    by = {}
    for r in pieces:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == {r[0] for r in now}
    for i, t, *_ in now:
        x, at = ids(t), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *x[at : at + r.length]))
            at += r.length
        assert at == len(x)
    assert max(r.sequence_id for r in pieces) == (sum(len(ids(t)) for _, t, *_ in now) - 1) // packing.WINDOW


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
