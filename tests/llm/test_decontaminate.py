import hashlib
import random
import re

import pytest

from ledgerloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, size=10):
    """(doc_id, words, hits, items) by looking at every window of every item in every document."""
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for name, item in items:
            v = words(item)
            n = min(size, len(v))
            for s in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(name or "")
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def sample(seed=5):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["Alpha", "beta", "GAMMA", "δέλτα", "e5", "zeta-eta", "Ünï"]) + str(rnd.randrange(6))
    items = [(f"i{k}", " ".join(word() for _ in range(rnd.choice([1, 3, 9, 10, 14, 30])))) for k in range(25)]
    items += [("i0", "again an item of the same name with more words than ten of them"), ("none", None), ("empty", "... !"), (None, "nameless item of four")]
    docs = []
    for i in range(60):
        parts = [word() for _ in range(rnd.randrange(60))]
        for _ in range(rnd.randrange(3)):
            _, text = rnd.choice(items)
            parts.insert(rnd.randrange(len(parts) + 1), (text or "").upper().replace(" ", rnd.choice([" ", ", ", "\n\t"])))
        docs.append((i, " ".join(parts)))
    return [*docs, (60, None), (61, ""), (62, "!!"), (None, items[3][1]), (3, docs[3][1]), (3, docs[3][1])], items


@pytest.mark.parametrize("most", [D.SET_WINDOWS, 40])
def test_against_every_window(spark, most):
    docs, items = sample()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id string, text string, doc_id int")
    got = D.contamination(df, bench, most=most).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in got), key=str) == plain(docs, items)


def test_digest_and_modes(spark, tmp_path):
    docs, items = sample(9)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(((r.doc_id, r.n_hit, r.items_sha256, r.contaminated) for r in D.op2_decontamination(spark, str(tmp_path)).collect()), key=str)
    want = plain(docs, items)
    assert got == sorted(((i, h, hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0) for i, _, h, f in want), key=str)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, known string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    cut = D.decontaminate(df, bench)
    assert cut.columns == df.columns and cut.count() == len(docs)
    assert all(h == 0 for _, _, h, _ in plain([(r.doc_id, r.text) for r in cut.collect()], items))
    clean = {i for i, _, h, _ in want if not h}
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert all(texts[i] == t for i, t in docs if i in clean)
    assert sorted((r.doc_id for r in D.decontaminate(df, bench, "documents").collect()), key=str) == sorted((i for i, t in docs if plain([(i, t)], items)[0][2] == 0), key=str)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id string, text string")
    assert [tuple(r)[:4] for r in D.contamination(docs, bench).collect()] == [(1, 2, 0, 0)]
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert D.decontaminate(docs, bench).collect() == docs.collect()


def test_blocks_cut_as_one(spark):
    rnd = random.Random(3)
    short = [f"zip zap{k}" for k in range(6)]
    passage = []
    for k in range(20):
        passage += [f"p{rnd.randrange(999)}" for _ in range(4)] + short[k % 6].split()
    items = [*((f"s{k}", s) for k, s in enumerate(short)), ("long", " ".join(passage))]
    docs = [(1, "before it " + " ".join(passage) + " after it"), (2, "clean words"), (3, None), (4, "a zip zip zap1 zap1 b"), (5, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for mode in ("spans", "documents"):
        one, more = (sorted(map(tuple, D.decontaminate(df, bench, mode, most=m).collect())) for m in (D.SET_WINDOWS, 10))
        assert one == more
        assert mode == "documents" or more[0] == (1, "before it \n after it")
        assert mode == "spans" or [i for i, _ in more] == [2, 3, 5]
