import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from ledgerloom.llm import lm as L


def tokens_of(rows):
    return {i: [*(t or "").encode().lower().split(), None] for i, t in rows}


def counted(docs):
    """Counts of tokens, pairs and contexts."""
    one, two, ctx = Counter(w for t in docs for w in t), Counter(), Counter()
    for t in docs:
        two.update(zip(["<", *t], t))
        ctx.update(["<", *t[:-1]])
    return one, two, ctx


def crc(i):
    return zlib.crc32(str(i).encode())


def plain_weights(rows):
    """Expectation-maximisation token by token on the deleted documents."""
    tokens = tokens_of(rows)
    gone = {i for i in tokens if crc(i) % 7 != 2 and crc(i) // 7 % L.DELETED == 0}
    v = len({w for i, t in tokens.items() if crc(i) % 7 != 2 for w in t})
    one, two, ctx = counted([t for i, t in tokens.items() if crc(i) % 7 != 2 and i not in gone])
    n, seen = sum(one.values()), []
    for i in gone:
        for a, w in zip(["<", *tokens[i]], tokens[i]):
            seen.append((min(int(math.log2(ctx[a] + 1)), L.TOP_BUCKET), (two[a, w] / max(ctx[a], 1), one[w] / n, 1 / (v + 1))))
    weights = [[0, 0.5, 0.5], *([1 / 3] * 3 for _ in range(L.TOP_BUCKET))]
    for _ in range(L.ROUNDS):
        got = defaultdict(lambda: [0.0] * 3)
        for b, p in seen:
            mixed = [x * y for x, y in zip(weights[b], p)]
            got[b] = [g + m / sum(mixed) for g, m in zip(got[b], mixed)]
        whole = [sum(g[k] for g in got.values()) + 1 for k in range(3)]
        new = [[(g + 10 * x / sum(whole)) * (b > 0 or k > 0) for k, (g, x) in enumerate(zip(got[b], whole))] for b in range(L.TOP_BUCKET + 1)]
        new = [[x / sum(r) for x in r] for r in new]
        moved = max(abs(x - y) for p, q in zip(new, weights) for x, y in zip(p, q))
        weights = new
        if moved < L.CLOSE_ENOUGH:
            break
    return weights


def estimate(a, w, counts, weights):
    one, two, ctx = counts
    x = weights[min(int(math.log2(ctx[a] + 1)), L.TOP_BUCKET)]
    return x[0] * two[a, w] / max(ctx[a], 1) + x[1] * one[w] / sum(one.values()) + x[2] / (len(one) + 1)


def plain(rows, weights):
    """Scores by plain counting with the given weights."""
    tokens = tokens_of(rows)
    counts = counted([t for i, t in tokens.items() if crc(i) % 7 != 2])
    c1 = counts[0]
    n, v = sum(c1.values()), len(c1)
    out = {}
    for i, t in tokens.items():
        base = sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in t)
        s = sum(math.log10(estimate(a, w, counts, weights)) for a, w in zip(["<", *t], t))
        out[i] = (crc(i) % 7 == 2, len(t), sum(c1[w] > 0 for w in t), n, base, s)
    return out


def texts(n=120, seed=2):
    rnd = random.Random(seed)
    words = [f"W{i}" for i in range(40)]
    rows = [(i, " ".join(words[min(39, int(rnd.expovariate(0.2)))] + rnd.choice(["", "", "Ü"]) for _ in range(rnd.randrange(30)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "new words only here")]


def test_scores_against_plain_counting(spark, monkeypatch):
    rows, got_weights = texts(), []
    learn = L.learn_weights
    monkeypatch.setattr(L, "learn_weights", lambda *a: got_weights.append(learn(*a)) or got_weights[-1])
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, batch int")
    expected = plain_weights(rows)
    for batch, bucket, most in ((10**6, 10**6, 4096), (900, 60, 4096), (900, 60, 1)):
        got = {r.doc_id: tuple(r)[1:] for r in L.score(df, batch_bytes=batch, bucket_tokens=bucket, most_buckets=most).collect()}
        want = plain(rows, got_weights[-1])
        assert all(math.isclose(x, y, abs_tol=1e-9) for p, q in zip(got_weights[-1], expected) for x, y in zip(p, q))
        assert got.keys() == want.keys()
        for i, x in want.items():
            assert got[i][:4] == x[:4]
            assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got[i][4:], x[4:]))
    # a distribution in every context, seen often, seldom or never, over all words and the unknown one
    counts = counted([t for i, t in tokens_of(rows).items() if crc(i) % 7 != 2])
    for a in ["<", b"w0", b"w39", b"never"]:
        assert abs(sum(estimate(a, w, counts, got_weights[-1]) for w in [*counts[0], "unknown"]) - 1) < 1e-9
    assert got_weights[-1][0][0] == 0 and all(min(w) > 0 for w in got_weights[-1][1:])


def test_empty_and_unlearnt(spark):
    schema = "doc_id long, text string"
    assert L.score(spark.createDataFrame([], schema)).count() == 0
    (r,) = L.score(spark.createDataFrame([(None, "a b")], schema)).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (False, 3, 0, 0, 0.0)


def test_a_batch_sorts_its_hashes_and_no_more():
    import time

    rng = np.random.default_rng(2)
    b = L.Batch(iter([b" ".join(b"w%d" % x for x in rng.integers(0, 200_000, 800_000))]))
    both, learn = np.concatenate((b.single, b.pair)), np.ones(1, bool)

    def took(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    keys = b.keys()
    assert np.array_equal(keys, np.unique(both))
    distinct, times = np.unique(b.pair, return_counts=True)
    assert np.array_equal(b.counts(keys, learn)[np.searchsorted(keys, distinct)], times)
    assert np.array_equal(keys[b.places(keys)[2]], b.pair)
    # some 2 times the sort itself; a hash table took some 50 times
    assert min(took(b.keys) for _ in range(5)) < 12 * min(took(lambda: np.sort(both)) for _ in range(5))
