import random

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import simhash as S


def fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [words[i : i + size] for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(b" ".join(r), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, bits=4):
    f = {i: fingerprint(t) for i, t in rows}
    ids, label = list(f), {i: i for i in f}
    while True:
        new = {a: min(label[b] for b in ids if (f[a] ^ f[b]).bit_count() <= bits) for a in ids}
        if new == label:
            return f, label
        label = new


def test_golay_balls_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, i % 5, replace=False):
            y[i] ^= np.uint64(1 << int(b))
    rx, kx = S.golay_keys(x)
    ry, ky = S.golay_keys(y)
    for i in range(len(x)):
        assert set(kx[rx == i]) & set(ky[ry == i])
        assert len(kx[rx == i]) <= 108


@pytest.mark.parametrize("block", [1024, 3])
def test_clusters_against_all_pairs(spark, block, monkeypatch):
    rnd = random.Random(3)
    base = [[f"w{rnd.randrange(500)}" for _ in range(rnd.choice([3, 40, 300]))] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "Ünï ünï"), (6, "a b c"), (7, "a b c d e")]
    for words in base:
        for _ in range(10):
            w = list(words)
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(9)}"
            rows.append((len(rows), " ".join(w)))
    monkeypatch.setattr(S.near_links, "__defaults__", (block,))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, f0 string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.clusters(df).collect()}
    f, label = components(rows)
    assert got == {i: (f"{f[i]:016x}", label[i]) for i in f}
    assert len(set(label.values())) < len(rows) - 20


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.clusters(empty).count() == 0
    assert S.near_dedup(empty).count() == 0


def test_near_dedup_keeps_the_first_of_each_group(spark):
    rnd = random.Random(5)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    near = [*words[:399], "other"]
    clean = " ".join(f"c{rnd.randrange(10**6)}" for _ in range(300))
    rows = [(9, " ".join(words), 1), (3, " ".join(words), 2), (4, " ".join(near), 3), (5, clean, 4), (5, clean, 4), (6, "", 5), (7, None, 6), (None, clean, 7), (8, " ", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = sorted(S.near_dedup(df).select("doc_id", "node").collect())
    assert [tuple(r) for r in got] == [(3, 2), (5, 4), (6, 5), (8, 8)]


def linked(sets, at_least=0.8):
    label = list(range(len(sets)))
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if len(x & y) >= at_least * len(x | y):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if k == old else k for k in label]
    return label


@pytest.mark.parametrize("block", [1024, 5])
def test_near_dedup_against_all_pairs_about_the_threshold(spark, block, monkeypatch):
    """Isolated pairs and families with much in common, many of them just over or under the similarity."""
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(10**6)}"
    texts = []
    for n in range(150):
        a = [word() for _ in range(150)]
        texts += [a, [*a[: 133 + n % 8], *(word() for _ in range(17 - n % 8))]]
    for _ in range(3):
        form = [word() for _ in range(120)]
        for _ in range(40):
            own, k = list(form), rnd.randrange(0, 100, 5)
            own[k : k + rnd.randrange(1, 16)] = [word() for _ in range(rnd.randrange(1, 16))]
            texts.append(own)
    texts = [" ".join(t) for t in texts]
    label = linked([set(S.shingle_hashes(t, 5).tolist()) for t in texts])
    monkeypatch.setattr(S.near_groups, "__defaults__", (S.DEDUP_SHINGLE, S.DEDUP_SIMILARITY, block))
    got = sorted(r.doc_id for r in S.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert got == sorted(set(label))
    assert 300 < len(set(label)) - sum(label[i] == i for i in range(300)) + 300 and 0 < sum(label[i] != i for i in range(300)) < 150


def test_a_nearer_text_that_fails_hides_no_pair():
    """A and B are nearest to C, which is no copy of either; A and B come in the next round."""
    import pyarrow as pa

    far = lambda d: (1 << d) - 1
    rows = [(1, far(8)), (2, far(8) << 8), (3, 0)]
    columns = {"key": [7] * 3, "i": [0] * 3, "j": [0] * 3, "node": [3, 1, 2], "n": [300] * 3, "parity": [x.to_bytes(8 * S.BITMAP, "little") for x in (0, rows[0][1], rows[1][1])], "comp": [3, 1, 2]}
    seen = set()
    for low, high in ((0, 1), (1, 5)):
        out = S._proposals(pa.table(columns), low, high, 0.8).to_pylist()
        seen |= {(r["src"], r["dst"]) for r in out if not r["more"]}
    assert seen == {(1, 2), (1, 3), (2, 3)}
    assert not any(r["more"] for r in out)


def test_parities_rule_out_no_pair_of_the_similarity():
    rng = np.random.default_rng(4)
    out = 0
    for n in (1500, 3000, 5000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for share in (0.0, 0.5, 0.8, 0.88, 0.9, 1.0):
            b = np.concatenate((a[: int(n * share)], rng.integers(0, 1 << 63, int(n * (1.1 - share))).astype(np.uint64)))
            wide = [S.parity(s, 1 << (2 * len(s) - 1).bit_length()) for s in (a, b)]
            real = len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
            may = S.possible(len(a), wide[0], len(b), wide[1], 0.8)
            assert may or not real
            out += not may
    assert out >= 6


def test_long_texts_with_a_passage_in_common_are_no_candidates():
    """Their bitmaps of parities are full, so these rule out no pair."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    sets, sketch = [], lambda s: S.parity(s, 64 * S.BITMAP) + S.counts(s, 64 * S.BITMAP)
    common = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    for i in range(40):
        sets.append(np.unique(np.concatenate((common, rng.integers(0, 1 << 63, 2500 + 250 * (i % 20)).astype(np.uint64)))))
    for i in (0, 7, 19):  # near copies, one on either side of the similarity and one by far
        for share in (0.895, 0.875, 0.99):
            keep = rng.permutation(sets[i])[: int(len(sets[i]) * share)]
            sets.append(np.unique(np.concatenate((keep, rng.integers(0, 1 << 63, len(sets[i]) - len(keep)).astype(np.uint64)))))
    real = {(a, b) for b in range(len(sets)) for a in range(b) if S.similar(sets[a], sets[b], 0.8)}
    for size in (3, len(sets)):  # small groups are looked at together
        seen = set()
        for at in range(0, len(sets), size) if size > 3 else [0]:
            which = list(range(len(sets))) if size > 3 else sorted({0, *range(40, 43)})
            n = len(which)
            columns = {"key": [7] * n, "i": [0] * n, "j": [0] * n, "node": which, "n": [len(sets[x]) for x in which], "parity": [sketch(sets[x]) for x in which], "comp": which}
            seen |= {(r["src"], r["dst"]) for r in S._proposals(pa.table(columns), 0, 100, 0.8).to_pylist() if not r["more"]}
        want = {p for p in real if set(p) <= set(which)}
        assert want and want <= seen and len(seen) <= len(want) + 15


def test_keys_of_connected_texts_are_left_out(spark, monkeypatch):
    rnd = random.Random(8)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join([*words[:198], f"x{i}"])) for i in range(60)]
    made, stash = {}, S.stash
    monkeypatch.setattr(S, "stash", lambda df, name="step": made.setdefault(name, []).append(stash(df, name)) or made[name][-1])
    groups = S.near_groups(spark.createDataFrame(rows, "node long, text string"))
    assert {r.component for r in groups.collect()} == {0} and groups.count() == 60
    assert made["met"][0].count() > 0 and made["met"][-1].count() == 0
    assert made["candidates"][0].count() == 0
