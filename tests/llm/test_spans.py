import random
import re

import numpy as np

from ledgerloom.llm import spans as S

BREAK = re.compile(r"(?<=[.!?])\s+|\n\s*")


def plain_units(text):
    """Units by the rule, window by window."""
    out = []
    for sentence in BREAK.split(text):
        words = sentence.split()
        h = [S.word_hash(w.lower()) for w in words]
        key = [int(S._mixed(np.array([(a * 3 + b) % (1 << 64)], np.uint64))[0]) for a, b in zip(h, [*h[1:], 0])]
        at = {0}
        for i in range(len(words) - S.UNIT_WORDS + 1 if len(words) > S.UNIT_WORDS else 0):
            at.add(min(range(i, i + S.UNIT_WORDS), key=lambda q: (key[q], -q)))
        at = sorted(at)
        out += [words[a:b] for a, b in zip(at, [*at[1:], len(words)]) if b > a]
    return out


def plain_runs(sizes):
    n, found = len(sizes), set()
    enough = lambda a, b: b - a >= S.UNITS and sum(sizes[a:b]) >= S.WORDS
    for i in range(n):
        ends = [e for e in range(i + 1, n + 1) if enough(i, e)]
        starts = [s for s in range(i + 1) if enough(s, i + 1)]
        found |= {(i, e) for e in ends[:1]} | {(s, i + 1) for s in starts[-1:]}
    return sorted(found)


def runs_of(sizes):
    a, b = S.runs(np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), np.array([0, len(sizes)]))
    return list(zip(a.tolist(), b.tolist()))


def test_arrays_follow_the_rule():
    rnd = random.Random(7)
    texts = [prose(rnd, n) for n in (0, 1, 12, 13, 40, 300)] + [" ".join(rnd.choice("ab") for _ in range(60)), "one " * 30, None, "", "x. y! z?\nw", " . ! ", "A\u2028b \x1cc.\x85d", "ΣΑΣ. ς"]
    assert [S.units(t) for t in texts] == [plain_units(t or "") for t in texts]
    for _ in range(60):
        sizes = [rnd.randrange(1, 13) for _ in range(rnd.randrange(30))]
        assert runs_of(sizes) == plain_runs(sizes)
    together = list(zip(*S.spans(texts)))
    alone = [(i, *x[1:]) for i, t in enumerate(texts) for x in zip(*S.spans([t]))]
    assert together == alone


def test_equal_runs_have_equal_hashes():
    rnd = random.Random(3)
    seen = {}
    for _ in range(20):
        text = " ".join(rnd.choice(["a", "b.", "C", "c"]) for _ in range(60))
        us = S.units(text)
        for _, h, c, s, e in zip(*S.spans([text])):
            words = tuple(w.lower() for u in us[s:e] for w in u)
            assert seen.setdefault((h, c), words) == words
    assert len(seen) == len(set(seen.values()))


def brute(rows):
    """Texts without repeated spans, by comparing whole spans of words."""
    first, cut = {}, {}
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    for d, t in order:
        us = [tuple(w.lower() for w in u) for u in S.units(t or "")]
        for a, b in plain_runs([len(u) for u in us]):
            if first.setdefault(tuple(w for u in us[a:b] for w in u), (d, t, a)) != (d, t, a):
                cut.setdefault((d, t), set()).update(range(a, b))
    out = []
    for d, t in rows:
        gone = cut.get((d, t), set())
        if gone:
            at = S.places(t)
            t = t[: at[0][0]] + "".join(t[x:y] for i, (x, y) in enumerate(at) if i not in gone)
        out.append((d, t))
    return out


def prose(rnd, words):
    out = []
    for i in range(words):
        w = f"w{rnd.randrange(5000)}"
        out.append(w + (". " if rnd.random() < 0.1 else "\n" if rnd.random() < 0.02 else " "))
    return "".join(out)


def test_units_and_places_agree():
    rnd = random.Random(4)
    for t in [prose(rnd, 300), " x", "", "a.b c! d?\n\n e", "one " * 30, "\n\n", "Ü. é x. z"]:
        us, at = S.units(t), S.places(t)
        assert [t[a:b].split() for a, b in at] == us


def test_passages_are_covered_to_their_ends():
    rnd = random.Random(8)
    for _ in range(100):
        sizes = [rnd.randrange(1, 13) for _ in range(40)]
        covered = {u for a, b in runs_of(sizes) for u in range(a, b)}
        assert covered == set(range(40))


def test_against_brute_force(spark):
    rnd = random.Random(6)
    passages = [prose(rnd, 60) for _ in range(4)]
    rows = [(i, prose(rnd, rnd.randrange(5, 200)) + "\n" + rnd.choice(passages) + "\n" + prose(rnd, 50)) for i in range(60)]
    rows += [(100, rows[3][1]), (101, None), (102, ""), (None, rows[4][1]), (103, passages[0] * 3), (104, "clean words. " * 2), (5, rows[5][1])]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, s string")
    out = S.remove_repeats(df)
    assert out.columns == ["doc_id", "text", "s", "__removed"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    kept = " ".join(t for _, t in got if t)
    assert all(" ".join(kept.split()).count(" ".join(p.split())) == 1 for p in passages)


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_inside_long_sentences_are_cut_alike():
    rnd = random.Random(12)
    word = lambda: f"w{rnd.randrange(5000)}"
    for before, after in ((3, 7), (0, 5), (40, 41)):
        passage = [word() for _ in range(500)]
        texts = [" ".join([*(word() for _ in range(k)), *passage, *(word() for _ in range(30))]) for k in (before, after)]
        assert all(len(u) <= S.UNIT_WORDS for t in texts for u in S.units(t))
        first = set(zip(*S.spans(texts[:1])[1:3]))
        us = S.units(texts[1])
        gone = {u for _, h, c, s, e in zip(*S.spans(texts[1:])) if (h, c) in first for u in range(s, e)}
        left = [w for i, u in enumerate(us) if i not in gone for w in u]
        assert len(set(left) & set(passage)) <= 60
        assert sum(len(us[i]) for i in gone) >= 500 - 2 * 24


def test_chunks_are_bounded():
    rnd = random.Random(2)
    for n in (1, 12, 13, 14, 25, 200):
        for words in ([f"w{rnd.randrange(60)}" for _ in range(n)], ["one"] * n):
            assert max(map(len, S.units(" ".join(words)))) <= S.UNIT_WORDS
