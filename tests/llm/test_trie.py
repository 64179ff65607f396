import hashlib
import random
import re
import sys
import zlib

import numpy as np
import pytest

from ledgerloom.llm import trie as T
from ledgerloom.plans.stash import stash

SCHEMA = "conv_id long, turn long, role string, text string, k1 string, d string"


def label(r, x):
    return hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()


def brute(rows):
    told = {}
    for c, t, r, x in rows:
        if c is not None:
            told.setdefault(c, []).append((t is not None, t or 0, r or "", label(r or "", x or ""), x or ""))
    told = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in told.items()}
    made = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(told.get(c - c % 20, [])[:h] + own[h:])
    members, ends = {}, {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    kids = {}
    for seq in members:
        if seq:
            kids.setdefault(seq[:-1], []).append(seq)

    def saved(seq):
        own = (len(members[seq]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", seq[-1][1])) if seq else 0
        return own + sum(map(saved, kids.get(seq, [])))

    def leaves(seq):
        return sum(map(leaves, kids[seq])) if seq in kids else 1

    return sorted((min(m), len(s), min(members[s[:-1]]) if s else -1, len(m), len(kids.get(s, [])), leaves(s), saved(s), hashlib.sha256(",".join(map(str, sorted(ends.get(s, [])))).encode()).hexdigest()) for s, m in members.items())


def got(spark, rows, limit=None):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    out = T.trie(T.prefixes(T.rebuilt(stash(T.numbered(df))), "part", "n"), limit).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *r[3:]) for r in out)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(70):
        if c not in (20, 40, 41):
            for t in range(rng.randrange(1, 8)):
                rows.append((c, t, rng.choice(["user", "assistant"]) if t > 2 else "user", "w " * rng.choice([1, 1, 1, 2, 3])))
    return rows


@pytest.mark.parametrize("limit", [1, 4, 30, None])
def test_equals_brute_force(spark, limit):
    rows = conversations(limit or 0)
    assert got(spark, rows, limit) == brute(rows)


def test_hot_beginnings_copies_and_odd_rows(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(6)]  # copies of one conversation
    rows += [(c, t, "user", "very common" if t < 3 else f"{c} {t}") for c in range(200, 260) for t in range(5)]  # one beginning
    rows += [(300, None, None, None), (300, None, "user", "b"), (300, 1, "user", "a"), (300, 1, "user", "a"), (300, 1, "assistant", ""), (None, 0, "user", "x")]
    rows += [(301, 0, "user", "long " * 100_000), (9_000_000_019, 5, "a:b", "3:c"), (9_000_000_018, 5, "a", ":b3:c")]
    want = brute(rows)
    for limit in (2, 50, None):
        assert got(spark, rows, limit) == want


def test_a_very_long_conversation(spark):
    rows = [(7, t, "user", f"{t}") for t in range(700)] + [(8, t, "user", f"{t}") for t in range(650)]
    sys.setrecursionlimit(5000)
    assert got(spark, rows, 100) == got(spark, rows) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == []


def test_louds_bits():
    # two roots; the first has two children, of which the second has one
    keys = np.array([10, 20, 11, 12, 13]), np.zeros(5, np.int64)
    parents = np.array([0, 0, 10, 10, 12]), np.zeros(5, np.int64)
    t = T.Louds(keys, parents, np.array([0, 0, 1, 1, 2]))
    assert "".join("01"[int(b)] for b in t.bits) == "110" + "110" + "0" + "0" + "10" + "0"
    assert t.labels[:, 0].tolist() == [10, 20, 11, 12, 13]
    assert t.parent.tolist() == [-1, -1, 0, 0, 3] and t.degree.tolist() == [2, 0, 0, 1, 0]
    assert t.rolled_up(np.array([1, 1, 1, 1, 1]))[0].tolist() == [4, 1, 1, 2, 1]
