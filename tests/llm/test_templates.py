import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import templates as T


def brute(rows, documents):
    """The rule of the module, in one process."""
    docs = sorted({(d, t) for d, t in rows}, key=str)
    lines = {r: [T.masked(x) for x in (r[1] or "").split("\n")] for r in docs}
    leaves = defaultdict(set)
    count = defaultdict(int)
    for r in docs:
        for m in {tuple(t) for t in lines[r] if len(t) >= T.TOKENS}:
            leaves[(len(m), m[: T.LEADING])].add(m)
            count[(len(m), m[: T.LEADING])] += 1
    name = {}
    for leaf, members in leaves.items():
        if count[leaf] >= documents and len(members) > 1:
            open_ = []
            for m in sorted(members):
                best = max(open_, key=lambda o: sum(a == b != T.WILD for a, b in zip(o[1], m)), default=None)
                if best and sum(a == b != T.WILD for a, b in zip(best[1], m)) >= T.AGREE * len(m):
                    best[1] = [a if a == b else T.WILD for a, b in zip(best[1], m)]
                    name[m] = best[0]
                else:
                    open_.append([m, list(m)])

    def often(voters):
        seen = defaultdict(set)
        for r in voters:
            for t in lines[r]:
                if len(t) >= T.TOKENS:
                    seen[name.get(tuple(t), tuple(t))].add(r)
        return {t for t, x in seen.items() if len(x) >= documents}

    first = often(docs)
    share = lambda r: sum(len(t) for t in lines[r] if len(t) >= T.TOKENS and name.get(tuple(t), tuple(t)) in first)
    voted = often([r for r in docs if share(r) <= T.COPIED * sum(map(len, lines[r]))]) & first
    out = []
    for d, t in rows:
        cut = [i for i, x in enumerate(lines[d, t]) if t and len(x) >= T.TOKENS and name.get(tuple(x), tuple(x)) in voted]
        out.append((d, t if not cut else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut), cut))
    return out


def rows_of():
    rnd = random.Random(9)
    line = lambda: " ".join(f"w{rnd.choice('abcdefghij')}{rnd.choice('klmnop')}{rnd.choice('qrstuv')}" for _ in range(rnd.randrange(4, 15)))
    heads = [lambda: f"Posted by {rnd.choice(['ann', 'bob', 'cy'])} on day {rnd.randrange(99)} of the year", lambda: "All rights reserved.", lambda: f"Page {rnd.randrange(9)} of {rnd.randrange(9)}"]
    rows = [(i, "\n".join([line(), rnd.choice(heads)(), *(line() for _ in range(5)), "Ok."])) for i in range(60)]
    family = "\n".join(line() for _ in range(6))
    rows += [(100 + i, family + "\nAll rights reserved.\nown w" + "abcdefghijklmnopqrst"[i]) for i in range(20)]
    return [*rows, (200, None), (201, ""), (202, "\n\n"), (203, "All rights reserved."), (None, rows[0][1]), (3, rows[3][1]), rows[4]]


@pytest.mark.parametrize("set_lines", [1000, 0])
def test_against_the_rule_in_one_process(spark, set_lines):
    rows = rows_of()
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, mask int, total int")
    out = T.drop_templates(df, set_lines=set_lines)
    assert out.columns == ["doc_id", "text", "mask", "total", "__lines", "__dropped"]
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    got = sorted(((r.doc_id, r.text, r["__dropped"]) for r in out.collect()), key=key)
    assert got == sorted(brute(rows, T.DOCUMENTS), key=key)
    text = "\n".join(t for _, t, _ in got if t)
    assert not any(x in text for x in ("All rights", "Posted by", "Page "))
    # lines that only copies share stay
    assert all(len(t.split("\n")) == 7 for d, t, _ in got if d is not None and 100 <= d < 120)


@pytest.mark.parametrize("run_lines", [5, 16, 4096])
def test_full_leaves_in_runs(spark, run_lines):
    """Templates whose lines lie far apart in their leaf, among lines that share nothing but their first tokens."""
    rnd = random.Random(3)
    name = lambda n=6: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    own = lambda: " ".join(name() for _ in range(12))
    rows = []
    for i in range(120):
        first = rnd.choice([f"Posted by {name()} in the archive of the town", f"Posted by {name()} {name()} who has read this at home"])
        rows.append((i, f"{first}\n{own()}"))
        rows.append((1000 + i, f"Posted by {' '.join(name() for _ in range(7))}\n{own()}"))
    got = sorted((r.doc_id, r.text, r["__dropped"]) for r in T.drop_templates(spark.createDataFrame(rows, "doc_id long, text string"), run_lines=run_lines).collect())
    assert [(d, cut) for d, _, cut in got] == [(d, [0] if d < 1000 else []) for d, _ in sorted(rows)]
    assert got == sorted(brute(rows, T.DOCUMENTS))


@pytest.mark.parametrize("lines", [583, 5_000, 50_000])
def test_many_lines_of_one_template_are_one(spark, lines):
    names = ["".join(chr(97 + i // 26**k % 26) for k in range(5)) for i in range(lines)]
    made = spark.createDataFrame([(7, hash(n), f"the user {n} has come to our great new shop") for n in names], "g long, mask long, line string")
    assert [(r.n, r.m) for r in T._templates(made, 512).groupBy("template").agg(F.count("*").alias("n"), F.count_distinct("mask").alias("m")).collect()] == [(lines, lines)]
    if lines == 583:
        docs = spark.createDataFrame([(i, f"the user {n} has come to our great new shop\nown words of {n}") for i, n in enumerate(names)], "doc_id long, text string")
        assert all(r["__dropped"] == [0, 1] for r in T.drop_templates(docs, run_lines=64).collect())


def test_a_full_leaf_is_one(spark):
    """Over 512 lines of a leaf that share a template of their own, and ten that stand far apart among others."""
    rnd = random.Random(7)
    name = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    own = lambda: " ".join(name() for _ in range(12))
    rows = [(i, f"Posted by {name()} in the archive of the town\n{own()}") for i in range(600)]
    rows += [(1000 + i, f"Posted by {' '.join(name() for _ in range(7))}\n{own()}") for i in range(1500)]
    rows += [(5000 + i, f"Posted by {chr(97 + 2 * i)}{name()} for all who read {chr(97 + i)}x here\n{own()}") for i in range(10)]
    got = sorted((r.doc_id, r.text, r["__dropped"]) for r in T.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [(d, cut) for d, _, cut in got] == [(d, [] if 1000 <= d < 5000 else [0]) for d, _ in rows]
    assert got == sorted(brute(rows, T.DOCUMENTS))


def test_the_index_finds_every_template(monkeypatch):
    rnd = random.Random(5)
    for n in (3, 4, 5, 6, 7, 10, 20):
        lines = sorted({" ".join(["a", "b", *(rnd.choice(["x", "y", T.WILD, *("zuvw" if rnd.random() < 0.3 else "")]) for _ in range(n - 2))]) for _ in range(300)})
        lines = [(i, x) for i, x in enumerate(lines)]
        found = T.grow(lines)
        with monkeypatch.context() as m:
            m.setattr(T, "_segments", lambda *_: [])
            assert T.grow(lines) == found


def test_empty(spark):
    assert T.drop_templates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_boilerplate_of_short_pages_goes(spark):
    """Pages that are mostly one footer are no copies of one another; true copies have one vote."""
    rnd = random.Random(8)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    footer, family = words(60), [words(50) for _ in range(2)]
    rows = [(i, f"{words(40)}\n{footer}") for i in range(40)] + [(100 + i, "\n".join([*family, words(3)])) for i in range(20)]
    got = {r.doc_id: r["__dropped"] for r in T.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: [1] if d < 100 else [] for d, _ in rows}
