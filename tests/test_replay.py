"""Stored steps run anew in part, and repaired JSON."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.jsons import repaired_json
from ledgerloom.operators.replay import Plan, Step
from ledgerloom.sources import versions


def steps(broken=False):
    total = lambda lines: lines.groupBy("k").agg(F.sum("v").alias("v"))
    if broken:
        total = lambda lines: lines.groupBy("k").agg(F.raise_error(F.lit("lost")).cast("long").alias("v"))
    return [
        Step("total", ("lines",), total),
        Step("double", ("total",), lambda t: t.select("k", (F.col("v") * 2).alias("v")), gates=("ok",)),
        Step("other", ("notes",), lambda n: n.select("k", F.upper("s").alias("s"))),
        Step("end", ("double", "other"), lambda d, o: d.join(o, "k")),
    ]


def rows(df, *columns):
    return [] if df is None else sorted(tuple(r) for r in df.select(*columns).collect())


def test_replay_equals_a_full_run(spark, tmp_path):
    rng, n = random.Random(8), [0]
    now = {"lines": {}, "notes": {}, "ok": {}}
    schema = {"lines": "k long, i int, v long, version int", "notes": "k long, s string", "ok": "k long"}

    def new(source, keys):
        return {k: [(k, i, rng.randrange(50), 0) for i in range(rng.randrange(1, 4))] if source == "lines" else [(k, rng.choice("abc"))] if source == "notes" else [(k,)] for k in keys}

    def frame(source, by_key):
        return spark.createDataFrame([r for v in by_key.values() for r in v], schema[source])

    plan = Plan(spark, f"{tmp_path}/p", "k", ["lines", "notes", "ok"], steps())
    assert plan.table("end") is None

    def change(given, gone=None):
        made = {s: new(s, keys) for s, keys in given.items()}
        for s, v in made.items():
            now[s].update(v)
        for s, keys in (gone or {}).items():
            for k in keys:
                now[s].pop(k, None)
        m = plan.put({s: frame(s, v) for s, v in made.items()}, {s: spark.createDataFrame([(k,) for k in keys], "k long") for s, keys in (gone or {}).items()})
        n[0] += 1
        full = Plan(spark, f"{tmp_path}/full{n[0]}", "k", ["lines", "notes", "ok"], steps())
        full.put({s: frame(s, v) for s, v in now.items()})
        for t, columns in (("total", "kv"), ("double", "kv"), ("other", "ks"), ("end", "kvs")):
            assert rows(plan.table(t), *columns) == rows(full.table(t), *columns), (n[0], t)
        return m.facts

    facts = change({"lines": range(12), "notes": range(10), "ok": range(0, 12, 2)})
    assert facts == {"ran": {"total": 12, "double": 6, "other": 10, "end": 12}, "blocked": {"double": 6}}
    # a change of two keys runs what depends on it for these keys; the other branch and the confirmations stay
    assert change({"lines": [2, 3]}) == {"ran": {"total": 2, "double": 1, "end": 2}, "blocked": {"double": 1}}
    assert rows(plan.table("end").where("version = 2"), "k") == [(2,)]
    # a confirmation runs what stood behind it
    assert change({"ok": [3]}) == {"ran": {"double": 1, "end": 1}, "blocked": {}}
    assert change({"notes": [0]}, gone={"lines": [2], "ok": [4]})["ran"] == {"total": 1, "double": 1, "other": 1, "end": 3}
    before = {t: rows(plan.table(t), "*") for t in ("total", "end")}
    plan.compact()
    assert {t: rows(plan.table(t), "*") for t in before} == before
    change({"lines": [2, 5], "notes": [5]})


def test_a_step_that_fails_leaves_the_version_before(spark, tmp_path):
    lines = spark.createDataFrame([(1, 5), (1, 6), (None, 7)], "k long, v long")
    ok, notes = spark.createDataFrame([(1,)], "k long"), spark.createDataFrame([(1, "x")], "k long, s string")
    Plan(spark, f"{tmp_path}/p", "k", ["lines", "notes", "ok"], steps()).put({"lines": lines, "notes": notes, "ok": ok})
    bad = Plan(spark, f"{tmp_path}/p", "k", ["lines", "notes", "ok"], steps(broken=True))
    with pytest.raises(Exception, match="lost"):
        bad.put({"lines": lines.withColumn("v", F.lit(0).cast("long"))})
    assert rows(bad.table("total"), F.coalesce("k", F.lit(-1)), "v") == [(-1, 7), (1, 11)] and rows(bad.table("end"), "k", "v", "s") == [(1, 22, "X")]
    assert versions.versions(spark, f"{tmp_path}/p") == [1]
    with pytest.raises(ValueError):
        bad.put({"total": lines})
    with pytest.raises(ValueError):
        Plan(spark, f"{tmp_path}/q", "k", ["lines"], [Step("a", ("b",), lambda b: b)])


DAMAGED = [
    ('```json\n{"a": [1, 2]}\n```', {"a": [1, 2]}),  # fenced
    ('Sure, here: {"a": "x}"} Anything else? {"b": 1}', {"a": "x}"}),  # in prose
    ('{"a": [1, 2,], "b": 3,}', {"a": [1, 2], "b": 3}),  # commas too many
    ('{"a": {"b": [1, {"c": "]"', {"a": {"b": [1, {"c": "]"}]}}),  # brackets open
    ('{"a": "cut of', {"a": "cut of"}),  # a string open
    ('{"a": 1, "b":', {"a": 1, "b": None}), ('{"a": 1, "b', {"a": 1, "b": None}),  # a value missing
    ('{"a": True, "b": None, "c": "True"}', {"a": True, "b": None, "c": "True"}),  # words of another language
    ('{"a": 1, // note "x"\n "b": /* {} */ "/* kept */"}', {"a": 1, "b": "/* kept */"}),  # comments
    ("{“a”: “b”}", {"a": "b"}),  # typographic marks
    ('{"a": "line\nbreak\tand “marks”"}', {"a": "line\nbreak\tand “marks”"}),  # raw line breaks
    ('{"a": "x\\', {"a": "x"}), ('{"u": "\\u12', {"u": ""}), ('{"a": "b\\"c", "d": 1', {"a": 'b"c', "d": 1}), ("```\n[1, 2", [1, 2]), ("[]", []), ('{"a": "' + "y" * 100_000, {"a": "y" * 100_000}),
]


def test_json_repair(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DAMAGED)], "i int, t string")
    got = {r.i: r.j for r in df.select("i", repaired_json(F.col("t")).alias("j")).collect()}
    for i, (t, want) in enumerate(DAMAGED):
        assert got[i] is not None and json.loads(got[i]) == want, t[:80]


def test_json_that_cannot_be_made_out_and_json_that_is_sound(spark):
    rng = random.Random(5)

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        return [rng.random(), rng.choice(["", 'q"\\/', "é漢😀", "a,}]"]), rng.choice([True, False, None]), rng.randrange(99), [], {}][kind] if kind < 4 else [value(depth - 1) for _ in range(3)] if kind == 4 else {f"k{i}": value(depth - 1) for i in range(3)}

    sound = [json.dumps({"v": value(3)}, ensure_ascii=bool(i % 2)) for i in range(60)]
    rows_ = [*sound, None, "", "no object", "{]", '{"a" 1}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows_)], "i int, t string").repartition(3)
    got = {r.i: r.j for r in df.select("i", repaired_json(F.col("t")).alias("j")).collect()}
    assert [got[i] for i in range(60)] == sound and all(got[i] is None for i in (60, 61, 62, 64))
    assert "Python" not in df.select(repaired_json(F.col("t")))._jdf.queryExecution().toString().replace("PythonRDD", "")
    # cut off anywhere, a record is either null or JSON whose values are those of the whole
    whole = '{"a": [1, {"b": "x y"}], "c": "d"}'
    cut = spark.createDataFrame([(n, whole[:n]) for n in range(1, len(whole))], "i int, t string")
    for r in cut.select("i", repaired_json(F.col("t")).alias("j")).collect():
        assert r.j is None or isinstance(json.loads(r.j), dict), r
