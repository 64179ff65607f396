import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import sharding as S

SCHEMA = "doc_id long, text string, shard_of string, size string"


def plain(rows, shards):
    """The same law in plain Python: (id, size, crc, shard, slot)."""
    own = sorted((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    total, at, out, slots = sum(r[2] for r in own), 0, [], {}
    for there, i, size, crc in own:
        shard = (2 * at + size) * shards // (2 * total)
        out.append((i if there else None, size, crc, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        at += size
    return sorted(out, key=repr)


def got(spark, rows, shards=16, run=S.RUN, parts=3):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in S.assigned(df, shards, run=run).select("id", "size", "crc", "shard", "slot").collect()), key=repr)


@pytest.mark.parametrize("run", [1, 7, S.RUN])
def test_equals_plain_sums(spark, run):
    rng = random.Random(run)
    rows = [(rng.choice([None, 7, 7, *range(40)]), rng.choice([None, "", "é漢😀", "x" * rng.randrange(300)])) for _ in range(300)]
    rows += [(7, "same text")] * 150 + [(None, None)] * 3  # a third of all rows agree in every column
    assert got(spark, rows, run=run) == plain(rows, 16)


def test_near_equal_bytes_and_gapless_slots(spark):
    rng = random.Random(1)
    rows = [(i, "w" * rng.randrange(2000)) for i in range(1000)]
    out = got(spark, rows)
    target, largest = sum(r[1] for r in out) / 16, max(r[1] for r in out)
    for s in range(16):
        own = [r for r in out if r[3] == s]
        assert abs(sum(r[1] for r in own) - target) <= largest
        assert sorted(r[4] for r in own) == list(range(len(own)))


def test_few_rows_and_large_ones(spark):
    for rows in ([(1, "a" * 1000), (2, "b")], [(1, None)], [(2, "b"), (1, "a" * 1000), (3, "c")]):
        assert got(spark, rows, parts=1) == plain(rows, 16)
    assert got(spark, [(3, "x" * 3_000_000), (4, "y")]) == plain([(3, "x" * 3_000_000), (4, "y")], 16)
    assert got(spark, []) == []


def test_order_of_the_input_does_not_matter(spark):
    rows = [(i % 11, f"text {i % 5}") for i in range(200)]
    assert got(spark, rows, parts=1) == got(spark, rows[::-1], parts=8)


def test_written_shards_hold_the_rows(spark, tmp_path):
    rows = [(i if i % 9 else None, f"text {i}" * (i % 13), "x", "y") for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    S.write_shards(df, f"{tmp_path}/out", 5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(repr, back.select(*df.columns).collect())) == sorted(map(repr, df.collect()))
    want = {}
    for _, size, crc, shard, _ in plain([r[:2] for r in rows], 5):
        want[shard] = want.get(shard, 0) + size
    sizes = dict(back.groupBy("shard").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1)).collect())
    assert {k: v for k, v in sizes.items()} == want  # no repeated rows here, so no ties at the cuts
    with pytest.raises(ValueError):
        S.write_shards(back, f"{tmp_path}/again")


def test_query_runs_no_python(spark, tmp_path):
    spark.createDataFrame([(5, "b"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = S.op13_sharding(spark, str(tmp_path))
    assert "Python" not in df._jdf.queryExecution().toString()
    assert sorted((r.doc_id, r.size, r.text_crc32, r.law, r.slot) for r in df.collect()) == [(2, 1, 0, "bytes", 0), (5, 2, zlib.crc32(b"b"), "bytes", 0)]
