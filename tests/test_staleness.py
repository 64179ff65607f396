import random

from ledgerloom.operators import reviews
from ledgerloom.streaming import feeds, staleness

SCHEMA = "chain_id long, stage string, seq long, signed boolean, fact string"


def test_stream_with_late_and_repeated_events_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(c, s, q, q == 0, rng.choice("ab")) for c in range(8) for s in ("fields", "tests", "workbook", "other") for q in range(rng.randrange(1, 5))]
    rows += [rng.choice(rows) for _ in range(40)] + [(None, "fields", 1, False, "a"), (20, "fields", 3, False, "x"), (21, "fields", 3, None, "a"), (21, "fields", 1, True, "b")]
    rng.shuffle(rows)
    feed, seen = f"{tmp_path}/feed", []
    for i in range(0, len(rows), 37):
        spark.createDataFrame(rows[i : i + 37], SCHEMA).coalesce(1).write.mode("append").parquet(feed)
        seen += rows[i : i + 37]
        stream = feeds.read_events(spark, feed, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
        staleness.follow(staleness.signed_events(stream, ["fact"]), f"{tmp_path}/told", f"{tmp_path}/at")
    told = spark.read.parquet(f"{tmp_path}/told")
    batch = staleness.stale_now(staleness.signed_events(spark.createDataFrame(seen, SCHEMA), ["fact"]))
    want = {r.chain_id: list(r.stages) for r in batch.collect()}
    assert {r.chain_id: list(r.stages) for r in staleness.latest(told).collect()} == want and len(want) > 3 and 21 in want
    # nothing is told twice in a row
    by = {}
    for r in told.orderBy("n").collect():
        assert by.get(r.chain_id, []) != list(r.stages)
        by[r.chain_id] = list(r.stages)
    # the batch form is the cascade of the stages that differ from what was signed
    last = {}
    for c, s, q, signed, f in seen:
        if c is not None:
            last[c, s, bool(signed)] = max(last.get((c, s, bool(signed)), (q, f)), (q, f))
    changed = [(c, s) for (c, s, signed), (q, f) in last.items() if not signed and (c, s, True) in last and q > last[c, s, True][0] and f != last[c, s, True][1]]
    cascade = reviews.invalidated(spark.createDataFrame([x for x in changed if x[1] != "other"], "chain_id long, stage string"))
    assert {(r.chain_id, r.stage) for r in cascade.collect()} == {(c, s) for c, v in want.items() for s in v if s != "other"}


def test_a_chain_costs_two_calls_of_its_state():
    from pyspark.sql import Row

    class Kept:
        calls, value = 0, None

        def get(self):
            Kept.calls += 1
            return Kept.value

        def update(self, value):
            Kept.calls, Kept.value = Kept.calls + 1, value

    made = staleness._Signatures()
    made.kept = Kept()
    event = lambda stage, seq, signed, mark: Row(chain_id=1, stage=stage, seq=seq, signed=signed, signature=mark)
    stages = ("fields", "tests", "é\"")
    told = list(made.handleInputRows((1,), iter([event(s, 0, True, "a") for s in stages] + [event(s, 2, False, "b") for s in stages]), None))
    assert [(r.chain_id, r.stages, r.n) for r in told] == [(1, ["conclusion", "evidence", "fields", "tests", "workbook", "é\""], 1)] and Kept.calls == 2
    assert list(made.handleInputRows((1,), iter([event("fields", 1, False, "z")]), None)) == [] and Kept.calls == 3  # late: nothing to keep
    told = list(made.handleInputRows((1,), iter([event(s, 3, False, "a") for s in stages]), None))
    assert [(r.stages, r.n) for r in told] == [([], 2)] and Kept.calls == 5
