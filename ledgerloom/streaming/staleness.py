"""Which chains have gone stale, as their facts come in.

Events are (chain_id, stage, seq, signed, signature): a stage's facts as of a sequence number, or, signed, the facts that a
person has confirmed. For each chain the state holds the newest signature and the newest signed one of every stage, so late
events (of a smaller number) and repeated ones change nothing. A stage has changed if its newest signature came after the
signed one and differs from it; the stages that depend on it are stale with it. A chain is told of only when its set of
stale stages is another than before, so the output follows the changes, not the events.

Defined cases: null chains are left out; of two events of one stage and number the one with the larger signature counts; a
stage that nobody has signed is not stale; a stage that nothing depends on is stale alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.operators.reviews import DEPENDS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def signed_events(rows: DataFrame, facts: list[str], chain: str = "chain_id", stage: str = "stage", seq: str = "seq", signed: str = "signed") -> DataFrame:
    """Events from rows with facts: their signature is the SHA-256 of the facts as JSON."""
    mark = F.sha2(F.to_json(F.struct(*facts)), 256)
    return rows.where(F.col(chain).isNotNull()).select(F.col(chain).alias("chain_id"), F.col(stage).alias("stage"), F.col(seq).cast("long").alias("seq"), F.coalesce(F.col(signed), F.lit(False)).alias("signed"), mark.alias("signature"))


def stale_now(events: DataFrame) -> DataFrame:
    """(chain_id, stages): the stale stages of each chain that has any, in order, from all events there are."""
    of = lambda s: F.max(F.when(F.col("signed") == s, F.struct("seq", "signature")))
    both = events.groupBy("chain_id", "stage").agg(of(False).alias("now"), of(True).alias("then"))
    changed = both.where((F.col("now.seq") > F.col("then.seq")) & (F.col("now.signature") != F.col("then.signature")))
    after = F.create_map(*(x for k, v in DEPENDS.items() for x in (F.lit(k), F.array(*map(F.lit, (k, *v))))))
    stale = changed.select("chain_id", F.explode(F.coalesce(F.try_element_at(after, F.col("stage")), F.array("stage"))).alias("stage"))
    return stale.groupBy("chain_id").agg(F.array_sort(F.collect_set("stage")).alias("stages"))


class _Signatures(StatefulProcessor):
    """One value for each chain, read once and written once a batch: a call of the state costs more than all else here."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "facts string, told string, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        got = self.kept.get()  # null for a chain that is new
        before, told, n = got if got is not None else ("[{}, {}]", "", 0)
        now, then = facts = [{stage: (seq, mark) for stage, (seq, mark) in side.items()} for side in json.loads(before)]
        for r in rows:
            side, new = (then if r["signed"] else now), (r["seq"], r["signature"])
            if r["stage"] not in side or new > side[r["stage"]]:
                side[r["stage"]] = new
        stale: set[str] = set()
        for stage, new in now.items():
            if stage in then and new[0] > then[stage][0] and new[1] != then[stage][1]:
                stale.update((stage, *DEPENDS.get(stage, ())))
        stages, after = ",".join(sorted(stale)), json.dumps(facts, ensure_ascii=False, separators=(",", ":"))
        more = int(stages != told)
        if more or after != before:
            self.kept.update((after, stages, n + more))
        if more:
            yield Row(chain_id=key[0], stages=sorted(stale), n=n + 1)

    def close(self) -> None:
        pass


def stale_chains(events: DataFrame) -> DataFrame:
    """(chain_id, stages, n) from a stream of events: a chain's stale stages whenever they have changed, with how often they
    had. A chain whose stages are sound again is told of with none."""
    kind = events.schema["chain_id"].dataType.simpleString()
    return events.groupBy("chain_id").transformWithState(_Signatures(), f"chain_id {kind}, stages array<string>, n long", "Update", "None")


def follow(events: DataFrame, path: str, checkpoint: str) -> None:
    """Runs the stream over all that is there now; its tellings are appended to a Parquet table, batch by batch. A batch that
    is repeated after a failure tells the same again under its number, so latest() stays right."""
    conf = events.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, _ROCKS)  # read when the stream starts
    try:
        stream = stale_chains(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        stream.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")).start().awaitTermination()
    finally:
        conf.set(_PROVIDER, before)


def latest(told: DataFrame) -> DataFrame:
    """(chain_id, stages): what was told of each chain last, if any stage is stale."""
    last = told.groupBy("chain_id").agg(F.max(F.struct("n", "stages")).alias("t"))
    return last.where(F.size("t.stages") > 0).select("chain_id", "t.stages")
