"""Stored results of a plan of steps, computed again only where something has changed.

A plan's tables are its sources and its steps' results; every row belongs to a key (a business, a chain). A change brings
new rows of some keys of some sources. Its keys go down the graph: a step is computed for those that any of its inputs
has changed for, from its inputs' rows of these keys alone. What is new is written as parts beside the old ones, with marks
(key, before) that retire the older rows of the keys; one commit makes all of it the next version. A step that fails, or
another writer who was first, leaves the version before as it was.

A gate is a source that holds the keys a person has confirmed. Steps behind a gate are computed for these only; others
are blocked and have no rows. A change of evidence does not touch confirmations, so a confirmed key's tests run anew and
nobody is asked twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.stash import small, stash
from ledgerloom.sources import versions as V


@dataclass(frozen=True)
class Step:
    """make takes the inputs' rows and returns the result's; every row has the plan's key, and those of one key come from
    those of the same key."""

    name: str
    inputs: tuple[str, ...]
    make: Callable[..., DataFrame]
    gates: tuple[str, ...] = ()


class Plan:
    """Steps over sources, stored under a path."""

    def __init__(self, spark: SparkSession, path: str, key: str, sources: Sequence[str], steps: Sequence[Step]) -> None:
        self.spark, self.path, self.key, self.sources, self.steps = spark, path, key, tuple(sources), tuple(steps)
        known = set(self.sources)
        for s in self.steps:
            if missing := {*s.inputs, *s.gates} - known:
                raise ValueError(f"step {s.name} comes before {sorted(missing)}")
            if s.name in known:
                raise ValueError(f"two tables are named {s.name}")
            known.add(s.name)

    def _marks(self, m: V.Manifest, name: str) -> DataFrame | None:
        made = V.table(self.spark, self.path, m, f"{name}.marks")
        return None if made is None else made.groupBy(self.key).agg(F.max("before").alias("__before"))

    def table(self, name: str, m: V.Manifest | None = None) -> DataFrame | None:
        """The rows of a source or a step in a version (the newest), with the version that computed each; None before its
        first row."""
        m = V.manifest(self.spark, self.path) if m is None else m
        rows, marks = V.table(self.spark, self.path, m, name), self._marks(m, name)
        if rows is None or marks is None:
            return rows
        last = small(stash(marks.withColumnRenamed(self.key, "__key"), "marks"))
        kept = rows.join(last, rows[self.key].eqNullSafe(last["__key"]), "left").where(F.col("__before").isNull() | (F.col("version") >= F.col("__before")))
        return kept.select(*(rows[c] for c in rows.columns))

    def _of(self, rows: DataFrame | None, keys: DataFrame) -> DataFrame | None:
        if rows is None:
            return None
        few = keys.withColumnRenamed(self.key, "__key")
        return rows.join(small(few), rows[self.key].eqNullSafe(few["__key"]), "left_semi")

    def put(self, changes: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None) -> V.Manifest:
        """The next version: the keys that a source's change has rows of have these rows from now on, those in gone none.
        The manifest's facts say for how many keys each step ran and was blocked; steps that are not named did not run."""
        if unknown := {*changes, *(gone or {})} - set(self.sources):
            raise ValueError(f"no source: {sorted(unknown)}")
        m = V.manifest(self.spark, self.path)
        version, draft = m.version + 1, V.Manifest(m.version, dict(m.tables))
        dirty: dict[str, DataFrame] = {}

        def write(name: str, rows: DataFrame | None, keys: DataFrame) -> None:
            dirty[name] = keys
            if rows is not None:
                draft.tables[name] = [*draft.tables.get(name, []), V.part(rows.drop("version").withColumn("version", F.lit(version)), self.path, name)]
            if name in m.tables:  # rows that are retired
                marks = V.part(keys.withColumn("before", F.lit(version)), self.path, f"{name}.marks")
                draft.tables[f"{name}.marks"] = [*draft.tables.get(f"{name}.marks", []), marks]

        for name in self.sources:
            parts = [d.select(self.key) for d in (changes.get(name), (gone or {}).get(name)) if d is not None]
            if parts:
                write(name, changes.get(name), stash(reduce(DataFrame.unionByName, parts).distinct(), "keys"))
        ran, blocked = {}, {}
        for step in self.steps:
            touched = [dirty[i] for i in (*step.inputs, *step.gates) if i in dirty]
            if not touched:
                continue
            keys = stash(reduce(DataFrame.unionByName, touched).distinct(), "keys")
            open_keys = keys
            for gate in step.gates:
                confirmed = self.table(gate, draft)
                open_keys = open_keys.limit(0) if confirmed is None else open_keys.join(self._of(confirmed, keys).select(self.key).distinct(), self.key, "left_semi")
            if step.gates:
                open_keys = stash(open_keys, "open")
            inputs = [self._of(self.table(i, draft), open_keys) for i in step.inputs]
            write(step.name, None if any(i is None for i in inputs) else step.make(*(i.drop("version") for i in inputs)), keys)
            ran[step.name] = open_keys.count()
            if n := keys.count() - ran[step.name]:
                blocked[step.name] = n
        return V.commit(self.spark, self.path, m, draft.tables, {"ran": ran, "blocked": blocked})

    def compact(self) -> V.Manifest:
        """The same rows, a part for each table and no marks."""
        m, made = V.manifest(self.spark, self.path), {}
        for name in (*self.sources, *(s.name for s in self.steps)):
            if f"{name}.marks" in m.tables or len(m.tables.get(name, [])) > 1:
                made |= {name: [V.part(self.table(name, m), self.path, name)], f"{name}.marks": []}
        return V.commit(self.spark, self.path, m, made, m.facts)
