"""Connected components by alternating stars, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.stash import drop, stash


def _signature(edges: DataFrame) -> tuple[int, object]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


#: Edges of a task, about, and tasks of a step, at the least.
TASK_EDGES, TASKS = 100_000, 8


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """One star step; the edges it starts from are deleted. The minima are stored first, so that the join that follows has two plain scans and a hot
    centre can be split by adaptive execution. Small graphs are stored in few files, whatever the session's number of
    partitions."""
    if large:
        pairs = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    else:
        pairs = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    least = stash(pairs.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("m")).coalesce(tasks), "stars")
    joined = pairs.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("m").alias("v")), F.struct(F.col("b").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    made = stash(out.where("u > v").distinct().coalesce(tasks), "edges")
    drop(least, edges)  # a round leaves its edges only
    return made


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the least node reachable.

    Alternating large-star and small-star steps: each keeps the components and shortens the paths, so a few rounds
    (logarithmic in the diameter) reach stars. Nothing but a count and a hash of the edges comes to the driver.
    Self-loops and null ends are ignored; an empty table gives an empty table.
    """
    now = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") > F.col("v")))
    now = stash(now.distinct(), "edges")
    seen = _signature(now)
    while seen[0]:
        tasks = max(TASKS, seen[0] // TASK_EDGES)
        now = _star(_star(now, True, tasks), False, tasks)
        mark = _signature(now)
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
