"""Ranks over a whole table without a task that holds it, sampling, and the best row of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.plans.stash import stash

_BITS = 33  # of monotonically_increasing_id() within a partition


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Adds the row's place from 1 in the total order given.

    The rows are sorted by range, stored, and numbered within their partitions; the partitions' sizes, summed in
    order, place them (a row for each partition, whatever the input).
    """
    placed = stash(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    sizes = placed.groupBy(F.shiftright("__at", _BITS).alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    out = placed.withColumn("__part", F.shiftright("__at", _BITS)).join(F.broadcast(starts), "__part")
    inner = F.col("__at").bitwiseAND(F.lit((1 << _BITS) - 1))
    return out.withColumn(name, F.col("__before") + inner + 1).drop("__at", "__part", "__before")


def sample_size(total: int, rate: float) -> int:
    """The rate's share of the rows, rounded up, one at the least."""
    if total <= 0 or rate <= 0:
        return 0
    return min(total, max(1, -int(-total * min(rate, 1.0) // 1)))


def quality_sample(rows: DataFrame, risk_rate: float, random_rate: float, seed: str, job: str, key: str = "chain_id", score: str = "score") -> DataFrame:
    """(chain_id, route, risk_score, selection_id): the riskiest share of the rows, and a random share of all from the
    rest. Ties and the random order are by SHA-256, so the same rows come out in any run."""
    mark = lambda kind: F.sha2(F.concat_ws("|", F.lit(job), F.lit(seed), F.lit(kind), F.col(key)), 256)
    own = rows.select(F.col(key).cast("string").alias(key), F.col(score).alias("__score"))
    total = own.count()
    n, m = sample_size(total, risk_rate), sample_size(total, random_rate)
    by_risk = ranked(own.withColumn("__tie", mark("risk")), F.desc("__score"), "__tie", key, name="__rank")
    risky = by_risk.where(F.col("__rank") <= n).select(key, F.lit("RISK").alias("route"), F.round("__score", 6).alias("risk_score"))
    rest = by_risk.where(F.col("__rank") > n).select(key)
    random = ranked(rest.withColumn("__tie", mark("random")), "__tie", key, name="__rank").where(F.col("__rank") <= m)
    both = risky.unionByName(random.select(key, F.lit("RANDOM").alias("route"), F.lit(0.0).alias("risk_score")))
    return both.withColumn("selection_id", F.concat(F.lit("qs_"), F.substring(F.sha2(F.concat_ws("|", F.lit(job), F.lit(seed), F.col(key)), 256), 1, 16)))


def risk_score(amount: Column, most: Column, days: Column, documents: Column) -> Column:
    """The amount's share of the largest; more the nearer to the period's end, within a week; more for many documents."""
    share = F.when((most > 0) & amount.isNotNull(), F.abs(amount) / most).otherwise(F.lit(0.0))
    near = F.when(F.abs(days) <= 7, 1.0 - F.abs(days) / 8.0).otherwise(F.lit(0.0))
    many = F.when(documents >= 4, F.least(documents / 10.0, F.lit(0.8))).otherwise(F.lit(0.0))
    return share + near + many


def best_of(df: DataFrame, keys: list[str], score: str, position: str, value: str, tie: str = "first") -> DataFrame:
    """(keys, value) of the row with the highest score: the first or last such row by position; tie "plain" takes the
    first row whatever its score. One aggregation; tasks reduce their own rows first."""
    s, p = F.coalesce(F.col(score), F.lit(float("-inf"))), F.col(position)
    order = {"first": F.struct(s, -p), "last": F.struct(s, p), "plain": F.struct(-p)}[tie]
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def latest(df: DataFrame, key: str, preferred: str, date: str, position: str) -> DataFrame:
    """(key, position) of the latest dated row, preferred rows first, the last of equals."""
    order = F.struct(F.coalesce(F.col(preferred), F.lit(False)), F.col(date), F.col(position))
    return df.groupBy(key).agg(F.max_by(position, order).alias(position))


def worst_status(c: Column) -> Column:
    """Aggregate: FAIL over WARNING over PASS; SKIPPED and unknown ones do not count, and all skipped is PASS."""
    rank = F.max(F.when(c == "FAIL", 3).when(c == "WARNING", 2).otherwise(1))
    return F.element_at(F.array(F.lit("PASS"), F.lit("WARNING"), F.lit("FAIL")), rank)
