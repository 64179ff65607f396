"""The trie of shared conversation prefixes, as succinct level-order tries (operator 12).

A turn's label is 128 bits of the SHA-256 of its role and text. A prefix's key is the exclusive or of its turns' hashes,
each with its depth, in two lanes of 64 bits, so keys and parents' keys are running aggregates over narrow rows; texts are
read once and never shuffled. Rows of one key are one node.

A node is heavy if the conversations that start with it have more than `limit` turns from it on (their sum, a bound for
the nodes below it). Heavy nodes form the top of the trie. Below them hang subtrees of at most `limit` nodes: the shards.
A task takes whole shards, some at a time, builds one LOUDS bitvector and label array over them with numpy, and rolls up
leaves and saved tokens from the last level to the first with add.at. The totals of the shards' tops are summed by
parent, and the heavy nodes, at most rows / limit on each level, are rolled up the same way with those sums as their
start. The limit grows with the rows, so the heavy part stays some 50,000 nodes a level; only a conversation of more than
`limit` turns adds those turns to it.

Digests of the conversations that end at a node are taken in two steps, so a node with any share of all conversations is
no large group: ids are sorted by range over all tasks and joined to strings of bounded size; only these meet by node.

Defined cases: null roles and texts are empty; null turns come first; equal turns are ordered by role and label, and
repeated rows are turns of their own; rows without a conversation's id take no part; very long texts are hashed where they
lie; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.sharding import crc32_sql
from ledgerloom.plans.stash import small, stash

#: Least number of nodes that a shard may hold, and the share of all rows from which on it grows. No effect on results.
SHARD_NODES, SHARES = 20_000, 50_000
#: Characters of joined ids in one row.
JOINED = 1 << 16

_WORD = r"[^\x20\x09-\x0D]+"
_EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n, label, words): every conversation's turns in order, from 1."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    label = F.substring(F.unhex(F.sha2(F.concat(F.length(blank(role)).cast("string"), F.lit(":"), blank(role), blank(text)), 256)), 1, 16)
    own = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), blank(role).alias("role"), label.alias("label"), F.regexp_count(blank(text), F.lit(_WORD)).cast("long").alias("words"))
    n = F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "label"))
    return own.select("conv_id", n.alias("n"), "label", "words")


def prefixes(turns: DataFrame, *order: str) -> DataFrame:
    """(conv_id, d, last, k1, k2, p1, p2, words): of every conversation a row for each prefix, the empty one included, with
    its key and its parent's. turns: (conv_id, label, words) and what orders them; a row with a null label stands for the
    conversation itself, so each must have one, before its turns."""
    w = W.partitionBy("conv_id").orderBy(*order)
    rows = turns.select("conv_id", *order, "label", "words", (F.row_number().over(w) - 1).alias("d"), (F.count("*").over(W.partitionBy("conv_id")) - 1).alias("last"))
    own = [F.when(F.col("d") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(i), "d", "label")) for i in (1, 2)]
    rows = rows.withColumns({"x1": own[0], "x2": own[1]})
    keys = rows.withColumns({f"k{i}": F.bit_xor(f"x{i}").over(w.rowsBetween(W.unboundedPreceding, 0)) for i in (1, 2)})
    parent = [F.when(F.col("d") > 0, F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}"))).alias(f"p{i}") for i in (1, 2)]
    return keys.select("conv_id", "d", "last", "k1", "k2", *parent, "words")


class Louds:
    """A forest in level order: one 1 for each child and a 0 for each node, the top that holds the roots first. labels
    and parents follow that order; `order` says which row given stands where."""

    def __init__(self, keys: tuple[np.ndarray, np.ndarray], parents: tuple[np.ndarray, np.ndarray], level: np.ndarray) -> None:
        """keys and parents' keys in two lanes; level is 0 for roots, whose parents are not looked at."""
        n = len(level)
        k1, k2 = (np.concatenate((a, b)) for a, b in zip(keys, parents, strict=True))
        by = np.lexsort((k2, k1))
        new = np.ones(2 * n, bool)
        new[1:] = (np.diff(k1[by]) != 0) | (np.diff(k2[by]) != 0)
        group = np.empty(2 * n, np.int64)
        group[by] = np.cumsum(new) - 1
        row = np.full(2 * n, -1)
        row[group[:n]] = np.arange(n)
        above = row[group[n:]]
        sizes = np.bincount(level)
        self.levels = np.concatenate(([0], np.cumsum(sizes)))  # where each level begins
        rows, place, self.order = np.split(np.argsort(level, kind="stable"), self.levels[1:-1]), np.empty(n, np.int64), np.empty(n, np.int64)
        for at, own in zip(self.levels, rows, strict=False):
            up = place[above[own]] if at else np.zeros(len(own), np.int64)
            o = np.lexsort((keys[1][own], keys[0][own], up))
            self.order[at : at + len(own)] = own[o]
            place[own[o]] = np.arange(at, at + len(own))
        degrees = np.bincount(place[above[level > 0]], minlength=n)
        self.bits = np.ones(2 * n + 1, bool)
        self.bits[np.cumsum(np.concatenate((sizes[:1], degrees))) + np.arange(n + 1)] = False
        self.labels = np.stack([k[self.order] for k in keys], axis=1)

    @property
    def parent(self) -> np.ndarray:
        """Of each node the place of its parent, -1 for a root: the zeros before its one, read off the bits."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    @property
    def degree(self) -> np.ndarray:
        """Of each node the ones between its zero and the zero before."""
        zeros = np.flatnonzero(~self.bits)
        return np.diff(zeros) - 1

    def rolled_up(self, *values: np.ndarray) -> list[np.ndarray]:
        """Sums of each array, in level order, over every node's subtree."""
        sums, parent = [v.copy() for v in values], self.parent
        for at, end in zip(self.levels[-2:0:-1], self.levels[:1:-1], strict=True):
            for s in sums:
                np.add.at(s, parent[at:end], s[at:end])
        return sums


_OUT = "k1 long, k2 long, p1 long, p2 long, top boolean, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_IN = ("s1", "s2", "k1", "k2", "p1", "p2", "depth", "conv_id", "n_convs", "words", "kids", "leaves", "saved", "ends_sha256")


def _rolled(t: pa.Table) -> pa.RecordBatch:
    """The finished nodes of some whole shards, sorted by shard."""
    a = {c: t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in _IN[:-1] if c not in ("p1", "p2")}
    p = tuple(t[c].combine_chunks().fill_null(0).to_numpy() for c in ("p1", "p2"))
    new = np.ones(len(a["s1"]), bool)
    new[1:] = (np.diff(a["s1"]) != 0) | (np.diff(a["s2"]) != 0)
    starts = np.flatnonzero(new)
    level = a["depth"] - np.repeat(np.minimum.reduceat(a["depth"], starts), np.diff(np.append(starts, len(new))))
    trie = Louds((a["k1"], a["k2"]), p, level)
    o, parent = trie.order, trie.parent
    kids = trie.degree + a["kids"][o]
    leaves, saved = trie.rolled_up((kids == 0) + a["leaves"][o], (a["n_convs"][o] - 1) * a["words"][o] + a["saved"][o])
    conv, top = a["conv_id"][o], parent < 0
    cols = [pa.array(trie.labels[:, 0]), pa.array(trie.labels[:, 1]), *(t[c].combine_chunks().take(pa.array(o)) for c in ("p1", "p2")), pa.array(top), pa.array(a["depth"][o]), pa.array(conv), pa.array(conv[parent], mask=top), pa.array(a["n_convs"][o]), pa.array(kids), pa.array(leaves), pa.array(saved), t["ends_sha256"].combine_chunks().take(pa.array(o))]
    return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in _OUT.split(", ")])


def _by_shard(nodes: DataFrame, several: int) -> DataFrame:
    """The finished nodes; nodes lie with the others of their shard, sorted by shard. A task holds the rows of one shard
    and of up to `several` rows of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= several:
                t = pa.Table.from_batches(held)
                s1, s2 = t["s1"].to_numpy(), t["s2"].to_numpy()
                ended = np.flatnonzero((s1 != s1[-1]) | (s2 != s2[-1]))  # all but the last shard are whole
                cut = int(ended[-1]) + 1 if len(ended) else 0
                if cut:
                    yield _rolled(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
        if held and sum(b.num_rows for b in held):
            yield _rolled(pa.Table.from_batches(held))

    return nodes.select(*_IN).mapInArrow(run, _OUT)


def _digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) from (k1, k2, conv_id)."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, ids = (c.to_numpy() for c in batch.columns)
            if not len(ids):
                continue
            starts = np.flatnonzero(np.concatenate(([True], (np.diff(k1) != 0) | (np.diff(k2) != 0))))
            told = ids.tolist()
            cuts = [i for a, b in zip(starts, [*starts[1:], len(ids)], strict=True) for i in range(a, b, JOINED // 20)]
            text = [",".join(map(str, told[a:b])) for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(k1[cuts]), pa.array(k2[cuts]), pa.array(ids[cuts]), pa.array(text)], ["k1", "k2", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, made = None, None, []
        for batch in batches:
            for a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (a, b):
                    if key is not None:
                        made.append((*key, sha.hexdigest()))
                    key, sha = (a, b), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], ["k1", "k2", "ends_sha256"])
                made = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([sha.hexdigest()])], ["k1", "k2", "ends_sha256"])

    parts = ends.repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(joined, "k1 long, k2 long, first long, ids string")
    return parts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def trie(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """The nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of the rows of
    prefixes(). conv_id and parent_conv_id are the smallest members."""
    rows = stash(rows, "prefixes")
    limit = limit or max(SHARD_NODES, rows.count() // SHARES)
    key = ["k1", "k2"]
    weights = rows.groupBy(*key).agg(F.sum(F.col("last") - F.col("d") + 1).alias("weight")).where(F.col("weight") > limit).select(*key, F.lit(1).alias("heavy"))
    heavy = stash(weights, "heavy")
    marked = rows.join(small(heavy), key, "left").withColumn("heavy", F.coalesce("heavy", F.lit(0)))
    path = W.partitionBy("conv_id")
    marked = marked.withColumn("above", F.sum("heavy").over(path))  # the heavy prefixes of a conversation are its first ones
    shard = [F.max(F.when(F.col("d") == F.col("above"), F.col(f"k{i}"))).over(path).alias(f"s{i}") for i in (1, 2)]
    marked = marked.select(*key, "p1", "p2", "d", "conv_id", "words", "heavy", *shard)
    first = [F.max(c).alias(c) for c in ("p1", "p2", "words", "heavy", "s1", "s2")]
    nodes = marked.groupBy(*key).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("d").cast("long").alias("depth"), *first)
    ends = _digests(rows.where("d = last").select(*key, "conv_id"))
    nodes = stash(nodes.join(ends, key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY))), "nodes")
    zero = {c: F.lit(0).cast("long") for c in ("kids", "leaves", "saved")}
    light = nodes.where("heavy = 0").withColumns(zero).repartition("s1", "s2").sortWithinPartitions("s1", "s2")
    done = stash(_by_shard(light, SHARD_NODES), "shards")
    sums = done.where("top").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    upper = nodes.where("heavy = 1").join(sums, key, "left").na.fill(0, ["kids", "leaves", "saved"]).withColumns({"s1": F.lit(0).cast("long"), "s2": F.lit(0).cast("long")})
    top = _by_shard(upper.repartition(1), 1 << 62)
    names = small(stash(nodes.where("heavy = 1").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above")), "names"))
    below = done.join(names, ["p1", "p2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return below.select(*out).unionByName(top.select(*out))


#: Fixed values of the rebuilt conversations: twenty share the first turns of the first of them, three at the most.
SHARERS, MOST_SHARED = 20, 4


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n, label, words): of every conversation c a row that stands for it, then the first h turns of
    conversation c - c % 20, then its own after its first h; h is crc32(c) % 4. turns: stored rows of numbered()."""
    convs = turns.where("n = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % SHARERS).alias("base"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    none = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("n"), F.lit(None).cast("binary").alias("label"), F.lit(0).cast("long").alias("words"))
    heads = turns.where((F.col("conv_id") % SHARERS == 0) & (F.col("n") < MOST_SHARED)).withColumnRenamed("conv_id", "base")
    given = convs.join(heads, "base").where(F.col("n") <= h).select("conv_id", F.lit(1).alias("part"), "n", "label", "words")
    own = turns.where(F.col("n") > h).select("conv_id", F.lit(2).alias("part"), "n", "label", "words")
    return none.unionByName(given).unionByName(own)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stash(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turns")
    return trie(prefixes(rebuilt(turns), "part", "n"))


_TEXT = "length(r) || ':' || r || length(x) || ':' || x"
OP12_SQL = f"""
WITH s AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, sha256(length(r) || ':' || r || x)) AS n FROM s),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, CAST({crc32_sql("CAST(conv_id AS VARCHAR)")} AS BIGINT) % 4 AS h FROM (SELECT DISTINCT conv_id FROM s)),
b AS (SELECT c.conv_id, 0 AS part, n, r, x FROM c JOIN t ON t.conv_id = c.base AND n <= h UNION ALL SELECT c.conv_id, 1, n, r, x FROM c JOIN t ON t.conv_id = c.conv_id AND n > h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, n) AS d, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS words FROM b),
p AS (SELECT conv_id, d, words, string_agg({_TEXT}, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM o UNION ALL SELECT conv_id, 0, 0, '' FROM c),
q AS (SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY d) AS up, d = max(d) OVER (PARTITION BY conv_id) AS "end" FROM p),
n AS (SELECT path, min(up) AS up, min(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE "end"), '')) AS ends_sha256 FROM q GROUP BY path),
k AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.up = n.path) AS kids FROM n)
SELECT a.conv_id, a.depth, u.conv_id AS parent_conv_id, a.n_convs, a.kids AS n_children, CAST(count(*) FILTER (WHERE b.kids = 0) AS BIGINT) AS n_leaves, CAST(sum((b.n_convs - 1) * b.words) AS BIGINT) AS saved_tokens, a.ends_sha256
FROM k a LEFT JOIN n u ON u.path = a.up JOIN k b ON starts_with(b.path, a.path) GROUP BY ALL
"""
