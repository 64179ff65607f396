"""Exact top-k inner products on a bit-sliced index (operator 9).

Rows are dealt into blocks of bounded size. In a block, every bit of every quantised component is one bitmap over
the rows. A query's weighted sum of components is made by bitmap arithmetic alone: the weights are recoded into
signed powers of two, so each (component bit, weight digit) is one bitmap of some power of two, and carry-save adders
reduce these to the slices of the scores. The best rows are then taken from the most significant slice downward; rows
still tied at the end are resolved by id.

Defined cases: a vector that is null, empty, or holds a null, NaN or infinite component takes no part, nor does a row
without an id; rows that share an id are rows of their own, none of them answers a query of that id, and queries that
share one give their best together; only vectors of the same length are compared; scores must fit a long. An empty
table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_ROWS = 16_384
QUERY_ROWS = 64
#: Blocks of queries that meet a block of rows in one task, at the most; tasks there should be, at the least.
QUERY_BLOCKS, TASKS = 16, 32


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, dim, q array<long>) of the vectors that take part."""
    v = F.col("v")
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    own = own.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    own = own.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return own.select("vec_id", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("q"))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """The slices of one block: bitmaps by component and bit, rows in the order of their ids."""
    pdf = pdf.sort_values("vec_id")
    a = np.vstack(pdf["q"].to_numpy()).astype(np.int64)
    lo = int(a.min())
    bits = max(1, int(a.max() - lo).bit_length())
    a -= lo
    n, d = a.shape
    words = (n + 63) // 64
    slices = np.zeros((d, bits, words * 8), np.uint8)
    for b in range(bits):
        slices[:, b, : (n + 7) // 8] = np.packbits(((a >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
    return pd.DataFrame({"dim": [d], "block": [pdf["block"].iloc[0]], "n": [n], "lo": [lo], "bits": [bits], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "slices": [slices.tobytes()]})


def _digits(x: int) -> list[tuple[int, bool]]:
    """x as a sum of signed powers of two, no two neighbours: (power, negative)."""
    out, minus, at, x = [], x < 0, 0, abs(x)
    while x:
        if x & 1:
            d = 2 - (x & 3)
            out.append((at, (d < 0) != minus))
            x -= d
        x >>= 1
        at += 1
    return out


def _sum_slices(maps: np.ndarray, bits: int, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices of the sum of query[d] * a[d] less a constant, by carry-save adders; and the constant.

    maps has the bitmaps of all components and, after them, their complements: -2**s * a = 2**s * ~a - 2**s * (2**bits - 1).
    """
    half, const, picks = len(maps) // 2, 0, {}
    for d, q in enumerate(query.tolist()):
        for s, minus in _digits(q):
            if minus:
                const -= ((1 << bits) - 1) << s
            for b in range(bits):
                picks.setdefault(s + b, []).append(d * bits + b + half * minus)
    slices, carry, w = [], [], 0
    last = max(picks, default=-1)
    while w <= last or carry:
        parts = carry + ([maps[picks[w]]] if w in picks else [])
        carry = []
        stack = np.concatenate(parts) if parts else np.zeros((1, maps.shape[1]), np.uint64)
        while len(stack) > 2:
            t = len(stack) // 3
            a, b, c = stack[:t], stack[t : 2 * t], stack[2 * t : 3 * t]
            x = a ^ b
            carry.append((a & b) | (x & c))
            stack = np.concatenate((x ^ c, stack[3 * t :])) if len(stack) > 3 * t else x ^ c
        if len(stack) == 2:
            carry.append((stack[0] & stack[1])[None])
            stack = (stack[0] ^ stack[1])[None]
        slices.append(stack[0])
        w += 1
    return slices, const


def _top(slices: list[np.ndarray], eligible: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k rows with the largest sums; at the boundary the first positions."""
    sure, maybe = np.zeros_like(eligible), eligible.copy()
    for s in reversed(slices):
        x = sure | (maybe & s)
        n = int(np.bitwise_count(x).sum())
        if n > k:
            maybe &= s
        else:
            sure = x
            maybe &= ~s
            if n == k:
                maybe[:] = 0
                break
    rows = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    certain = rows(sure)
    return np.concatenate((certain, rows(maybe)[: k - len(certain)]))


def _search(index: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k rows of one block for each query of some query blocks."""
    out = []
    for r in index.itertuples(index=False):
        ids = np.frombuffer(r.ids, np.int64)
        maps = np.frombuffer(r.slices, np.uint64).reshape(r.dim * r.bits, -1)
        maps = np.concatenate((maps, ~maps))
        valid = np.zeros(maps.shape[1] * 64, np.uint8)
        valid[: r.n] = 1
        for qids, qs in zip(asked["qids"], asked["qs"], strict=True):
            qids, qs = np.frombuffer(qids, np.int64), np.frombuffer(qs, np.int64).reshape(-1, r.dim)
            first, last = np.searchsorted(ids, qids), np.searchsorted(ids, qids, "right")
            for qid, q, x, y in zip(qids.tolist(), qs, first.tolist(), last.tolist(), strict=True):
                mine = valid
                if x < y:
                    mine = valid.copy()
                    mine[x:y] = 0
                slices, const = _sum_slices(maps, r.bits, q)
                best = _top(slices, np.packbits(mine, bitorder="little").view(np.uint64), k)
                const += r.lo * int(q.sum())
                for row in best.tolist():
                    word, bit = row >> 6, row & 63
                    score = const + sum(((int(s[word]) >> bit) & 1) << w for w, s in enumerate(slices))
                    out.append((qid, int(ids[row]), score))
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    q = np.vstack(pdf["q"].to_numpy()).astype(np.int64)
    return pd.DataFrame({"dim": [q.shape[1]], "part": [pdf["part"].iloc[0]], "qids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "qs": [q.tobytes()]})


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """The index, a row a block, and the number of blocks a length of vectors has."""
    blocks = max(1, math.ceil(rows.count() / block_rows))
    # by place as well, so that rows of one id, or equal rows, don't fill a block
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)))
    return dealt.groupBy("dim", "block").applyInPandas(_build, "dim int, block long, n long, lo long, bits int, ids binary, slices binary"), blocks


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of another id with the largest inner products of
    floor(scale * x), ties to the smaller id. Every block of rows meets every block of queries once; a task holds one
    block of rows and a bounded number of blocks of queries. A block answers with k rows a query, so what is merged is k
    rows for each query and block."""
    rows, asked = quantised(vectors, id_col, vec_col, scale), quantised(queries, id_col, vec_col, scale)
    index, blocks = build_index(rows, block_rows)
    parts = max(1, math.ceil(asked.count() / query_rows))
    part = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(parts))
    packed = asked.withColumn("part", part).groupBy("dim", "part").applyInPandas(_pack, "dim int, part long, qids binary, qs binary")
    shares = min(parts, max(math.ceil(parts / QUERY_BLOCKS), math.ceil(TASKS / blocks)))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = packed.select("dim", F.pmod("part", F.lit(shares)).alias("share"), "qids", "qs").withColumn("block", all_of(blocks))
    index = index.withColumn("share", all_of(shares))
    tasks, keys = min(4096, max(blocks * shares, 1)), ["dim", "block", "share"]
    # each block of rows is sent once a share, and each block of queries once a block of rows
    met = index.repartition(tasks, *keys).groupBy(*keys).cogroup(asked.repartition(tasks, *keys).groupBy(*keys))
    found = met.applyInPandas(lambda a, b: _search(a, b, k), "query_id long, vec_id long, score long")
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("m"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.m")).alias("score"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.where("vec_id % 50 = 0"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
