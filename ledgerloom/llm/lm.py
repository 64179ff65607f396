"""Language-model scores by deleted interpolation (operator 4).

A token's probability mixes maximum-likelihood estimates of two lengths of context and the uniform distribution:

    p(w | v) = a(b) c(vw) / c(v)  +  u(b) c(w) / N  +  e(b) / (V + 1),

with weights for each bucket b of the context's frequency (its binary logarithm); a context that was never seen has no
estimate of its own, so its weight there is zero and the others make up one. They are learnt by expectation-
maximisation: a fixed share of the training documents is deleted from the counts (the counts of all training documents
less those of the deleted ones), and the weights are those under which the deleted tokens are likeliest. The text's
score is then taken with the counts of all training documents.

Documents are dealt into batches of bounded text. A batch gives each of its distinct words and pairs once, as hashes
with counts; these are dealt by hash into buckets of bounded size, added up, and each batch gets the corpus counts of
its own hashes back. So a frequent word is one entry a batch, not a row for each occurrence; what is shuffled grows
with the corpus; and no vocabulary is held whole anywhere.

Defined cases: a null text is empty (its one token is the end); a null doc_id learns nothing and is not held out;
repeated rows are documents of their own; with no training documents every count is zero; with no deleted tokens the
weights of a bucket are equal; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.batches import few_rows, texts_of
from ledgerloom.plans.stash import stash

#: Bytes of text in a batch, and tokens of the corpus for each bucket of hashes.
BATCH_BYTES, BUCKET_TOKENS = 10_000_000, 2_000_000
#: Buckets beyond which counts are rows, one for each hash of a batch.
MOST_BUCKETS = 4096
#: One training document in so many is deleted from the counts that the weights are learnt with.
DELETED = 20
ROUNDS, CLOSE_ENOUGH = 15, 1e-4
TOP_BUCKET = 24
_START, _END = 0, 1  # numbers of the place before a text and of its end; words follow


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes (the finaliser of SplitMix64 over their combination)."""
    z = a * np.uint64(0x9E3779B97F4A7C15) + b
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_ONE = np.uint64(1)


def _distinct(a: np.ndarray) -> np.ndarray:
    """Sorted, each once; np.unique() puts them into a hash table first, which takes many times as long."""
    a = np.sort(a)
    return a[np.concatenate(([True], a[1:] != a[:-1]))[: len(a)]]



def _pack(a: np.ndarray, kind: type) -> bytes:
    """Compressed, byte by byte of all numbers."""
    a = np.ascontiguousarray(a.astype(kind))
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 1)


def _unpack(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


class _Numbers(dict):
    """Numbers words in the order of their first use, from 2."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 2
        return n


class Batch:
    """The tokens of some texts as hashes: token, pair (with the token before) and before, one text after the other.

    Odd hashes are single tokens, even ones pairs or the place before a text.
    """

    def __init__(self, texts: Iterator[bytes]) -> None:
        known = _Numbers()
        ids, self.sizes = [], []
        for text in texts:
            words = text.lower().split()
            ids += [np.fromiter(map(known.__getitem__, words), np.int32, len(words)), np.array([_END], np.int32)]
            self.sizes.append(len(words) + 1)
        h = np.array([0, 1, *(xxhash.xxh64_intdigest(w, 1) for w in known)], np.uint64)
        self.single = _mix(h, np.full(len(h), 7, np.uint64)) | _ONE
        self.single[_START] &= ~_ONE
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64) if ids else np.zeros(0, np.int64)
        self.token = np.concatenate(ids or [np.zeros(0, np.int32)])
        self.before = np.concatenate(([_START], self.token[:-1]))[: len(self.token)]
        self.before[self.starts] = _START
        self.pair = _mix(h[self.before], h[self.token]) & ~_ONE

    def keys(self) -> np.ndarray:
        return _distinct(np.concatenate((self.single, self.pair)))

    def counts(self, keys: np.ndarray, learn: np.ndarray) -> np.ndarray:
        """Occurrences of each of the keys in the texts that learn is true for."""
        which = np.repeat(learn, self.sizes)
        n = np.zeros(len(keys), np.int64)
        pairs = np.sort(self.pair[which])
        first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))[: len(pairs)])
        n[np.searchsorted(keys, pairs[first])] = np.diff(first, append=len(pairs))
        singles = np.bincount(self.token[which], minlength=len(self.single))
        singles[_START] = learn.sum()
        n[np.searchsorted(keys, self.single)] += singles
        return n

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the token, the context and the pair of each token stand among the keys."""
        order = np.argsort(self.pair)
        ranked = self.pair[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))[: len(ranked)]
        pair = np.empty(len(order), np.int64)
        pair[order] = np.searchsorted(keys, ranked[new])[np.cumsum(new) - 1]
        place = np.searchsorted(keys, self.single)
        return place[self.token], place[self.before], pair


def _bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def dealt(docs: DataFrame, batches: int, deleted: bool = False) -> DataFrame:
    """(batch, doc_id, learn, deleted, text binary compressed); which documents learn is the contract's. Deleted ones have
    batches of their own, from number `batches` on; deleted: only these."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    learn = F.coalesce(crc % 7 != 2, F.lit(False))
    gone, mark = learn & (F.floor(crc / 7) % DELETED == 0), F.xxhash64("doc_id", "text")
    batch = F.when(gone, F.lit(batches) + F.pmod(mark, F.lit(-(-batches // DELETED)))).otherwise(F.pmod(mark, F.lit(batches)))
    own = docs.select(batch.alias("batch"), "doc_id", learn.alias("learn"), gone.alias("deleted"), F.col("text"))
    if deleted:
        own = own.where(gone)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in parts:
            text = pa.array([squeeze(t.encode()) for t in texts_of(b.column(4))], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], text], ["batch", "doc_id", "learn", "deleted", "text"])

    return few_rows(own).mapInArrow(run, "batch long, doc_id long, learn boolean, deleted boolean, text binary")


def _batch(t: pa.Table) -> Batch:
    widen = zstandard.ZstdDecompressor().decompress
    return Batch(widen(x.as_py()) for x in t.column("text"))


def corpus_counts(rows: DataFrame, bits: int) -> DataFrame:
    """(batch, bucket, counts binary, n, v, less): for each batch the corpus counts of its hashes in one bucket; on one
    row of each bucket its tokens, distinct tokens, and tokens of deleted documents."""

    def give(t: pa.Table) -> pa.Table:
        b = _batch(t)
        keys = b.keys()
        n = b.counts(keys, t.column("learn").to_numpy().astype(bool))
        less = n if t.column("deleted")[0].as_py() else np.zeros_like(n)
        edges = np.searchsorted(_bucket_of(keys, bits), np.arange((1 << bits) + 1))
        out: list[list] = [[], [], [], [], []]
        for k, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if y > x:
                for column, value in zip(out, (k, t.column("batch")[0].as_py(), _pack(np.diff(keys[x:y], prepend=np.uint64(0)), np.uint64), _pack(n[x:y], np.uint32), _pack(less[x:y], np.uint32)), strict=True):
                    column.append(value)
        return pa.table(dict(zip(("bucket", "batch", "keys", "n", "less"), (pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), *(pa.array(c, pa.binary()) for c in out[2:])), strict=True)))

    def add(t: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpack(x.as_py(), np.uint64), dtype=np.uint64) for x in t.column("keys")]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        n, less = (np.bincount(at, np.concatenate([_unpack(x.as_py(), np.uint32) for x in t.column(c)]), len(distinct)).astype(np.int64) for c in ("n", "less"))
        single = (distinct & _ONE).astype(bool)
        ends = np.cumsum([len(k) for k in keys]).tolist()
        packed = [_pack(np.concatenate((n[at[a:b]], less[at[a:b]])), np.uint32) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        sums = [[int(x)] + [0] * (len(keys) - 1) for x in (n[single].sum(), (single & (n > 0)).sum(), less[single].sum())]
        return pa.table({"batch": t.column("batch"), "bucket": t.column("bucket"), "counts": pa.array(packed, pa.binary()), "n": pa.array(sums[0], pa.int64()), "v": pa.array(sums[1], pa.int64()), "less": pa.array(sums[2], pa.int64())})

    given = rows.groupBy("batch").applyInArrow(give, "bucket int, batch long, keys binary, n binary, less binary")
    return given.groupBy("bucket").applyInArrow(add, "batch long, bucket int, counts binary, n long, v long, less long")


def counts_by_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hash, n, less), the corpus counts, and (batch, hash), the hashes of each batch: the way for corpora of so many
    batches and buckets that a batch has but a few hashes in a bucket. Rows grow with the tokens."""

    def give(t: pa.Table) -> pa.Table:
        b = _batch(t)
        keys = b.keys()
        n = b.counts(keys, t.column("learn").to_numpy().astype(bool))
        gone, batch = t.column("deleted")[0].as_py(), t.column("batch")[0].as_py()
        return pa.table({"batch": pa.array(np.full(len(keys), batch)), "hash": pa.array(keys.view(np.int64)), "n": pa.array(n), "less": pa.array(n if gone else np.zeros_like(n))})

    given = stash(rows.groupBy("batch").applyInArrow(give, "batch long, hash long, n long, less long"), "given")
    return stash(given.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("less").alias("less")), "sums"), given.select("batch", "hash")


def _joined(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Corpus counts of a batch's hashes in their order, all and of deleted documents."""
    if "hash" in t.column_names:
        order = np.argsort(t.column("hash").to_numpy().view(np.uint64))
        return tuple(t.column(c).to_numpy()[order].astype(np.int64) for c in ("n", "less"))
    parts = sorted(zip(t.column("bucket").to_pylist(), t.column("counts").to_pylist(), strict=True))
    halves = [np.split(_unpack(c, np.uint32).astype(np.int64), 2) for _, c in parts]
    return np.concatenate([h[0] for h in halves]), np.concatenate([h[1] for h in halves])


def _components(b: Batch, n: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token the bucket of its context, the estimates with and without context, and its count."""
    token, context, pair = b.places(b.keys())
    times = n[context]
    bucket = np.minimum(np.log2(times + 1).astype(np.int64), TOP_BUCKET)
    return bucket, n[pair] / np.maximum(times, 1), n[token] / max(total, 1), n[token]


def learn_weights(rows: DataFrame, counts: DataFrame, batches: int, total: int, less: int, distinct: int) -> list[list[float]]:
    """[pair, single, uniform] for each bucket of the context's frequency, from the rows of the deleted documents."""

    def held(t: pa.Table, c: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"b": pa.array([], pa.int32()), "pair": pa.array([], pa.float64()), "single": pa.array([], pa.float64())})
        n, gone = _joined(c)
        bucket, pair, single, _ = _components(_batch(t), n - gone, total - less)
        return pa.table({"b": pa.array(bucket.astype(np.int32)), "pair": pa.array(pair), "single": pa.array(single)})

    counts = counts.where(F.col("batch") >= batches)
    seen = rows.groupBy("batch").cogroup(counts.groupBy("batch")).applyInArrow(held, "b int, pair double, single double")
    seen = seen.groupBy("b", "pair", "single").agg(F.count("*").alias("n"))
    seen = stash(seen, "deleted")
    return interpolate(seen, 1 / (distinct + 1))


def interpolate(seen: DataFrame, rest: float) -> list[list[float]]:
    """Expectation-maximisation over (b, pair, single, n): the bucket, the two estimates, and the number of such tokens."""
    buckets = range(TOP_BUCKET + 1)
    weights = [[0.0, 0.5, 0.5], *([1 / 3] * 3 for _ in buckets[1:])]
    for _ in range(ROUNDS):
        at = lambda i, w=weights: F.element_at(F.array(*(F.lit(x[i]) for x in w)), F.col("b") + 1)
        mixed = seen.select("b", "n", (at(0) * F.col("pair")).alias("a"), (at(1) * F.col("single")).alias("u"), (at(2) * F.lit(rest)).alias("e"))
        share = lambda c: F.sum(F.col("n") * F.col(c) / (F.col("a") + F.col("u") + F.col("e"))).alias(c)
        got = {r.b: [r.a, r.u, r.e] for r in mixed.groupBy("b").agg(share("a"), share("u"), share("e")).collect()}  # a row a bucket
        if not got:
            break
        # a bucket with few tokens leans on all of them
        whole = [sum(r[i] for r in got.values()) + 1 for i in range(3)]
        whole = [x / sum(whole) for x in whole]
        new = []
        for b in buckets:
            r = [x + 10 * w for x, w in zip(got.get(b, [0.0] * 3), whole, strict=True)]
            r[0] *= b > 0
            new.append([x / sum(r) for x in r])
        moved = max(abs(x - y) for p, q in zip(new, weights, strict=True) for x, y in zip(p, q, strict=True))
        weights = new
        if moved < CLOSE_ENOUGH:
            break
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, bucket_tokens: int = BUCKET_TOKENS, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each document."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, math.ceil(size / batch_bytes))
    bits = max(0, math.ceil(math.log2(max(1, size / 6 / bucket_tokens))))
    rows = dealt(own, batches)
    if 1 << bits <= most_buckets:
        counts = stash(corpus_counts(rows, bits), "counts")
        sums = counts.agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("less").alias("less")).first()
        counts = counts.select("batch", "bucket", "counts")
    else:
        all_, own_ = counts_by_rows(rows)
        single = all_.where(F.col("hash").bitwiseAND(F.lit(1)) == 1)
        sums = single.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v"), F.sum("less").alias("less")).first()
        counts = own_.join(all_, "hash").select("batch", "hash", "n", "less")
    total, distinct, less = (x or 0 for x in sums)
    weights = np.array(learn_weights(dealt(own, batches, True), counts, batches, total, less, distinct))

    def give(t: pa.Table, c: pa.Table) -> pa.Table:
        b = _batch(t)
        n, _ = _joined(c)
        bucket, pair, single, seen = _components(b, n, total)
        w = weights[bucket]
        p = np.log10(w[:, 0] * pair + w[:, 1] * single + w[:, 2] / (distinct + 1))
        base = np.log10((seen + 1) / (total + distinct + 1))
        add = lambda x: np.add.reduceat(x, b.starts) if len(b.starts) else x
        held = pa.array([x is not None and _crc(x) % 7 == 2 for x in t.column("doc_id").to_pylist()], pa.bool_())
        return pa.table({"doc_id": t.column("doc_id"), "held_out": held, "n_tokens": pa.array(b.sizes, pa.int64()), "n_known": pa.array(add((seen > 0).astype(np.int64))), "train_tokens": pa.array([total] * len(b.sizes), pa.int64()), "base_score": pa.array(add(base)), "score": pa.array(add(p))})

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("batch").cogroup(counts.groupBy("batch")).applyInArrow(give, kinds)


def _crc(doc_id: int) -> int:
    import zlib

    return zlib.crc32(str(doc_id).encode())


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
