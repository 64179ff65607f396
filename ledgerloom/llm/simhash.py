"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 1).

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a shortened word of the perfect
binary Golay code (23, 12, 7). Two words at distance 2 or less have a midpoint at distance 1 from both, so the sets of
codewords to which a word and its one-bit neighbours decode (six at the most) meet. At four differing bits or fewer,
some two of the three segments differ in two bits or fewer together, so two fingerprints that are to be linked share a
key: a pair of segments and a codeword index of each. Rows meet by key and every pair is verified on the whole
fingerprints; a bucket gives a minimum spanning forest of its links, not all pairs. Buckets of very many fingerprints
are dealt into blocks, and each pair of blocks meets in a group of its own, so no group is larger than two blocks.

Defined cases: a null text has no words, like an empty one; texts without words share fingerprint zero and are linked like
any other; a null doc_id takes part but is never the smallest of a component that has others; repeated rows are
copies; an empty table gives an empty result; other columns are not read (near_dedup() keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.batches import AT_A_TIME, few_rows, texts_of
from ledgerloom.operators.components import connected_components
from ledgerloom.plans.stash import small, stash

SEED = 42
MAX_BITS = 4
WIDTHS = (22, 21, 21)
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: A bucket of more rows than this is dealt into blocks of so many.
BLOCK_ROWS = 1024
#: Rows of buckets that a task looks at together; buckets larger than the second number have a forest of their own.
GATHERED, TOGETHER = 40_000, 32


@lru_cache(1)
def decode_table() -> np.ndarray:
    """The index of the nearest codeword for every word of the widest segment."""
    words = np.arange(1 << max(WIDTHS), dtype=np.uint32)
    residues = [1]  # of x^i, so of one-bit errors
    for _ in range(22):
        r = residues[-1] << 1
        residues.append(r ^ GENERATOR if r >> 11 else r)
    syndrome = np.zeros(len(words), np.uint16)
    for i in range(max(WIDTHS)):
        syndrome ^= ((words >> np.uint32(i)) & np.uint32(1)).astype(np.uint16) * np.uint16(residues[i])
    leader = np.zeros(1 << 11, np.uint32)
    bits = [(residues[i], 1 << i) for i in range(23)]
    for i, (r, e) in enumerate(bits):
        leader[r] = e
        for j, (s, f) in enumerate(bits[:i]):
            leader[r ^ s] = e | f
            for t, g in bits[:j]:
                leader[r ^ s ^ t] = e | f | g
    return ((words ^ leader[syndrome]) >> np.uint32(11)).astype(np.int16)


def _codewords(segment: np.ndarray, width: int) -> np.ndarray:
    """(n, 6) codeword indices of the ball of radius 1 around each word; -1 where there are fewer."""
    flips = np.array([0, *(1 << i for i in range(width))], np.uint32)
    c = np.sort(decode_table()[segment[:, None] ^ flips], axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    return -np.sort(-c, axis=1)[:, :6]


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): every key of every fingerprint (uint64)."""
    balls, at = [], 0
    for w in WIDTHS:
        balls.append(_codewords(((prints >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.uint32), w).astype(np.int32))
        at += w
    rows, keys = [], []
    for p, (s, t) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, b = balls[s][:, :, None], balls[t][:, None, :]
        r, i, j = np.nonzero((a >= 0) & (b >= 0))
        rows.append(r)
        keys.append((p << 24) | (balls[s][r, i] << 12) | balls[t][r, j])
    return np.concatenate(rows), np.concatenate(keys)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every run of `size` words, repeats included; of the whole sequence where there are fewer words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()[min(size, len(words)) - 1 :]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends)]), ">u8").astype(np.uint64)  # noqa: B905


def _majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed long."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def _mixed(h: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles (the finaliser of SplitMix64)."""
    z = h + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, key_cols: list[str], text_col: str = "text", shingle: int = 4, prints: int = 1) -> DataFrame:
    """The key columns and f0, f1, ...: SimHash fingerprints of the whole text, as signed longs."""
    own = few_rows(docs).select(*key_cols, F.col(text_col).alias("__text"))
    names = [f"f{i}" for i in range(prints)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[] for _ in names]
            for text in texts_of(batch.column(len(key_cols))):
                h = shingle_hashes(text, shingle)
                for i, column in enumerate(out):
                    h = _mixed(h) if i else h
                    column.append(_majority(h))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key_cols)], *(pa.array(c, pa.int64()) for c in out)], [*key_cols, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(run, f"{kinds}, " + ", ".join(f"{n} long" for n in names))


def _keyed(nodes: DataFrame, names: list[str], only_keys: bool) -> DataFrame:
    """A row for each node and key; the first 27 bits of the key name the fingerprint, the segments and the codewords."""
    prints = [n for n in names if n != "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5_000):
                part = batch.slice(at, 5_000)
                for i, f in enumerate(prints):
                    rows, keys = golay_keys(part.column(names.index(f)).to_numpy(zero_copy_only=False).view(np.uint64))
                    keys = pa.array((keys | (i << 26)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([keys], ["key"]) if only_keys else pa.RecordBatch.from_arrays([keys, *part.take(pa.array(rows)).columns], ["key", *names])

    return nodes.select(*names).mapInArrow(run, "key int" + ("" if only_keys else "".join(f", {n} long" for n in names)))


def _forest(f: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges of a minimum spanning forest of rows of fingerprints (n, prints) at `most` differing bits or fewer (Prim)."""
    n = len(f)
    best, via, left = np.full(n, 1 << 20), np.zeros(n, np.int64), np.ones(n, bool)
    edges, at = [], 0
    for _ in range(n - 1):
        left[at] = False
        d = np.bitwise_count(f ^ f[at]).sum(1)
        nearer = left & (d < best)
        best[nearer], via[nearer] = d[nearer], at
        at = int(np.argmin(np.where(left, best, 1 << 21)))
        if best[at] <= most:
            edges.append((int(via[at]), at))
    return edges


def _links(batch: pa.Table, names: list[str], most: int) -> pa.RecordBatch:
    """The links of complete runs of rows of one group; at most one for each row but the first of a run."""
    prints = [n for n in names if n != "node"]
    f = np.stack([batch.column(n).to_numpy().view(np.uint64) for n in prints], axis=1)
    group = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in ("key", "i", "j")], axis=1)
    node = batch.column(names[0]).to_numpy()
    new = np.concatenate(([True], (group[1:] != group[:-1]).any(1)))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate((starts, [len(node)])))
    run = np.cumsum(new) - 1
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    # runs of two need no forest; of the others, small ones are looked at together, for each distance between rows
    a = starts[sizes == 2]
    ok = np.bitwise_count(f[a] ^ f[a + 1]).sum(1) <= most
    pairs.append((a[ok], a[ok] + 1))
    small = np.flatnonzero((sizes[run] > 2) & (sizes[run] <= TOGETHER))
    hits = []
    last = starts[run] + sizes[run]
    for d in range(1, int(sizes[run[small]].max()) if len(small) else 0):
        a = small[small + d < last[small]]
        dist = np.bitwise_count(f[a] ^ f[a + d]).sum(1)
        ok = dist <= most
        hits.append(np.stack((dist[ok], a[ok], a[ok] + d), axis=1))
    if hits:
        hits = np.concatenate(hits).astype(np.int64)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := root.get(x, x)) != x:
                root[x] = x = root.get(p, p)
            return x

        kept = []
        for _, x, y in hits[np.argsort(hits[:, 0], kind="stable")].tolist():
            if (p := find(x)) != (q := find(y)):
                root[p] = q
                kept.append((x, y))
        if kept:
            pairs.append(tuple(np.array(kept).T))
    for s, n in zip(starts[sizes > TOGETHER].tolist(), sizes[sizes > TOGETHER].tolist(), strict=True):
        if found := _forest(f[s : s + n], most):
            pairs.append(tuple(np.array(found).T + s))
    a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    e = np.unique(np.sort(np.stack((node[a], node[b]), axis=1), axis=1), axis=0)
    e = e[e[:, 0] != e[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["src", "dst"])


def near_links(nodes: DataFrame, names: list[str], most: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(src, dst): a forest of links in each bucket; names are the columns of nodes: the fingerprints, "node" first
    where the fingerprint isn't the node itself."""
    counts = _keyed(nodes, names, True).groupBy("key").agg(F.count("*").alias("n"))
    heavy = stash(counts.where(F.col("n") > 2 * block_rows).select("key", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")), "heavy")
    keyed = _keyed(nodes, names, False)
    zero = F.lit(0)
    if heavy.isEmpty():
        dealt = keyed.withColumns({"i": zero, "j": zero})
    else:
        mine = F.pmod(F.xxhash64(names[0]), F.col("blocks").cast("long")).cast("int")
        dealt = keyed.join(heavy, "key", "left").withColumn("mine", mine).withColumn("other", F.explode(F.coalesce(F.sequence(zero, F.col("blocks") - 1), F.array(zero))))
        dealt = dealt.withColumns({"i": F.coalesce(F.least("mine", "other"), zero), "j": F.coalesce(F.greatest("mine", "other"), zero)}).drop("mine", "other", "blocks")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < GATHERED:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            # the last run may go on
            k, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
            end = int(np.flatnonzero((k != k[-1]) | (i != i[-1]) | (j != j[-1])).max(initial=-1)) + 1
            if end:
                yield _links(table.slice(0, end), names, most)
            held, rows = table.slice(end).to_batches(), table.num_rows - end
        if rows:
            yield _links(pa.Table.from_batches(held).combine_chunks(), names, most)

    return dealt.mapInArrow(run, "src long, dst long").distinct()


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each document: fingerprints at max_bits (4 or fewer) are linked."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the keys meet at up to {MAX_BITS} differing bits")
    prints = stash(fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], "text", shingle), "prints")
    nodes = stash(prints.groupBy("f0").agg(F.min("doc_id").alias("first")), "nodes")
    members = connected_components(near_links(nodes, ["f0"], max_bits)).withColumnRenamed("node", "f0")
    members = stash(members.join(nodes, "f0"), "members")
    least = stash(members.groupBy("component").agg(F.min("first").alias("least")), "least")
    linked = members.join(least, "component").select("f0", "least")
    labels = stash(nodes.join(linked, "f0", "left").select("f0", F.coalesce("least", "first").alias("component_id")), "labels")
    return prints.join(labels, "f0").select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


#: Settings of near_dedup(): words of a shingle, and the least Jaccard similarity of near copies.
DEDUP_SHINGLE, DEDUP_SIMILARITY = 5, 0.8
#: Bits in which fingerprints that meet under a key may differ to be looked at on their shingles.
CANDIDATE_BITS = 12
#: Longs of a parity bitmap; by how much a round of candidates is larger than the one before.
BITMAP, STEP = 16, 16


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = DEDUP_SHINGLE, similarity: float = DEDUP_SIMILARITY) -> DataFrame:
    """One document of each group of exact and near copies, in its own columns: that with the smallest id.

    Equal texts are one node. Near copies are nodes whose sets of shingles have a Jaccard similarity of at least
    `similarity`: any two such nodes are connected by verified pairs (near_groups()). Texts without words are copies of
    one another only if equal. Of rows that are the same in id and text any one stays.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.withColumns({"__h": F.xxhash64(text), "__c": F.hash(text), "__null": F.col(id_col).isNull(), "__id": F.col(id_col)})
    rows = stash(marked.select("__h", "__c", "__null", "__id"), "rows")
    texts = rows.groupBy("__h", "__c").agg(F.min(F.struct("__null", "__id")).alias("first"))
    texts = stash(texts.select("__h", "__c", F.col("first.__null").alias("__null"), F.col("first.__id").alias("__id")), "texts")
    near = near_groups(marked.select("__h", text_col), shingle, similarity)
    members = stash(near.withColumnRenamed("node", "__h").join(texts, "__h"), "members")
    first = stash(members.groupBy("component").agg(F.min(F.struct("__null", "__id", "__h", "__c")).alias("first")), "first")
    dropped = members.join(first, "component").where(F.struct("__null", "__id", "__h", "__c") != F.col("first")).select("__h", "__c", F.lit(True).alias("drop"))
    kept = stash(texts.join(dropped, ["__h", "__c"], "left").where("drop IS NULL").select("__h", "__c", "__null", "__id"), "kept")
    keys = ["__h", "__c", "__null", "__id"]
    copies = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    gone = stash(copies.join(kept, _same(copies, kept), "left_anti"), "gone")
    out = marked.join(small(gone), _same(marked, gone), "left_anti")
    twice = stash(copies.where("n > 1").select(*keys), "twice")
    if not twice.isEmpty():
        # only the repeated rows are dealt by their keys
        again = marked.join(small(twice), _same(marked, twice), "left_semi").join(small(gone), _same(marked, gone), "left_anti").dropDuplicates(keys)
        out = out.join(small(twice), _same(marked, twice), "left_anti").unionByName(again)
    return out.select(*docs.columns)


def _same(a: DataFrame, b: DataFrame):  # noqa: ANN202
    return (a["__h"] == b["__h"]) & (a["__c"] == b["__c"]) & (a["__null"] == b["__null"]) & a["__id"].eqNullSafe(b["__id"])


def _sketches(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """docs: (key, text). (node, n, f0, parity binary, wide binary, prefix array<long>) of each text with words: the number of
    distinct shingles, the fingerprint, the parity of the number of shingles at each of 64 * BITMAP places (for sets larger
    than that followed by the numbers themselves, and again at twice as many places as shingles), and so many of the least
    hashes that two sets of the similarity have one in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_A_TIME):
                part = batch.slice(at, AT_A_TIME)
                sizes, prints, maps, wide, prefixes = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    h = shingle_hashes(text, shingle)
                    s = np.unique(h)
                    n = len(s)
                    sizes.append(n)
                    prints.append(_majority(h))
                    prefixes.append(s[: n - int(np.ceil(similarity * n - 1e-6)) + 1].view(np.int64))
                    maps.append(parity(s, 64 * BITMAP) + (counts(s, 64 * BITMAP) if n > 64 * BITMAP else b""))
                    wide.append(parity(s, 1 << (2 * n - 1).bit_length()) if n > 64 * BITMAP else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(maps, pa.binary()), pa.array(wide, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], ["node", "n", "f0", "parity", "wide", "prefix"])

    return few_rows(docs).mapInArrow(run, "node long, n int, f0 long, parity binary, wide binary, prefix array<bigint>").where("n > 0").dropDuplicates(["node"])


def parity(s: np.ndarray, places: int) -> bytes:
    """Whether an odd number of hashes falls on each of so many places, a power of two."""
    odd = np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def counts(s: np.ndarray, places: int) -> bytes:
    """How many hashes fall on each of so many places, modulo 16; two places a byte."""
    n = np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places).astype(np.uint8) & 15
    return (n[::2] | n[1::2] << 4).tobytes()


def _counts_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows of counts modulo 16, the least number of hashes in which the sets can differ."""
    total = np.zeros(len(x), np.int64)
    for shift in (0, 4):
        d = ((x >> shift) - (y >> shift)) & 15
        total += np.minimum(d, 16 - d).sum(1, dtype=np.int64)
    return total


def possible(n: int, a: bytes | None, m: int, b: bytes | None, similarity: float) -> bool:
    """Whether sets of n and m hashes with these parities may have the similarity: parities differ in no more places than
    the sets differ in hashes. Of unequal bitmaps the larger is folded."""
    if a is None or b is None:
        return True
    x, y = (np.frombuffer(z, np.uint64) for z in (a, b))
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) * (1 + similarity) <= (n + m) * (1 - similarity) + 1e-6


def _possible(edges: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The edges that the wide bitmaps of long texts don't rule out. So long texts meet only where they may be copies."""
    wide = sketches.where("wide IS NOT NULL")
    side = lambda end: wide.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("wide").alias(f"wide_{end}"))
    both = edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left").select("src", "dst", "n_src", "wide_src", "n_dst", "wide_dst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_A_TIME):
                part = batch.slice(at, AT_A_TIME)
                keep = [possible(n, a, m, b, similarity) for n, a, m, b in zip(*(part.column(i).to_pylist() for i in range(2, 6)), strict=True)]
                yield pa.RecordBatch.from_arrays(part.columns[:2], ["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return stash(few_rows(both).mapInArrow(run, "src long, dst long"), "possible")


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets of hashes have the Jaccard similarity."""
    least, most = sorted((len(a), len(b)))
    if least < similarity * most:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common)


def _verified(edges: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The edges (src, dst) whose texts have the similarity; docs: (key, text). Each edge meets its two texts."""
    key, text = docs.columns
    ends = stash(edges.select(F.col("src").alias(key)).unionByName(edges.select(F.col("dst").alias(key))).distinct(), "ends")
    texts = stash(docs.join(small(ends), key, "left_semi").dropDuplicates([key]), "texts")
    both = edges.join(texts.select(F.col(key).alias("src"), F.col(text).alias("a")), "src").join(texts.select(F.col(key).alias("dst"), F.col(text).alias("b")), "dst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_A_TIME):
                part = batch.slice(at, AT_A_TIME)
                keep = []
                for b, x, y in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if b != last:
                        last, held = b, np.unique(shingle_hashes(y, shingle))
                    keep.append(similar(np.unique(shingle_hashes(x, shingle)), held, similarity))
                yield pa.RecordBatch.from_arrays(part.columns[:2], ["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return stash(few_rows(both).select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long"), "verified")


def _proposals(table: pa.Table, low: int, high: int, similarity: float) -> pa.RecordBatch:
    """Of complete groups, for each row the rows after it that may be near copies: those in places low to high by distance,
    without those of its own component. (src, dst, more): more names, as src, a key that has candidates beyond."""
    node, size, comp, key = (table.column(c).to_numpy().astype(np.int64) for c in ("node", "n", "comp", "key"))
    maps = table.column("parity").to_pylist()
    f = np.frombuffer(b"".join(m[: 8 * BITMAP] for m in maps), np.uint64).reshape(-1, BITMAP)
    # bitmaps of large sets are full, so these have counts, too
    large = np.array([len(m) > 8 * BITMAP for m in maps], bool)
    numbers = np.frombuffer(b"".join(m[8 * BITMAP :] for m in maps), np.uint8).reshape(-1, 32 * BITMAP)
    at_number = np.cumsum(large) - 1
    del maps
    group = np.stack([key, *(table.column(c).to_numpy().astype(np.int64) for c in ("i", "j"))], axis=1)
    new = np.concatenate(([True], (group[1:] != group[:-1]).any(1)))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate((starts, [len(node)])))
    run = np.cumsum(new) - 1

    def candidates(a: np.ndarray | int, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # no more shingles than these can differ; bitmaps, sizes and counts differ in no more than the shingles do
        d = np.maximum(np.bitwise_count(f[a] ^ f[b]).sum(-1, dtype=np.int64), np.abs(size[a] - size[b]))
        most = (size[a] + size[b]) * (1 - similarity) + 1e-6
        both = np.flatnonzero((d * (1 + similarity) <= most) & large[a] & large[b])
        for x in range(0, len(both), AT_A_TIME):
            which = both[x : x + AT_A_TIME]
            left, right = np.broadcast_to(at_number[a], b.shape)[which], at_number[b[which]]
            d[which] = np.maximum(d[which], _counts_apart(numbers[left], numbers[right]))
        return d, d * (1 + similarity) <= most

    pairs: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    more: list[np.ndarray] = [np.zeros(0, np.int64)]
    few = np.flatnonzero(sizes[run] <= TOGETHER)
    last = starts[run] + sizes[run]
    hits = [np.zeros((0, 3), np.int64)]
    for step in range(1, int(sizes[run[few]].max()) if len(few) else 0):
        a = few[few + step < last[few]]
        d, ok = candidates(a, a + step)
        hits.append(np.stack((a[ok], d[ok], a[ok] + step), axis=1))
    hits = np.concatenate(hits)
    hits = hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))]
    place = np.arange(len(hits)) - np.searchsorted(hits[:, 0], hits[:, 0])
    apart = comp[hits[:, 0]] != comp[hits[:, 2]]
    pairs.append(hits[(place >= low) & (place < high) & apart][:, [0, 2]])
    more.append(key[hits[(place >= high) & apart, 0]])
    for s, n in zip(starts[sizes > TOGETHER].tolist(), sizes[sizes > TOGETHER].tolist(), strict=True):
        if (comp[s : s + n] == comp[s]).all():
            continue
        for a in range(s, s + n - 1):
            d, ok = candidates(a, np.arange(a + 1, s + n))
            at = np.flatnonzero(ok)
            if len(at) <= low:
                continue
            at = at[np.argsort(d[at], kind="stable")] + a + 1
            b = at[low:high][comp[at[low:high]] != comp[a]]
            pairs.append(np.stack((np.full(len(b), a), b), axis=1))
            if (comp[at[high:]] != comp[a]).any():
                more.append(key[a : a + 1])
    p = np.concatenate(pairs)
    e = np.unique(np.sort(node[p], axis=1), axis=0)
    m = np.unique(np.concatenate(more))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate((e[:, 0], m))), pa.array(np.concatenate((e[:, 1], m))), pa.array(np.arange(len(e) + len(m)) >= len(e))], ["src", "dst", "more"])


def close_pairs(docs: DataFrame, shingle: int = DEDUP_SHINGLE, similarity: float = DEDUP_SIMILARITY, block_rows: int = BLOCK_ROWS, sketches: DataFrame | None = None) -> DataFrame:
    """docs: (key, text). (src, dst): pairs of keys of the similarity whose fingerprints meet under a key of the fuzzy hash,
    as a forest in each bucket: sure for few differing bits, likely for more. near_groups() misses none."""
    if sketches is None:
        sketches = stash(fingerprints(docs, docs.columns[:1], docs.columns[1], shingle).withColumnRenamed(docs.columns[0], "node").where("f0 <> 0").dropDuplicates(["node"]), "prints")
    forest = stash(near_links(sketches, ["node", "f0"], CANDIDATE_BITS, block_rows), "forest")
    return _verified(forest, docs, shingle, similarity)


def near_groups(docs: DataFrame, shingle: int = DEDUP_SHINGLE, similarity: float = DEDUP_SIMILARITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs: (key, text). (node, component): the groups of keys that pairs of the similarity connect.

    First the fuzzy hashes: fingerprints that meet under a key give a forest of candidates, and those that hold on their
    shingles connect most copies. Golay keys vouch for a few differing bits only, and the similarity allows for more; so
    the pairs that they miss are found by the shingles themselves. Sets of the similarity share one of their least
    hashes, so they meet under it; keys of very many are dealt into blocks, and each pair of blocks meets. Candidates,
    those that parity bitmaps, counts and sizes cannot rule out and that are not connected yet, are taken in rounds: each row's
    nearest, then STEP times as many of the next, and so on. So no candidate is left out.
    """
    sketches = stash(_sketches(docs, shingle, similarity), "sketches")
    comps = stash(connected_components(close_pairs(docs, shingle, similarity, block_rows, sketches)), "comps")
    posted = sketches.select(F.explode("prefix").alias("key"), "node")
    blocks = F.when(F.col("count") > 2 * block_rows, F.ceil(F.col("count") / block_rows)).otherwise(1).cast("int")
    shared = stash(posted.groupBy("key").count().where("count > 1").select("key", blocks.alias("blocks")), "shared")
    met = stash(posted.join(small(shared), "key"), "met")
    # keys all of whose rows are connected already have nothing to give
    now = met.select("key", "node").join(small(comps), "node", "left").select("key", F.coalesce("component", "node").alias("c"))
    open_ = stash(now.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("key"), "open")
    met = stash(met.join(small(open_), "key", "left_semi"), "met")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    low, high = 0, 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < GATHERED:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            # the last group may go on
            k, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
            end = int(np.flatnonzero((k != k[-1]) | (i != i[-1]) | (j != j[-1])).max(initial=-1)) + 1
            if end:
                yield _proposals(table.slice(0, end), *places, similarity)
            held, rows = table.slice(end).to_batches(), table.num_rows - end
        if rows:
            yield _proposals(pa.Table.from_batches(held).combine_chunks(), *places, similarity)

    while True:
        places = (low, high)
        known = sketches.select("node", "n", "parity").join(small(comps), "node", "left").select("node", "n", "parity", F.coalesce("component", "node").alias("comp"))
        dealt = met.join(known, "node").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "n", "parity", "comp")
        dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
        found = stash(dealt.mapInArrow(run, "src long, dst long, more boolean").distinct(), "candidates")
        edges = _possible(found.where(~F.col("more")).select("src", "dst"), sketches, similarity)
        new = None if edges.isEmpty() else _verified(edges, docs, shingle, similarity)
        if new is not None and not new.isEmpty():
            # what is connected already is a star
            comps = stash(connected_components(new.unionByName(comps.select(F.col("node").alias("src"), F.col("component").alias("dst")))), "comps")
        left = stash(found.where("more").select(F.col("src").alias("key")), "left")
        if left.isEmpty():
            return comps
        met = stash(met.join(small(left), "key", "left_semi"), "met")
        low, high = high, STEP * high + 1


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
