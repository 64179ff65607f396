"""Benchmark decontamination by word windows (operator 2).

Every window of an item's normalised words is known by a hash; the hashes of a bounded block of items go to the
workers as a broadcast set, and each document's windows are looked up in one scan of its words, without a shuffle.
Every hit is verified word by word. Where the items have more windows than one set may hold, they are dealt into more
blocks and the documents scanned once for each; the hits are then joined by row, so no item is left out.

Defined cases: a null or empty text has no words and no hits; an item without words is in no document; an item of
fewer words than a window is one window; items may repeat one another; a null item_id counts as the empty string;
rows with a null doc_id are kept; an empty benchmark leaves everything clean; other columns pass through decontaminate().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.batches import few_rows, texts_of
from ledgerloom.plans.stash import stash

WINDOW = 10
#: Windows of items in one broadcast set.
SET_WINDOWS = 1_000_000

# Word characters: digits, letters a-z after lower-casing A-Z, and whatever is not ASCII.
_BLANKED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_JAVA_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_BLANKED).split()


class WindowSet:
    """The windows of some items, looked up in all windows of a text at once. A window is a hash and a place among the
    items' words, where hits are verified."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        parts, found, at = [], {}, 0
        for name, words in items:
            if not words:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)
            n = min(size, len(ids))
            h = self._hash(ids, np.arange(len(ids) - n + 1), n)
            found.setdefault(n, []).append((h, np.full(len(h), len(self.names), np.uint32), np.arange(at, at + len(h), dtype=np.int64)))
            self.names.append(name)
            parts.append(ids.astype(np.uint32))
            at += len(ids)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        #: By the number of words: the windows' hashes in order, their items and places.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, w in found.items():
            h, item, place = (np.concatenate(x) for x in zip(*w, strict=True))
            order = np.argsort(h, kind="stable")
            self.windows[n] = h[order], item[order], place[order]

    @staticmethod
    def _hash(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(starts), np.uint64)
        for k in range(n):
            h = h * np.uint64(_MULTIPLIER) + ids[starts + k]
        return h

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window; the items that have one."""
        hit, found = np.zeros(len(words), bool), set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        for n, (table, item, place) in self.windows.items():
            if len(ids) < n:
                continue
            # only windows all of whose words are some item's
            seen = np.concatenate(([0], np.cumsum(ids > 0)))
            starts = np.flatnonzero(seen[n:] - seen[:-n] == n)
            if not len(starts):
                continue
            h = self._hash(ids, starts, n)
            first, last = np.searchsorted(table, h), np.searchsorted(table, h, "right")
            for s, a, b in zip(*(x[first < last].tolist() for x in (starts, first, last)), strict=True):
                own = ids[s : s + n]
                for i in range(a, b):
                    p = place[i]
                    if (self.words[p : p + n] == own).all():
                        hit[s : s + n] = True
                        found.add(self.names[item[i]])
        return hit, found


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, most: int) -> list[DataFrame]:
    """The items, dealt by hash into so many blocks that each has `most` windows on average. An item is never split."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_words = F.regexp_count("text", F.lit(_JAVA_WORD))
    total = items.agg(F.sum(F.greatest(n_words - (size - 1), F.least(n_words, F.lit(1))))).first()[0] or 0
    n = -(-total // most) or 1
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items for i in range(n)]


def _scan(docs: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """docs: (row_key, text). A row for each document: its words, hit positions as runs, and items found."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(WindowSet([(r.item_id, words_of(r.text)) for r in sets.collect()], size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = known.value
        for batch in batches:
            counts, runs, items = [], [], []
            for text in texts_of(batch.column(1)):
                words = words_of(text)
                hit, found = windows.hits(words)
                counts.append(len(words))
                edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))) if found else ()
                runs.append([int(x) for x in edges])
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["row_key", "n_words", "runs", "items"])

    kind = docs.schema["row_key"].dataType.simpleString()
    return few_rows(docs).mapInArrow(run, f"row_key {kind}, n_words long, runs array<bigint>, items array<string>")


def _union(runs: Iterable[Iterable[int]]) -> list[tuple[int, int]]:
    """The union of [start, end) runs, given as flat lists, in order and apart."""
    spans: list[tuple[int, int]] = []
    for a, b in sorted((int(r[i]), int(r[i + 1])) for r in runs for i in range(0, len(r), 2)):
        if spans and a <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(spans[-1][1], b)
        else:
            spans.append((a, b))
    return spans


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, most: int = SET_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items array<string>, runs array<array<bigint>>), a row for each document."""
    blocks = _blocks(benchmark, item_col, item_text_col, size, most)
    if len(blocks) == 1:
        own = docs.select(F.col(id_col).alias("row_key"), F.col(text_col).alias("text"))
        found = _scan(own, blocks[0], size).withColumn("runs", F.array("runs")).withColumnRenamed("row_key", "doc_id")
    else:
        # equal rows have equal hits, so they may share a key
        key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("c"))
        own = docs.select(key.alias("row_key"), F.col(text_col).alias("text"))
        rows = own.groupBy("row_key").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
        parts = [_scan(rows.select("row_key", "text"), b, size) for b in blocks]
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p)
        found = union.groupBy("row_key").agg(F.max("n_words").alias("n_words"), F.collect_list("runs").alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = found.join(rows.select("row_key", "copies"), "row_key").withColumn("row_key", F.explode(F.expr("array_repeat(row_key.id, int(copies))"))).withColumnRenamed("row_key", "doc_id")
    if len(blocks) == 1:
        bounds = F.col("runs")[0]
        hit = F.aggregate(F.sequence(F.lit(0), F.size(bounds) - 1), F.lit(0).cast("long"), lambda acc, i: acc + F.when(i % 2 == 0, -F.get(bounds, i)).otherwise(F.get(bounds, i)))
        hit = F.when(F.size(bounds) > 0, hit).otherwise(F.lit(0).cast("long"))
    else:
        hit = F.pandas_udf(lambda s: s.map(lambda runs: sum(b - a for a, b in _union(runs))), "long")("runs")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "runs")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "spans", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, most: int = SET_WINDOWS) -> DataFrame:
    """The documents without benchmark text, in their own columns.

    mode "spans": the words of every occurrence, and what stands between them, are cut out of the text; a text without
    hits stays as it is, byte for byte. mode "documents": documents with a hit go. Of several blocks of items, the hits on
    the same text are united before it is cut. What a cut joins up may be a hit again, so cut texts are looked at anew
    until none is found.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, size, most)
    if len(blocks) > 1:
        return _by_blocks(docs, blocks, mode, text_col, size)
    for block in blocks:
        known = docs.sparkSession.sparkContext.broadcast(WindowSet([(r.item_id, words_of(r.text)) for r in block.collect()], size))

        def cleaned(text: str | None, known=known) -> str | None:
            return _cut(text, known.value, mode)

        docs = few_rows(docs)
        # two columns, so that a null text differs from a document that goes
        apply = F.pandas_udf(lambda s, f=cleaned: s.map(f), "string")
        done = apply(F.coalesce(F.col(text_col), F.lit("")))
        if mode == "documents":
            docs = docs.where(done.isNotNull())
        else:
            docs = docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), done))
    return docs


_SPAN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _cut(text: str | None, known: WindowSet, mode: str) -> str | None:
    while True:
        words = words_of(text)
        hit, found = known.hits(words)
        if not found:
            return text
        if mode == "documents":
            return None
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()
        text = _without(text, list(zip(edges[::2], edges[1::2], strict=True)))


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of these [start, end) runs, which are apart and in order, and what is between them."""
    raw = text.encode()
    places = [m.span() for m in _SPAN.finditer(raw.lower())]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"\n".join([*out, raw[at:]]).decode()


def _by_blocks(docs: DataFrame, blocks: list[DataFrame], mode: str, text_col: str, size: int) -> DataFrame:
    """decontaminate() by several blocks of items. Equal texts are looked at once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.xxhash64(text).alias("h"), F.crc32(text).alias("c"))
    now = docs.select(key.alias("row_key"), text.alias("text")).dropDuplicates(["row_key"])
    cut, done = F.pandas_udf(lambda texts, runs: pd.Series([_without(t, _union(r)) for t, r in zip(texts, runs, strict=True)], dtype=object), "string"), None
    while True:
        union = None
        for b in blocks:
            part = _scan(now, b, size).where(F.size("runs") > 0).select("row_key", "runs")
            union = part if union is None else union.unionByName(part)
        hits = stash(union.groupBy("row_key").agg(F.collect_list("runs").alias("runs")), "hits")
        if mode == "documents":
            return docs.withColumn("__key", key).join(hits.select(F.col("row_key").alias("__key")), "__key", "left_anti").select(*docs.columns)
        if done is not None:
            clean = now.join(hits, "row_key", "left_anti")
            done = clean if done is False else done.unionByName(clean)
        if hits.isEmpty():
            break
        now = stash(now.join(hits, "row_key").select("row_key", cut("text", "runs").alias("text")), "cut")
        done = False if done is None else done
    if not done:
        return docs
    cleaned = stash(done.select(F.col("row_key").alias("__key"), F.col("text").alias("__cut")), "cleaned")
    out = docs.withColumn("__key", key).join(cleaned, "__key", "left")
    return out.withColumn(text_col, F.coalesce("__cut", F.col(text_col))).select(*docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
lengths AS (SELECT DISTINCT least(10, len(w)) AS n FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
o AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d JOIN lengths ON len(w) >= n)),
h AS (SELECT o.r, o.s, o.n, g.item_id FROM o JOIN g USING (n, g)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM h)) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
