"""Substring dedup by sliding sentence spans (operator 10).

A text is read as units: sentences (up to a ., ! or ? before white space, or a line's end), long ones cut into chunks
of a bounded number of words, where the words themselves say so; so a passage inside a long sentence is cut alike
wherever it stands, but for some words at its ends. From every unit forwards, and to every unit backwards, the shortest
run of several units with enough words is hashed; so a repeated passage of twice that many words is covered from its
first to its last unit, wherever it stands. The hashes (96 bits of the words in lower case) of all documents meet; the
first occurrence of each (smallest document, then place) stays, and the units of every other are removed. What is left
of a text stays as it was, byte for byte.

Texts are read some hundred at a time: their words are hashed once each, and borders, runs and their hashes are array
operations over all of them.

Defined cases: a null text has no units and stays null; a text with too few units or words has no spans and stays; a
null doc_id sorts last; rows equal in id and text are one document, and each is returned; an empty table gives no
rows; other columns are kept by remove_repeats().
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.batches import AT_A_TIME, Known, few_rows
from ledgerloom.plans.stash import stash

#: Units of a span and its words, at the least; words of a unit, at the most.
UNITS, WORDS, UNIT_WORDS = 3, 24, 12

_TOKEN = re.compile(r"\S+")
#: Rows of windows that are looked at together.
_WINDOWS = 100_000
# An odd number for each of the two hashes of a run: words are digits to this base.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def word_hash(word: str) -> int:
    """A hash of a word in lower case; the last bit says whether a sentence may end with it."""
    return (xxhash.xxh64_intdigest(word) & ~1) | word.endswith((".", "!", "?"))


#: A worker's table of words.
_WORDS = Known(word_hash, 200_000)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    z = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def cut_up(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts, one after the other: the hash of each word, the words at which units start (and the number of
    words), and the number of units before each text (and of all).

    A sentence of more than UNIT_WORDS words is cut at the least hash of two neighbouring words (the last of equals) in
    every window of UNIT_WORDS. So no chunk is longer, and only words within a window's reach matter.
    """
    get, words, lines, docs = _WORDS.__getitem__, [], [0], [0]
    for text in texts:
        if text:
            for line in text.lower().split("\n"):
                words += map(get, line.split())
                lines.append(len(words))
        docs.append(len(words))
    h = np.array(words, np.uint64)
    n = len(h)
    new = np.zeros(n + 1, bool)
    new[lines] = new[docs] = True
    new[1:][(h & np.uint64(1)).astype(bool)] = True
    if n > UNIT_WORDS:
        sentence = np.cumsum(new[:n]) - 1
        long = np.bincount(sentence)[sentence] > UNIT_WORDS
        rows = np.flatnonzero(long[: n - UNIT_WORDS + 1] & (sentence[: n - UNIT_WORDS + 1] == sentence[UNIT_WORDS - 1 :]))
        after = np.where(new[1:], np.uint64(0), np.append(h[1:], np.uint64(0)))
        windows = np.lib.stride_tricks.sliding_window_view(_mixed(h * np.uint64(3) + after), UNIT_WORDS)[:, ::-1]
        for at in range(0, len(rows), _WINDOWS):
            part = rows[at : at + _WINDOWS]
            new[part + UNIT_WORDS - 1 - windows[part].argmin(1)] = True
    starts = np.flatnonzero(new[:n])
    return h, np.append(starts, n), np.searchsorted(starts, docs)


def runs(bounds: np.ndarray, docs: np.ndarray, least_units: int = UNITS, least_words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the shortest runs from and to each unit, within its text."""
    n = len(bounds) - 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    unit = np.arange(n)
    doc = np.searchsorted(docs, unit, "right") - 1
    ahead = np.maximum(unit + least_units, np.searchsorted(bounds, bounds[:-1] + least_words))
    back = np.minimum(unit + 1 - least_units, np.searchsorted(bounds, bounds[1:] - least_words, "right") - 1)
    fits, holds = ahead <= docs[doc + 1], back >= docs[doc]
    found = np.unique(np.concatenate((unit[fits] * (n + 1) + ahead[fits], back[holds] * (n + 1) + unit[holds] + 1)))
    return found // (n + 1), found % (n + 1)


def hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A long and an int for each run [start, end) of words."""
    out = []
    for i, base in enumerate(_BASES):
        powers = np.cumprod(np.append(np.uint64(1), np.full(len(h), base, np.uint64)), dtype=np.uint64)
        back = np.cumprod(np.append(np.uint64(1), np.full(len(h), pow(base, -1, 1 << 64), np.uint64)), dtype=np.uint64)
        sums = np.append(np.uint64(0), np.cumsum(_mixed(h + np.uint64(i)) * powers[:-1], dtype=np.uint64))
        out.append(_mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64)))
    return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def spans(texts: Sequence[str | None]) -> tuple[np.ndarray, ...]:
    """(text, h, c, start, end) of every span: its text's number, its hashes, and its units within the text."""
    h, bounds, docs = cut_up(texts)
    start, end = runs(bounds, docs)
    doc = np.searchsorted(docs, start, "right") - 1
    first, second = hashes(h, bounds[start], bounds[end])
    return doc.astype(np.int32), first, second, (start - docs[doc]).astype(np.int32), (end - docs[doc]).astype(np.int32)


def units(text: str | None) -> list[list[str]]:
    """The words of each unit of a text."""
    words = (text or "").split()
    bounds = cut_up([text])[1].tolist()
    return [words[a:b] for a, b in zip(bounds, bounds[1:])]  # noqa: B905


def places(text: str) -> list[tuple[int, int]]:
    """Where each unit starts, and where the next does."""
    at = [m.start() for m in _TOKEN.finditer(text)]
    out = [at[w] for w in cut_up([text])[1][:-1].tolist()]
    return list(zip(out, [*out[1:], len(text)]))  # noqa: B905


def _spans_of(docs: DataFrame) -> DataFrame:
    """docs: (k, id, text). (h, c, k, id, s, e), a row a span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_A_TIME):
                part = batch.slice(at, AT_A_TIME)
                rows, h, c, s, e = spans(part.column(2).to_pylist())
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), part.column(0).take(rows), part.column(1).take(rows), pa.array(s), pa.array(e)], ["h", "c", "k", "id", "s", "e"])

    return few_rows(docs).mapInArrow(run, f"h long, c int, k long, id {docs.schema['id'].dataType.simpleString()}, s int, e int")


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, runs array<struct<s, e>>): the units to be removed from each document that has any; k names it."""
    own = docs.select(_key(id_col, text_col).alias("k"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # texts are read once for each use: stored, their spans would be larger than the texts
    found = _spans_of(own)
    here = F.struct(F.col("id").isNull().alias("none"), "id", "k", "s")
    often = found.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(here).alias("first")).where("n > 1")
    often = stash(often.select("h", "c", F.col("first.k").alias("fk"), F.col("first.s").alias("fs")), "repeated")
    more = found.select("h", "c", "k", "s", "e").join(often, ["h", "c"]).where((F.col("k") != F.col("fk")) | (F.col("s") != F.col("fs")))
    return more.select("k", "s", "e").groupBy("k").agg(F.collect_set(F.struct("s", "e")).alias("runs"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in their own columns, the text without repeated spans, and __removed: how many units went."""
    gone = stash(repeats(docs, id_col, text_col), "gone")
    joined = docs.withColumn("__k", _key(id_col, text_col)).join(gone.select(F.col("k").alias("__k"), F.col("runs").alias("__runs")), "__k", "left")
    kinds = [(f.name, f.dataType.simpleString()) for f in docs.schema.fields]
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for from_ in range(0, batch.num_rows, AT_A_TIME):
                part = batch.slice(from_, AT_A_TIME)
                texts, removed = part.column(place).to_pylist(), []
                for i, cut in enumerate(part.column(len(kinds)).to_pylist()):
                    drop = {u for r in cut or () for u in range(r["s"], r["e"])}
                    if drop:
                        at, text = places(texts[i]), texts[i]
                        texts[i] = text[: at[0][0]] + "".join(text[a:b] for u, (a, b) in enumerate(at) if u not in drop)
                    removed.append(len(drop))
                columns = list(part.columns[: len(kinds)])
                columns[place] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64())], [*(n for n, _ in kinds), "__removed"])

    return few_rows(joined.select(*docs.columns, "__runs")).mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in [*kinds, ("__removed", "long")]))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", F.col("__removed").alias("n_removed"), F.length("text").cast("long").alias("n_chars"), "text")
