"""Concatenate-and-cut packing into fixed windows of tokens (operator 7).

Pass one tokenises every document once and keeps, with its ids, how many tokens stand before it in its own partition;
the table is written to the shared folder, so its partitions stay as they are. The totals of the partitions, summed in
the order of their numbers, give each partition's place in the whole stream. Pass two cuts every document where a
window of the stream ends: no shuffle, and a task holds one batch of documents.

Defined cases: a null text is empty and still has its end id; a null doc_id is kept; repeated rows are documents of
their own; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.batches import Known, few_rows, texts_of
from ledgerloom.plans.stash import stash

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
WINDOW = 2048
#: Entries of the young half of a worker's table of known chunks, and of words. No effect on results.
YOUNG = 200_000

# Strings that the plain way below doesn't treat as the tokenizer does; texts that hold them go to the tokenizer whole.
_ODD = ("<|startoftext|>", "<|endoftext|>", "\x1c", "\x1d", "\x1e", "\x1f", "\x85")
# The vocabulary's own pattern for words, as its file states it.
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit numbers; the same ids as the tokenizer's own encode().

    The vocabulary's words never cross white space, so the ids of a text are those of its chunks between white space,
    in order. Each distinct chunk is put through the tokenizer's model once and then looked up.
    """

    def __init__(self, path: str, young: int = YOUNG) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.word, self.letters = self.whole.model, regex.compile(_WORD), _byte_letters()
        self.chunks, self.words = Known(self._of_chunk, young), Known(self._of_word, young // 4)

    def _of_word(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _of_chunk(self, chunk: str) -> bytes:
        # letters alone are one word, and known as a chunk
        return self._of_word(chunk) if chunk.isascii() and chunk.isalpha() else b"".join([self.words[w] for w in self.word.findall(chunk)])

    def encode(self, text: str) -> bytes:
        if any(odd in text for odd in _ODD):
            return b"".join([i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids])
        # lower() knows a final sigma, the tokenizer doesn't
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return b"".join(map(self.chunks.__getitem__, text.split()))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, young: int = YOUNG) -> Encoder:
    """One for each Python worker."""
    if (path, young) not in _ENCODERS:
        _ENCODERS[path, young] = Encoder(path, young)
    return _ENCODERS[path, young]


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, young: int = YOUNG, keep: bool = True) -> DataFrame:
    """(part, before, doc_id, doc_tokens, ids): the ids of each document and its end, and its place in its partition.
    keep: whether a worker keeps its encoder for its next partition, or makes another one."""
    own = few_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, enc = TaskContext.get().partitionId(), 0, encoder(path, young)
        for batch in batches:
            ids = [enc.encode(t) + end for t in texts_of(batch.column(1))]
            sizes, before = [len(x) // 4 for x in ids], []
            for n in sizes:
                before.append(at)
                at += n
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], ["part", "before", "doc_id", "doc_tokens", "ids"])
        if not keep:
            _ENCODERS.pop((path, young), None)

    return own.mapInArrow(run, "part int, before long, doc_id long, doc_tokens long, ids binary")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, young: int = YOUNG, keep: bool = True) -> DataFrame:
    """The pieces of all documents: (doc_id, start, length, doc_tokens, sequence_id, offset, ids binary).

    The sequences are full but for the last; within one, offsets are gapless from 0. ids are little-endian unsigned
    32-bit numbers.
    """
    tokens = stash(tokenised(docs, path, id_col, text_col, end_id, young, keep), "tokens")
    # a row for each partition of the scan: as many as it had tasks, whatever the rows
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    base = totals.select("part", F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(base), "part").select("doc_id", "doc_tokens", "ids", (F.col("base") + F.col("before")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, total, ids, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = 0
                while start < total:
                    seq, offset = divmod(at + start, window)
                    length = min(total - start, window - offset)
                    for column, value in zip(out, (doc, start, length, total, seq, offset, ids[4 * start : 4 * (start + length)]), strict=True):
                        column.append(value)
                    start += length
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:6]), pa.array(out[6], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids binary padded to the window, bounds): the training rows, with where each document's piece
    lies. A group has at most one piece a token, so it is bounded by the window."""
    made = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    pad = F.lit(pad_id.to_bytes(4, "little") * window)
    return made.select("sequence_id", F.substring(F.concat(ids, pad), 1, 4 * window).alias("ids"), F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["length"].alias("length"), x["doc_id"].alias("doc_id"), x["start"].alias("start"))).alias("bounds"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(pack(docs, vocabulary_path()))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
