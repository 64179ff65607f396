import random
import struct
import zlib

import pytest

from ledgerloom.llm import packing as P

pytest.importorskip("public_tokenizers")


def sample():
    rnd = random.Random(3)
    pieces = ["The quick", "brown", "DON'T", "it's", "naïve", "ΟΔΟΣ", "漢字仮名", "😀!!", "x²", "é", " ", " ", "\x1c", "\x85", "<|endoftext|>", "--", "3.14", "\n\n", "\t", "İ", "ﬁ", "don’t", "​", "a" * 60]
    return [(i, rnd.choice(["", " "]).join(rnd.choice(pieces) for _ in range(rnd.randrange(80)))) for i in range(200)] + [(900, None), (901, ""), (None, "no id"), (5, "twice"), (5, "twice"), (902, "word " * 9000)]


def ids(text):
    from tokenizers import Tokenizer

    global _TOKENIZER
    _TOKENIZER = globals().get("_TOKENIZER") or Tokenizer.from_file(P.vocabulary_path())
    return [*_TOKENIZER.encode(text or "", add_special_tokens=False).ids, P.END_ID]


def test_ids_are_the_tokenizers(spark):
    enc = P.encoder(P.vocabulary_path())
    for _, text in sample():
        assert enc.encode(text or "") == struct.pack(f"<{len(ids(text)) - 1}I", *ids(text)[:-1])


def test_a_small_table_gives_the_same_ids():
    enc = P.Encoder(P.vocabulary_path(), 100)
    for _, text in sample():
        assert enc.encode(text or "") == struct.pack(f"<{len(ids(text)) - 1}I", *ids(text)[:-1])
        assert max(len(enc.chunks), len(enc.chunks.old)) <= 100 and max(len(enc.words), len(enc.words.old)) <= 25


def test_what_is_in_use_stays_known():
    made = []
    known = P.Known(lambda k: made.append(k) or k.encode(), 10)
    for i in range(1000):
        assert known["often"] == b"often" and known[str(i)] == str(i).encode()
    assert made.count("often") == 1


def test_pieces(spark, tmp_path):
    rows = sample()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(5)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = P.op7_packing(spark, str(tmp_path)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        if i == 5:
            continue
        want, at = ids(text), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(want))
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *want[at : at + r.length]))
            at += r.length
        assert at == len(want)
    total = sum(len(ids(t)) for _, t in rows)
    assert sum(r.length for r in got) == total
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    full, rest = divmod(total, P.WINDOW)
    assert sorted(filled.values(), reverse=True) == [P.WINDOW] * full + [rest] * bool(rest)


def test_sequences(spark):
    rows = [(1, "one two three"), (2, "four"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    pieces = P.pack(df, P.vocabulary_path(), window=4)
    stream = [x for r in sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset)) for x in struct.unpack(f"<{r.length}I", r.ids)]
    assert sorted(stream) == sorted(x for _, t in rows for x in ids(t))
    made = P.sequences(pieces, 4, 0).orderBy("sequence_id").collect()
    assert all(len(r.ids) == 16 for r in made)
    assert [x for r in made for x in struct.unpack("<4I", r.ids)] == stream + [0] * (-len(stream) % 4)


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), P.vocabulary_path()).count() == 0
