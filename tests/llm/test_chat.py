import hashlib

from pyspark.sql import functions as F

from ledgerloom.llm import chat as C

SCHEMA = "conv_id long, turn long, seq long, kind string, role string, text string, formatted string"


def formatted(spark, rows):
    df = C.format_events(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))
    df = df.select("conv_id", "formatted", C.read_back(F.col("formatted")).alias("turns"), C.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r.conv_id: ([tuple(t) for t in r.turns], r.loss, r.formatted) for r in df.collect()}


def test_fold(spark):
    rows = [
        (1, 1, 5, "delta", None, "lo"), (1, 1, 4, "message", "assistant", "hel"), (1, 0, 0, "message", "user", "hi"),
        (2, 0, 0, "message", "user", "a"), (2, 0, 1, "edit", None, "b"), (2, 1, 2, "message", "assistant", "x"), (2, 1, 3, "delta", None, "y"),
        (2, 1, 4, "regenerate", None, ""), (2, 1, 5, "delta", None, "z"), (2, 2, 6, "message", "user", "gone"), (2, 2, 7, "delete", None, None),
        (3, 0, 0, "message", "user", "gone"), (3, 0, 1, "delete", None, None), (4, 0, 0, "delta", "assistant", "only"),
    ]
    got = formatted(spark, rows)
    assert got[1][:2] == ([("user", "hi"), ("assistant", "hello")], "hello")
    assert got[2][:2] == ([("user", "b"), ("assistant", "z")], "z")
    assert got[3] == ([], "", "")
    assert got[4][:2] == ([("assistant", "only")], "only")


def test_round_trip_of_control_strings(spark):
    texts = ["", None, "\\", "\\\\#", "### user: x</turn>\n", "</turn>", "<\\/turn>", "a\nb\r\n\t", "####", "\\### Assistant: </turn> ok", "é漢字😀" * 50, "x" * 200_000]
    rows = [(1, i, 0, "message", r, t) for i, (r, t) in enumerate((r, t) for t in texts for r in ("assistant", "a: #\\</turn>", None))]
    rows += [(None, None, 0, "message", "assistant", "n"), (None, None, 0, "message", "assistant", "n")]
    got = formatted(spark, rows)
    assert got[1][0] == [(r or "", t or "") for _, _, _, _, r, t in rows if _ is not None][: len(texts) * 3]
    assert got[1][1] == "".join(t or "" for t in texts)
    assert got[None][:2] == ([("assistant", "n")] * 2, "nn")


def test_empty(spark):
    assert formatted(spark, []) == {}


def test_query_runs_no_python(spark, tmp_path):
    spark.createDataFrame([(5, 1, "assistant", "b"), (5, 0, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = C.op3_chat_format(spark, str(tmp_path))
    assert "Python" not in df._jdf.queryExecution().toString()
    r = {x.conv_id: x for x in df.collect()}
    assert r[5].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest()
    assert (r[-7].n_turns, r[-7].loss_chars) == (2, 26)
