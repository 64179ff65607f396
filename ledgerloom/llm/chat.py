"""Chat formatting from event logs, in DataFrame operations only (operator 3).

An event is (conversation, turn, sequence, kind, role, text). The events of a turn are folded in the order of their
sequence: "message" opens a message, "delta" appends to it, "edit" replaces its text, "regenerate" throws away what was
streamed and starts anew, "delete" takes it back; any other kind is read as "message". The messages of a conversation,
in the order of its turns, are then rendered:

    ### role: text</turn>

one after the other. In texts and roles a backslash and a # get a backslash before them, and so do the slash of </turn>
and a colon in a role; taking one backslash away before any character undoes all of it, so texts come back as they were
and no text can open or close a turn.

Defined cases: null text and null role are empty; null conversations and turns are values of their own (null turns come
first); several messages of one turn stay apart, ordered by sequence, role and text, repeated rows included; an event
other than "delete" with no message open opens one; an empty table gives no conversations; a conversation whose
messages are all deleted has the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>\n"
_HEAD = r"(?s)^### ([^\\:]*+(?:\\.[^\\:]*+)*+): (.*)$"


def escape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#"))
    return F.replace(c, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _fold(events: Column) -> Column:
    """The messages of one turn from its events in order."""
    none = F.expr("cast(array() as array<struct<role: string, text: string>>)")
    message = lambda a: F.array(F.struct(a["role"].alias("role"), a["text"].alias("text")))

    def step(a: Column, e: Column) -> Column:
        opens = ~e["kind"].isin("delta", "edit", "regenerate", "delete")
        text = F.when(e["kind"] == "delta", F.concat(a["text"], e["text"])).when(e["kind"] == "delete", F.lit("")).otherwise(e["text"])
        return F.struct(
            F.when(opens & a["live"], F.concat(a["done"], message(a))).otherwise(a["done"]).alias("done"),
            F.when(opens | (e["role"] != ""), e["role"]).otherwise(a["role"]).alias("role"),
            text.alias("text"),
            (e["kind"] != "delete").alias("live"),
        )

    start = F.struct(none.alias("done"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("live"))
    return F.aggregate(events, start, step, lambda a: F.when(a["live"], F.concat(a["done"], message(a))).otherwise(a["done"]))


def format_events(events: DataFrame, conv: str = "conv_id", turn: str = "turn", seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<start, end>>): the rendered conversation, and where the assistant's
    texts stand in it, in code points from 0, end exclusive."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    event = F.struct(F.col(seq).alias("seq"), F.when(F.col(kind).isin("delta", "edit", "regenerate", "delete"), 1).otherwise(0).alias("after"), blank(role).alias("role"), blank(text).alias("text"), blank(kind).alias("kind"))
    turns = events.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), event.alias("e")).groupBy("conv_id", "turn").agg(_fold(F.sort_array(F.collect_list("e"))).alias("m"))
    rows = turns.select("conv_id", "turn", F.posexplode_outer("m").alias("i", "m"))
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("m.role")), F.lit(":"), F.lit("\\:")), F.lit(": "))
    body = escape(F.col("m.text"))
    rows = rows.select("conv_id", "turn", "i", (F.col("m.role") == "assistant").alias("loss"), F.coalesce(head, F.lit("")).alias("head"), F.coalesce(body, F.lit("")).alias("body"), F.when(F.col("m").isNotNull(), F.lit(CLOSE)).otherwise("").alias("tail"))
    before = W.partitionBy("conv_id").orderBy("turn", "i").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("head") + F.length("body") + F.length("tail")).over(before), F.lit(0)) + F.length("head"))
    made = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "i", "loss", "at", F.length("body").alias("n"), F.concat("head", "body", "tail").alias("s")))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["at"].alias("start"), (x["at"] + x["n"]).alias("end")))
    return made.select("conv_id", F.array_join(F.transform("t", lambda x: x["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation."""
    parts = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(unescape(F.regexp_extract(x, _HEAD, 1)).alias("role"), unescape(F.regexp_extract(x, _HEAD, 2)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """What stands under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    events = told.unionByName(tricky).withColumns({"seq": F.lit(0), "kind": F.lit("message")})
    made = format_events(events).withColumns({"turns": read_back(F.col("formatted")), "loss": loss_text(F.col("formatted"), F.col("loss_spans"))})
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>') AS et,
             replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:') AS er FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(et) + length(er) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
