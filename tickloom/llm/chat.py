"""Chat formatting by event sourcing: a log of streamed deltas, edits and regenerations is folded into messages, then rendered.

A message's text is what its events leave when folded in the order of their sequence: a delta
appends, an edit replaces, a regeneration starts over.  Events are folded by spans of the sequence
first and span after span then, so that no task holds all events of a message.  Rendered
conversations mark turns; control strings inside texts and roles are escaped and come back whole.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Events of a message are folded in spans of so many numbers of the sequence.
SPAN = 512
#: A turn is HEAD, role, COLON, text, END.
HEAD, COLON, END = "### ", ": ", "</turn>\n"
#: Control strings and what stands for them inside texts; the backslash goes first, so that each one left begins an escape.
ESCAPES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t")]
#: In roles the end of the role is one more.
ROLE_ESCAPES = [*ESCAPES, (": ", "\\c")]


def escaped(text: Column, pairs=ESCAPES) -> Column:
    for raw, mark in pairs:
        text = F.replace(text, F.lit(raw), F.lit(mark))
    return text


def unescaped(text: Column, pairs=ESCAPES) -> Column:
    """The inverse of :func:`escaped`: no mark is part of another one, so the backslash can go last."""
    for raw, mark in reversed(pairs):
        text = F.replace(text, F.lit(mark), F.lit(raw))
    return text


def _folded(parts: Column) -> Column:
    """Text of ordered parts (resets, text): those from the last reset on, joined."""
    last = F.array_max(F.transform(parts, lambda p, i: F.when(p["resets"], i + 1).otherwise(1)))
    return F.array_join(F.transform(F.slice(parts, last, F.size(parts)), lambda p: p["text"]), "")


def fold_events(log: DataFrame) -> DataFrame:
    """conv_id, message, first_seq, role, text of each message of a log of conv_id, message, seq, kind, role and text.

    kind 'delta' appends its text, 'edit' replaces the text by its own, 'regenerate' starts over
    with its own; events of other kinds are ignored.  The role is that of the last event that names
    one.  Null texts are empty, null sequences come first, a null conversation or message is one of
    its own.  Events of one message that repeat count once; of different ones with the same sequence
    edits come after deltas and regenerations last, then texts by code point.  Other columns are
    ignored.  An empty log gives no message.
    """
    rank = F.when(F.col("kind") == "delta", 0).when(F.col("kind") == "edit", 1).when(F.col("kind") == "regenerate", 2)
    events = log.select("conv_id", "message", "seq", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"), "role").where("rank is not null")
    events = events.withColumn("span", F.floor(F.col("seq") / SPAN))
    last_role = F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "rank", "role")))
    spans = events.groupBy("conv_id", "message", "span").agg(F.sort_array(F.collect_set(F.struct("seq", "rank", "text"))).alias("events"), last_role.alias("named"), F.min("seq").alias("first_seq"))
    part = F.transform("events", lambda e: F.struct((e["rank"] > 0).alias("resets"), e["text"].alias("text")))
    spans = spans.select("conv_id", "message", "named", "first_seq", F.struct("span", F.exists("events", lambda e: e["rank"] > 0).alias("resets"), _folded(part).alias("text")).alias("part"))
    messages = spans.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.max("named").alias("named"), F.min("first_seq").alias("first_seq"))
    return messages.select("conv_id", "message", "first_seq", F.col("named.role").alias("role"), _folded(F.col("parts")).alias("text"))


def render(messages: DataFrame, *, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted and mask of each conversation of messages (conv_id, first_seq, message, role, text).

    Turns stand in the order of first_seq, then message, role and text.  mask has a span of each
    turn whose role is ``learn``: turn (from 0), and start and end in code points from the turn's
    first.  Null roles and texts are empty.  A conversation is one value, up to 2 GB.
    """
    role, text = escaped(F.coalesce("role", F.lit("")), ROLE_ESCAPES), escaped(F.coalesce("text", F.lit("")))
    start = F.length(role) + len(HEAD) + len(COLON)
    turn = F.struct("first_seq", "message", "role", F.concat(F.lit(HEAD), role, F.lit(COLON), text, F.lit(END)).alias("piece"), F.when(F.col("role") == learn, F.struct(start.alias("start"), (start + F.length(text)).alias("end"))).alias("span"))
    turns = messages.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t, i: F.struct(i.alias("turn"), t["span"]["start"].alias("start"), t["span"]["end"].alias("end"))), lambda s: s["start"].isNotNull())
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (array of role and text) and learned (array of texts under the mask), from formatted and mask alone."""
    pieces = F.filter(F.split("formatted", END), lambda p: p != "")
    body = lambda p: F.substring(p, len(HEAD) + 1, F.length(p))
    split = lambda p: F.struct(unescaped(F.substring_index(body(p), COLON, 1), ROLE_ESCAPES).alias("role"), unescaped(F.substring(body(p), F.locate(COLON, body(p)) + len(COLON), F.length(p))).alias("text"))
    rows = rendered.withColumn("pieces", pieces)
    learned = F.transform("mask", lambda m: unescaped(F.substring(F.get("pieces", m["turn"]), m["start"] + 1, m["end"] - m["start"])))
    return rows.select("conv_id", "formatted", F.transform("pieces", split).alias("turns"), learned.alias("learned"))
