"""Chat formatting from an event log, in DataFrame operations only.

A log holds what a chat service streams: ``delta`` events append to a message,
``edit`` replaces it, ``regenerate`` discards it and starts anew. Events are folded per
message, messages are put in order per conversation and rendered with a reversible
template. The spans that carry loss are code point offsets into the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Strings that steer the model; inside texts each gets a backslash in front.
CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>"
OPEN, CLOSE = "<s>", "</s>\n"


def escape(text: Column) -> Column:
    """A backslash before every control string; backslashes already there stay."""
    return F.regexp_replace(text, f"(?={CONTROL})", r"\\")


def unescape(text: Column) -> Column:
    """Takes away the one backslash right before every control string."""
    return F.regexp_replace(text, rf"\\({CONTROL})", "$1")


def fold_messages(log: DataFrame) -> DataFrame:
    """Final messages: ``conv_id``, ``turn``, ``message``, ``role``, ``text``.

    ``log`` has ``conv_id``, ``turn``, ``message`` (tells apart messages of one turn),
    ``seq``, ``kind``, ``role`` and ``text``. Of a message only events from the last
    ``edit`` or ``regenerate`` on count; NULL texts are empty. One aggregate per message.
    """
    events = F.array_sort(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))))
    folded = log.groupBy("conv_id", "turn", "message").agg(F.min("role").alias("role"), events.alias("events"))
    since = F.array_max(F.transform("events", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i).otherwise(0)))
    live = F.filter("events", lambda e, i: (i >= F.col("since")) & (e["kind"] != "regenerate"))
    return folded.withColumn("since", since).select(
        "conv_id", "turn", "message", "role", F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss`` (spans ``start``, ``length`` in code points).

    Turns stand in order of turn, then role, text and message. A turn is
    ``<s>role``, a line break, the escaped text, a line break and ``</s>``; a role is
    URL-encoded, so it never breaks the frame. Loss lies on the texts of ``assistant``.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    shown = messages.select("conv_id", "turn", "message", role.alias("role"), text.alias("plain"), escape(text).alias("text"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "plain", "message", "text"))).alias("turns")
    convs = shown.groupBy("conv_id").agg(turns).withColumn(
        "turns", F.transform("turns", lambda t: F.struct(F.url_encode(t["role"]).alias("role"), t["text"].alias("text"))))
    piece = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit("\n" + CLOSE))
    length = lambda t: F.length(t["role"]) + F.length(t["text"]) + F.lit(len(OPEN) + len(CLOSE) + 2)
    spans = F.aggregate(
        "turns", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + length(t)).alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(t["role"]) + F.lit(len(OPEN) + 1)).alias("start"), F.length(t["text"]).alias("length"))))).otherwise(acc["spans"]).alias("spans")))
    return convs.select("conv_id", F.array_join(F.transform("turns", piece), "").alias("formatted"), spans["spans"].alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of what the output says: see ``format_conversations``."""
    body = F.expr(f"substring(formatted, 1, length(formatted) - {len(CLOSE)})")
    raw = F.split(body, r"(?<!\\)</s>\n", -1)
    turns = F.transform(raw, lambda t: F.struct(
        F.url_decode(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"),
        F.substr(t, F.instr(t, F.lit("\n")) + 1, F.length(t) - F.instr(t, F.lit("\n")) - 1).alias("text")))
    read = rendered.withColumn("read", turns)
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), unescape(t["text"]), F.lit("\n"))), "")
    lost = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return read.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def event_log(conversations: DataFrame, piece: int = 400) -> DataFrame:
    """The log that would have left these final rows.

    A text streams as deltas of ``piece`` code points. An assistant's first piece comes
    first as a draft that is regenerated, a user's comes first in capitals and is edited
    away. Rows of one turn, equal or not, are messages of their own.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role",
                                F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("message"))
    event = lambda seq, kind, text: F.struct(F.lit(seq).cast("int").alias("seq") if isinstance(seq, int) else seq.alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    part = lambda i: F.substr(F.col("text"), i * piece + 1, F.lit(piece))
    count = F.greatest(F.lit(1), F.ceil(F.length("text") / piece).cast("int"))
    stream = F.transform(F.sequence(F.lit(0), count - 1), lambda i: event(i + 3, "delta", part(i)))
    first = F.substr(F.col("text"), F.lit(1), F.lit(piece))
    draft = F.when(F.col("role") == "assistant", F.array(event(0, "delta", first), event(1, "regenerate", F.lit("")))) \
        .when(F.col("role") == "user", F.array(event(0, "delta", F.upper(first)), event(1, "edit", F.lit("")))) \
        .otherwise(F.array().cast("array<struct<seq:int,kind:string,text:string>>"))
    return rows.select("conv_id", "turn", "message", "role", F.explode(F.concat(draft, stream)).alias("e")).select(
        "conv_id", "turn", "message", "role", "e.seq", "e.kind", "e.text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Fold, render and read back whole conversations.

    Returns ``conv_id``, ``n_turns``, ``turns_sha256`` (role, line break, text, line break
    per turn), ``loss_chars`` and ``loss_sha256`` (all text under the loss mask, unescaped)
    and ``formatted_chars``. NULL texts and roles are empty. Rows of one turn are ordered by
    role, then text; a NULL turn comes first; rows without a conv_id form one conversation.
    An empty table gives no rows. Other columns are ignored. A message, and then a
    conversation, must fit into one row, as its digest does.
    """
    return read_back(render(fold_messages(event_log(conversations))))


def with_probe(conversations: DataFrame) -> DataFrame:
    """Conversation -7 quotes the template's own control strings."""
    probe = conversations.sparkSession.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(text) + 10 + len(regexp_extract_all(text, '</?s>|\[/?INST\]|<</?SYS>>')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
