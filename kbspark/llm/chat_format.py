r"""Chat formatting: event-sourced reconstruction, then rendering.  DataFrame functions only.

A log row is an event of a conversation:

* ``message``     a whole message of its own (also where ``message_id`` is null),
* ``delta``       text appended to the message ``message_id``,
* ``edit``        replaces the text that message has so far,
* ``regenerate``  empties it; the deltas that follow make the new text.

Logs are partitioned by conversation (and message), sorted by sequence and folded into final
messages; those are rendered in the order of their first event.

Template: ``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>`` newline.  Inside roles and texts
each backslash is doubled and a backslash is put behind the first character of every control
string, so no control string survives inside a text and removing one backslash per pair
(:func:`unescape`) gives back the exact input.

Scale: messages are rendered where they are, gathered in blocks of :data:`BLOCK` sequence numbers,
and only whole blocks meet in the row of their conversation, so a hot conversation reaches its
final task as few, already joined strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Control strings of this template and of other public chat templates.
CONTROL = r"\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>"


def escape(text: Column) -> Column:
    """Make ``text`` free of control strings, reversibly."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(doubled, rf"<(?={CONTROL})", r"<\\"), r"\[(?=/?INST\])", r"[\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, seq, role, text) of a log with columns conv_id, seq, message_id, kind, role, text.

    Nulls: role and text count as empty, a null kind as ``message``, a null seq sorts first, null
    conv_id is a conversation of its own.  Events of one message with equal seq fold in the order
    regenerate, edit, delta, then by text.  Repeated ``message`` rows are messages of their own.
    """
    e = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), "message_id",
        F.coalesce("kind", F.lit("message")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    own = F.col("message_id").isNull() | (F.col("kind") == "message")
    whole = e.where(own).select("conv_id", "seq", "role", "text")
    order = F.when(F.col("kind") == "regenerate", 0).when(F.col("kind") == "edit", 1).otherwise(2)
    log = F.sort_array(F.collect_list(F.struct("seq", order.alias("o"), "text")))
    resets = F.expr("array_max(transform(filter(log, e -> e.o < 2), e -> struct(e.seq, e.o, e.text)))")
    folded = (
        e.where(~own)
        .groupBy("conv_id", "message_id")
        .agg(F.min("seq").alias("seq"), F.min_by("role", F.struct("seq", order, "role")).alias("role"), log.alias("log"))
        .withColumn("reset", resets)
        .withColumn("live", F.expr("filter(log, e -> reset IS NULL OR e > reset OR (e = reset AND e.o = 1))"))
        .select("conv_id", "seq", "role", F.expr("array_join(transform(live, e -> e.text), '')").alias("text"))
    )
    return whole.unionByName(folded)


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments array<struct<text, loss>>.

    The segments joined in order are ``formatted``; those with ``loss`` are the (escaped) texts of
    the assistant, nothing else.  Messages sort by seq, then role, then text.
    """
    text = escape(F.col("text"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    plain = lambda c: F.struct(c.alias("text"), F.lit(False).alias("loss"))
    segments = F.when(
        F.col("role") == "assistant",
        F.array(plain(head), F.struct(text.alias("text"), F.lit(True).alias("loss")), plain(F.lit(END + "\n"))),
    ).otherwise(F.array(plain(F.concat(head, text, F.lit(END + "\n")))))
    message = F.struct(F.col("seq"), F.col("role"), F.col("text"), segments.alias("segments"))
    blocks = (
        messages.withColumn("block", F.floor(F.col("seq") / BLOCK))
        .groupBy("conv_id", "block")
        .agg(F.sort_array(F.collect_list(message)).alias("m"))
        .select("conv_id", F.struct("block", F.expr("flatten(transform(m, x -> x.segments))").alias("segments")).alias("b"))
    )
    return (
        blocks.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("b")).alias("b"))
        .select("conv_id", F.expr("flatten(transform(b, x -> x.segments))").alias("segments"))
        .select("conv_id", F.expr("array_join(transform(segments, s -> s.text), '')").alias("formatted"), "segments")
    )


def format_chats(events: DataFrame) -> DataFrame:
    """Fold the log and render it; an empty log gives no rows, extra columns are ignored."""
    return render(fold_events(events))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    cut = lambda p: F.split(p, r"<\|im_sep\|>")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(cut(p)[0]).alias("role"), unescape(F.regexp_replace(cut(p)[1], r"<\|im_end\|>\n$", "")).alias("text")
        ),
    )


def conversation_events(conversations: DataFrame) -> DataFrame:
    """The log of a table of finished turns (conv_id, turn, role, text)."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"),
        F.lit(None).cast("long").alias("message_id"), F.lit("message").alias("kind"), "role", "text",
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Figures read back from the output of :func:`format_chats`."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text)), "")
    return formatted.withColumns({"turns": parse_turns(F.col("formatted")), "loss": loss}).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), n AS (
  SELECT *,
    length(text) + length(role) + length(text) - length(replace(text, '\', '')) + length(role) - length(replace(role, '\', ''))
    + len(regexp_extract_all(text, '<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|</?s>|\[/?INST\]'))
    + len(regexp_extract_all(role, '<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|</?s>|\[/?INST\]'))
    + 33 AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""
