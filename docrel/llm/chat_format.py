"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log has one row per event: conv_id, seq (order in the conversation), message, kind, role, text.

    open        the message begins and has this role (of several the last)
    delta       the text is added to the message
    edit        the text replaces what the message had
    regenerate  what the message had is thrown away; later deltas build it anew

Events of other kinds count for nothing but the message's place. ``fold`` cuts the log by conversation and message,
finds each message's last edit or regeneration by a partial maximum and gathers only the texts from there on, in their
order, so drafts that were thrown away are never held together. ``render`` lays out a conversation as

    ### role: text</turn>

one turn a line, with the spans (start, end in code points) of the texts that carry loss. The control strings
``### `` and ``</turn>`` inside texts and roles, and the backslash, are written as escapes and come back unchanged
(``read_back``). A formatted conversation is one value, as a text of documents is, and Spark's limit of 2 GB for a value
holds for it; beyond it the job fails, nothing is cut off.

Null texts and roles are empty, a null seq comes first, null conversations and messages are keys like any others.
Equal events (same conversation, message, seq, kind and text) count once; ties in seq put edits before deltas, then go
by text. Messages stand by their first seq, then by number. An empty log gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Control strings of the template.
OPEN, MIDDLE, CLOSE, END_LINE = "### ", ": ", "</turn>", "\n"
#: What a text becomes inside the template; the backslash first, and last on the way back.
ESCAPES = [("\\", "\\b"), ("### ", "##\\h "), ("</turn>", "\\l/turn>")]
UNESCAPES = [("\\c", ":"), ("\\h", "#"), ("\\l", "<"), ("\\b", "\\")]
EVENT = "struct<seq: bigint, kind: string, role: string, text: string>"
#: Deltas that a turn's text is streamed in, at most, and code points of one, at least.
DELTAS, DELTA_CHARS = 16, 64


def escaped(text: Column, role: bool = False) -> Column:
    for plain, code in [*ESCAPES, *([(":", "\\c")] if role else [])]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for code, plain in UNESCAPES:
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def fold(log: DataFrame) -> DataFrame:
    """Final messages: conv_id, message, first_seq, role, text."""
    key = ["conv_id", "message"]
    resets = F.col("kind").isin("edit", "regenerate")
    of = log.groupBy(*key).agg(
        F.min("seq").alias("first_seq"),
        F.max(F.when(F.col("kind") == "open", F.struct("seq", F.coalesce("role", F.lit("")).alias("role"))))["role"].alias("role"),
        F.max(F.when(resets, F.struct("seq")))["seq"].alias("reset"),
        F.coalesce(F.max(resets), F.lit(False)).alias("was_reset"),
    )
    texts = log.where(F.col("kind").isin("delta", "edit") & (F.col("text") != "")).select(*key, "seq", (F.col("kind") == "delta").alias("later"), "text")
    left, right = texts.alias("t"), of.alias("m")
    same = F.col("t.conv_id").eqNullSafe(F.col("m.conv_id")) & F.col("t.message").eqNullSafe(F.col("m.message"))
    # A null seq comes first, also that of a reset.
    kept = ~F.col("m.was_reset") | F.col("m.reset").isNull() | F.coalesce(F.col("t.seq") >= F.col("m.reset"), F.lit(False))
    parts = left.join(right, same).where(kept).select("t.*")
    whole = F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("seq", "later", "text"))), lambda x: x["text"]), "")
    built = parts.groupBy(*key).agg(whole.alias("text")).alias("b")
    same = F.col("m.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("m.message").eqNullSafe(F.col("b.message"))
    return right.join(built, same, "left").select(
        "m.conv_id", "m.message", "m.first_seq", F.coalesce("m.role", F.lit("")).alias("role"), F.coalesce("b.text", F.lit("")).alias("text")
    )


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (array of start and end of the texts that carry loss)."""
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), role=True), F.lit(MIDDLE))
    body = escaped(F.col("text"))
    line = F.concat(head, body, F.lit(CLOSE + END_LINE))
    before = Window.partitionBy("conv_id").orderBy("first_seq", "message").rowsBetween(Window.unboundedPreceding, -1)
    turns = messages.select("*", line.alias("line"), F.length(head).cast("long").alias("head"), F.length(body).cast("long").alias("body"))
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("line")).over(before), F.lit(0)) + F.col("head"))
    span = F.when(F.col("role").isin(*loss_roles), F.struct(F.col("at").alias("start"), (F.col("at") + F.col("body")).alias("end")))
    # Places tell the order; a null span is no element.
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("lines"), F.sort_array(F.collect_list(span)).alias("loss"))
    return gathered.select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("formatted"), "loss")


def read_back(output: DataFrame) -> DataFrame:
    """The turns that formatted conversations hold, from their text and mask alone: conv_id, pos, role, text, and
    loss_text (what the mask covers, null where it covers nothing)."""
    lines = output.select("conv_id", F.posexplode(F.split("formatted", CLOSE + END_LINE)).alias("pos", "line")).where("line <> ''")
    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + len(CLOSE + END_LINE)).over(before), F.lit(0))
    head = F.length(F.substring_index("line", MIDDLE, 1)) + len(MIDDLE)
    lines = lines.select("*", head.alias("head"), (start + head).alias("at")).alias("l")
    masks = output.select("conv_id", F.inline("loss")).alias("k")
    same = F.col("l.conv_id").eqNullSafe(F.col("k.conv_id")) & (F.col("l.at") == F.col("k.start"))
    role = F.expr(f"substring(l.line, {len(OPEN) + 1}, l.head - {len(OPEN) + len(MIDDLE)})")
    covered = F.expr("substring(l.line, l.head + 1, cast(k.end - k.start as int))")
    return lines.join(masks, same, "left").select(
        "l.conv_id",
        "l.pos",
        unescaped(role).alias("role"),
        unescaped(F.expr("substring(l.line, l.head + 1)")).alias("text"),
        F.when(F.col("k.start").isNotNull(), unescaped(covered)).alias("loss_text"),
    )


def event_log(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as a log that folds into them: every turn is a message, null turns
    first, ties by role and text. By a hash, a turn is streamed plainly, drafted backwards and regenerated, or written
    and then edited, at once or after the whole conversation."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    turns = turns.withColumn("message", number).withColumn("way", F.pmod(F.xxhash64(F.lit(12), "conv_id", "message"), F.lit(4)))
    turns = turns.withColumn("step", F.greatest(F.lit(DELTA_CHARS), F.ceil(F.length("text") / DELTAS)).cast("int"))
    cuts = F.expr("sequence(0, greatest(0, cast((length(text) - 1) div step as int)))")

    def event(seq: Column, kind: str, text: Column | None = None) -> Column:
        role = F.col("role") if kind == "open" else F.lit(None).cast("string")
        return F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), (F.lit(None).cast("string") if text is None else text).alias("text"))

    at = F.col("message") * (DELTAS + 8)
    deltas = F.transform(cuts, lambda i: event(at + 4 + i, "delta", F.expr("text").substr(i * F.col("step") + 1, F.col("step"))))
    draft = F.array(event(at + 1, "delta", F.reverse("text")))
    events = (
        F.when(F.col("way") == 0, deltas)
        .when(F.col("way") == 1, F.concat(draft, F.array(event(at + 2, "regenerate")), deltas))
        .when(F.col("way") == 2, F.concat(draft, F.array(event(at + 2, "edit", F.upper("text")), event(at + 3, "edit", F.col("text")))))
        .otherwise(F.concat(draft, F.array(event(F.lit(1 << 60) + F.col("message"), "edit", F.col("text")))))
    )
    return turns.select("conv_id", "message", F.inline(F.concat(F.array(event(at, "open")), events).cast(f"array<{EVENT}>")))


def digests(output: DataFrame) -> DataFrame:
    """Per formatted conversation what its file gives back: counts and hashes of turns and of the text under the mask."""
    turn = F.struct("pos", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("said"), F.coalesce("loss_text", F.lit("")).alias("loss_text"))
    turns = read_back(output).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).alias("t")
    joined = lambda name: F.array_join(F.transform("t.turns", lambda x: x[name]), "")
    return output.alias("o").join(turns, F.col("o.conv_id").eqNullSafe(F.col("t.conv_id")), "left").select(
        "o.conv_id",
        F.size("t.turns").cast("long").alias("n_turns"),
        F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.length(joined("loss_text")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss_text"), 256).alias("loss_sha256"),
        F.length("o.formatted").cast("long").alias("formatted_chars"),
    )


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    log = materialize(event_log(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(added)))
    return digests(materialize(render(fold(log))))


ORACLE = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n,
    '### ' || replace(replace(replace(replace(role, '\', '\b'), '### ', '##\h '), '</turn>', '\l/turn>'), ':', '\c') || ': '
      || replace(replace(replace(text, '\', '\b'), '### ', '##\h '), '</turn>', '\l/turn>') || '</turn>' || chr(10) as line
  from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(line))::bigint as formatted_chars
from turns group by conv_id
"""
