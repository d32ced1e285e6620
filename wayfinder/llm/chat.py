"""Chat formatting: event-sourced reconstruction of conversations, then rendering. DataFrame functions only.

An event log has one row an event: conversation, sequence number, message, kind, role, text.
Kinds: `message` opens a message or restates it, `delta` appends to it, `edit` puts a text in place of
what it holds, `regenerate` empties it and drops every later message that had begun by then. Other or null
kinds count as `delta`. The fold sorts a conversation's events by sequence (ties: kind, role, text, message
id, so reruns agree) and needs one shuffle, by conversation; running sums over a sorted partition spill, and
only a message's pieces and a conversation's messages are gathered, which is the size of the output row.

Template: each turn is `<s>[INST]role[/INST]text</s>`. In roles and texts a backslash follows every `<`,
`[` and backslash, so no control string survives inside them, and taking it away again is exact.

Defined results: null texts and roles are empty, repeated rows are repeated events (each `message` row
without a message id is a message of its own, to which later events without one belong), a null
conversation id is one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN_OPEN, ROLE_END, TURN_CLOSE = "<s>[INST]", "[/INST]", "</s>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def fold_events(events: DataFrame, conv: str = "conv_id", seq: str = "seq", message: str = "message_id", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """One row a message that stands at the end: conv_id, position (the sequence number that opened it), message_id, role, text."""
    e = events.select(
        F.col(conv).alias("conv_id"), F.col(seq).alias("seq"), F.col(message).alias("message_id"), F.col(kind).alias("kind"),
        F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).repartition("conv_id")
    # n tells a conversation's events apart, repeated ones too
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("seq", "kind", "role", "text", "message_id")))
    opens = F.when(F.col("message_id").isNull() & (F.col("kind") == "message"), 1).otherwise(0)
    so_far = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumn("opened", F.when(F.col("message_id").isNull(), F.sum(opens).over(so_far)).otherwise(0))
    one = ["conv_id", "message_id", "opened"]
    e = e.withColumn("position", F.min("seq").over(Window.partitionBy(*one)))
    # a message goes if a later regeneration concerns one that had begun before it
    later = Window.partitionBy("conv_id").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumn("cut", F.min(F.when(F.col("kind") == "regenerate", F.col("position"))).over(later))
    pieces = e.groupBy(*one).agg(
        F.min("position").alias("position"),
        F.coalesce(F.max(F.when(F.col("kind").isin("message", "edit", "regenerate"), F.col("n"))), F.lit(0)).alias("restart"),
        F.min_by("cut", "n").alias("cut"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("n"))).alias("role"),
        F.sort_array(F.collect_list(F.struct("n", "kind", "text"))).alias("pieces"),
    )
    kept = pieces.where(F.col("cut").isNull() | (F.col("cut") >= F.col("position")))
    text = F.array_join(F.transform(F.filter("pieces", lambda p: (p["n"] >= F.col("restart")) & (F.coalesce(p["kind"], F.lit("")) != "regenerate")), lambda p: p["text"]), "")
    return kept.select("conv_id", "position", "message_id", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted, and segments whose texts put together are formatted; `loss` marks those to learn from."""
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "role", "text"))).alias("turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of_turn(t: Column) -> Column:
        head = F.concat(F.lit(TURN_OPEN), escape(t["role"]), F.lit(ROLE_END))
        return F.array(segment(head, F.lit(False)), segment(escape(t["text"]), t["role"] == LOSS_ROLE), segment(F.lit(TURN_CLOSE), F.lit(False)))

    out = turns.select("conv_id", F.flatten(F.transform("turns", of_turn)).alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a rendered conversation."""
    raw = F.split(formatted, F.lit(r"</s>"))
    bodies = F.transform(F.slice(raw, 1, F.size(raw) - 1), lambda t: F.split(F.substr(t, F.lit(len(TURN_OPEN) + 1)), F.lit(r"\[/INST\]"), 2))
    return F.transform(bodies, lambda b: F.struct(unescape(b[0]).alias("role"), unescape(b[1]).alias("text")))


def loss_text(segments: Column) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def as_events(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A plain table of turns as a log: one `message` event a row, in order of turn (ties: role, text)."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).repartition("conv_id")
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select("conv_id", seq.alias("seq"), seq.alias("message_id"), F.lit("message").alias("kind"), "role", "text")


def format_conversations(turns: DataFrame) -> DataFrame:
    return render(fold_events(as_events(turns)))


def digest(formatted: DataFrame) -> DataFrame:
    """What the rendered conversations hold, read back from them."""
    f = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return f.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
