"""Chat formatting from an event log: fold events into messages, then render (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridflow.llm.common import ahead, running

START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = 1024


def escape(text: Column) -> Column:
    """No text holds `<|` afterwards: `<`, any backslashes and `|` get one more backslash."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles stand on one line: a line feed becomes `%0A`, a per cent sign `%25`."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of an event log: conv_id, turn, msg, role, text.

    `events` has conv_id, seq, turn, msg, kind, role, text. (conv_id, turn, msg) is a
    message; `msg` tells messages of one turn apart. Events are folded by seq: `delta`
    adds its text at the end; `edit` puts its text in place of all before; `regenerate`
    starts the message again with its text. An edit or a regeneration also discards what
    was written before it to later turns of the conversation. The role is that of the
    latest event that names one.

    Null text adds nothing, a null kind is a delta, null seq comes first, equal seqs go by
    kind and text. Null conv_id is one conversation. Null turns come after all others.
    Messages whose events are all discarded disappear. Other columns are ignored.
    """
    e = events.select(
        F.struct("conv_id").alias("_conv"), "turn", "msg", F.coalesce("seq", F.lit(-(1 << 62))).alias("seq"),
        F.coalesce("kind", F.lit("delta")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"),
    )
    resets = F.col("kind").isin("edit", "regenerate")
    message = F.array_sort(F.collect_list(F.struct("seq", "kind", "text", "role")))
    folded = e.groupBy("_conv", F.struct("turn").alias("_turn"), "msg").agg(message.alias("_log"))
    cuts = e.filter(resets).groupBy("_conv", F.struct("turn").alias("_turn")).agg(F.max("seq").alias("_reset"))
    if not cuts.isEmpty():
        turns = e.select("_conv", F.struct("turn").alias("_turn")).distinct().join(cuts, ["_conv", "_turn"], "left")
        folded = folded.join(earlier_resets(turns), ["_conv", "_turn"])
        folded = folded.withColumn("_log", F.filter("_log", lambda x: x["seq"] >= F.col("_cut")))
        folded = folded.filter(F.size("_log") > 0)
    role = F.aggregate("_log", F.lit(None).cast("string"), lambda s, x: F.coalesce(x["role"], s))
    # the text starts at the last reset of the sorted log
    last = F.greatest(
        F.array_max(F.transform("_log", lambda x, i: F.when(x["kind"].isin("edit", "regenerate"), i + 1).otherwise(1))),
        F.lit(1),
    )
    kept = F.slice("_log", last, F.size("_log"))
    return folded.select(
        F.col("_conv.conv_id").alias("conv_id"), F.col("_turn.turn").alias("turn"), "msg", role.alias("role"),
        F.array_join(F.transform(kept, lambda x: x["text"]), "").alias("text"),
    )


def earlier_resets(turns: DataFrame) -> DataFrame:
    """Largest reset seq among the earlier turns of the conversation, in two levels over the turns."""
    turn = F.col("_turn.turn")
    turns = turns.withColumn("_part", F.coalesce(F.floor(turn / TURNS), F.lit(1 << 40)))
    parts = turns.groupBy("_conv", "_part").agg(F.max("_reset").alias("_reset"))
    parts = parts.select("_conv", "_part", F.max("_reset").over(ahead(["_conv"], ["_part"])).alias("_before"))
    inside = F.max("_reset").over(ahead(["_conv", "_part"], [turn]))
    cut = F.coalesce(F.greatest(F.col("_inside"), F.col("_before")), F.lit(-(1 << 62)))
    return turns.withColumn("_inside", inside).join(parts, ["_conv", "_part"]).select("_conv", "_turn", cut.alias("_cut"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, spans: one (start, end, loss) per turn, in code points of `formatted`.

    Turns stand in order of turn, role, text, msg. Each is START, role, line feed, text, END,
    with control strings in role and text escaped reversibly; `loss` marks the texts of
    `loss_role`. Texts first meet by TURNS turns of a conversation, then by conversation.
    """
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    m = messages.select(
        F.struct("conv_id").alias("_conv"), "turn", "msg", "role", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(1 << 40)).alias("_part"),
        F.concat(F.lit(START), role, F.lit("\n")).alias("_head"), text.alias("_body"),
    )
    m = m.withColumn("_piece", F.concat("_head", "_body", F.lit(END)))
    order = [F.col("turn"), F.col("role"), F.col("text"), F.col("msg")]
    m = running(m, ["_conv"], "_part", order, F.length("_piece"), "_start")
    start = F.col("_start") + F.length("_head")
    span = F.struct(
        start.alias("start"), (start + F.length("_body")).alias("end"),
        F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("loss"),
    )
    piece = F.struct("_start", "_piece", span.alias("_span"))
    m = m.groupBy("_conv", "_part").agg(F.array_sort(F.collect_list(piece)).alias("_p"))
    chunk = F.struct(
        "_part", F.array_join(F.transform("_p", lambda x: x["_piece"]), "").alias("text"),
        F.transform("_p", lambda x: x["_span"]).alias("spans"),
    )
    m = m.groupBy("_conv").agg(F.array_sort(F.collect_list(chunk)).alias("_chunks"))
    return m.select(
        F.col("_conv.conv_id").alias("conv_id"),
        F.array_join(F.transform("_chunks", lambda x: x["text"]), "").alias("formatted"),
        F.flatten(F.transform("_chunks", lambda x: x["spans"])).alias("spans"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Parse `formatted`: conv_id, formatted, turns (role, text, loss), loss_text.

    Turns are cut at their marks and unescaped. loss_text is all text under the loss mask:
    each marked span cut out of `formatted` by its start and end, then unescaped. A piece of
    `formatted` starts where the span before it and its end mark end, so that a span is
    looked up in its own piece.
    """
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)
    pieces = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(piece: Column, span: Column) -> Column:
        body = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.length(role) + 2, F.length(body))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"), span["loss"].alias("loss"))

    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("spans", lambda s: s["end"] + len(END)))
    place = F.zip_with(
        "spans", F.slice(starts, F.lit(1), F.size("spans")),
        lambda s, first: F.struct(s["loss"].alias("loss"), (s["start"] - first).alias("at"), (s["end"] - s["start"]).alias("n")),
    )
    marked = F.zip_with(
        pieces, place,
        lambda piece, p: F.when(p["loss"], unescape(F.substring(piece, p["at"].cast("int") + 1, p["n"].cast("int")))).otherwise(F.lit("")),
    )
    return rendered.select("conv_id", "formatted", F.zip_with(pieces, "spans", turn).alias("turns"), F.array_join(marked, "").alias("loss_text"))


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """An event log as rendered conversations with their loss mask; see fold_events and render."""
    return render(fold_events(events), loss_role)
