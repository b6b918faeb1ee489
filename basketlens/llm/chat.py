"""Chat formatting with loss masks by a finite-state machine over roles; DataFrame functions only.

Semantics (`format_chats`)
    Rows of one conv_id are a conversation, ordered by turn, then role, then text; a null text or role is empty; repeated
    rows are turns of their own; a null conv_id is a conversation like any other. An empty table gives an empty result.
    Other columns are not read. The state machine starts at `start` and follows TRANSITIONS; `valid` says whether every
    turn was allowed and the last state is final, `first_bad` is the number (from 0) of the first turn that was not
    allowed, null where all were. Conversations out of order are formatted as well, with valid false.

Template
    TEMPLATE gives each role its opening and closing mark and a loss flag; a role that it does not name is written between
    OTHER's marks together with its name. A turn is three segments: mark, text, mark; only the text of a role with the
    loss flag is under the loss mask. Control strings inside texts are escaped by one backslash after their first
    character (one more where there are some already), so no text can open or close a turn and `unescaped(escaped(x))`
    is x for every x.

A conversation is one row of the result, so its turns are gathered in one place; nothing else is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Marks:
    open: str
    close: str
    loss: bool = False


TEMPLATE = {
    "system": Marks("[SYS] ", " [/SYS]"),
    "user": Marks("[INST] ", " [/INST]"),
    "assistant": Marks("<s>", "</s>", loss=True),
}
OTHER, NAME_END = Marks("[TURN] ", " [/TURN]"), " [TEXT] "
TRANSITIONS = {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"}
FINAL = ("assistant",)

_CONTROL = r"(/?(?:INST|SYS|TURN|TEXT)\]|/?s>)"
_TURN = r"(?s)\[INST\] .*? \[/INST\]|\[SYS\] .*? \[/SYS\]|\[TURN\] .*? \[/TURN\]|<s>.*?</s>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])\\(\\*)" + _CONTROL, r"$1$2$3")


def _by_role(role: Column, of, other: Column) -> Column:
    out = other
    for name, marks in TEMPLATE.items():
        out = F.when(role == name, of(marks)).otherwise(out)
    return out


def _pieces(role: Column, text: Column) -> Column:
    """struct of a turn's three texts and whether the middle one is under the mask."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    opened = _by_role(role, lambda m: F.lit(m.open), F.concat(F.lit(OTHER.open), escaped(role), F.lit(NAME_END)))
    closed = _by_role(role, lambda m: F.lit(m.close), F.lit(OTHER.close))
    return F.struct(opened.alias("opened"), escaped(text).alias("text"), closed.alias("closed"), _by_role(role, lambda m: F.lit(m.loss), F.lit(OTHER.loss)).alias("loss"))


def _walk(turns: Column) -> Column:
    """struct(state after the last allowed turn, number of turns allowed, whether the machine still runs): the state
    machine over a conversation's turns, which stops at the first turn that TRANSITIONS does not allow."""
    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("allowed"), F.lit(True).alias("runs"))

    def step(at: Column, turn: Column) -> Column:
        to = F.lit(None).cast("string")
        for (state, role), then in TRANSITIONS.items():
            to = F.when((at["state"] == state) & (turn["role"] == role), F.lit(then)).otherwise(to)
        go = at["runs"] & to.isNotNull()
        return F.struct(F.when(go, to).otherwise(at["state"]).alias("state"), (at["allowed"] + go.cast("int")).alias("allowed"), go.alias("runs"))

    return F.aggregate(turns, begin, step)


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, valid, first_bad, segments (text, loss, start), formatted, loss_spans (start, length).

    Starts and lengths are code points of `formatted`, which is the segments' texts in order; the loss spans are the
    segments with the loss flag. Where a turn begins is a running sum over its conversation's rows, so the work grows with
    the turns, not with their square.
    """
    rows = conversations.select("conv_id", "turn", "role", "text", _pieces(F.col("role"), F.col("text")).alias("p"))
    size = F.length("p.opened") + F.length("p.text") + F.length("p.closed")
    earlier = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(size).over(earlier), F.lit(0)).cast("int"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "turn", "role", "p"))).alias("turns"))
    piece = lambda text, loss, start: F.struct(text.alias("text"), loss.alias("loss"), start.alias("start"))

    def emitted(t: Column) -> Column:
        p, text_at = t["p"], t["at"] + F.length(t["p"]["opened"])
        return F.array(piece(p["opened"], F.lit(False), t["at"]), piece(p["text"], p["loss"], text_at), piece(p["closed"], F.lit(False), text_at + F.length(p["text"])))

    out = turns.select("conv_id", _walk(F.col("turns")).alias("walk"), F.flatten(F.transform("turns", emitted)).alias("segments"))
    valid, first_bad = F.col("walk.runs") & F.col("walk.state").isin(*FINAL), F.when(~F.col("walk.runs"), F.col("walk.allowed").cast("long"))
    spans = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), F.length(s["text"]).alias("length")))
    return out.select("conv_id", valid.alias("valid"), first_bad.alias("first_bad"), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), spans.alias("loss_spans"))


def _read(turn: Column) -> Column:
    """Back from a formatted turn: struct(role, text, begin), begin being where its text begins in it."""

    def inner(m: Marks) -> Column:
        return F.substring(turn, len(m.open) + 1, F.length(turn) - len(m.open) - len(m.close))

    end = F.locate(NAME_END, turn)
    role, text = F.substring(turn, F.lit(len(OTHER.open) + 1), end - len(OTHER.open) - 1), F.substring(turn, end + len(NAME_END), F.length(turn) - end + 1 - len(NAME_END) - len(OTHER.close))
    begin = end - 1 + len(NAME_END)
    for name, m in TEMPLATE.items():
        mine = turn.startswith(m.open)
        role, text, begin = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, inner(m)).otherwise(text), F.when(mine, F.lit(len(m.open))).otherwise(begin)
    return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"), begin.alias("begin"))


def read_turns(chats: DataFrame) -> DataFrame:
    """Back from formatted texts and their masks: conv_id, pos, role, text, loss (the text under the mask in this turn, unescaped, or null)."""
    turns = chats.select("conv_id", F.posexplode(F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(0))).alias("pos", "turn"))
    earlier = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("turn")).over(earlier), F.lit(0))).withColumn("r", _read(F.col("turn")))
    spans = chats.select(F.col("conv_id").alias("of"), F.inline("loss_spans"))
    under = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("at") + F.col("r.begin") == F.col("start"))
    loss = unescaped(F.substring("turn", F.col("r.begin") + 1, F.col("length")))
    return turns.join(spans, under, "left").select("conv_id", "pos", "r.role", "r.text", loss.alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of each conversation, taken from its formatted text and mask alone, with the state machine's verdict."""
    turns = read_turns(chats).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text", "loss"))).alias("turns"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.filter(F.transform("turns", lambda t: t["loss"]), lambda x: x.isNotNull()), "")
    sizes = chats.select(F.col("conv_id").alias("of"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "first_bad")
    out = turns.join(sizes, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), loss.alias("loss"), "formatted_chars", "valid", "first_bad")
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars", "valid", "first_bad")


def probe(conversations: DataFrame) -> DataFrame:
    """Conversation -1: a user and an assistant row whose texts hold control strings."""
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    rows = conversations.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)
