"""Chat conversations as training text: one string per conversation with a loss mask, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the template: start, then per role what opens and closes its block. Other roles name themselves.
START = "<s>"
BLOCKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
ROLE, NAMED, ROLE_END = "[ROLE]", "[IS]", "[/ROLE]"
#: Between turns of one role, which share a block.
NEXT = "[AND]"
#: What a mark is made of: every one begins with < or [ and has neither further on, so none can arise where two strings meet.
BODIES = r"/?s>|(?:/?SYS|/?INST|OUT|/?ROLE|IS|AND)\]"
MARK = r"(?:</?s>|\[(?:/?SYS|/?INST|OUT|/?ROLE|IS|AND)\])"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    """The text with one more backslash behind the first character of whatever is a mark, or a mark so escaped before."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({BODIES})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    """Inverse of ``escaped``."""
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({BODIES})", "$1$2$3")


def _part(s: Column, loss: Column | bool = False) -> Column:
    return F.struct(s.alias("s"), (F.lit(loss) if isinstance(loss, bool) else loss).alias("loss"))


def _opening(role: Column) -> Column:
    """The parts before a block's first text."""
    found = F.array(_part(F.lit(ROLE)), _part(escaped(role)), _part(F.lit(NAMED)))
    for name, (mark, _) in BLOCKS.items():
        found = F.when(role == name, F.array(_part(F.lit(mark)))).otherwise(found)
    return found


def _closing(role: Column) -> Column:
    found = F.lit(ROLE_END)
    for name, (_, mark) in BLOCKS.items():
        found = F.when(role == name, F.lit(mark)).otherwise(found)
    return _part(found)


def format_chats(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask.

    Turns are collected as structs and sorted by turn (of equal turns by role, then
    text); neighbours of one role become one block, which holds the array of their
    texts. The template is ``<s>`` and a block after block; texts are escaped so that no
    mark within a text passes for one of the template. ``loss_mask`` tells the formatted
    string off in order as array<struct<chars int, loss boolean>>, code points and
    whether they are learned: just the assistant's (escaped) texts are.

    A null or missing text is empty, a null role the role ``''``; null turns come first;
    a null conv_id is one conversation; repeated rows are repeated turns; an empty table
    gives no rows; other columns aren't read. A conversation is one row of the result,
    so it is put together in one task and must fit in a row.
    """
    turns = chats.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    sorted_ = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    role_at = lambda i: F.element_at("t", i)["role"]
    first = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.when(i == 1, True).otherwise(role_at(i) != role_at(F.greatest(i - 1, F.lit(1)))))
    # starts holds each block's first turn and, last, the place behind the last turn
    starts = sorted_.withColumn("starts", F.concat(first, F.array(F.size("t") + 1)))
    block = lambda i: F.slice("t", F.element_at("starts", i), F.element_at("starts", i + 1) - F.element_at("starts", i))
    blocks = starts.select("conv_id", F.transform(F.sequence(F.lit(1), F.size("starts") - 1), lambda i: F.struct(role_at(F.element_at("starts", i)).alias("role"), F.transform(block(i), lambda t: t["text"]).alias("texts"))).alias("blocks"))

    def parts(b: Column) -> Column:
        texts = F.flatten(F.transform(b["texts"], lambda x, i: F.when(i == 0, F.array(_part(escaped(x), b["role"] == LEARNED))).otherwise(F.array(_part(F.lit(NEXT)), _part(escaped(x), b["role"] == LEARNED)))))
        return F.concat(_opening(b["role"]), texts, F.array(_closing(b["role"])))

    pieces = blocks.select("conv_id", F.concat(F.array(_part(F.lit(START))), F.flatten(F.transform("blocks", parts))).alias("parts"))
    return pieces.select("conv_id", F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("formatted"), F.transform("parts", lambda p: F.struct(F.length(p["s"]).alias("chars"), p["loss"].alias("loss"))).alias("loss_mask"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """The columns given and turns (array<struct<role, text>>) and learned (array<string>), read back from formatted and loss_mask alone.

    Blocks end at their closing marks and begin with what names their role. ``learned``
    is what lies under the mask: the string is cut at all marks, which are the mask's
    stretches but for the empty ones, so each stretch meets its flag by its place.
    """
    closing = "|".join(m.replace("[", r"\[").replace("]", r"\]") for m in [*(end for _, end in BLOCKS.values()), ROLE_END])
    blocks = F.filter(F.split(F.substring("formatted", len(START) + 1, 1 << 30), rf"(?<={closing})"), lambda b: b != "")

    def named(b: Column) -> Column:
        inner = F.substring(b, len(ROLE) + 1, F.length(b) - len(ROLE + ROLE_END))
        name = F.substring_index(inner, NAMED, 1)
        found = F.struct(unescaped(name).alias("role"), F.substring(inner, F.length(name) + (len(NAMED) + 1), F.length(inner)).alias("texts"))
        for role, (mark, end) in BLOCKS.items():
            own = F.struct(F.lit(role).alias("role"), F.substring(b, len(mark) + 1, F.length(b) - len(mark + end)).alias("texts"))
            found = F.when(b.startswith(mark), own).otherwise(found)
        return found

    each = lambda b: F.transform(F.split(b["texts"], NEXT.replace("[", r"\[").replace("]", r"\]")), lambda x: F.struct(b["role"].alias("role"), unescaped(x).alias("text")))
    stretches = F.filter(F.split("formatted", rf"(?<={MARK})|(?={MARK})"), lambda x: x != "")
    flags = F.filter("loss_mask", lambda m: m["chars"] > 0)
    told = formatted.withColumn("blocks", F.transform(blocks, named)).withColumn("cut", F.arrays_zip(stretches.alias("s"), flags.alias("m")))
    under = F.filter("cut", lambda z: z["m"]["loss"] & (F.length(z["s"]) == z["m"]["chars"]))
    return told.select(*formatted.columns, F.flatten(F.transform("blocks", each)).alias("turns"), F.transform(under, lambda z: unescaped(z["s"])).alias("learned"))
