"""Preference formatting: one prompt, two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discloscope.llm.common import without

# fixed values: marks of a rendered turn
START, END = "<|", "|>"
STOP = "<|end|>\n"


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``, the array of (role, text) in turn order.

    Turns of one number follow each other by role and text, repeated rows count once. A null role is ``user``, a null
    text is empty. Rows without a conversation are left out, as there is no turn order to put them in; a null turn
    number comes first.
    """
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit(END + "\n"))


def _body(turn: Column) -> Column:
    # a text cannot forge the marks
    return F.concat(F.replace(turn["text"], F.lit(START), F.lit("< |")), F.lit(STOP))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def assistant_spans(turns: Column) -> Column:
    """(start, end) in code points of what carries loss in the rendered turns: assistant texts with their stop mark."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(_head(turn))
        end = start + F.length(_body(turn))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(turn["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step)["spans"]


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Number of leading turns in which both conversations agree."""
    n = F.least(F.size(chosen), F.size(rejected))
    same = F.zip_with(F.slice(chosen, F.lit(1), n), F.slice(rejected, F.lit(1), n), lambda a, b: a == b)
    miss = F.array_position(same, False)
    return F.when(miss > 0, miss - 1).otherwise(n).cast("int")


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """All rows with ``n_prompt_turns``, ``prompt``, and per side the completion and its ``_spans``.

    ``chosen`` and ``rejected`` are arrays of (role, text). Their longest common turn prefix is rendered once as the
    prompt and carries no loss; what follows is rendered for each side, and only assistant texts, with their stop
    mark, are in the spans (code points of the completion). A side that is a prefix of the other, or equal to it,
    has an empty completion and no spans; so has a null side, which counts as no turns. Input columns that clash with
    the added names give way.
    """
    added = ["n_prompt_turns", "prompt", "chosen_completion", "chosen_spans", "rejected_completion", "rejected_spans"]
    none = F.array().cast("array<struct<role:string,text:string>>")
    pairs = without(pairs, *[a for a in added if a not in (chosen, rejected)])
    sides = {"chosen": F.coalesce(F.col(chosen), none), "rejected": F.coalesce(F.col(rejected), none)}
    n = F.col("n_prompt_turns")
    rest = {k: F.slice(v, n + 1, F.greatest(F.size(v) - n, F.lit(0))) for k, v in sides.items()}
    return pairs.withColumn("n_prompt_turns", common_turns(sides["chosen"], sides["rejected"])).select(
        "*", rendered(F.slice(sides["chosen"], F.lit(1), n)).alias("prompt"),
        rendered(rest["chosen"]).alias("chosen_completion"), assistant_spans(rest["chosen"]).alias("chosen_spans"),
        rendered(rest["rejected"]).alias("rejected_completion"), assistant_spans(rest["rejected"]).alias("rejected_spans"))


def reply_swaps(conversations: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations: ``conv_id``, ``chosen``, ``rejected``.

    The chosen side is the conversation; the rejected side has, in place of its last assistant reply, the last
    assistant reply of the conversation whose id is one higher (an empty reply if there is none). Conversations
    without an assistant turn give no pair.
    """
    turns = turns_of(conversations)
    last = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), "assistant").cast("int")
    named = turns.withColumn("_last", last).filter(F.col("_last") < F.size("turns"))
    others = named.select((F.col("conv_id") - 1).alias("conv_id"), F.get("turns", F.col("_last"))["text"].alias("_other"))
    joined = named.join(others, "conv_id", "left")
    swapped = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.when(
        i == F.col("_last"), F.coalesce("_other", F.lit(""))).otherwise(t["text"]).alias("text")))
    return joined.select("conv_id", F.col("turns").alias("chosen"), swapped.alias("rejected"))
