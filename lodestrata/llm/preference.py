"""Preference formatting of conversations: one prompt, and a pair of masked completions.

A chosen and a rejected conversation are compared turn by turn. Their longest common prefix of
turns is rendered once, as the prompt; what follows in each is its completion. A completion's
mask is a list of [start, end) offsets, in characters, of what the assistant says with its end
marker; only there a loss applies. All of it is built of array functions, so nothing leaves the JVM.

`pairs` makes preference pairs of single conversations: the chosen one is the conversation up to
its last assistant turn; the rejected one answers there with the latest earlier assistant turn of
another text or, if there is none, with the first half of the words of the chosen answer (rounded down).

Defined results: turns with a null conv_id are left out, and so are conversations without an
assistant turn. A null role counts as '' and a null text as '', in `render` too; there null turns are left out, and a
null conversation is one without turns. Turns are ordered by turn (nulls
first), ties by role and text; rows that are wholly equal are one. If both conversations are equal
in every turn, the prompt is all of them and both completions are empty. If they share no turn,
the prompt is empty. Texts are rendered whole, however long. An empty table gives no rows. Other columns are ignored
by `pairs`; `render` passes them through, but for those that have the name of one of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.session import fresh

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(CLOSE))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """Offsets of the assistant's words and end markers in the rendered turns."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("spans"))

    def step(seen: Column, turn: Column) -> Column:
        head = seen["at"] + len(OPEN) + F.length(turn["role"]) + 1
        end = seen["at"] + F.length(_rendered(turn))
        spans = F.when(turn["role"] == ASSISTANT, F.concat(seen["spans"], F.array(F.array(head.cast("long"), end.cast("long"))))).otherwise(seen["spans"])
        return F.struct(end.cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda seen: seen["spans"])


def _sound(turns: Column) -> Column:
    """The turns without nulls."""
    turn = "array<struct<role: string, text: string>>"
    whole = F.filter(F.coalesce(turns, F.array().cast(turn)), lambda t: t.isNotNull())
    return F.transform(whole, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def render(pairs: DataFrame) -> DataFrame:
    """The rendered prompt, completions and masks of rows with `chosen` and `rejected` (arrays of (role, text)).

    Other columns stay as they are, in front.
    """
    own = ("chosen", "rejected", "prompt_turns", "prompt", *(f"{x}_{y}" for x in ("chosen", "rejected") for y in ("completion", "mask")))
    others = [c for c in pairs.columns if c.lower() not in own]
    chosen, rejected, shared = (fresh(c, pairs.columns) for c in ("good", "bad", "shared"))
    plain = pairs.select(*(f"`{c}`" for c in others), _sound(pairs["chosen"]).alias(chosen), _sound(pairs["rejected"]).alias(rejected))
    agree = F.zip_with(chosen, rejected, lambda a, b: F.coalesce(a == b, F.lit(False)))
    cut = plain.withColumn(shared, (F.array_position(F.concat(agree, F.array(F.lit(False))), False) - 1).cast("int"))
    tail = {name: F.slice(name, F.col(shared) + 1, F.greatest(F.size(name) - F.col(shared), F.lit(0))) for name in (chosen, rejected)}
    return cut.select(
        *(f"`{c}`" for c in others),
        F.col(shared).cast("long").alias("prompt_turns"),
        _text(F.slice(chosen, F.lit(1), F.col(shared))).alias("prompt"),
        _text(tail[chosen]).alias("chosen_completion"),
        _mask(tail[chosen]).alias("chosen_mask"),
        _text(tail[rejected]).alias("rejected_completion"),
        _mask(tail[rejected]).alias("rejected_mask"),
    )


def conversations_as_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_set(turn)).alias("turns"))
    return turns.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected) of every conversation that has an assistant turn."""
    turns = conversations_as_turns(conversations)
    last = F.size("turns") - F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"]), ASSISTANT) + 1
    spoken = turns.where(F.exists("turns", lambda t: t["role"] == ASSISTANT)).withColumn("last", last.cast("int"))
    spoken = spoken.select("conv_id", F.slice("turns", F.lit(1), F.col("last")).alias("chosen"), F.slice("turns", F.lit(1), F.col("last") - 1).alias("before"))
    answer = F.element_at("chosen", -1)["text"]
    earlier = F.filter("before", lambda t: (t["role"] == ASSISTANT) & (t["text"] != answer))
    words = F.split(answer, " ")
    half = F.array_join(F.slice(words, F.lit(1), F.floor(F.size(words) / 2).cast("int")), " ")
    stale = F.when(F.size(earlier) > 0, F.try_element_at(earlier, F.lit(-1))["text"]).otherwise(half)
    return spoken.select("conv_id", "chosen", F.concat("before", F.array(F.struct(F.lit(ASSISTANT).alias("role"), stale.alias("text")))).alias("rejected"))
