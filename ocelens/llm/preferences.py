"""Preference formatting of chosen and rejected conversations (operator 8).

The longest common prefix of turns is rendered once as the prompt; what follows in either
conversation is its completion, in which only the assistant's turns are trained on. The
result has one row per rendered turn, so a conversation with very many turns is spread over
many tasks; ``assembled`` joins the turns of a pair where a training row is wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocelens.functions.ordering import with_rank, with_rank_in_group
from ocelens.session import materialise


def preference_turns(chosen: DataFrame, rejected: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(pair_id, part, position, role, text, rendered, trained, prompt_turns).

    Columns read on both sides: pair_id, turn, role, text. Turns are taken in the order of
    (turn, role, text); exact repetitions of a row count once, so numbering may have gaps
    and ties. Null roles and texts are empty. Rows without a pair_id belong to no pair and
    are left out. ``part`` is prompt, chosen or rejected; ``position`` counts from 0 within
    the conversation; a prompt turn comes once. A pair with one side only has no prompt.
    Empty tables give no rows; a text of any length is rendered whole.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col("pair_id").isNotNull()).select(
            "pair_id",
            F.lit(name).alias("part"),
            F.col("turn").cast("long").alias("turn"),
            *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
        ).distinct()

    both = side(chosen, "chosen").unionByName(side(rejected, "rejected"))
    turns = materialise(with_rank_in_group(materialise(both), ["pair_id", "part"], ["turn", "role", "text"], by_ranges=True))
    said = F.struct("role", "text")
    at = turns.groupBy("pair_id", "position").agg(
        ((F.count("*") == 2) & (F.min(said) == F.max(said))).alias("_same"),
    )
    lengths = at.groupBy("pair_id").agg(
        F.coalesce(F.min(F.when(~F.col("_same"), F.col("position"))), F.max("position") + 1).alias("prompt_turns")
    )
    rows = turns.join(materialise(lengths), "pair_id")
    shared = F.col("position") < F.col("prompt_turns")
    return rows.where(~shared | (F.col("part") == "chosen")).select(
        "pair_id",
        F.when(shared, "prompt").otherwise(F.col("part")).alias("part"),
        "position",
        "role",
        "text",
        F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n")).alias("rendered"),
        (~shared & (F.col("role") == trained_role)).alias("trained"),
        "prompt_turns",
    )


def replaced_replies(conversations: DataFrame, trained_role: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) for data without preferences: a mismatched reply as the negative.

    Columns read: conv_id, turn, role, text. Chosen is every conversation; rejected is the
    same one with its last reply replaced by that of the next conversation that has one
    (the last takes the first one's). Where rows tie for the last reply, the greatest
    (turn, text) counts. A conversation without a reply is the same on both sides, so all
    of it is prompt. Rows without a conv_id are left out; an empty table gives none.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").alias("pair_id"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    )
    replies = rows.where(F.col("role") == trained_role).groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("_last"))
    ranked = materialise(with_rank(materialise(replies), ["pair_id"], "_rank"))
    n = ranked.count()
    following = ranked.select(F.expr(f"pmod(_rank - 1, {max(n, 1)}L)").alias("_rank"), F.col("_last.text").alias("_other"))
    swaps = materialise(ranked.join(following, "_rank").select("pair_id", "_last", "_other"))
    last = F.col("role").eqNullSafe(trained_role) & F.struct("turn", "text").eqNullSafe(F.col("_last"))
    rejected = rows.join(swaps, "pair_id", "left").select(
        "pair_id", "turn", "role", F.when(last, F.col("_other")).otherwise(F.col("text")).alias("text")
    )
    return rows, rejected


def assembled(turns: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, rejected, chosen_mask, rejected_mask): one training row per pair.

    A mask lists (length in characters, trained) of the turns of a completion.
    """
    picked = {part: F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("position", "rendered", "trained")))) for part in ("prompt", "chosen", "rejected")}
    rows = turns.groupBy("pair_id").agg(*[c.alias(f"_{p}") for p, c in picked.items()])
    mask = lambda p: F.transform(f"_{p}", lambda t: F.struct(F.length(t["rendered"]).alias("chars"), t["trained"].alias("trained")))
    return rows.select(
        "pair_id",
        *[F.array_join(F.col(f"_{p}.rendered"), "").alias(p) for p in picked],
        mask("chosen").alias("chosen_mask"),
        mask("rejected").alias("rejected_mask"),
    )
