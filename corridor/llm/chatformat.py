"""Preference formatting of paired conversations. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The roles whose turns are learned; all others are masked.
LEARNED = ("assistant",)


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _spans(turns: Column) -> Column:
    """start:end of every learned text inside the rendered turns, comma-joined; characters, end exclusive."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        begin = a["at"] + F.length(t["role"]) + 5
        end = begin + F.length(t["text"])
        own = F.concat_ws(":", begin.cast("string"), end.cast("string"))
        return F.struct((end + 8).alias("at"), F.when(t["role"].isin(*LEARNED), F.concat(a["spans"], F.array(own))).otherwise(a["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step, lambda a: a["spans"]), ",")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """Pairs of conversations to pair_id, prompt, chosen, rejected and their spans to learn.

    ``turns``: pair_id, chosen (boolean), turn, role, text. The longest common prefix of turns (equal role and text) is
    rendered once as prompt, the rest of either side as its completion; the spans say which characters of a completion
    count, as assistant texts do. Turns go by their number, then role and text; turns repeated in full count once.
    A null role is ``user``, a null text empty, a null turn comes first; other columns are ignored. A pair without one
    of its sides, or without pair_id, gives no row: nothing is preferred there. n_prefix is the number of common turns.
    Sides that are equal have empty completions. Repeats of a turn are dropped before rows meet, and a pair's turns then
    meet in one row, as a rendered conversation is one value.
    """
    clean = turns.where("pair_id is not null and chosen is not null").select(
        "pair_id", "chosen", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    side = F.struct("turn", "role", "text")
    sides = clean.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("chosen"), side))).alias("c"), F.array_sort(F.collect_list(F.when(~F.col("chosen"), side))).alias("r")
    ).where("size(c) > 0 and size(r) > 0")
    alike = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(alike, False)
    sides = sides.withColumn("n_prefix", F.when(first > 0, first - 1).otherwise(F.size(alike)).cast("int"))
    rest = {k: F.slice(k, F.col("n_prefix") + 1, F.size(k)) for k in ("c", "r")}
    sides = sides.select("pair_id", "n_prefix", F.slice("c", F.lit(1), F.col("n_prefix")).alias("p"), *[x.alias(k) for k, x in rest.items()])
    return sides.select(
        "pair_id",
        "n_prefix",
        F.array_join(F.transform("p", rendered), "").alias("prompt"),
        F.array_join(F.transform("c", rendered), "").alias("chosen"),
        F.array_join(F.transform("r", rendered), "").alias("rejected"),
        _spans(F.col("c")).alias("chosen_spans"),
        _spans(F.col("r")).alias("rejected_spans"),
    )


def paired(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as pairs: 2k is the chosen one of pair k and 2k + 1 the rejected one."""
    return conversations.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("chosen"), "turn", "role", "text")
