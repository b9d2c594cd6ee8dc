"""Preference formatting: a shared prompt, and the chosen and rejected completions with loss masks.

Input are pairs of conversations, turn by turn. The longest common prefix of turns (same place, role
and text) is found by one aggregate over the turns: the first place where the two sides differ. It is
rendered once as prompt; what follows is rendered per side, with a mask span (begin and end characters
within the completion) for every assistant turn, the only text that a loss is taken on.

Defined results: a null role or text counts as empty; turns of one conversation at the same place are
ordered by role and text; gaps in places do not matter, turns are numbered anew; where one side is the
begin of the other, its completion is empty; where both are equal the whole conversation is prompt; a
conversation without a partner is in no pair. ``usable`` says that both sides have a masked span and
differ. A turn list is one record of training data, as long as its conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: How a turn is rendered.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n"
TRAINED = "assistant"


def turn_lists(turns: DataFrame, nameless: bool = False) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (role, text).

    With ``nameless`` the turns without an id are one conversation, too; else they are left out.
    """
    text = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (
        turns.filter(F.lit(nameless) | F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(text)).alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    )


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def _head(turn: Column) -> Column:
    return F.length(turn["role"]) + len(OPEN) + len(MIDDLE)


def masks(turns: Column) -> Column:
    """(begin, end) of the text of every trained turn within the rendered turns."""
    spans = F.transform(turns, lambda t, k: F.struct(
        (F.aggregate(F.slice(turns, 1, k), F.lit(0), lambda a, x: a + _head(x) + F.length(x["text"]) + len(CLOSE)) + _head(t)).alias("begin"),
        F.length(t["text"]).alias("length"), (t["role"] == TRAINED).alias("trained")))
    return F.transform(F.filter(spans, lambda s: s["trained"] & (s["length"] > 0)),
                       lambda s: F.struct(s["begin"].alias("begin"), (s["begin"] + s["length"]).alias("end")))


def formatted(pairs: DataFrame) -> DataFrame:
    """``pairs`` (pair_id, chosen, rejected: lists of turns) as prompt, completions and masks."""
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce(a == b, F.lit(False)))
    # The first place that differs; the lists are padded to equal length, and null equals nothing.
    first = F.array_position(same, F.lit(False))
    prefix = F.when(first == 0, F.size("chosen")).otherwise(first - 1).cast("int")
    cut = pairs.withColumn("prefix", prefix)

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col("prefix") + 1, F.greatest(F.size(side) - F.col("prefix"), F.lit(0)))

    cut = cut.withColumns({"prompt": rendered(F.slice("chosen", 1, F.col("prefix"))), "c": rest("chosen"), "r": rest("rejected")})
    cut = cut.withColumns({
        "chosen_text": rendered(F.col("c")), "rejected_text": rendered(F.col("r")),
        "chosen_mask": masks(F.col("c")), "rejected_mask": masks(F.col("r")),
    })
    return cut.select(
        "pair_id", F.col("prefix").alias("prefix_turns"), "prompt", "chosen_text", "rejected_text", "chosen_mask", "rejected_mask",
        ((F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0) & (F.col("chosen_text") != F.col("rejected_text"))).alias("usable"))


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs for data without preferences: a conversation is chosen over its own begin with the last
    trained answer of the neighbouring conversation (even and odd ids) in place of its own.

    The join key is unique on both sides.
    """
    lists = turn_lists(conversations)
    trained = F.transform("turns", lambda t, k: F.when(t["role"] == TRAINED, k))
    lists = lists.withColumn("last", F.array_max(trained)).filter("last IS NOT NULL")
    other = lists.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.get("turns", F.col("last")).alias("answer"))
    return lists.join(other, "conv_id").select(
        F.col("conv_id").alias("pair_id"), F.slice("turns", 1, F.col("last") + 1).alias("chosen"),
        F.concat(F.slice("turns", 1, F.col("last")), F.array("answer")).alias("rejected"))


def whole_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs of whole conversations, one for each: it is chosen over the next in order of ids, the last
    over the first. Where there is no other, the rejected side is empty, so the pair is not usable.

    The next id is found inside ranges of ids, which are even because ids are unique here; the first id
    of each range is all that the driver sees.
    """
    key = F.struct(F.col("conv_id").isNotNull().alias("named"), F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("id"))
    lists = stored(turn_lists(conversations, nameless=True).withColumn("key", key))
    ids = stored(lists.select("key").repartitionByRange("key").select("key", F.spark_partition_id().alias("range")))
    firsts = sorted((r["range"], tuple(r["first"])) for r in ids.groupBy("range").agg(F.min("key").alias("first")).collect())
    after = lists.sparkSession.createDataFrame(
        [(at, firsts[(k + 1) % len(firsts)][1]) for k, (at, _) in enumerate(firsts)], "range int, first struct<named:boolean,id:bigint>")
    following = F.lead("key").over(Window.partitionBy("range").orderBy("key"))
    partners = ids.withColumn("next", following).join(after, "range").select("key", F.coalesce("next", "first").alias("partner"))
    other = lists.select(F.col("key").alias("partner"), F.col("turns").alias("other"))
    return lists.join(partners, "key").join(other, "partner").select(
        F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"),
        F.when(F.col("key") != F.col("partner"), F.col("other")).otherwise(F.slice("turns", 1, 0)).alias("rejected"))
