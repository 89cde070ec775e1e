"""Operator 10: preference formatting of chosen and rejected conversations.

The longest run of first turns that both conversations of a pair share (same
role and text) is rendered once as the prompt; what follows is each side's
completion, with a mask of the spans, in code points of the completion, on
which a loss is taken: the texts of assistant turns and their end marks.

The prefix is found by aligning the two sides turn by turn in one grouping and
taking the first place where they differ; each turn is rendered where it lies,
and only then do a pair's turns meet in the row that the result asks for.

Defined cases: turns are ordered by turn, then role, then text; repeated rows
count once; a null role or text is an empty string; turns without a
conversation id are in no pair; a pair without one side has an empty prompt and
an empty completion for that side; equal conversations are all prompt and have
two empty completions; an empty table gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEARNED_ROLE = "assistant"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def adjacent_pairs(turns: DataFrame) -> DataFrame:
    """Turns with (pair_id, side): conversations 2n and 2n + 1 form pair n, the even one is the chosen side."""
    side = F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected")
    return turns.withColumn("pair_id", F.floor(F.col("conv_id") / 2).cast("long")).withColumn("side", side)


def format_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask).

    turns has pair_id, side ("chosen" or "rejected"), turn, role, text; masks are
    arrays of (start, end).
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    order = W.partitionBy("pair_id", "side").orderBy("turn", "role", "text")
    placed = (
        turns.filter(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected"))
        .select("pair_id", "side", "turn", role.alias("role"), text.alias("text"))
        .distinct()
        .withColumn("place", F.row_number().over(order))
    )
    sides = [F.max(F.when(F.col("side") == s, F.struct("role", "text"))).alias(s) for s in ("chosen", "rejected")]
    # Grouping by (pair, place) keeps the turns of a long conversation apart.
    aligned = placed.groupBy("pair_id", "place").agg(*sides)
    same = F.col("chosen").isNotNull() & F.col("rejected").isNotNull() & (F.col("chosen") == F.col("rejected"))
    entry = F.struct("place", same.alias("same"), "chosen", "rejected")
    grouped = aligned.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(entry)).alias("turns"),
        (F.coalesce(F.min(F.when(~same, F.col("place"))), F.max("place") + 1) - 1).cast("long").alias("n_prompt_turns"),
    )

    def joined(side: str, keep) -> Column:
        kept = F.filter("turns", lambda t: keep(t["place"]) & t[side].isNotNull())
        return F.array_join(F.transform(kept, lambda t: rendered(t[side]["role"], t[side]["text"])), "")

    def mask(side: str) -> Column:
        kept = F.filter("turns", lambda t: (t["place"] > F.col("n_prompt_turns")) & t[side].isNotNull())
        sizes = F.transform(
            kept,
            lambda t: F.struct(
                (F.length(t[side]["role"]) + 5).cast("long").alias("head"),
                F.length(rendered(t[side]["role"], t[side]["text"])).cast("long").alias("size"),
                (t[side]["role"] == LEARNED_ROLE).alias("learned"),
            ),
        )
        kind = "struct<at:bigint,out:array<struct<start:bigint,end:bigint>>>"
        begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out")).cast(kind)

        def add(state: Column, t: Column) -> Column:
            span = F.struct((state["at"] + t["head"]).alias("start"), (state["at"] + t["size"] - 1).alias("end"))
            out = F.when(t["learned"], F.concat(state["out"], F.array(span))).otherwise(state["out"])
            return F.struct((state["at"] + t["size"]).alias("at"), out.alias("out")).cast(kind)

        return F.aggregate(sizes, begin, add)["out"]

    n = F.col("n_prompt_turns")
    return grouped.select(
        "pair_id",
        "n_prompt_turns",
        joined("chosen", lambda place: place <= n).alias("prompt"),
        joined("chosen", lambda place: place > n).alias("chosen"),
        mask("chosen").alias("chosen_mask"),
        joined("rejected", lambda place: place > n).alias("rejected"),
        mask("rejected").alias("rejected_mask"),
    )


def listed(mask: str) -> Column:
    return F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
