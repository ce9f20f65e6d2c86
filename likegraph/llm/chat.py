"""Preference pairs of conversations: a common prompt rendered once, and two completions with masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likegraph.llm.arrays import running_totals

# Fixed values of a public chat format.
OPEN, ROLE_END, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns (turn, role, text) in order of turn; ties by role and text.

    A conversation is one row of the result, as it is one text in the end. Null roles and texts are empty.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))


def _rendered(x: Column) -> Column:
    return F.concat(F.lit(OPEN), x["role"], F.lit(ROLE_END), x["text"], F.lit(CLOSE))


def _mask(part: Column, learned: str) -> Column:
    """[from, to) in code points of the rendered part: what the learned role says, with its end mark."""
    totals = running_totals(F.transform(part, lambda x: F.length(_rendered(x)).cast("long")))
    span = lambda x, end: F.struct(x["role"].alias("role"), (end - F.length(F.concat(x["text"], F.lit(CLOSE)))).cast("long").alias("from"), (end - len(CLOSE) + len(CLOSE.rstrip())).cast("long").alias("to"))
    spans = F.zip_with(part, totals, span)
    return F.transform(F.filter(spans, lambda s: s["role"] == learned), lambda s: F.struct(s["from"], s["to"]))


def preferences(chosen: DataFrame, rejected: DataFrame, learned: str = "assistant") -> DataFrame:
    """Chosen and rejected conversations of ``turns``, by conv_id: n_common, prompt, chosen, chosen_mask, rejected, rejected_mask.

    The prompt is the longest run of turns, from the first, that have equal role and text in both. What
    follows is each side's completion, empty where that side ends with the prompt. A conversation of one
    side only is not a pair and is left out; null ids match each other.
    """
    a, b = chosen.select(F.col("conv_id"), F.col("turns").alias("c")), rejected.select(F.col("conv_id").alias("other"), F.col("turns").alias("r"))
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False)
    pairs = a.join(b, F.col("conv_id").eqNullSafe(F.col("other"))).withColumn("n", F.when(first > 0, first - 1).otherwise(F.size("c")).cast("int"))
    rest = lambda x: F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0)))
    text = lambda part: F.array_join(F.transform(part, _rendered), "")
    return pairs.select("conv_id", F.col("n").alias("n_common"), text(F.slice("c", 1, F.col("n"))).alias("prompt"), rest("c").alias("c"), rest("r").alias("r")).select(
        "conv_id", "n_common", "prompt", text(F.col("c")).alias("chosen"), _mask(F.col("c"), learned).alias("chosen_mask"), text(F.col("r")).alias("rejected"), _mask(F.col("r"), learned).alias("rejected_mask")
    )


def with_other_answers(convs: DataFrame) -> DataFrame:
    """Conversations of ``turns`` with the text of the last assistant turn taken from the conversation of the next id (conv_id + 1; none: empty).

    Where ids repeat or conversations lack such a turn, the least text of the next id counts, and turns
    stay as they are.
    """
    last = F.array_max(F.transform(F.filter(F.transform("turns", lambda x, i: F.struct(x["role"].alias("role"), i.alias("i"))), lambda s: s["role"] == "assistant"), lambda s: s["i"]))
    known = convs.withColumn("at", last)
    answer = known.filter("at is not null").select((F.col("conv_id") - 1).alias("conv_id"), F.element_at("turns", F.col("at") + 1)["text"].alias("answer"))
    joined = known.join(answer, "conv_id", "left")
    return joined.select("conv_id", F.transform("turns", lambda x, i: F.when(i == F.col("at"), x.withField("text", F.coalesce("answer", F.lit("")))).otherwise(x)).alias("turns"))
