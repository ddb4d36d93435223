"""Recorded model answers to labels: sub-claim lists, turn logs, scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verispark.functions.jsontext import parse_json_list, valid_json_block
from verispark.functions.labels import ERROR, ERROR_MAX_STEPS, normalize_uam_label

MAX_STEPS = 5  # fixed value
WEB_MAX_STEPS = 8  # fixed value: agents that search the web


def explode_subclaims(answers: DataFrame, raw: str = "raw", claim_text: str = "claim_text") -> DataFrame:
    """(claim_id, pos, sub_claim): items of the answer's list, or the claim itself when there are none."""
    items = parse_json_list(F.col(raw))
    used = F.when(F.size(items) > 0, items).otherwise(F.array(F.col(claim_text)))
    return answers.select("claim_id", F.posexplode(used).alias("pos", "sub_claim"))


def final_answer(content: Column) -> Column:
    """Label of a turn that ends the run, ERROR when it names none, NULL for every other turn."""
    block = valid_json_block(content)
    shown = F.to_json(F.try_variant_get(F.try_parse_json(block), "$.action_input.label", "variant"))
    # Missing, empty, zero and false count as no label.
    empty = shown.isNull() | shown.isin('""', "0", "0.0", "false", "null", "[]", "{}")
    label = F.when(empty, F.lit(ERROR)).otherwise(F.get_json_object(block, "$.action_input.label"))
    return F.when(F.get_json_object(block, "$.action") == "final_answer", label)


def react_outcome(steps: DataFrame, max_steps: int = MAX_STEPS, normalize: bool = False) -> DataFrame:
    """One row per run (agent_name, claim_id) from its turn log (step from 0, content, tokens).

    The first final answer within `max_steps` gives the label; runs without one get
    ERROR_MAX_STEPS. Tokens are added up to the step that ended the run. At most `max_steps`
    rows per run are kept, so the window is small.
    """
    keys = ["agent_name", "claim_id"]
    label = final_answer(F.col("content"))
    if normalize:
        label = normalize_uam_label(label)
    tokens = ("total_tokens", "prompt_tokens", "completion_tokens")
    turns = steps.filter(F.col("step") < max_steps).select(*keys, "step", *tokens, label.alias("_label"))
    run = W.partitionBy(*keys)
    ended = F.min(F.when(F.col("_label").isNotNull(), F.col("step"))).over(run)
    used = turns.withColumn("_end", ended).filter(F.col("_end").isNull() | (F.col("step") <= F.col("_end")))
    return used.groupBy(*keys).agg(
        F.coalesce(F.max("_label"), F.lit(ERROR_MAX_STEPS)).alias("model_label"),
        F.count("*").cast("int").alias("n_steps"),
        *[F.sum(t).cast("bigint").alias(t) for t in tokens],
    )


def is_correct(predicted: Column, truth: Column, ignore_case: bool = False) -> Column:
    """Exact match, or without regard to case for verbal labels."""
    hit = F.upper(predicted) == F.upper(truth) if ignore_case else predicted == truth
    return F.coalesce(hit, F.lit(False)).cast("int")
