"""Damaged labels: reports, recovery from trajectories, the three repair passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verispark.functions.jsontext import mined_label
from verispark.functions.labels import (
    ERROR,
    ERROR_MAX_STEPS,
    FIXABLE_CLASSES,
    LABEL_CLASSES,
    UNFIXABLE,
    classify_label,
    fix_label,
    is_standard,
    valid_for_agent,
)
from verispark.functions.text import compute_once, strip


def classify_labels(results: DataFrame) -> DataFrame:
    return results.withColumn("label_class", classify_label(F.col("model_label"), F.col("agent_name")))


def corruption_report(results: DataFrame) -> DataFrame:
    """Rows and share per class; classes without rows are listed too."""
    spark = results.sparkSession
    classes = spark.createDataFrame([(c, i) for i, c in enumerate(LABEL_CLASSES)], "label_class string, class_no int")
    counts = classify_labels(results).groupBy("label_class").agg(F.count("*").alias("_n"))
    listed = classes.join(counts, "label_class", "left")
    n = F.coalesce("_n", F.lit(0))
    total = counts.agg(F.sum("_n").alias("_total"))  # one row
    return listed.crossJoin(total).select(
        "class_no", "label_class", n.alias("n"), F.round(n / F.col("_total") * 100, 6).alias("pct"))


def corruption_totals(results: DataFrame) -> DataFrame:
    cls = classify_label(F.col("model_label"), F.col("agent_name"))
    return results.agg(
        F.count("*").alias("n_rows"),
        F.count(F.when(cls != "valid", 1)).alias("n_nonstandard"),
        F.count(F.when(cls.isin(*FIXABLE_CLASSES), 1)).alias("n_fixable"),
    )


def results_overview(results: DataFrame) -> DataFrame:
    return results.groupBy("agent_name").agg(F.count("*").alias("n"))


def nonstandard_labels(results: DataFrame) -> DataFrame:
    """Per odd label: rows and the agents that gave it."""
    odd = results.filter(~is_standard(F.col("model_label")))
    return odd.groupBy("model_label").agg(
        F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("agent_name")), ",").alias("agents"))


def mine_trajectory_label(results: DataFrame) -> DataFrame:
    """`mined`: label found in `raw_output`, NULL when there is none."""
    return results.withColumn("mined", mined_label(F.col("raw_output")))


def recovery_estimate(results: DataFrame) -> DataFrame:
    stuck = compute_once(results.filter(F.col("model_label") == ERROR_MAX_STEPS), "_found", mined_label(F.col("raw_output")))
    good = F.coalesce(valid_for_agent(F.col("_found"), F.col("agent_name")), F.lit(False))
    return stuck.agg(
        F.count("*").alias("n_max_steps"),
        F.count(F.when(good, 1)).alias("n_recoverable"),
        F.count(F.when(~good, 1)).alias("n_rerun"),
    )


def error_samples(results: DataFrame) -> DataFrame:
    """Per agent: number of ERROR rows and the start of the earliest one's output."""
    return results.filter(F.col("model_label") == ERROR).groupBy("agent_name").agg(
        F.count("*").alias("n"), F.min_by(F.substring("raw_output", 1, 120), "id").alias("sample"))


def _with_new_label(df: DataFrame, new) -> DataFrame:
    df = compute_once(df, "_new", new)
    return (
        df.withColumn("is_correct", F.when(F.col("_new").isNull(), F.col("is_correct")).otherwise(
            (F.col("_new") == strip(F.col("original_label"))).cast("int")))
        .withColumn("model_label", F.coalesce("_new", "model_label"))
        .drop("_new")
    )


def _odd(label):
    """Neither a label nor one of the error marks; a NULL label is odd."""
    return F.coalesce(~is_standard(label) & ~label.isin(ERROR, ERROR_MAX_STEPS), F.lit(True))


def fix_labels(results: DataFrame, strict: bool = False) -> DataFrame:
    """Pass 1: number, prefix or list label to a digit, when valid for the agent."""
    new = F.when(_odd(F.col("model_label")), fix_label(F.col("model_label"), F.col("agent_name"), strict))
    return _with_new_label(results, new)


def recover_max_steps(results: DataFrame) -> DataFrame:
    """Pass 2: a valid label from the trajectory of a run that reached its last step."""
    found = F.when(F.col("model_label") == ERROR_MAX_STEPS, mined_label(F.col("raw_output")))
    work = compute_once(results, "_found", found)
    new = F.when(valid_for_agent(F.col("_found"), F.col("agent_name")), F.col("_found"))
    return _with_new_label(work, new).drop("_found")


def is_unfixable(label):
    """To be run again; a NULL label is one of these and counted under NULL."""
    return F.coalesce(label.isin(*UNFIXABLE), F.lit(False)) | _odd(label)


def drop_unfixable(results: DataFrame) -> DataFrame:
    """Pass 3: rows to be run again are removed."""
    return results.filter(~is_unfixable(F.col("model_label")))


def unfixable_counts(results: DataFrame) -> DataFrame:
    """Rows removed by pass 3 per label; each row counts once."""
    return results.filter(is_unfixable(F.col("model_label"))).groupBy("model_label").agg(F.count("*").alias("n"))


def repair_plan(results: DataFrame, skip_mining: bool = False, strict: bool = False) -> DataFrame:
    """What a repair would do, one row per changed result: id, old and new label, pass, action.

    Every pass is an expression on its row, so the plan is one scan without a shuffle. Pass 3
    looks at the labels after passes 1 and 2.
    """
    label, agent = F.col("model_label"), F.col("agent_name")
    fixed = F.when(_odd(label), fix_label(label, agent, strict))
    work = compute_once(results, "_fix", fixed)
    mined = F.lit(None).cast("string") if skip_mining else F.when(label == ERROR_MAX_STEPS, mined_label(F.col("raw_output")))
    work = compute_once(work, "_found", mined)
    work = work.withColumn("_mined", F.when(valid_for_agent(F.col("_found"), agent), F.col("_found")))
    new = F.coalesce("_fix", "_mined")
    pass_no = (
        F.when(F.col("_fix").isNotNull(), 1)
        .when(F.col("_mined").isNotNull(), 2)
        .when(is_unfixable(label), 3)
    )
    return work.withColumn("pass_no", pass_no).filter("pass_no IS NOT NULL").select(
        "id", "agent_name", label.alias("old_label"), new.alias("new_label"), "pass_no",
        F.when(F.col("pass_no") == 3, "delete").otherwise("update").alias("action"),
    )


def repair_results(results: DataFrame, skip_mining: bool = False, strict: bool = False) -> DataFrame:
    """The repaired table."""
    out = fix_labels(results, strict)
    if not skip_mining:
        out = recover_max_steps(out)
    return drop_unfixable(out)


def repair_summary(results: DataFrame, skip_mining: bool = False) -> DataFrame:
    plan = repair_plan(results, skip_mining)
    left = repair_results(results, skip_mining).agg(
        F.count(F.when(F.col("model_label") == ERROR_MAX_STEPS, 1)).alias("max_steps_left"))
    return plan.agg(
        F.count(F.when(F.col("pass_no") == 1, 1)).alias("fixed_labels"),
        F.count(F.when(F.col("pass_no") == 2, 1)).alias("recovered"),
        F.count(F.when(F.col("pass_no") == 3, 1)).alias("deleted"),
    ).crossJoin(left)  # one row each
