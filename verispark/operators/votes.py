"""Votes of several reasoners: majority, agreement, grounding in evidence.

The reasoners of a claim are a short fixed roster; their votes meet in one row per claim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispark.functions.text import TOKEN_BREAK

GROUNDING_RATIO = 1.3  # fixed value: how much better a minority must be grounded
MIN_TERM = 3  # fixed value: terms are longer than this


# Lines of the report for the consolidator.
REPORT_TITLE = "Wstępna analiza grounding'u (automatyczna):"
EXPERT_LINE = "  - Ekspert %s: %s odwołań do artykułów z kontekstu, odpowiedź: %s"
MAJORITY_LINE = "  Większość (%s/3) wybrała: %s."
MINORITY_LINE = "  ⚠ Ekspert %s (mniejszość) ma wyższy grounding (%s) niż średnia większości (%s). Rozważ jakość argumentów."


def vote_summary(votes: DataFrame) -> DataFrame:
    """Labels in style order, number of votes, majority label (ties: the one seen first) and its count."""
    per = votes.groupBy("claim_id", "label").agg(
        F.count("*").alias("_n"), F.min("style_no").alias("_first"), F.collect_list("style_no").alias("_styles"))
    ballots = F.array_sort(F.flatten(F.collect_list(
        F.transform("_styles", lambda s: F.struct(s.alias("style_no"), F.col("label"))))))
    best = F.max(F.struct("_n", (-F.col("_first")).alias("_f"), "label"))
    return per.groupBy("claim_id").agg(
        F.array_join(F.transform(ballots, lambda b: b["label"]), ",").alias("labels"),
        F.sum("_n").alias("n_votes"),
        F.count("*").alias("n_labels"),
        best["label"].alias("majority_label"),
        best["_n"].alias("majority_count"),
    )


def unanimous_fast_path(votes: DataFrame, key: str = "claim_id") -> DataFrame:
    """`label` where all votes agree; the others need a consolidator."""
    same = F.min("label") == F.max("label")
    return votes.groupBy(key).agg(
        same.cast("int").alias("unanimous"), F.when(same, F.min("label")).alias("label"),
        (~same).cast("int").alias("needs_consolidation"))


def evidence_terms(evidence: DataFrame) -> DataFrame:
    """Distinct longer words of the titles and sections of a claim's evidence."""
    words = F.split(F.lower(F.concat_ws(" ", "title", "section")), TOKEN_BREAK)
    return (
        evidence.select("claim_id", F.explode(words).alias("term")).filter(F.length("term") > MIN_TERM)
        .groupBy("claim_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    )


def evidence_grounding(votes: DataFrame, evidence: DataFrame) -> DataFrame:
    """`score`: how many evidence terms occur in the reasoning of each vote."""
    terms = evidence_terms(evidence)
    text = F.lower("reasoning")
    named = votes.join(terms, "claim_id", "left").withColumn("_text", text)
    score = F.coalesce(F.size(F.filter("terms", lambda t: F.contains(F.col("_text"), t))), F.lit(0))
    return named.withColumn("score", F.when(F.col("terms").isNull(), 0).otherwise(score)).withColumn(
        "n_terms", F.coalesce(F.size(F.coalesce("terms", F.array().cast("array<string>"))), F.lit(0))
    ).drop("_text", "terms")


def _panels(grounded: DataFrame) -> DataFrame:
    """One row per claim: votes in style order, majority label and count, mean score of the majority."""
    vote = F.struct("style_no", "label", "score")
    packed = grounded.groupBy("claim_id").agg(F.array_sort(F.collect_list(vote)).alias("votes"), F.max("n_terms").alias("n_terms"))

    def count(lab: Column) -> Column:
        return F.size(F.filter("votes", lambda v: v["label"] == lab))

    ranked = F.transform("votes", lambda v, i: F.struct(count(v["label"]).alias("n"), (-i).alias("first"), v["label"].alias("label")))
    panel = packed.withColumn("_best", F.array_max(ranked))
    panel = panel.select(
        "claim_id", "votes", "n_terms", F.col("_best.label").alias("majority_label"), F.col("_best.n").alias("majority_count"))
    total = F.aggregate(
        F.filter("votes", lambda v: v["label"] == F.col("majority_label")), F.lit(0.0), lambda acc, v: acc + v["score"])
    return panel.withColumn("majority_score", total / F.col("majority_count"))


def _better_grounded(v: Column) -> Column:
    return (
        (F.col("majority_count") >= 2) & (v["label"] != F.col("majority_label"))
        & (v["score"] > F.col("majority_score") * GROUNDING_RATIO)
    )


def grounded_minority(grounded: DataFrame) -> DataFrame:
    """Votes against the majority that are clearly better grounded than it."""
    rows = _panels(grounded).withColumn("_found", F.filter("votes", _better_grounded))
    return rows.select(
        "claim_id", "majority_label", F.round("majority_score", 6).alias("majority_score"), F.inline("_found"))


def grounding_report(grounded: DataFrame) -> DataFrame:
    """Text for the consolidator; empty when the votes agree or there are no terms."""
    panel = _panels(grounded)

    def name(v: Column) -> Column:
        return v["style_no"].cast("string")

    mean = F.bround("majority_score", 0).cast("int").cast("string")
    lines = F.transform("votes", lambda v: F.format_string(EXPERT_LINE, name(v), v["score"].cast("string"), F.coalesce(v["label"], F.lit(""))))
    majority = F.when(F.col("majority_count") >= 2, F.array(
        F.format_string(MAJORITY_LINE, F.col("majority_count").cast("string"), F.col("majority_label"))))
    alerts = F.transform(F.filter("votes", _better_grounded), lambda v: F.format_string(MINORITY_LINE, name(v), v["score"].cast("string"), mean))
    none = F.array().cast("array<string>")
    body = F.concat(F.array(F.lit(REPORT_TITLE)), lines, F.coalesce(majority, none), alerts)
    differ = (F.col("majority_count") < F.size("votes")) & (F.col("n_terms") > 0)
    return panel.select("claim_id", F.when(differ, F.array_join(body, "\n")).otherwise("").alias("report"))


def low_confidence(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`confident`: the entailment score, 1 when there is none, reaches the threshold."""
    score = F.coalesce("nli_score", F.lit(1.0))
    return scored.withColumn("nli_score", score).withColumn("confident", (score >= threshold).cast("int"))
