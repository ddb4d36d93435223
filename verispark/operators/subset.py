"""Comparable subsets: coverage, claims common to every run, restriction and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispark.operators.ordered import join_small, keep_first
from verispark.operators.results import KEY, base_agent


def sample_subset(claims: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """n claims, the same ones for the same seed: those with the smallest digest of id and seed."""
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    return claims.orderBy(digest, id_col).limit(n)


def run_pairs(results: DataFrame) -> DataFrame:
    return results.select(base_agent(F.col("agent_name")).alias("base_agent"), "model_name", "claim_id").distinct()


def coverage_matrix(results: DataFrame, models: Sequence[str]) -> DataFrame:
    """Distinct claims per base agent, one column per model."""
    return run_pairs(results).groupBy("base_agent").pivot("model_name", list(models)).count().na.fill(0)


def common_claims(results: DataFrame, agents: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Claim ids that every (agent, model) pair has."""
    pairs = run_pairs(results).filter(F.col("base_agent").isin(*agents) & F.col("model_name").isin(*models))
    return (
        pairs.groupBy("claim_id").agg(F.count("*").alias("_n"))
        .filter(F.col("_n") == len(agents) * len(models)).select("claim_id")
    )


def coverage_check(
    common: DataFrame, subset: DataFrame, results: DataFrame, agents: Sequence[str], models: Sequence[str]
) -> DataFrame:
    """Problems: common ids outside the subset, pairs without a common id, no common id at all."""
    outside = common.join(subset.select(F.col("id").alias("claim_id")), "claim_id", "left_anti").agg(
        F.count("*").alias("n")).select(F.lit("outside_subset").alias("problem"), F.lit("").alias("pair"), "n")
    listed = F.array(*[
        F.struct(F.lit(a).alias("base_agent"), F.lit(m).alias("model_name")) for a in agents for m in models])
    need = common.select("claim_id", F.inline(listed))
    gaps = need.join(run_pairs(results), ["claim_id", "base_agent", "model_name"], "left_anti")
    missing = gaps.groupBy("base_agent", "model_name").agg(F.count("*").alias("n")).select(
        F.lit("pair_missing").alias("problem"), F.concat_ws("/", "base_agent", "model_name").alias("pair"), "n")
    empty = common.agg(F.count("*").alias("c")).filter("c = 0").select(
        F.lit("no_common").alias("problem"), F.lit("").alias("pair"), F.col("c").alias("n"))
    return outside.filter("n > 0").unionByName(missing).unionByName(empty)


def restrict_results(
    results: DataFrame, common: DataFrame, benchmark: str, models: Sequence[str], order: Sequence[Column | str]
) -> DataFrame:
    """Rows of one benchmark, of the known models and common claims; the first per key."""
    kept = results.filter((F.col("benchmark_name") == benchmark) & F.col("model_name").isin(*models))
    # Repeated keys are cut before the shuffle; the claims are then few enough to be sent around.
    return join_small(keep_first(kept, KEY, order), common, ["claim_id"], "left_semi")


def enrich_claims(claims: DataFrame, common: DataFrame) -> DataFrame:
    """Common claims with `exam_type` from their metadata; NULL when it does not parse."""
    kept = claims.join(common.select(F.col("claim_id").alias("id")), "id", "left_semi")
    meta = F.when(F.try_parse_json("metadata").isNotNull(), F.col("metadata"))
    return kept.select(
        "id", "claim_text", "topic", "claim_date", "label_original",
        F.get_json_object(meta, "$.exam_type").alias("exam_type"), "metadata")


def validate_subset(restricted: DataFrame, common: DataFrame, enriched: DataFrame) -> DataFrame:
    """Rows and distinct claims per run against the number of common claims."""
    per = restricted.groupBy("agent_name", "model_name").agg(
        F.count("*").alias("n_rows"), F.count_distinct("claim_id").alias("n_claims"))
    want = common.agg(F.count("*").alias("n_common"))  # one row
    have = enriched.agg(F.count("*").alias("n_claim_rows"))  # one row
    return per.crossJoin(F.broadcast(want)).crossJoin(F.broadcast(have)).withColumn(
        "mismatch", (F.col("n_claims") != F.col("n_common")).cast("int"))
