"""The table of evaluation results: scope, resume, append, merge, completeness, summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verispark.functions.labels import ERROR
from verispark.operators.ordered import join_small, keep_first, running_sums

KEY = ["agent_name", "claim_id", "benchmark_name", "model_name"]
SCOPE = ["agent_name", "benchmark_name", "model_name"]

# Cost tier by agent name; other names are tier 2.
TIERS = {
    **dict.fromkeys(("uam_ga1", "dem_ga1", "uam_ga2", "uam_ga_web_tool_arch", "dem_ga2", "dem_ga3"), 1),
    **dict.fromkeys(("uam_ga3", "dem_ga4", "uam_ga4", "dem_ga5"), 2),
    **dict.fromkeys(("uam_ga5", "dem_ga6", "uam_ga6", "uam_ga_debate", "dem_ga7"), 3),
}
DEFAULT_TIER = 2
TIER_LIMITS = {1: None, 2: 2000, 3: 500}  # fixed values

REQUIRED = (
    "model_label", "original_label", "is_correct", "total_tokens", "prompt_tokens",
    "completion_tokens", "time_thought", "raw_output",
)  # fixed values: fields every result must have


def base_agent(name: Column) -> Column:
    return F.substring_index(name, "__", 1)


def agent_run_name(name: Column, model: Column) -> Column:
    """Add `__model` (with `/` and `:` as `-`) unless the name has a suffix or there is no model."""
    suffixed = F.concat(name, F.lit("__"), F.translate(model, "/:", "--"))
    bare = (F.coalesce(model, F.lit("")) != "") & ~name.contains("__")
    return F.when(bare, suffixed).otherwise(name)


def align_result_schema(df: DataFrame) -> DataFrame:
    """Older tables have no `model_name`; it becomes the empty text."""
    if "model_name" not in df.columns:
        return df.withColumn("model_name", F.lit(""))
    return df.withColumn("model_name", F.coalesce("model_name", F.lit("")))


def union_results(parts: Sequence[DataFrame]) -> DataFrame:
    out = align_result_schema(parts[0])
    for p in parts[1:]:
        out = out.unionByName(align_result_schema(p), allowMissingColumns=True)
    return out


def assign_tier(agents: DataFrame) -> DataFrame:
    """`tier`: the agent's own cost tier, else the one of its name, else 2."""
    names = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])
    known = F.try_element_at(names, base_agent(F.col("agent_name")))
    own = F.col("cost_tier") if "cost_tier" in agents.columns else F.lit(None)
    return agents.withColumn("tier", F.coalesce(own.cast("int"), known, F.lit(DEFAULT_TIER)))


def tier_limited_claims(
    claims: DataFrame, agents: DataFrame, tier_limits: dict[int, int | None] = TIER_LIMITS, limit: int | None = None
) -> DataFrame:
    """(agent_name, tier, claim id): cheap agents get every claim, costly ones the first few.

    The first n come from a distributed top-n on id, not from numbering the whole table.
    """
    # The roster is short: its names become a literal list per tier, and no join puts a tier in one task.
    roster: dict[int, list[str]] = {}
    for row in agents.select("agent_name", "tier").distinct().collect():
        roster.setdefault(row.tier, []).append(row.agent_name)
    parts = []
    for tier, names in sorted(roster.items()):
        caps = [c for c in (tier_limits.get(tier), limit) if c is not None]
        rows = claims.orderBy("id").limit(min(caps)) if caps else claims
        listed = F.array(*[F.lit(n) for n in sorted(names)])
        parts.append(rows.select("*", F.lit(tier).alias("tier"), F.explode(listed).alias("agent_name")))
    pool = parts[0]
    for p in parts[1:]:
        pool = pool.unionByName(p)
    return pool


def in_scope(results: DataFrame, scope: DataFrame) -> DataFrame:
    marked = scope.select(*SCOPE).distinct().withColumn("_in", F.lit(True))
    return results.join(marked, SCOPE, "left").withColumn("_in", F.coalesce("_in", F.lit(False)))


def purge_errors(results: DataFrame, scope: DataFrame) -> DataFrame:
    """Drop ERROR rows of the agents in `scope`, so that they are tried again."""
    return in_scope(results, scope).filter(~(F.col("_in") & F.col("model_label").eqNullSafe(ERROR))).drop("_in")


def clear_scope(results: DataFrame, scope: DataFrame) -> DataFrame:
    """Drop every row of the (agent, benchmark, model) triples in `scope`."""
    return results.join(scope.select(*SCOPE).distinct(), SCOPE, "left_anti")


def pending_claims(
    claims: DataFrame, agents: Sequence[tuple[str, str]], benchmark: str, results: DataFrame
) -> DataFrame:
    """Claims still to be done per agent. The registered agents are a short list in the program."""
    listed = F.array(*[F.struct(F.lit(a).alias("agent_name"), F.lit(m).alias("model_name")) for a, m in agents])
    wanted = claims.select("*", F.inline(listed)).withColumn("benchmark_name", F.lit(benchmark))
    done = results.select(*SCOPE, F.col("claim_id").alias("id")).distinct()
    return wanted.join(done, [*SCOPE, "id"], "left_anti")


def new_results(target: DataFrame, incoming: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The rows to append: those whose key the target lacks; of several with one key the first in `order`.

    Only the target's key columns are read.
    """
    typed = incoming.withColumn("is_correct", F.col("is_correct").cast("boolean").cast("int"))
    for c in ("total_tokens", "prompt_tokens", "completion_tokens"):
        typed = typed.withColumn(c, F.col(c).cast("bigint"))
    typed = typed.withColumn("time_thought", F.col("time_thought").cast("double"))
    fresh = keep_first(align_result_schema(typed), KEY, order)
    return fresh.join(target.select(*KEY), KEY, "left_anti")


def insert_results(target: DataFrame, incoming: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The target with its `new_results` appended."""
    return union_results([target, new_results(target, incoming, order)])


def merge_results(target: DataFrame, sources: Sequence[DataFrame], order: Sequence[Column | str]) -> DataFrame:
    """Rows of the sources that the target lacks, earlier sources first; `source_no` tells whose.

    Each key keeps its first row over all sources before the target is looked at: repeated keys
    are cut ahead of the shuffle, and the target is read once whatever the number of sources.
    """
    pool = union_results([s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources, 1)])
    first = keep_first(pool, KEY, [F.col("source_no"), *order])
    return first.join(align_result_schema(target).select(*KEY), KEY, "left_anti")


def merge_counts(merged: DataFrame, sources: Sequence[DataFrame]) -> DataFrame:
    """Rows inserted and skipped per source."""
    seen = union_results([s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources, 1)])
    total = seen.groupBy("source_no").agg(F.count("*").alias("n_rows"))
    taken = merged.groupBy("source_no").agg(F.count("*").alias("_n"))
    inserted = F.coalesce("_n", F.lit(0))
    return total.join(taken, "source_no", "left").select(
        "source_no", "n_rows", inserted.alias("inserted"), (F.col("n_rows") - inserted).alias("skipped")
    )


def validate_results(results: DataFrame, fields: Sequence[str] = REQUIRED) -> DataFrame:
    """`missing`: names of required fields without a value, sorted."""
    names = [
        F.when(F.col(c).isNull(), F.lit(c)) if c in results.columns else F.lit(c) for c in sorted(fields)
    ]
    return results.withColumn("missing", F.array_compact(F.array(*names)))


def completed_pairs(results: DataFrame, claims: DataFrame, benchmark: str) -> DataFrame:
    """(base_agent, model_name) with at least as many rows as there are claims; ERROR rows count."""
    per = results.filter(F.col("benchmark_name") == benchmark).groupBy("agent_name", "model_name").agg(
        F.count("*").alias("n_rows"))
    total = claims.agg(F.count("*").alias("n_claims"))  # one row
    return per.crossJoin(F.broadcast(total)).filter("n_rows >= n_claims").select(
        base_agent(F.col("agent_name")).alias("base_agent"), "model_name", "n_rows")


def select_agents(agents: DataFrame, names: Sequence[str] | None, completed: DataFrame) -> DataFrame:
    """Named agents without the completed ones."""
    kept = agents.filter(F.col("agent_name").isin(*names)) if names is not None else agents
    kept = kept.withColumn("base_agent", base_agent(F.col("agent_name")))
    return kept.join(completed.select("base_agent", "model_name").distinct(), ["base_agent", "model_name"], "left_anti")


def agent_summary(results: DataFrame) -> DataFrame:
    """Totals per agent; ERROR rows count as claims but add no tokens, time or correct answers. A NULL label is no ERROR."""
    ok = ~F.col("model_label").eqNullSafe(ERROR)

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))

    n = F.greatest(F.count("*"), F.lit(1))
    return results.groupBy("agent_name").agg(
        F.count("*").alias("n"),
        total("is_correct").cast("bigint").alias("correct"),
        F.round(total("is_correct") / n * 100, 6).alias("accuracy_pct"),
        F.count(F.when(~ok, 1)).alias("errors"),
        total("total_tokens").cast("bigint").alias("tokens"),
        F.round(total("time_thought"), 6).alias("time_s"),
        F.round(total("time_thought") / n, 6).alias("avg_time_s"),
        F.round(total("total_tokens") / F.greatest(total("time_thought"), F.lit(0.1)), 6).alias("tok_per_s"),
    )


def running_accuracy(results: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Accuracy after each row per agent, in `order`."""
    ok = ~F.col("model_label").eqNullSafe(ERROR)
    run = running_sums(
        results.select("agent_name", "id", "model_label", "is_correct", "created_at"), ["agent_name"], order,
        {"correct": F.when(ok, F.col("is_correct")).otherwise(0), "errors": (~ok).cast("int")},
    )
    return run.withColumn("accuracy_pct", F.round(F.col("correct") / F.col("pos") * 100, 6))


def accuracy_snapshots(running: DataFrame, every: int = 50) -> DataFrame:
    """Every 50th row and the last one; here errors leave the denominator."""
    sizes = running.groupBy("agent_name").agg(F.max("pos").alias("_n"))
    at = (F.col("pos") % every == 0) | (F.col("pos") == F.col("_n"))
    return join_small(running, sizes, ["agent_name"]).filter(at).select(
        "agent_name", "pos", "correct", "errors",
        F.round(F.col("correct") / F.greatest(F.col("pos") - F.col("errors"), F.lit(1)) * 100, 6).alias("accuracy_pct"),
    )


def model_throughput(responses: DataFrame) -> DataFrame:
    """Per model: tests, passed, correct, tokens, time and tokens per second.

    An answer is correct when the expected text occurs in its first five characters.
    """
    answer = F.substring(F.trim("response"), 1, 5)
    right = F.when(F.col("success") & F.col("expected").isNotNull(), F.contains(answer, F.col("expected")).cast("int"))
    tokens = F.sum(F.when(F.col("success"), F.col("completion_tokens")).otherwise(0))
    time = F.sum(F.when(F.col("success"), F.col("elapsed")).otherwise(0.0))
    return responses.groupBy("model").agg(
        F.count("*").alias("tests_total"),
        F.count(F.when(F.col("success"), 1)).alias("tests_passed"),
        F.coalesce(F.sum(right), F.lit(0)).cast("bigint").alias("correct"),
        tokens.cast("bigint").alias("total_tokens"),
        F.round(time, 6).alias("total_time"),
        F.round(F.when(time > 0, tokens / time).otherwise(0.0), 6).alias("avg_tok_per_s"),
    )


Labeler = Callable[[dict], dict]

_LABELED = T.StructType(
    [
        T.StructField("model_label", T.StringType()),
        T.StructField("original_label", T.StringType()),
        T.StructField("is_correct", T.IntegerType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("time_thought", T.DoubleType()),
        T.StructField("raw_output", T.StringType()),
    ]
)


def evaluate(pending: DataFrame, make_labeler: Callable[[str], Labeler], partitions: int | None = None) -> DataFrame:
    """Apply a labeler to every pending (agent, claim); a failing claim becomes an ERROR row.

    `make_labeler(agent_name)` runs once per agent and task. Parallelism is the number of
    partitions.
    """
    head = [f for f in pending.schema.fields if f.name in (*SCOPE, "id")]
    schema = T.StructType([*head, *_LABELED.fields])
    columns = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[str, Labeler] = {}
        for batch in batches:
            rows = []
            for claim in batch.to_dict("records"):
                agent = claim["agent_name"]
                truth = claim.get("label_original") or claim.get("label") or ""
                try:
                    if agent not in ready:
                        ready[agent] = make_labeler(agent)
                    got = ready[agent](claim)
                    absent = sorted(k for k in REQUIRED if k not in got)
                    if absent:
                        raise ValueError(f"result without {absent}")
                    got = {**got, "is_correct": int(bool(got["is_correct"]))}
                except Exception as exc:  # noqa: BLE001 - one bad claim must not end the run
                    got = {
                        "model_label": ERROR, "original_label": truth, "is_correct": 0, "total_tokens": 0,
                        "prompt_tokens": 0, "completion_tokens": 0, "time_thought": 0.0, "raw_output": f"ERROR: {exc}",
                    }
                rows.append({**{f.name: claim[f.name] for f in head}, **got})
            yield pd.DataFrame(rows, columns=columns)

    spread = pending.repartition(partitions) if partitions else pending
    return spread.mapInPandas(run, schema).withColumnRenamed("id", "claim_id")


def completeness(results: DataFrame, agents: DataFrame, claims: DataFrame, benchmark: str) -> DataFrame:
    """Per expected agent: distinct claims without ERROR against the number of claims."""
    done = (
        results.filter((F.col("benchmark_name") == benchmark) & (F.col("model_label") != ERROR))
        .groupBy("agent_name").agg(F.count_distinct("claim_id").alias("_done"))
    )
    total = claims.agg(F.count("*").alias("total"))  # one row
    got = F.coalesce("_done", F.lit(0))
    return (
        agents.select("agent_name").distinct().join(done, "agent_name", "left").crossJoin(F.broadcast(total))
        .select(
            "agent_name", got.alias("completed"), "total",
            F.when(F.col("total") == 0, "no input").when(got == F.col("total"), "complete")
            .otherwise(F.concat(F.lit("missing "), (F.col("total") - got).cast("string"))).alias("status"),
        )
    )
