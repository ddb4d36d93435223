"""Reports over results: accuracy, cost, stability, distributions, topic and year splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispark.functions.labels import UAM_LABELS
from verispark.operators.ordered import exact_quantiles, join_small, rolling, rolling_median, running_sums

# Short display name and cost tier per base agent.
AGENT_META = {
    "uam_ga1": ("ga1\nZero-shot", 1),
    "uam_ga2": ("ga2\nBM25", 1),
    "uam_ga3": ("ga3\nRAG+Decomp", 2),
    "uam_ga4": ("ga4\nBM25+Decomp", 2),
    "uam_ga5": ("ga5\nFewShot+RAG", 3),
    "uam_ga6": ("ga6\nDebate", 3),
}
ANSWER_LETTERS = ("A (0)", "B (1)", "C (2)", "D (3)")  # fixed values


def pct(c: Column) -> Column:
    return F.round(F.avg(c) * 100, 6)


def short_model(name: Column, rules: Sequence[tuple[str, str]], other: str) -> Column:
    """First rule whose text occurs in the model name, else `other`."""
    out = F.lit(other)
    for part, short in reversed(rules):
        out = F.when(name.contains(part), F.lit(short)).otherwise(out)
    return out


def label_dims(results: DataFrame, rules: Sequence[tuple[str, str]], other: str) -> DataFrame:
    """Add `model`, `base_agent`, display `label` and `tier`; an unknown agent keeps its name, tier 0."""
    names = F.create_map(*[F.lit(x) for k, v in AGENT_META.items() for x in (k, v[0])])
    tiers = F.create_map(*[F.lit(x) for k, v in AGENT_META.items() for x in (k, v[1])])
    base = F.nullif(F.regexp_extract("agent_name", r"^(uam_ga\d+)", 1), F.lit(""))
    return (
        results.withColumn("model", short_model(F.col("model_name"), rules, other))
        .withColumn("base_agent", base)
        .withColumn("label", F.coalesce(F.try_element_at(names, "base_agent"), "base_agent"))
        .withColumn("tier", F.coalesce(F.try_element_at(tiers, "base_agent"), F.lit(0)))
    )


def model_summary(df: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """n, accuracy, mean and median time, mean tokens."""
    sums = df.groupBy(*keys).agg(
        F.count("is_correct").alias("n"),
        pct(F.col("is_correct")).alias("accuracy_pct"),
        F.round(F.avg("time_thought"), 6).alias("avg_time"),
        F.round(F.avg("total_tokens"), 6).alias("avg_tokens"),
    )
    median = exact_quantiles(df, keys, "time_thought", {"median_time": 0.5})
    return sums.join(median, list(keys), "left").withColumn("median_time", F.round("median_time", 6))


def agent_frontier(df: DataFrame) -> DataFrame:
    """Accuracy, median time and mean tokens per base agent and model."""
    return model_summary(df, ("base_agent", "model")).drop("n", "avg_time")


def cumulative_accuracy(
    df: DataFrame, order: Sequence[Column | str], first: int | None = None, keys: Sequence[str] = ("model",)
) -> DataFrame:
    """Share of correct answers up to each row; `first` keeps the start of each run."""
    run = running_sums(df, keys, order, {"_c": F.col("is_correct")})
    if first is not None:
        run = run.filter(F.col("pos") <= first)
    return run.withColumn("cum_acc", F.col("_c") / F.col("pos") * 100).drop("_c")


def stabilization_point(df: DataFrame, order: Sequence[Column | str], threshold: float = 1.0) -> DataFrame:
    """Per model: first position from which the running accuracy stays within `threshold` points."""
    cum = cumulative_accuracy(df, order)
    final = df.groupBy("model").agg((F.avg("is_correct") * 100).alias("_f"), F.count("*").alias("n"))
    over = F.round(F.abs(F.col("cum_acc") - F.col("_f")), 9) > threshold
    last = join_small(cum, final, ["model"]).groupBy("model", "n", "_f").agg(
        F.coalesce(F.max(F.when(over, F.col("pos"))), F.lit(0)).alias("_last"))
    return last.select(
        "model", "n", F.round("_f", 6).alias("final_acc"),
        F.when(F.col("_last") < F.col("n"), F.col("_last") + 1).alias("stable_from"))


def rolling_accuracy(df: DataFrame, order: Sequence[Column | str], window: int = 300, least: int = 50) -> DataFrame:
    """Centred moving accuracy per model; NULL where fewer than `least` rows are in the frame."""
    half = window // 2
    out = rolling(df, ["model"], order, half, window - half - 1,
                  {"_n": F.count("is_correct"), "_a": F.avg("is_correct")})
    return out.withColumn("rolling_acc", F.when(F.col("_n") >= least, F.col("_a") * 100)).drop("_n", "_a")


def rolling_median_time(df: DataFrame, order: Sequence[Column | str], window: int = 300, least: int = 20) -> DataFrame:
    return rolling_median(df, ["model"], order, "time_thought", window, least, "rolling_median")


def box_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles and whiskers: furthest values within 1.5 quartile ranges of the box."""
    box = exact_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    x = F.col(value)
    inside = (x >= F.col("q1") - reach) & (x <= F.col("q3") + reach)
    ends = (
        join_small(df, box, keys).groupBy(*keys)
        .agg(F.min(F.when(inside, x)).cast("double").alias("whisker_low"),
             F.max(F.when(inside, x)).cast("double").alias("whisker_high"))
    )
    return box.join(ends, list(keys))


def tail_quantiles(df: DataFrame, values: Sequence[str], p: float = 0.99) -> DataFrame:
    """Exact quantile of each column over rows with a valid label: one row per column."""
    valid = df.filter(F.col("model_label").isin(*UAM_LABELS))
    stacked = valid.select(F.explode(F.array(*[
        F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("x")) for v in values])).alias("s")).select("s.*")
    return exact_quantiles(stacked, ["measure"], "x", {"value": p})


def histogram_bins(df: DataFrame, keys: Sequence[str], value: str, bins: int = 200) -> DataFrame:
    """Counts in equal bins between the smallest and largest value per key; empty bins are listed."""
    x = F.col(value).cast("double")
    ends = df.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    flat = F.col("_hi") == F.col("_lo")
    ends = ends.select(
        *keys, F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("hi"))
    # Equal values are counted first: far fewer rows reach the join.
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    place = F.least(F.floor((x - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    filled = join_small(counted, ends, keys).groupBy(*keys, place.cast("int").alias("bin")).agg(F.sum("_c").alias("_n"))
    domain = ends.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return domain.join(filled, [*keys, "bin"], "left").select(
        *keys, "bin", F.round(F.col("lo") + width * F.col("bin"), 9).alias("bin_start"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("n"))


def label_balance(df: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Counts per label, truth and prediction side by side, over valid predictions. One scan."""
    valid = df.filter(F.col("model_label").isin(*UAM_LABELS))
    both = F.array(
        F.struct(F.lit("Ground Truth").alias("src"), F.col("original_label").alias("label")),
        F.struct(F.lit("Predicted").alias("src"), F.col("model_label").alias("label")))
    return valid.select(*keys, F.inline(both)).groupBy(*keys, "src", "label").agg(F.count("*").alias("n"))


def efficiency_table(results: DataFrame, compat: bool = True) -> DataFrame:
    """Accuracy and cost per agent and model. `compat` divides tokens per correct as whole numbers."""
    tokens, right = F.sum("total_tokens"), F.sum("is_correct")
    per_right = F.when(right != 0, F.floor(tokens / right).cast("double") if compat else tokens / right)
    return results.groupBy("agent_name", "model_name").agg(
        F.count("*").alias("n"),
        F.round(right * 100.0 / F.count("*"), 2).cast("double").alias("accuracy_pct"),
        tokens.cast("bigint").alias("total_tokens"),
        F.round(F.avg("prompt_tokens"), 1).alias("avg_prompt_tokens"),
        F.round(F.avg("completion_tokens"), 1).alias("avg_completion_tokens"),
        F.round(F.avg("time_thought"), 3).alias("avg_time_s"),
        F.round(F.avg("time_thought") / F.nullif(F.avg("total_tokens"), F.lit(0.0)), 6).alias("avg_time_per_token"),
        F.round(per_right, 1).alias("tokens_per_correct"),
    )


def topic_family(topic: Column, suffix: str = " (kod egzaminu)", placeholders: bool = True) -> Column:
    """Exam codes (`R.13`, and `M.XX` with `placeholders`) fold into their letter; others stay."""
    t = F.coalesce(topic, F.lit("None"))
    tail = r"(\d|XX|YY)" if placeholders else r"\d"
    letters = F.regexp_extract(t, r"^([A-Za-z]+)\." + tail, 1)
    return F.when(letters != "", F.concat(F.upper(letters), F.lit(suffix))).otherwise(t)


def year_of(text: Column) -> Column:
    return text.try_cast("double").cast("int")


def claim_dims(claims: DataFrame) -> DataFrame:
    meta = F.when(F.try_parse_json("metadata").isNotNull(), F.col("metadata"))
    return claims.select(
        F.col("id").alias("claim_id"), "topic",
        topic_family(F.col("topic"), " (exam code)", placeholders=False).alias("topic_family"),
        year_of(F.col("claim_date")).alias("year"),
        F.get_json_object(meta, "$.correct_answer_index").alias("correct_idx"))


def join_claim_dims(results: DataFrame, claims: DataFrame) -> DataFrame:
    return join_small(results, claim_dims(claims), ["claim_id"], "left")


def accuracy_by_family(joined: DataFrame, models: Sequence[str], count_model: str, top: int = 15) -> DataFrame:
    """Accuracy per topic family, one column per model; the families with most claims."""
    named = joined.filter(F.col("topic_family").isNotNull())
    acc = named.groupBy("topic_family").pivot("model", list(models)).agg(pct(F.col("is_correct")))
    n = named.filter(F.col("model") == count_model).groupBy("topic_family").agg(F.count_distinct("claim_id").alias("n"))
    return acc.join(n, "topic_family", "left").orderBy(F.col("n").desc_nulls_last(), "topic_family").limit(top)


def accuracy_by_year(joined: DataFrame, models: Sequence[str]) -> DataFrame:
    dated = joined.filter(F.col("year").isNotNull())
    return dated.groupBy("year").pivot("model", list(models)).agg(pct(F.col("is_correct")))


def category_counts(claims: DataFrame) -> DataFrame:
    """Claims per right answer, in fixed order with NULL for absent ones, and per year."""
    letters = F.array(*[
        F.struct(F.lit("answer").alias("kind"), F.lit(v).alias("category"), F.lit(i).alias("place"))
        for i, v in enumerate(ANSWER_LETTERS)])
    domain = claims.sparkSession.range(1).select(F.inline(letters))
    answer = claims.select(F.col("label_original").try_cast("int").alias("place")).groupBy("place").agg(
        F.count("*").alias("n"))
    by_answer = domain.join(answer, "place", "left").select("kind", "category", "n")
    years = claims.select(year_of(F.col("claim_date")).cast("string").alias("category")).filter("category IS NOT NULL")
    by_year = years.groupBy("category").agg(F.count("*").alias("n")).select(F.lit("year").alias("kind"), "category", "n")
    return by_answer.unionByName(by_year)


def share_compare(subset: DataFrame, full: DataFrame, category: Column, least_pct: float = 0.0) -> DataFrame:
    """Share of each category in the subset and in the full table, in percent, absent ones 0."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.select(category.alias("category")).filter("category IS NOT NULL").groupBy("category").agg(
            F.count("*").alias("_n"))
        total = counts.agg(F.sum("_n").alias("_t"))  # one row
        return counts.crossJoin(total).select("category", F.round(F.col("_n") / F.col("_t") * 100, 6).alias(name))

    both = shares(full, "full_pct").join(shares(subset, "subset_pct"), "category", "full").na.fill(0.0)
    return both.filter(F.greatest("full_pct", "subset_pct") >= least_pct)
