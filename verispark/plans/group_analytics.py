"""Queries over the analytics operators (group J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from verispark.operators import analytics as an
from verispark.operators.subset import sample_subset
from verispark.plans.registry import plain_names, query
from verispark.views import view

RULES = [("bielik", "Bielik-11B")]
OTHER = "llama3.1:8b"
SHORT = ["Bielik-11B", OTHER]
_ORD = ["created_at", "id"]
_MODEL = "CASE WHEN contains(model_name, 'bielik') THEN 'Bielik-11B' ELSE 'llama3.1:8b' END"
_BASE = r"regexp_extract(agent_name, '^(uam_ga\d+)', 1)"

DIM_CTES = rf"""
r AS (SELECT *, {_MODEL} AS model, {_BASE} AS base_agent FROM v_results),
valid AS (SELECT * FROM r WHERE model_label IN ('0', '1', '2', '3')),
"""


def dims(spark, sf_dir):
    return an.label_dims(view(spark, sf_dir, "v_results"), RULES, OTHER)


_META = ", ".join(f"('{k}', replace('{v[0]}', chr(10), ' '), {v[1]})".replace("\n", "' || chr(10) || '") for k, v in an.AGENT_META.items())


@query(
    "label_dims",
    f"SELECT id, model, base_agent, label, CAST(tier AS INTEGER) AS tier FROM r JOIN (VALUES {_META}) m(base_agent, label, tier) USING (base_agent)",
    DIM_CTES,
)
def _(spark, sf_dir):
    return dims(spark, sf_dir).select("id", "model", "base_agent", F.replace("label", F.lit("\n"), F.lit(" ")).alias("label"), "tier")


@query(
    "model_summary",
    """SELECT model, count(*) AS n, round(avg(is_correct) * 100, 6) AS accuracy_pct, round(avg(time_thought), 6) AS avg_time,
  round(quantile_cont(time_thought, 0.5), 6) AS median_time, round(avg(total_tokens), 6) AS avg_tokens FROM r GROUP BY model""",
    DIM_CTES,
)
def _(spark, sf_dir):
    return an.model_summary(dims(spark, sf_dir))


_CUM = """
cum AS (SELECT model, id, row_number() OVER w AS pos, sum(is_correct) OVER w / row_number() OVER w * 100 AS cum_acc, count(*) OVER (PARTITION BY model) AS n,
  avg(is_correct) OVER (PARTITION BY model) * 100 AS f FROM r WINDOW w AS (PARTITION BY model ORDER BY created_at, id)),
"""


def _thin(spark, sf_dir, *more):
    return dims(spark, sf_dir).select("model", "id", "is_correct", "created_at", *more)


@query("cumulative_accuracy", "SELECT model, id, pos, round(cum_acc, 6) AS cum_acc FROM cum", DIM_CTES + _CUM)
def _(spark, sf_dir):
    out = an.cumulative_accuracy(_thin(spark, sf_dir), _ORD)
    return out.select("model", "id", "pos", F.round("cum_acc", 6).alias("cum_acc"))


@query("cumulative_accuracy_early", "SELECT model, id, pos, round(cum_acc, 6) AS cum_acc FROM cum WHERE pos <= 500", DIM_CTES + _CUM)
def _(spark, sf_dir):
    out = an.cumulative_accuracy(_thin(spark, sf_dir), _ORD, first=500)
    return out.select("model", "id", "pos", F.round("cum_acc", 6).alias("cum_acc"))


@query(
    "stabilization_point",
    """SELECT model, n, round(f, 6) AS final_acc, CASE WHEN coalesce(max(CASE WHEN round(abs(cum_acc - f), 9) > 1 THEN pos END), 0) < n
  THEN coalesce(max(CASE WHEN round(abs(cum_acc - f), 9) > 1 THEN pos END), 0) + 1 END AS stable_from FROM cum GROUP BY model, n, f""",
    DIM_CTES + _CUM,
)
def _(spark, sf_dir):
    return an.stabilization_point(_thin(spark, sf_dir), _ORD)


@query(
    "rolling_accuracy",
    """SELECT model, id, claim_id, CASE WHEN count(*) OVER w >= 50 THEN round(avg(is_correct) OVER w * 100, 6) END AS rolling_acc FROM r
WINDOW w AS (PARTITION BY model ORDER BY claim_id, id ROWS BETWEEN 150 PRECEDING AND 149 FOLLOWING)""",
    DIM_CTES,
)
def _(spark, sf_dir):
    out = an.rolling_accuracy(_thin(spark, sf_dir, "claim_id"), ["claim_id", "id"])
    return out.select("model", "id", "claim_id", F.round("rolling_acc", 6).alias("rolling_acc"))


@query(
    "rolling_median_time",
    """SELECT model, id, CASE WHEN count(*) OVER w >= 20 THEN round(quantile_cont(time_thought, 0.5) OVER w, 6) END AS rolling_median FROM r
WINDOW w AS (PARTITION BY model ORDER BY created_at, id ROWS BETWEEN 150 PRECEDING AND 149 FOLLOWING)""",
    DIM_CTES,
)
def _(spark, sf_dir):
    out = an.rolling_median_time(_thin(spark, sf_dir, "time_thought"), _ORD)
    return out.select("model", "id", F.round("rolling_median", 6).alias("rolling_median"))


@query(
    "agent_frontier",
    """SELECT base_agent, model, round(avg(is_correct) * 100, 6) AS accuracy_pct, round(quantile_cont(time_thought, 0.5), 6) AS median_time, round(avg(total_tokens), 6) AS avg_tokens
FROM r GROUP BY 1, 2""",
    DIM_CTES,
)
def _(spark, sf_dir):
    return an.agent_frontier(dims(spark, sf_dir))


def _box_sql(value: str) -> str:
    return f"""SELECT q.base_agent, q.model, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  CAST(min(CASE WHEN {value} >= q1 - 1.5 * (q3 - q1) AND {value} <= q3 + 1.5 * (q3 - q1) THEN {value} END) AS DOUBLE) AS whisker_low,
  CAST(max(CASE WHEN {value} >= q1 - 1.5 * (q3 - q1) AND {value} <= q3 + 1.5 * (q3 - q1) THEN {value} END) AS DOUBLE) AS whisker_high
FROM r JOIN (SELECT base_agent, model, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS q3 FROM r GROUP BY 1, 2) q
  ON r.base_agent = q.base_agent AND r.model = q.model GROUP BY q.base_agent, q.model, q1, median, q3"""


def _box(spark, sf_dir, value):
    out = an.box_stats(dims(spark, sf_dir).select("base_agent", "model", value), ["base_agent", "model"], value)
    return out.select("base_agent", "model", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "whisker_low", "whisker_high")


@query("box_stats", _box_sql("time_thought"), DIM_CTES)
def _(spark, sf_dir):
    return _box(spark, sf_dir, "time_thought")


@query("box_stats_tokens", _box_sql("total_tokens"), DIM_CTES)
def _(spark, sf_dir):
    return _box(spark, sf_dir, "total_tokens")


_TAILS = ("time_thought", "total_tokens", "prompt_tokens", "completion_tokens")


@query(
    "tail_quantiles",
    " UNION ALL ".join(f"SELECT '{m}' AS measure, round(quantile_cont(CAST({m} AS DOUBLE), 0.99), 6) AS value FROM valid" for m in _TAILS),
    DIM_CTES,
)
def _(spark, sf_dir):
    return an.tail_quantiles(dims(spark, sf_dir), _TAILS).withColumn("value", F.round("value", 6))


def _hist_sql(value: str, bins: int) -> str:
    return f"""SELECT d.model, CAST(d.bin AS INTEGER) AS bin, round(d.lo + (d.hi - d.lo) / {bins} * d.bin, 9) AS bin_start, count(v.model) AS n
FROM (SELECT model, min(CAST({value} AS DOUBLE)) AS lo, max(CAST({value} AS DOUBLE)) AS hi, unnest(range({bins})) AS bin FROM valid GROUP BY model) d
LEFT JOIN (SELECT model, {value} AS x FROM valid) v ON v.model = d.model AND least(floor((v.x - d.lo) * {bins} / (d.hi - d.lo)), {bins - 1}) = d.bin GROUP BY d.model, d.bin, d.lo, d.hi"""


@query("histogram_bins", _hist_sql("time_thought", 200), DIM_CTES)
def _(spark, sf_dir):
    valid = dims(spark, sf_dir).filter(F.col("model_label").isin("0", "1", "2", "3"))
    return an.histogram_bins(valid, ["model"], "time_thought", 200)


@query("histogram_bins_tokens", _hist_sql("completion_tokens", 150), DIM_CTES)
def _(spark, sf_dir):
    valid = dims(spark, sf_dir).filter(F.col("model_label").isin("0", "1", "2", "3"))
    return an.histogram_bins(valid, ["model"], "completion_tokens", 150)


@query(
    "label_balance",
    """SELECT model, 'Ground Truth' AS src, original_label AS label, count(*) AS n FROM valid GROUP BY 1, 3
UNION ALL SELECT model, 'Predicted', model_label, count(*) FROM valid GROUP BY 1, 3""",
    DIM_CTES,
)
def _(spark, sf_dir):
    return an.label_balance(dims(spark, sf_dir))


@query(
    "efficiency_table",
    """SELECT agent_name, model_name, count(*) AS n, round(100.0 * sum(is_correct) / count(*), 2) AS accuracy_pct, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  round(avg(prompt_tokens), 1) AS avg_prompt_tokens, round(avg(completion_tokens), 1) AS avg_completion_tokens, round(avg(time_thought), 3) AS avg_time_s,
  round(avg(time_thought) / nullif(avg(total_tokens), 0), 6) AS avg_time_per_token, round(CAST(sum(total_tokens) // nullif(sum(is_correct), 0) AS DOUBLE), 1) AS tokens_per_correct
FROM v_results GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return an.efficiency_table(view(spark, sf_dir, "v_results"))


_FAM2 = r"CASE WHEN regexp_matches(topic, '^([A-Za-z]+)\.(\d|XX|YY)') THEN concat(upper(regexp_extract(topic, '^([A-Za-z]+)\.(\d|XX|YY)', 1)), ' (kod egzaminu)') ELSE topic END"
_FAM1 = r"CASE WHEN regexp_matches(topic, '^([A-Za-z]+)\.\d') THEN concat(upper(regexp_extract(topic, '^([A-Za-z]+)\.\d', 1)), ' (exam code)') ELSE topic END"


@query("topic_family", f"SELECT id, topic, {_FAM2} AS family, {_FAM1} AS family_digits FROM v_claims")
def _(spark, sf_dir):
    return view(spark, sf_dir, "v_claims").select(
        "id", "topic", an.topic_family(F.col("topic")).alias("family"),
        an.topic_family(F.col("topic"), " (exam code)", placeholders=False).alias("family_digits"))


JOIN_CTES = (
    DIM_CTES
    + f"""
dim AS (SELECT id AS claim_id, topic, {_FAM1} AS topic_family, CAST(TRY_CAST(claim_date AS DOUBLE) AS INTEGER) AS year,
  CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.correct_answer_index') END AS correct_idx FROM v_claims),
j AS (SELECT r.*, d.topic, d.topic_family, d.year, d.correct_idx FROM r LEFT JOIN dim d USING (claim_id)),
"""
)


def joined(spark, sf_dir):
    return an.join_claim_dims(dims(spark, sf_dir), view(spark, sf_dir, "v_claims"))


@query("join_claim_dims", "SELECT id, claim_id, topic, topic_family, year, correct_idx FROM j", JOIN_CTES)
def _(spark, sf_dir):
    return joined(spark, sf_dir).select("id", "claim_id", "topic", "topic_family", "year", "correct_idx")


@query(
    "accuracy_by_family",
    """SELECT topic_family, round(avg(is_correct) FILTER (model = 'Bielik-11B') * 100, 6) AS Bielik_11B, round(avg(is_correct) FILTER (model = 'llama3.1:8b') * 100, 6) AS llama3_1_8b,
  count(DISTINCT claim_id) FILTER (model = 'Bielik-11B') AS n FROM j WHERE topic_family IS NOT NULL GROUP BY topic_family ORDER BY n DESC, topic_family LIMIT 15""",
    JOIN_CTES,
)
def _(spark, sf_dir):
    return plain_names(an.accuracy_by_family(joined(spark, sf_dir), SHORT, "Bielik-11B"))


@query(
    "accuracy_by_year",
    """SELECT year, round(avg(is_correct) FILTER (model = 'Bielik-11B') * 100, 6) AS Bielik_11B, round(avg(is_correct) FILTER (model = 'llama3.1:8b') * 100, 6) AS llama3_1_8b
FROM j WHERE year IS NOT NULL AND base_agent = 'uam_ga1' GROUP BY year""",
    JOIN_CTES,
)
def _(spark, sf_dir):
    return plain_names(an.accuracy_by_year(joined(spark, sf_dir).filter("base_agent = 'uam_ga1'"), SHORT))


@query(
    "category_counts",
    """SELECT 'answer' AS kind, d.c AS category, n FROM (VALUES (0, 'A (0)'), (1, 'B (1)'), (2, 'C (2)'), (3, 'D (3)')) d(i, c)
  LEFT JOIN (SELECT CAST(label_original AS INTEGER) AS i, count(*) AS n FROM v_claims GROUP BY 1) USING (i)
UNION ALL SELECT 'year', CAST(CAST(TRY_CAST(claim_date AS DOUBLE) AS INTEGER) AS VARCHAR), count(*) FROM v_claims WHERE TRY_CAST(claim_date AS DOUBLE) IS NOT NULL GROUP BY 2""",
)
def _(spark, sf_dir):
    return an.category_counts(view(spark, sf_dir, "v_claims"))


def _share_sql(cat: str, where: str, least: str = "") -> str:
    return f"""SELECT coalesce(f.category, s.category) AS category, coalesce(f.p, 0) AS full_pct, coalesce(s.p, 0) AS subset_pct FROM
 (SELECT {cat} AS category, round(count(*) / sum(count(*)) OVER () * 100, 6) AS p FROM v_claims {where} GROUP BY 1) f FULL JOIN
 (SELECT {cat} AS category, round(count(*) / sum(count(*)) OVER () * 100, 6) AS p FROM (SELECT * FROM v_claims ORDER BY md5(concat(CAST(id AS VARCHAR), ':42')), id LIMIT 20) {where} GROUP BY 1) s
 ON f.category = s.category {least}"""


def _share(spark, sf_dir, category, least=0.0):
    full = view(spark, sf_dir, "v_claims")
    return an.share_compare(sample_subset(full, 20, 42), full, category, least)


_YEAR = "CAST(TRY_CAST(claim_date AS DOUBLE) AS INTEGER)"


@query("share_compare", _share_sql(_FAM2, "", "WHERE greatest(coalesce(f.p, 0), coalesce(s.p, 0)) >= 1"))
def _(spark, sf_dir):
    return _share(spark, sf_dir, an.topic_family(F.col("topic")), 1.0)


@query("share_compare_years", _share_sql(_YEAR, f"WHERE {_YEAR} > 2013"))
def _(spark, sf_dir):
    full = view(spark, sf_dir, "v_claims")
    sub = sample_subset(full, 20, 42)
    year = an.year_of(F.col("claim_date"))
    return an.share_compare(sub.filter(year > 2013), full.filter(year > 2013), year)
