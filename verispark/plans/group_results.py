"""Queries over the evaluation table: batch, repair, merge and subset (groups H and I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from verispark.functions.labels import LABEL_CLASSES, UNFIXABLE, VERBAL_EXTENDED, fix_label
from verispark.operators import repair as rp
from verispark.operators import results as rs
from verispark.operators import subset as sb
from verispark.plans.registry import plain_names, query
from verispark.views import table, view

BASES = [f"uam_ga{i}" for i in range(1, 7)]
MODELS = ["bielik-11b", "llama3.1-8b"]
AGENTS = [(f"{b}__{m}", m) for b in BASES for m in MODELS]
BENCH = "am_benchmark"

_STANDARD = "('0', '1', '2', '3', " + ", ".join(f"'{x}'" for x in VERBAL_EXTENDED) + ")"
_UNFIX = "(" + ", ".join(f"'{x}'" for x in UNFIXABLE) + ")"
_NUM = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"
_VALID = "('0', '1', '2', '3')"
_ORD = ["created_at", "id"]

# Label cleaning in DuckDB SQL. No agent of the view is verbal, so only digits are valid.
LABEL_CTES = rf"""
num AS (SELECT *, CASE WHEN regexp_matches(model_label, {_NUM}) THEN TRY_CAST(model_label AS DOUBLE) END AS x FROM v_results),
fixes AS (SELECT *,
  CASE WHEN abs(x - round_even(x, 0)) < 0.01 AND round_even(x, 0) BETWEEN 0 AND 3 THEN CAST(CAST(round_even(x, 0) AS INTEGER) AS VARCHAR) END AS f1,
  nullif(regexp_extract(model_label, '\b([0-3])\b', 1), '') AS f2,
  CASE WHEN json_valid(replace(model_label, '''', '"')) THEN json_extract_string(replace(model_label, '''', '"'), '$[0]') END AS f3,
  model_label NOT IN {_STANDARD} AS nonstd FROM num),
cls AS (SELECT *, CASE WHEN model_label IN {_VALID} THEN 'valid' WHEN model_label = 'ERROR_MAX_STEPS' THEN 'error_max_steps' WHEN model_label = 'ERROR' THEN 'error_generic'
  WHEN x IS NOT NULL AND round_even(x, 0) BETWEEN 0 AND 3 THEN 'fixable_float' WHEN x IS NOT NULL THEN 'corrupt_float_oob'
  WHEN regexp_matches(model_label, '\b[0-3]\b') THEN 'fixable_prefix' WHEN model_label LIKE '[%' THEN 'fixable_array' ELSE 'corrupt_other' END AS label_class FROM fixes),
turn AS (SELECT id, i, json_extract_string(ts[i], '$.role') AS role, json_extract_string(ts[i], '$.content') AS content
  FROM (SELECT id, ts, generate_subscripts(ts, 1) AS i FROM (SELECT id, json_extract(raw_output, '$[*]') AS ts FROM v_results WHERE json_valid(raw_output)))),
tlab AS (SELECT id, i, content, nullif(regexp_extract(content, '(?s)\{{.*\}}', 0), '') AS block FROM turn WHERE role = 'assistant'),
tfound AS (SELECT id, i, coalesce(CASE WHEN json_valid(block) THEN CASE WHEN json_extract_string(block, '$.action') = 'final_answer' THEN trim(json_extract_string(block, '$.action_input.label')) END END,
  nullif(trim(regexp_extract(content, '"label"\s*:\s*"([^"]+)"', 1)), '')) AS lab FROM tlab),
mined AS (SELECT id, arg_max(lab, i) AS mined FROM tfound WHERE lab IS NOT NULL GROUP BY id),
plan AS (SELECT c.*, m.mined,
  CASE WHEN nonstd AND model_label NOT IN ('ERROR', 'ERROR_MAX_STEPS') AND coalesce(f1, f2, f3) IN {_VALID} THEN coalesce(f1, f2, f3) END AS fix1,
  CASE WHEN model_label = 'ERROR_MAX_STEPS' AND m.mined IN {_VALID} THEN m.mined END AS fix2 FROM cls c LEFT JOIN mined m USING (id)),
repaired AS (SELECT id, agent_name, claim_id, coalesce(fix1, fix2, model_label) AS model_label,
  CAST(CASE WHEN coalesce(fix1, fix2) IS NULL THEN is_correct WHEN coalesce(fix1, fix2) = trim(original_label) THEN 1 ELSE 0 END AS INTEGER) AS is_correct FROM plan
  WHERE NOT (coalesce(fix1, fix2, model_label) IN {_UNFIX} OR (coalesce(fix1, fix2, model_label) NOT IN {_STANDARD} AND coalesce(fix1, fix2, model_label) NOT IN ('ERROR', 'ERROR_MAX_STEPS')))),
"""


def results(spark, sf_dir):
    return view(spark, sf_dir, "v_results")


def agents_of(spark, sf_dir):
    return results(spark, sf_dir).select("agent_name", "model_name").distinct()


# ---- evaluation batch --------------------------------------------------------------------


@query(
    "pending_claims",
    f"""SELECT c.id, a.agent_name, a.model_name, '{BENCH}' AS benchmark_name
FROM v_claims c CROSS JOIN (SELECT DISTINCT agent_name, model_name FROM v_results) a
WHERE NOT EXISTS (SELECT 1 FROM v_results r WHERE r.agent_name = a.agent_name AND r.model_name = a.model_name AND r.claim_id = c.id AND r.model_label IN {_VALID})""",
)
def _(spark, sf_dir):
    stored = results(spark, sf_dir).filter(F.col("model_label").isin("0", "1", "2", "3"))
    out = rs.pending_claims(view(spark, sf_dir, "v_claims"), AGENTS, BENCH, stored)
    return out.select("id", "agent_name", "model_name", "benchmark_name")


_SCOPE_SQL = "(r.model_name = 'bielik-11b')"


def _scope(spark, sf_dir):
    return results(spark, sf_dir).filter("model_name = 'bielik-11b'").select(*rs.SCOPE).distinct()


@query("purge_errors", f"SELECT r.id, r.agent_name, r.model_label FROM v_results r WHERE NOT ({_SCOPE_SQL} AND r.model_label = 'ERROR')")
def _(spark, sf_dir):
    return rs.purge_errors(results(spark, sf_dir), _scope(spark, sf_dir)).select("id", "agent_name", "model_label")


@query("clear_scope", f"SELECT r.id, r.agent_name FROM v_results r WHERE NOT {_SCOPE_SQL}")
def _(spark, sf_dir):
    return rs.clear_scope(results(spark, sf_dir), _scope(spark, sf_dir)).select("id", "agent_name")


# Already stored: what one kind of event brought. Each other kind is a batch or a source file.
_KEYS = "agent_name, claim_id, benchmark_name, model_name"
_FIRST = f"row_number() OVER (PARTITION BY {_KEYS} ORDER BY created_at, id) AS rn"
STORE_CTES = f"""
stored AS (SELECT * FROM (SELECT *, {_FIRST} FROM v_results WHERE event_type = 'view') WHERE rn = 1),
"""


def _stored(spark, sf_dir):
    from verispark.operators.ordered import keep_first

    return keep_first(results(spark, sf_dir).filter("event_type = 'view'"), rs.KEY, _ORD)


@query(
    "insert_results",
    f"""SELECT id, agent_name, claim_id, model_name, model_label, is_correct, total_tokens FROM stored
UNION ALL SELECT id, agent_name, claim_id, model_name, model_label, is_correct, total_tokens FROM (SELECT *, {_FIRST} FROM v_results WHERE event_type <> 'view') b
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.agent_name = b.agent_name AND s.claim_id = b.claim_id AND s.benchmark_name = b.benchmark_name AND s.model_name = b.model_name)""",
    STORE_CTES,
)
def _(spark, sf_dir):
    incoming = results(spark, sf_dir).filter("event_type <> 'view'")
    out = rs.insert_results(_stored(spark, sf_dir), incoming, _ORD)
    return out.select("id", "agent_name", "claim_id", "model_name", "model_label", "is_correct", "total_tokens")


@query(
    "new_results",
    f"""SELECT id, agent_name, claim_id, model_name, model_label, is_correct, total_tokens FROM (SELECT *, {_FIRST} FROM v_results WHERE event_type <> 'view') b
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.agent_name = b.agent_name AND s.claim_id = b.claim_id AND s.benchmark_name = b.benchmark_name AND s.model_name = b.model_name)""",
    STORE_CTES,
)
def _(spark, sf_dir):
    """What an insert would append, without the stored rows."""
    incoming = results(spark, sf_dir).filter("event_type <> 'view'")
    out = rs.new_results(_stored(spark, sf_dir), incoming, _ORD)
    return out.select("id", "agent_name", "claim_id", "model_name", "model_label", "is_correct", "total_tokens")


_SRC = "CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END"
MERGE_CTES = (
    STORE_CTES
    + f"""
pool AS (SELECT *, {_SRC} AS source_no FROM v_results WHERE event_type <> 'view'),
merged AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.agent_name, p.claim_id, p.benchmark_name, p.model_name ORDER BY source_no, created_at, id) AS rn FROM pool p
  WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.agent_name = p.agent_name AND s.claim_id = p.claim_id AND s.benchmark_name = p.benchmark_name AND s.model_name = p.model_name)) WHERE rn = 1),
"""
)


def _sources(spark, sf_dir):
    res = results(spark, sf_dir)
    return [res.filter(F.col("event_type") == t) for t in ("click", "error", "purchase", "signup")]


@query("merge_results", "SELECT id, agent_name, claim_id, model_name, CAST(source_no AS INTEGER) AS source_no FROM merged", MERGE_CTES)
def _(spark, sf_dir):
    out = rs.merge_results(_stored(spark, sf_dir), _sources(spark, sf_dir), _ORD)
    return out.select("id", "agent_name", "claim_id", "model_name", "source_no")


@query(
    "merge_counts",
    """SELECT CAST(source_no AS INTEGER) AS source_no, count(*) AS n_rows, (SELECT count(*) FROM merged m WHERE m.source_no = p.source_no) AS inserted,
  count(*) - (SELECT count(*) FROM merged m WHERE m.source_no = p.source_no) AS skipped FROM pool p GROUP BY source_no""",
    MERGE_CTES,
)
def _(spark, sf_dir):
    sources = _sources(spark, sf_dir)
    return rs.merge_counts(rs.merge_results(_stored(spark, sf_dir), sources, _ORD), sources)


_TIER = "CASE WHEN base IN ('uam_ga1', 'uam_ga2') THEN 1 WHEN base IN ('uam_ga3', 'uam_ga4') THEN 2 WHEN base IN ('uam_ga5', 'uam_ga6') THEN 3 ELSE 2 END"
TIER_CTES = f"""
agents AS (SELECT DISTINCT agent_name, string_split(agent_name, '__')[1] AS base, CASE WHEN agent_name LIKE 'uam_ga4%' THEN 3 END AS cost_tier FROM v_results),
tiers AS (SELECT agent_name, cost_tier, CAST(coalesce(cost_tier, {_TIER}) AS INTEGER) AS tier FROM agents),
"""


def _tiered(spark, sf_dir):
    agents = agents_of(spark, sf_dir).select("agent_name").withColumn(
        "cost_tier", F.when(F.col("agent_name").startswith("uam_ga4"), 3))
    return rs.assign_tier(agents)


@query("assign_tier", "SELECT agent_name, tier FROM tiers", TIER_CTES)
def _(spark, sf_dir):
    return _tiered(spark, sf_dir).select("agent_name", "tier")


@query(
    "tier_limited_claims",
    """SELECT t.agent_name, t.tier, c.id FROM tiers t JOIN (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM v_claims) c
ON rn <= CASE t.tier WHEN 1 THEN 30 WHEN 2 THEN 20 ELSE 5 END""",
    TIER_CTES,
)
def _(spark, sf_dir):
    claims = view(spark, sf_dir, "v_claims").select("id")
    return rs.tier_limited_claims(claims, _tiered(spark, sf_dir), {1: None, 2: 20, 3: 5}, limit=30).select("agent_name", "tier", "id")


@query(
    "agent_run_name",
    """SELECT event_id, CASE WHEN event_type = 'view' OR user_id % 2 = 0 THEN name ELSE concat(name, '__', translate(model, '/:', '--')) END AS run_name,
  string_split(CASE WHEN event_type = 'view' OR user_id % 2 = 0 THEN name ELSE concat(name, '__', translate(model, '/:', '--')) END, '__')[1] AS base
FROM (SELECT event_id, event_type, user_id, CASE WHEN user_id % 2 = 0 THEN 'uam_ga1__old' ELSE 'uam_ga1' END AS name, CASE WHEN event_type = 'view' THEN '' ELSE concat('hf.co/', event_type, ':q4') END AS model FROM events)""",
)
def _(spark, sf_dir):
    ev = table(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE WHEN user_id % 2 = 0 THEN 'uam_ga1__old' ELSE 'uam_ga1' END AS name",
        "CASE WHEN event_type = 'view' THEN '' ELSE concat('hf.co/', event_type, ':q4') END AS model")
    named = ev.select("event_id", rs.agent_run_name(F.col("name"), F.col("model")).alias("run_name"))
    return named.withColumn("base", rs.base_agent(F.col("run_name")))


@query(
    "agent_summary",
    """SELECT agent_name, count(*) AS n, CAST(sum(c) AS BIGINT) AS correct, round(sum(c) / count(*) * 100, 6) AS accuracy_pct,
  CAST(count(*) - sum(ok) AS BIGINT) AS errors, CAST(sum(tok) AS BIGINT) AS tokens, round(sum(t), 6) AS time_s, round(sum(t) / count(*), 6) AS avg_time_s, round(sum(tok) / greatest(sum(t), 0.1), 6) AS tok_per_s
FROM (SELECT agent_name, CASE WHEN model_label <> 'ERROR' THEN 1 ELSE 0 END AS ok, CASE WHEN model_label <> 'ERROR' THEN is_correct ELSE 0 END AS c,
  CASE WHEN model_label <> 'ERROR' THEN total_tokens ELSE 0 END AS tok, CASE WHEN model_label <> 'ERROR' THEN time_thought ELSE 0 END AS t FROM v_results) GROUP BY agent_name""",
)
def _(spark, sf_dir):
    return rs.agent_summary(results(spark, sf_dir))


RUN_CTES = """
ran AS (SELECT agent_name, id, row_number() OVER w AS pos, CAST(sum(CASE WHEN model_label <> 'ERROR' THEN is_correct ELSE 0 END) OVER w AS BIGINT) AS correct,
  CAST(sum(CASE WHEN model_label = 'ERROR' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS errors, count(*) OVER (PARTITION BY agent_name) AS n
  FROM v_results WINDOW w AS (PARTITION BY agent_name ORDER BY created_at, id)),
"""


@query("running_accuracy", "SELECT agent_name, id, pos, correct, errors, round(correct / pos * 100, 6) AS accuracy_pct FROM ran", RUN_CTES)
def _(spark, sf_dir):
    run = rs.running_accuracy(results(spark, sf_dir), _ORD)
    return run.select("agent_name", "id", "pos", "correct", "errors", "accuracy_pct")


@query(
    "accuracy_snapshots",
    "SELECT agent_name, pos, correct, errors, round(correct / greatest(pos - errors, 1) * 100, 6) AS accuracy_pct FROM ran WHERE pos % 50 = 0 OR pos = n",
    RUN_CTES,
)
def _(spark, sf_dir):
    return rs.accuracy_snapshots(rs.running_accuracy(results(spark, sf_dir), _ORD))


_COMPLETED = f"""SELECT string_split(agent_name, '__')[1] AS base_agent, model_name, count(*) AS n_rows FROM v_results
GROUP BY agent_name, model_name HAVING count(*) >= (SELECT count(*) FROM (SELECT id FROM v_claims UNION ALL SELECT doc_id FROM labels UNION ALL SELECT -1 - doc_id FROM labels))"""


def _claims_universe(spark, sf_dir):
    """The claims and two more per labelled document, one on its quality and one on its tone."""
    labelled = table(spark, sf_dir, "labels").select(F.explode(F.array(F.col("doc_id"), -1 - F.col("doc_id"))).alias("id"))
    return view(spark, sf_dir, "v_claims").select("id").unionByName(labelled)


def _completed(spark, sf_dir):
    return rs.completed_pairs(results(spark, sf_dir), _claims_universe(spark, sf_dir), BENCH)


@query("completed_pairs", _COMPLETED)
def _(spark, sf_dir):
    return _completed(spark, sf_dir)


@query(
    "select_agents",
    f"""SELECT agent_name, model_name FROM (SELECT DISTINCT agent_name, model_name FROM v_results) a
WHERE string_split(agent_name, '__')[1] IN ('uam_ga1', 'uam_ga2', 'uam_ga3') AND NOT EXISTS (
  SELECT 1 FROM ({_COMPLETED}) d WHERE d.base_agent = string_split(a.agent_name, '__')[1] AND d.model_name = a.model_name)""",
)
def _(spark, sf_dir):
    done = _completed(spark, sf_dir)
    names = [n for n, _ in AGENTS if n.split("__")[0] in ("uam_ga1", "uam_ga2", "uam_ga3")]
    return rs.select_agents(agents_of(spark, sf_dir), names, done).select("agent_name", "model_name")


_RESP = """SELECT concat('model-', CAST(conv_id % 3 AS STRING)) AS model, text AS response, role = 'assistant' AS success,
  CASE WHEN turn % 4 = 3 THEN NULL WHEN turn % 2 = 0 THEN 'E' ELSE substring(text, 2, 2) END AS expected, length(text) AS completion_tokens, (turn + 1) * 0.5 AS elapsed"""


@query(
    "model_throughput",
    f"""SELECT model, count(*) AS tests_total, CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS tests_passed,
  CAST(coalesce(sum(CASE WHEN success AND expected IS NOT NULL AND contains(substring(trim(response), 1, 5), expected) THEN 1 ELSE 0 END), 0) AS BIGINT) AS correct,
  CAST(sum(CASE WHEN success THEN completion_tokens ELSE 0 END) AS BIGINT) AS total_tokens, CAST(round(sum(CASE WHEN success THEN elapsed ELSE 0 END), 6) AS DOUBLE) AS total_time,
  round(sum(CASE WHEN success THEN completion_tokens ELSE 0 END) / CAST(sum(CASE WHEN success THEN elapsed ELSE 0 END) AS DOUBLE), 6) AS avg_tok_per_s
FROM ({_RESP} FROM conversations) GROUP BY model""",
)
def _(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").selectExpr(
        "concat('model-', CAST(conv_id % 3 AS STRING)) AS model", "text AS response", "role = 'assistant' AS success",
        "CASE WHEN turn % 4 = 3 THEN NULL WHEN turn % 2 = 0 THEN 'E' ELSE substring(text, 2, 2) END AS expected",
        "length(text) AS completion_tokens", "CAST((turn + 1) * 0.5 AS DOUBLE) AS elapsed")
    return rs.model_throughput(conv)


def _demo_labeler(agent: str):
    """Answers by the length of the claim; fails on some claims, as remote models do."""
    shift = int(agent.split("__")[0][-1])

    def label(claim: dict) -> dict:
        n = len(claim["claim_text"])
        if n % 7 == 0:
            raise RuntimeError(f"no answer for {claim['id']}")
        got = str((n + shift) % 4)
        truth = claim["label_original"]
        return {
            "model_label": got, "original_label": truth, "is_correct": got == truth, "total_tokens": n + shift,
            "prompt_tokens": n, "completion_tokens": shift, "time_thought": n / 100, "raw_output": f"label {got}",
        }

    return label


@query(
    "evaluate",
    """SELECT agent_name, model_name, benchmark_name, id AS claim_id, CASE WHEN n % 7 = 0 THEN 'ERROR' ELSE lab END AS model_label, label_original AS original_label,
  CAST(CASE WHEN n % 7 <> 0 AND lab = label_original THEN 1 ELSE 0 END AS INTEGER) AS is_correct, CAST(CASE WHEN n % 7 = 0 THEN 0 ELSE n + s END AS BIGINT) AS total_tokens,
  CAST(CASE WHEN n % 7 = 0 THEN 0 ELSE n END AS BIGINT) AS prompt_tokens, CAST(CASE WHEN n % 7 = 0 THEN 0 ELSE s END AS BIGINT) AS completion_tokens,
  CAST(CASE WHEN n % 7 = 0 THEN 0 ELSE n / 100 END AS DOUBLE) AS time_thought, CASE WHEN n % 7 = 0 THEN concat('ERROR: no answer for ', id) ELSE concat('label ', lab) END AS raw_output
FROM (SELECT *, length(claim_text) AS n, CAST((length(claim_text) + s) % 4 AS VARCHAR) AS lab FROM v_claims CROSS JOIN
  (SELECT DISTINCT agent_name, model_name, benchmark_name, CAST(substr(agent_name, 7, 1) AS INTEGER) AS s FROM v_results))""",
)
def _(spark, sf_dir):
    claims = view(spark, sf_dir, "v_claims")
    none = results(spark, sf_dir).filter("model_label = 'never'")
    pending = rs.pending_claims(claims, AGENTS, BENCH, none)
    return rs.evaluate(pending, _demo_labeler)


@query(
    "validate_results",
    """SELECT id, concat_ws(',', CASE WHEN ct IS NULL THEN 'completion_tokens' END, CASE WHEN ml IS NULL THEN 'model_label' END, 'time_thought') AS missing
FROM (SELECT id, nullif(completion_tokens, 7) AS ct, nullif(model_label, '') AS ml FROM v_results)""",
)
def _(spark, sf_dir):
    res = results(spark, sf_dir).drop("time_thought")
    res = res.withColumn("completion_tokens", F.nullif("completion_tokens", F.lit(7))).withColumn(
        "model_label", F.nullif("model_label", F.lit("")))
    return rs.validate_results(res).select("id", F.array_join("missing", ",").alias("missing"))


@query(
    "align_result_schema",
    """SELECT id, agent_name, CASE WHEN event_type = 'view' THEN '' WHEN event_type = 'click' THEN '' ELSE model_name END AS model_name FROM v_results""",
)
def _(spark, sf_dir):
    res = results(spark, sf_dir).select("id", "agent_name", "model_name", "event_type")
    old = res.filter("event_type = 'view'").drop("model_name")
    gaps = res.filter("event_type = 'click'").withColumn("model_name", F.lit(None).cast("string"))
    new = res.filter("event_type NOT IN ('view', 'click')")
    return rs.union_results([old, gaps, new]).select("id", "agent_name", "model_name")


# ---- repair ------------------------------------------------------------------------------


@query("classify_labels", "SELECT id, model_label, label_class FROM cls", LABEL_CTES)
def _(spark, sf_dir):
    return rp.classify_labels(results(spark, sf_dir)).select("id", "model_label", "label_class")


_CLASSES = ", ".join(f"('{c}', {i})" for i, c in enumerate(LABEL_CLASSES))


@query(
    "corruption_report",
    f"""SELECT CAST(d.no AS INTEGER) AS class_no, d.name AS label_class, count(c.id) AS n, round(count(c.id) / (SELECT count(*) FROM v_results) * 100, 6) AS pct
FROM (VALUES {_CLASSES}) d(name, no) LEFT JOIN cls c ON c.label_class = d.name GROUP BY 1, 2""",
    LABEL_CTES,
)
def _(spark, sf_dir):
    return rp.corruption_report(results(spark, sf_dir))


@query(
    "corruption_totals",
    "SELECT count(*) AS n_rows, count(*) FILTER (label_class <> 'valid') AS n_nonstandard, count(*) FILTER (label_class IN ('fixable_float', 'fixable_prefix', 'fixable_array')) AS n_fixable FROM cls",
    LABEL_CTES,
)
def _(spark, sf_dir):
    return rp.corruption_totals(results(spark, sf_dir))


@query("results_overview", "SELECT agent_name, count(*) AS n FROM v_results GROUP BY agent_name")
def _(spark, sf_dir):
    return rp.results_overview(results(spark, sf_dir))


@query(
    "nonstandard_labels",
    f"SELECT model_label, count(*) AS n, string_agg(DISTINCT agent_name, ',' ORDER BY agent_name) AS agents FROM v_results WHERE model_label NOT IN {_STANDARD} GROUP BY model_label",
)
def _(spark, sf_dir):
    return rp.nonstandard_labels(results(spark, sf_dir))


@query("mine_trajectory_label", "SELECT v.id, m.mined FROM v_results v LEFT JOIN mined m USING (id)", LABEL_CTES)
def _(spark, sf_dir):
    return rp.mine_trajectory_label(results(spark, sf_dir)).select("id", "mined")


@query(
    "recovery_estimate",
    f"""SELECT count(*) AS n_max_steps, count(*) FILTER (mined IN {_VALID}) AS n_recoverable, count(*) FILTER (mined IS NULL OR mined NOT IN {_VALID}) AS n_rerun
FROM v_results LEFT JOIN mined USING (id) WHERE model_label = 'ERROR_MAX_STEPS'""",
    LABEL_CTES,
)
def _(spark, sf_dir):
    return rp.recovery_estimate(results(spark, sf_dir))


@query("error_samples", "SELECT agent_name, count(*) AS n, arg_min(substr(raw_output, 1, 120), id) AS sample FROM v_results WHERE model_label = 'ERROR' GROUP BY agent_name")
def _(spark, sf_dir):
    return rp.error_samples(results(spark, sf_dir))


@query(
    "fix_labels",
    "SELECT id, coalesce(fix1, model_label) AS model_label, CAST(CASE WHEN fix1 IS NULL THEN is_correct WHEN fix1 = original_label THEN 1 ELSE 0 END AS INTEGER) AS is_correct FROM plan",
    LABEL_CTES,
)
def _(spark, sf_dir):
    return rp.fix_labels(results(spark, sf_dir)).select("id", "model_label", "is_correct")


@query(
    "recover_max_steps",
    "SELECT id, coalesce(fix2, model_label) AS model_label, CAST(CASE WHEN fix2 IS NULL THEN is_correct WHEN fix2 = original_label THEN 1 ELSE 0 END AS INTEGER) AS is_correct FROM plan",
    LABEL_CTES,
)
def _(spark, sf_dir):
    return rp.recover_max_steps(results(spark, sf_dir)).select("id", "model_label", "is_correct")


@query(
    "drop_unfixable",
    f"""SELECT id, agent_name, model_label FROM v_results WHERE NOT (model_label IN {_UNFIX} OR (model_label NOT IN {_STANDARD} AND model_label NOT IN ('ERROR', 'ERROR_MAX_STEPS')))""",
)
def _(spark, sf_dir):
    return rp.drop_unfixable(results(spark, sf_dir)).select("id", "agent_name", "model_label")


@query(
    "unfixable_counts",
    f"""SELECT model_label, count(*) AS n FROM v_results WHERE model_label IN {_UNFIX} OR (model_label NOT IN {_STANDARD} AND model_label NOT IN ('ERROR', 'ERROR_MAX_STEPS')) GROUP BY model_label""",
)
def _(spark, sf_dir):
    return rp.unfixable_counts(results(spark, sf_dir))


_PASS = f"CASE WHEN fix1 IS NOT NULL THEN 1 WHEN fix2 IS NOT NULL THEN 2 WHEN model_label IN {_UNFIX} OR (nonstd AND model_label <> 'ERROR_MAX_STEPS') THEN 3 END"


@query(
    "repair_plan",
    f"""SELECT id, agent_name, model_label AS old_label, coalesce(fix1, fix2) AS new_label, CAST({_PASS} AS INTEGER) AS pass_no, CASE WHEN {_PASS} = 3 THEN 'delete' ELSE 'update' END AS action
FROM plan WHERE {_PASS} IS NOT NULL""",
    LABEL_CTES,
)
def _(spark, sf_dir):
    return rp.repair_plan(results(spark, sf_dir))


@query("repair_results", "SELECT id, agent_name, claim_id, model_label, is_correct FROM repaired", LABEL_CTES)
def _(spark, sf_dir):
    return rp.repair_results(results(spark, sf_dir)).select("id", "agent_name", "claim_id", "model_label", "is_correct")


@query(
    "repair_summary",
    f"""SELECT count(*) FILTER ({_PASS} = 1) AS fixed_labels, count(*) FILTER ({_PASS} = 2) AS recovered, count(*) FILTER ({_PASS} = 3) AS deleted,
  (SELECT count(*) FROM repaired WHERE model_label = 'ERROR_MAX_STEPS') AS max_steps_left FROM plan""",
    LABEL_CTES,
)
def _(spark, sf_dir):
    return rp.repair_summary(results(spark, sf_dir))


@query("fix_labels_strict", """SELECT id, CASE WHEN coalesce(f1, f2, f3) IN ('0', '1', '2', '3') AND (x IS NULL OR f1 IS NOT NULL) THEN coalesce(f1, f2, f3) END AS fixed FROM fixes""", LABEL_CTES)
def _(spark, sf_dir):
    return results(spark, sf_dir).select("id", fix_label(F.col("model_label"), F.col("agent_name"), strict=True).alias("fixed"))


@query(
    "completeness",
    """SELECT a.agent_name, coalesce(d.n, 0) AS completed, t.n AS total, CASE WHEN t.n = 0 THEN 'no input' WHEN coalesce(d.n, 0) = t.n THEN 'complete' ELSE concat('missing ', t.n - coalesce(d.n, 0)) END AS status
FROM (SELECT DISTINCT agent_name FROM v_results UNION SELECT DISTINCT concat(string_split(agent_name, '__')[1], '__new') FROM v_results) a
LEFT JOIN (SELECT agent_name, count(DISTINCT claim_id) AS n FROM v_results WHERE model_label <> 'ERROR' GROUP BY 1) d USING (agent_name)
CROSS JOIN (SELECT count(DISTINCT claim_id) AS n FROM v_results) t""",
)
def _(spark, sf_dir):
    res = results(spark, sf_dir)
    names = res.select("agent_name").distinct()
    expected = names.union(names.select(F.concat(rs.base_agent(F.col("agent_name")), F.lit("__new"))))
    return rs.completeness(res, expected, res.select("claim_id").distinct(), BENCH)


# ---- comparable subset -------------------------------------------------------------------

_SAMPLE = "SELECT doc_id AS id FROM documents ORDER BY md5(concat(CAST(doc_id AS VARCHAR), ':42')), doc_id LIMIT 400"


@query("sample_subset", _SAMPLE)
def _(spark, sf_dir):
    return sb.sample_subset(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), 400, 42)


@query(
    "coverage_matrix",
    """SELECT string_split(agent_name, '__')[1] AS base_agent, count(DISTINCT claim_id) FILTER (model_name = 'bielik-11b') AS bielik_11b,
  count(DISTINCT claim_id) FILTER (model_name = 'llama3.1-8b') AS llama3_1_8b FROM v_results WHERE model_label <> 'ERROR' GROUP BY 1""",
)
def _(spark, sf_dir):
    return plain_names(sb.coverage_matrix(_good(spark, sf_dir), MODELS))


SUBSET_CTES = """
good AS (SELECT * FROM v_results WHERE model_label <> 'ERROR'),
common AS (SELECT claim_id FROM good GROUP BY claim_id HAVING count(DISTINCT agent_name) = 12),
restricted AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent_name, claim_id, benchmark_name, model_name ORDER BY created_at, id) AS rn FROM v_results
  WHERE claim_id IN (SELECT claim_id FROM common)) WHERE rn = 1),
"""


def _good(spark, sf_dir):
    return results(spark, sf_dir).filter("model_label <> 'ERROR'")


def _common(spark, sf_dir):
    return sb.common_claims(_good(spark, sf_dir), BASES, MODELS)


def _restricted(spark, sf_dir):
    return sb.restrict_results(results(spark, sf_dir), _common(spark, sf_dir), BENCH, MODELS, _ORD)


@query("common_claims", "SELECT claim_id FROM common", SUBSET_CTES)
def _(spark, sf_dir):
    return _common(spark, sf_dir)


@query(
    "coverage_check",
    """SELECT 'outside_subset' AS problem, '' AS pair, count(*) AS n FROM common WHERE claim_id NOT IN (SELECT id FROM v_claims) HAVING count(*) > 0
UNION ALL SELECT 'pair_missing', concat(p.base, '/', p.model_name), count(*) FROM common c CROSS JOIN (SELECT DISTINCT string_split(agent_name, '__')[1] AS base, model_name FROM v_results) p
WHERE NOT EXISTS (SELECT 1 FROM v_results r WHERE r.claim_id = c.claim_id AND string_split(r.agent_name, '__')[1] = p.base AND r.model_name = p.model_name) GROUP BY 2
UNION ALL SELECT 'no_common', '', 0 FROM (SELECT count(*) AS c FROM common) WHERE c = 0""",
    SUBSET_CTES,
)
def _(spark, sf_dir):
    return sb.coverage_check(_common(spark, sf_dir), view(spark, sf_dir, "v_claims").select("id"), results(spark, sf_dir), BASES, MODELS)


@query("restrict_results", "SELECT id, agent_name, claim_id, model_name FROM restricted", SUBSET_CTES)
def _(spark, sf_dir):
    return _restricted(spark, sf_dir).select("id", "agent_name", "claim_id", "model_name")


@query(
    "enrich_claims",
    "SELECT id, claim_text, topic, claim_date, label_original, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.exam_type') END AS exam_type, metadata FROM v_claims WHERE id IN (SELECT claim_id FROM common)",
    SUBSET_CTES,
)
def _(spark, sf_dir):
    return sb.enrich_claims(view(spark, sf_dir, "v_claims"), _common(spark, sf_dir))


@query(
    "validate_subset",
    """SELECT agent_name, model_name, count(*) AS n_rows, count(DISTINCT claim_id) AS n_claims, (SELECT count(*) FROM common) AS n_common,
  (SELECT count(*) FROM v_claims WHERE id IN (SELECT claim_id FROM common)) AS n_claim_rows, CASE WHEN count(DISTINCT claim_id) <> (SELECT count(*) FROM common) THEN 1 ELSE 0 END AS mismatch
FROM restricted GROUP BY 1, 2""",
    SUBSET_CTES,
)
def _(spark, sf_dir):
    common = _common(spark, sf_dir)
    enriched = sb.enrich_claims(view(spark, sf_dir, "v_claims"), common)
    return sb.validate_subset(_restricted(spark, sf_dir), common, enriched)
