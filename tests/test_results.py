from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verispark.functions import labels as lb
from verispark.operators import repair as rp
from verispark.operators import results as rs
from verispark.operators import subset as sb
from verispark.views import view

SCHEMA = (
    "id long, agent_name string, claim_id long, benchmark_name string, model_name string, original_label string, model_label string, "
    "is_correct int, total_tokens long, prompt_tokens long, completion_tokens long, time_thought double, raw_output string, created_at string"
)


def result(i, agent="uam_ga1__m", claim=0, label="1", truth="1", raw="", model="m", at=None):
    return (i, agent, claim, "b", model, truth, label, int(label == truth), 10, 7, 3, 0.5, raw, at or f"2026-01-01T00:00:{i % 60:02d}")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


@pytest.mark.parametrize(
    ("label", "fixed", "strict", "cls"),
    [("1.0", "1", "1", "fixable_float"), ("2.5", "2", None, "fixable_float"), ("Output: 2", "2", "2", "fixable_prefix"),
     ("['1', '3']", "1", "1", "fixable_prefix"), ("-1", "1", None, "corrupt_float_oob"), ("7", None, None, "corrupt_float_oob"),
     ("['x']", None, None, "fixable_array"), ("None", None, None, "corrupt_other"), ("", None, None, "corrupt_other"),
     ("1d", None, None, "corrupt_other"), ("NaN", None, None, "corrupt_other"), ("3", "3", "3", "valid"),
     ("ERROR", None, None, "error_generic"), ("ERROR_MAX_STEPS", None, None, "error_max_steps"), ("4", None, None, "corrupt_float_oob"),
     (" 2 ", "2", "2", "fixable_float"), ("1e0", "1", "1", "fixable_float"), ("3.004", "3", "3", "fixable_float")],
)
def test_label_rules(spark, label, fixed, strict, cls):
    row = spark.createDataFrame([(label, "uam_ga1")], "l string, a string").select(
        lb.fix_label(F.col("l"), F.col("a")).alias("f"), lb.fix_label(F.col("l"), F.col("a"), strict=True).alias("s"),
        lb.classify_label(F.col("l"), F.col("a")).alias("c")).first()
    assert (row.f, row.s, row.c) == (fixed, strict, cls)


def test_verbal_agents_take_verbal_labels(spark):
    df = spark.createDataFrame([("FAŁSZ", "dem_ga1"), ("FAŁSZ", "uam_ga1"), ("4", "dem_ga1")], "l string, a string")
    assert [r.c for r in df.select(lb.classify_label(F.col("l"), F.col("a")).alias("c")).collect()] == ["valid", "corrupt_other", "valid"]


TRAJECTORIES = {
    '[{"role":"assistant","content":"{\\"action\\":\\"final_answer\\",\\"action_input\\":{\\"label\\":\\" 2 \\"}}"}]': "2",
    '[{"role":"assistant","content":"```json\\n{\\"action\\":\\"final_answer\\",\\"action_input\\":{\\"label\\":3}}\\n```"},{"role":"user","content":"\\"label\\": \\"0\\""}]': "3",
    '[{"role":"assistant","content":"bad {\\"label\\" : \\"1\\""}]': "1",
    '[{"role":"assistant","content":"\\"label\\": \\"0\\""},{"role":"assistant","content":"nothing"}]': "0",
    '[{"role":"assistant","content":"nothing"}]': None,
    "not json": None,
    "": None,
    "[]": None,
}


def test_mining(spark):
    df = frame(spark, *[result(i, label="ERROR_MAX_STEPS", raw=t) for i, t in enumerate(TRAJECTORIES)])
    got = [r.mined for r in rp.mine_trajectory_label(df).orderBy("id").collect()]
    assert got == list(TRAJECTORIES.values())
    row = rp.recovery_estimate(df).first()
    assert (row.n_max_steps, row.n_recoverable, row.n_rerun) == (8, 4, 4)


def test_repair_is_idempotent_and_matches_its_plan(spark, sf):
    res = view(spark, sf, "v_results")
    once = rp.repair_results(res).select("id", "model_label", "is_correct")
    again = rp.repair_results(rp.repair_results(res)).select("id", "model_label", "is_correct")
    assert sorted(once.collect()) == sorted(again.collect())
    plan = {r.id: r for r in rp.repair_plan(res).collect()}
    before = {r.id: r.model_label for r in res.collect()}
    after = {r.id: r.model_label for r in once.collect()}
    for i, old in before.items():
        if i not in plan:
            assert after[i] == old
        elif plan[i].action == "delete":
            assert i not in after
        else:
            assert after[i] == plan[i].new_label
    skipped = {r.pass_no for r in rp.repair_plan(res, skip_mining=True).collect()}
    assert skipped == {1, 3}


def test_repair_recomputes_correctness(spark):
    df = frame(spark, result(1, label="1.0", truth="1"), result(2, label="Output: 2", truth="3"), result(3, label="7"))
    got = {r.id: (r.model_label, r.is_correct) for r in rp.repair_results(df).collect()}
    assert got == {1: ("1", 1), 2: ("2", 0)}
    assert {r.model_label: r.n for r in rp.unfixable_counts(df).collect()} == {"1.0": 1, "Output: 2": 1, "7": 1}


def test_insert_ignores_known_keys(spark):
    target = frame(spark, result(1, claim=1))
    batch = frame(spark, result(2, claim=1), result(3, claim=2, at="2026-01-02"), result(4, claim=2, at="2026-01-01"))
    got = rs.insert_results(target, batch, ["created_at", "id"])
    assert sorted(r.id for r in got.collect()) == [1, 4]
    assert [r.id for r in rs.new_results(target, batch, ["created_at", "id"]).collect()] == [4]
    assert rs.new_results(got, batch, ["created_at", "id"]).count() == 0
    assert sorted(r.id for r in rs.insert_results(got, batch, ["created_at", "id"]).collect()) == [1, 4]


rows = st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 3), st.sampled_from(["m", "n"])), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows, rows, rows)
def test_merge_keeps_every_key_once(spark, t, s1, s2):
    def make(items, base):
        return frame(spark, *[result(base + i, agent=a, claim=c, model=m) for i, (a, c, m) in enumerate(items)])

    target = rs.keep_first(make(t, 0), rs.KEY, ["id"])
    sources = [make(s1, 100), make(s2, 200)]
    merged = rs.merge_results(target, sources, ["id"])
    keys = [(r.agent_name, r.claim_id, r.model_name) for r in target.collect() + merged.collect()]
    assert len(keys) == len(set(keys)) and set(keys) == set(t) | set(s1) | set(s2)
    full = rs.union_results([target, merged.drop("source_no")])
    assert rs.merge_results(full, sources, ["id"]).count() == 0
    counts = rs.merge_counts(merged, sources).collect()
    assert sum(r.inserted for r in counts) == merged.count()
    assert all(r.inserted + r.skipped == r.n_rows for r in counts)


def test_merge_reads_the_target_once(spark, sf):
    res = view(spark, sf, "v_results")
    target = rs.keep_first(res.filter("event_type = 'view'"), rs.KEY, ["id"])
    sources = [res.filter(F.col("event_type") == t) for t in ("click", "error", "purchase")]
    plan = rs.merge_results(target, sources, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 + len(sources)
    assert plan.count("row_number(), 1, Partial") == 2


def test_old_tables_without_model_name(spark):
    old = frame(spark, result(1)).drop("model_name")
    assert rs.align_result_schema(old).first().model_name == ""


def labeler(fail_on=None):
    def make(agent):
        def label(claim):
            if claim["id"] == fail_on:
                raise RuntimeError("crash")
            return {"model_label": "1", "original_label": claim["label"], "is_correct": claim["label"] == "1", "total_tokens": 5,
                    "prompt_tokens": 3, "completion_tokens": 2, "time_thought": 0.1, "raw_output": "ok"}

        return label

    return make


def test_crash_and_resume(spark):
    claims = spark.createDataFrame([(i, f"claim {i}", str(i % 3)) for i in range(10)], "id long, claim_text string, label string")
    agents = [("uam_ga1__m", "m")]
    none = frame(spark).filter("false")
    first = rs.evaluate(rs.pending_claims(claims, agents, "b", none), labeler(fail_on=5), partitions=3)
    stamped = first.withColumn("created_at", F.lit("2026-01-01")).withColumn("id", F.col("claim_id"))
    store = rs.insert_results(none, stamped, ["claim_id"])
    store = spark.createDataFrame(store.collect(), store.schema)
    assert store.count() == 10
    errors = store.filter("model_label = 'ERROR'").collect()
    assert len(errors) == 1 and errors[0].raw_output == "ERROR: crash" and errors[0].model_name == "m"
    kept = rs.purge_errors(store, store)
    pending = rs.pending_claims(claims, agents, "b", kept)
    assert [r.id for r in pending.collect()] == [5]
    second = rs.evaluate(pending, labeler()).withColumn("created_at", F.lit("x")).withColumn("id", F.col("claim_id"))
    done = rs.insert_results(kept, second, ["claim_id"])
    assert done.count() == 10 and done.filter("model_label = 'ERROR'").count() == 0


def test_result_without_a_field_becomes_an_error(spark):
    claims = spark.createDataFrame([(1, "c", "1")], "id long, claim_text string, label string")
    got = rs.evaluate(rs.pending_claims(claims, [("a", "m")], "b", frame(spark)), lambda a: (lambda c: {"model_label": "1"})).first()
    assert got.model_label == "ERROR" and "completion_tokens" in got.raw_output


def test_purge_keeps_max_steps_and_other_scopes(spark):
    df = frame(spark, result(1, label="ERROR"), result(2, label="ERROR_MAX_STEPS"), result(3, label="ERROR", agent="other"))
    assert sorted(r.id for r in rs.purge_errors(df, frame(spark, result(9))).collect()) == [2, 3]


def test_names_and_tiers(spark, one):
    assert one(rs.agent_run_name(F.col("a"), F.col("m")), a="uam_ga6", m="hf.co/x:y") == "uam_ga6__hf.co-x-y"
    assert one(rs.agent_run_name(F.col("a"), F.col("m")), a="uam_ga6__z", m="x") == "uam_ga6__z"
    assert one(rs.agent_run_name(F.col("a"), F.col("m")), a="uam_ga6", m="") == "uam_ga6"
    agents = spark.createDataFrame([("uam_ga1__m", None), ("dem_ga5", None), ("uam_ga6", None), ("new", None), ("uam_ga6__x", 1)], "agent_name string, cost_tier int")
    assert [r.tier for r in rs.assign_tier(agents).collect()] == [1, 2, 3, 2, 1]
    claims = spark.range(50)
    got = rs.tier_limited_claims(claims, rs.assign_tier(agents), {1: None, 2: 7, 3: 3}, limit=20)
    n = {r.agent_name: (r["count"], r.top) for r in got.groupBy("agent_name").agg(F.count("*").alias("count"), F.max("id").alias("top")).collect()}
    assert n == {"uam_ga1__m": (20, 19), "uam_ga6__x": (20, 19), "dem_ga5": (7, 6), "new": (7, 6), "uam_ga6": (3, 2)}


def test_completed_counts_errors_but_completeness_does_not(spark):
    claims = spark.range(2)
    df = frame(spark, result(1, claim=0), result(2, claim=1, label="ERROR"))
    assert [r.base_agent for r in rs.completed_pairs(df, claims, "b").collect()] == ["uam_ga1"]
    row = rs.completeness(df, df.select("agent_name"), claims, "b").first()
    assert (row.completed, row.total, row.status) == (1, 2, "missing 1")
    empty = rs.completeness(df, df.select("agent_name"), claims.filter("false"), "b").first()
    assert empty.status == "no input"
    agents = df.select("agent_name", "model_name").distinct()
    assert rs.select_agents(agents, None, rs.completed_pairs(df, claims, "b")).count() == 0


def test_running_accuracy_and_snapshots(spark):
    df = frame(spark, *[result(i, claim=i, label="ERROR" if i % 10 == 3 else str(i % 2), truth="1") for i in range(120)])
    run = rs.running_accuracy(df.withColumn("created_at", F.col("id")), ["created_at", "id"])
    snaps = rs.accuracy_snapshots(run).orderBy("pos").collect()
    assert [s.pos for s in snaps] == [50, 100, 120]
    good = sum(1 for i in range(120) if i % 10 != 3 and i % 2 == 1)
    assert snaps[-1].accuracy_pct == pytest.approx(good / (120 - 12) * 100, abs=1e-6)


def test_subset(spark):
    rows = [result(i * 10 + j, agent=f"{a}__{m}", claim=c, model=m) for i, (a, m) in enumerate([("x", "m"), ("x", "n"), ("y", "m"), ("y", "n")])
            for j, c in enumerate(range(3 if (a, m) == ("y", "n") else 4))]
    df = frame(spark, *rows)
    common = sb.common_claims(df, ["x", "y"], ["m", "n"])
    assert sorted(r.claim_id for r in common.collect()) == [0, 1, 2]
    matrix = {r.base_agent: (r.m, r.n) for r in sb.coverage_matrix(df, ["m", "n"]).collect()}
    assert matrix == {"x": (4, 4), "y": (4, 3)}
    problems = sb.coverage_check(common, spark.range(2), df.filter("claim_id <> 1"), ["x", "y"], ["m", "n"]).collect()
    assert {(p.problem, p.pair, p.n) for p in problems} == {
        ("outside_subset", "", 1), *{("pair_missing", f"{a}/{m}", 1) for a in "xy" for m in "mn"}}
    none = sb.coverage_check(common.filter("false"), spark.range(2), df, ["x"], ["m"]).collect()
    assert [p.problem for p in none] == ["no_common"]
    a = [r.id for r in sb.sample_subset(spark.range(100), 10, 42).collect()]
    assert a == [r.id for r in sb.sample_subset(spark.range(100).repartition(7), 10, 42).collect()]
    assert a != [r.id for r in sb.sample_subset(spark.range(100), 10, 43).collect()]


def test_validate_lists_missing_fields(spark):
    df = frame(spark, result(1)).drop("raw_output").withColumn("model_label", F.lit(None).cast("string"))
    assert rs.validate_results(df).first().missing == ["model_label", "raw_output"]


def test_null_labels_are_kept_and_counted(spark):
    rows = spark.createDataFrame(
        [(1, "a", 1, "b", "m", None, "0", 0, ""), (2, "a", 2, "b", "m", "ERROR", "0", 0, ""), (3, "a", 3, "b", "m", "1", "1", 1, "")],
        "id int, agent_name string, claim_id int, benchmark_name string, model_name string, model_label string, original_label string, is_correct int, raw_output string")
    assert [r.id for r in rs.purge_errors(rows, rows).orderBy("id").collect()] == [1, 3]
    plan = {r.id: r.action for r in rp.repair_plan(rows).collect()}
    assert plan == {1: "delete", 2: "delete"}
    assert {r.model_label: r.n for r in rp.unfixable_counts(rows).collect()} == {None: 1, "ERROR": 1}
    assert [r.id for r in rp.drop_unfixable(rows).collect()] == [3] and rp.repair_summary(rows).first().deleted == 2
