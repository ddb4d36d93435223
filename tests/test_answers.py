from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from verispark.functions import jsontext as js
from verispark.functions import labels as lb
from verispark.operators import outputs as out
from verispark.operators import prompts as pr
from verispark.operators import votes as vt


def test_thinking_and_blocks(one):
    t = "<THINK>a {x}\nb</think> x ```json\n{\"a\": 1}\n``` <scratchpad>z</scratchpad>"
    assert one(js.strip_thinking(F.col("t")), t=t) == "x ```json\n{\"a\": 1}\n```"
    assert one(js.valid_json_block(F.col("t")), t=t) == '{"a": 1}'
    assert one(js.valid_json_block(F.col("t")), t='say {"a": {"b": 2}} end') == '{"a": {"b": 2}}'
    assert one(js.valid_json_block(F.col("t")), t="no json") is None
    assert one(js.valid_json_block(F.col("t")), t="} {") is None
    assert one(js.valid_json_block(F.col("t")), t="{bad}") is None


@pytest.mark.parametrize(
    ("text", "want"),
    [('```json\n["a", "", "b"]\n```', ["a", "b"]), ('text ["x"] more', ["x"]), ("nothing", []), ("[1, 0, null, true, \"0\"]", ["1", "True", "0"]),
     ('{"a": 1}', []), ("[broken", []), ("[]", []), ('`["q"]`', ["q"])],
)
def test_lists(one, text, want):
    assert one(js.parse_json_list(F.col("t")), t=text) == want


def test_subclaims_fall_back_to_the_claim(spark):
    df = spark.createDataFrame([(1, '["a", "b"]', "whole"), (2, "none", "whole")], "claim_id long, raw string, claim_text string")
    rows = out.explode_subclaims(df).orderBy("claim_id", "pos").collect()
    assert [(r.claim_id, r.pos, r.sub_claim) for r in rows] == [(1, 0, "a"), (1, 1, "b"), (2, 0, "whole")]


@pytest.mark.parametrize(
    ("fn", "text", "want"),
    [(lb.label_first_digit, "A 1 then 3", "1"), (lb.label_first_digit, " 2 ", "2"), (lb.label_first_digit, " x ", "x"),
     (lb.label_cot, "A 1 then 3", "3"), (lb.label_cot, "Odpowiedź: 2, nie 3", "2"), (lb.label_cot, "3", "3"), (lb.label_cot, "odpowiedz:0\n1", "0"),
     (lb.label_cot, "1\nnic", "1"), (lb.label_cot, "brak", "brak"),
     (lb.label_verbal, "Odpowiedź: FAŁSZ. PRAWDA", "FAŁSZ"), (lb.label_verbal, "to CZĘŚCIOWA_PRAWDA", "PRAWDA"), (lb.label_verbal, "manipulacja!", "MANIPULACJA"),
     (lb.label_verbal, "nic", "ERROR"), (lambda c: lb.label_verbal(c, "longest"), "to CZĘŚCIOWA_PRAWDA", "CZĘŚCIOWA_PRAWDA"),
     (lb.label_json_field, '{"label": "PRAWDA"}', "PRAWDA"), (lb.label_json_field, '{"x": 1}', "ERROR"), (lb.label_json_field, "bad", "ERROR"),
     (lb.normalize_uam_label, "1.0", "1"), (lb.normalize_uam_label, "Output: 2", "2"), (lb.normalize_uam_label, "ERROR_MAX_STEPS", "ERROR_MAX_STEPS"), (lb.normalize_uam_label, "12", "12")],
)
def test_labels(one, fn, text, want):
    assert one(fn(F.col("t")), t=text) == want


def test_unknown_verbal_mode(spark):
    with pytest.raises(ValueError):
        lb.label_verbal(F.lit("x"), "other")


def test_turn_logs(spark):
    def final(label):
        return f'{{"action": "final_answer", "action_input": {{"label": {label}}}}}'

    logs = {
        1: ["{bad", final('"2"'), final('"3"')],
        2: ['{"action": "search"}'] * 5,
        3: [final('""')],
        4: ['{"action": "final_answer"}'],
        5: ['{"action": "search"}'] * 5 + [final('"1"')],
        6: [final("0")],
        7: [final("3")],
    }
    rows = [("a", c, s, t, 10, 7, 3) for c, turns in logs.items() for s, t in enumerate(turns)]
    df = spark.createDataFrame(rows, "agent_name string, claim_id long, step int, content string, total_tokens int, prompt_tokens int, completion_tokens int")
    got = {r.claim_id: (r.model_label, r.total_tokens) for r in out.react_outcome(df).collect()}
    assert got == {1: ("2", 20), 2: ("ERROR_MAX_STEPS", 50), 3: ("ERROR", 10), 4: ("ERROR", 10), 5: ("ERROR_MAX_STEPS", 50), 6: ("ERROR", 10), 7: ("3", 10)}
    assert {r.claim_id: r.model_label for r in out.react_outcome(df, max_steps=8).collect()}[5] == "1"


def test_scores(one):
    assert one(out.is_correct(F.lit("1"), F.lit("1"))) == 1
    assert one(out.is_correct(F.lit("prawda"), F.lit("PRAWDA"))) == 0
    assert one(out.is_correct(F.lit("prawda"), F.lit("PRAWDA"), ignore_case=True)) == 1


def votes(spark, *rows):
    return spark.createDataFrame([(c, s, lab, r) for c, s, lab, r in rows], "claim_id long, style_no int, label string, reasoning string")


def test_votes(spark):
    v = votes(spark, (1, 1, "2", ""), (1, 2, "0", ""), (1, 3, "0", ""), (2, 1, "3", ""), (2, 2, "1", ""), (2, 3, "2", ""), (3, 1, "1", ""), (3, 2, "1", ""), (3, 3, "1", ""))
    got = {r.claim_id: (r.labels, r.majority_label, r.majority_count) for r in vt.vote_summary(v).collect()}
    assert got == {1: ("2,0,0", "0", 2), 2: ("3,1,2", "3", 1), 3: ("1,1,1", "1", 3)}
    assert {r.claim_id: r.label for r in vt.unanimous_fast_path(v).collect()} == {1: None, 2: None, 3: "1"}


def test_grounding(spark):
    v = votes(spark, (1, 1, "0", "nic"), (1, 2, "0", "warszawa"), (1, 3, "1", "Warszawa i historia"), (2, 1, "0", "warszawa"), (2, 2, "1", ""), (2, 3, "2", ""))
    e = spark.createDataFrame([(1, "Warszawa", "Historia"), (1, "Ala", "Warszawa")], "claim_id long, title string, section string")
    g = vt.evidence_grounding(v, e)
    assert {(r.claim_id, r.style_no): r.score for r in g.collect()} == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (2, 1): 0, (2, 2): 0, (2, 3): 0}
    assert [(r.claim_id, r.style_no, r.majority_score) for r in vt.grounded_minority(g).collect()] == [(1, 3, 0.5)]
    report = {r.claim_id: r.report for r in vt.grounding_report(g).collect()}
    assert report[2] == ""
    assert report[1].splitlines() == [
        "Wstępna analiza grounding'u (automatyczna):",
        "  - Ekspert 1: 0 odwołań do artykułów z kontekstu, odpowiedź: 0",
        "  - Ekspert 2: 1 odwołań do artykułów z kontekstu, odpowiedź: 0",
        "  - Ekspert 3: 2 odwołań do artykułów z kontekstu, odpowiedź: 1",
        "  Większość (2/3) wybrała: 0.",
        "  ⚠ Ekspert 3 (mniejszość) ma wyższy grounding (2) niż średnia większości (0). Rozważ jakość argumentów.",
    ]


def test_prompts(spark):
    subs = spark.createDataFrame([(1, 1, 'b "x"', ""), (1, 0, "a", "ctx")], "claim_id long, pos int, sub_claim string, context string")
    q = spark.createDataFrame([(1, "Pytanie?")], "claim_id long, question string")
    text = pr.build_evidence_prompt(subs, q, "debater").first().prompt
    assert text == (
        'Twierdzenie do weryfikacji:\nPytanie?\n\nPod-twierdzenia: ["a", "b \\"x\\""]\n\n'
        "=== Pod-twierdzenie 1: a ===\nKontekst z Wikipedii:\nctx\n\n=== Pod-twierdzenie 2: b \"x\" ===\n⚠ Brak kontekstu w bazie wiedzy.\n")
    assert pr.build_evidence_prompt(subs, q, "judge").first().prompt == "Pod-twierdzenie: a\nctx\n"
    assert pr.build_evidence_prompt(subs.filter("pos = 1"), q, "judge").first().prompt == "(brak)"
    with pytest.raises(ValueError):
        pr.build_evidence_prompt(subs, q, "other")


def test_debate(spark):
    rows = [(1, r, role, f"{role[0]}{r}", str(r), r == 2 and role == "opponent", 10) for r in range(3) for role in ("opponent", "proponent")]
    df = spark.createDataFrame(rows, "claim_id long, round_no int, role string, argument string, label string, failed boolean, total_tokens int")
    entry = "── {} ({}) ──\n{}\n".format
    opening = entry("PROPONENT", "Opening", "p0") + "\n" + entry("OPONENT", "Opening", "o0")
    assert pr.debate_transcript(df).first().transcript.startswith(opening)
    history = {r.round_no: r.history for r in pr.debate_history(df).collect()}
    assert history[0] == "" and history[1] == opening and history[2].endswith(entry("OPONENT", "Rebuttal", "o1"))
    final = {r.role: (r.label, r.tokens) for r in pr.final_labels(df).collect()}
    assert final == {"proponent": ("2", 30), "opponent": ("NIEWERYFIKOWALNE", 20)}


def test_confidence(spark):
    df = spark.createDataFrame([(1, 0.4), (2, 0.5), (3, None)], "claim_id long, nli_score double")
    assert [(r.nli_score, r.confident) for r in vt.low_confidence(df).orderBy("claim_id").collect()] == [(0.4, 0), (0.5, 1), (1.0, 1)]
