"""Queries over recorded answers, votes, debates and prompts (groups F and G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from verispark.functions import jsontext as js
from verispark.functions import labels as lb
from verispark.operators import outputs as out
from verispark.operators import prompts as pr
from verispark.operators import votes as vt
from verispark.plans.group_retrieval import BM25_CTES, bm25_benchmark
from verispark.plans.registry import query
from verispark.views import table, view

WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_STRIP = f"trim(regexp_replace(raw, '(?is)<think>.*?</think>|<reasoning>.*?</reasoning>|<scratchpad>.*?</scratchpad>', '', 'g'), {WS})"
_BLOCK = r"CASE WHEN regexp_matches(clean, '(?s)```(?:json)?(.*?)```') THEN trim(regexp_extract(clean, '(?s)```(?:json)?(.*?)```', 1), WSC) ELSE nullif(regexp_extract(clean, '(?s)\{.*\}', 0), '') END".replace("WSC", WS)
_T = f"trim(raw, {WS})"

ANSWER_CTES = f"""
ans AS (SELECT *, {_STRIP} AS clean FROM v_answers),
blk AS (SELECT *, {_BLOCK} AS block0 FROM ans),
parsed AS (SELECT *, CASE WHEN json_valid(block0) THEN block0 END AS block FROM blk),
lists AS (SELECT *, trim(trim(regexp_replace(raw, '```(?:json)?\\s*', '', 'g'), '`'), {WS}) AS l1, regexp_extract(raw, '(?s)\\[.*\\]', 0) AS l2 FROM v_answers),
items AS (SELECT conv_id, turn, text, list_filter(CASE WHEN json_valid(l1) AND json_type(l1) = 'ARRAY' THEN json_extract_string(l1, '$[*]') WHEN json_valid(l2) AND json_type(l2) = 'ARRAY' THEN json_extract_string(l2, '$[*]') ELSE CAST([] AS VARCHAR[]) END,
  lambda x: x <> '') AS items FROM lists),
"""


def answers(spark, sf_dir):
    return view(spark, sf_dir, "v_answers")


@query("strip_thinking", "SELECT conv_id, turn, clean FROM ans", ANSWER_CTES)
def _(spark, sf_dir):
    return answers(spark, sf_dir).select("conv_id", "turn", js.strip_thinking(F.col("raw")).alias("clean"))


@query("extract_json_block", "SELECT conv_id, turn, block0 AS block, CASE WHEN block IS NULL THEN 1 ELSE 0 END AS parse_error FROM parsed", ANSWER_CTES)
def _(spark, sf_dir):
    rows = answers(spark, sf_dir).withColumn("block", js.json_block(js.strip_thinking(F.col("raw"))))
    bad = (~F.coalesce(js.is_json(F.col("block")), F.lit(False))).cast("int")
    return rows.select("conv_id", "turn", "block", bad.alias("parse_error"))


@query("parse_json_list", "SELECT conv_id, turn, array_to_string(items, '|') AS items, CAST(len(items) AS INTEGER) AS n FROM items", ANSWER_CTES)
def _(spark, sf_dir):
    got = answers(spark, sf_dir).select("conv_id", "turn", js.parse_json_list(F.col("raw")).alias("items"))
    return got.select("conv_id", "turn", F.array_join("items", "|").alias("items"), F.size("items").alias("n"))


@query(
    "explode_subclaims",
    "SELECT claim_id, CAST(i - 1 AS INTEGER) AS pos, used[i] AS sub_claim FROM (SELECT claim_id, used, generate_subscripts(used, 1) AS i FROM (SELECT conv_id * 10 + turn AS claim_id, CASE WHEN len(items) > 0 THEN items ELSE [text] END AS used FROM items))",
    ANSWER_CTES,
)
def _(spark, sf_dir):
    rows = answers(spark, sf_dir).select((F.col("conv_id") * 10 + F.col("turn")).alias("claim_id"), "raw", F.col("text").alias("claim_text"))
    return out.explode_subclaims(rows)


@query("label_first_digit", f"SELECT conv_id, turn, coalesce(nullif(regexp_extract(raw, '[0-3]', 0), ''), {_T}) AS label FROM v_answers")
def _(spark, sf_dir):
    return answers(spark, sf_dir).select("conv_id", "turn", lb.label_first_digit(F.col("raw")).alias("label"))


@query(
    "label_cot",
    f"""SELECT conv_id, turn, CASE WHEN {_T} IN ('0', '1', '2', '3') THEN {_T} ELSE coalesce(nullif(regexp_extract(raw, '[Oo]dpowied[źz]:\\s*([0-3])', 1), ''), list_last(regexp_extract_all(raw, '[0-3]')), {_T}) END AS label FROM v_answers""",
)
def _(spark, sf_dir):
    return answers(spark, sf_dir).select("conv_id", "turn", lb.label_cot(F.col("raw")).alias("label"))


def _verbal_sql(labels) -> str:
    inside = " ".join(f"WHEN contains(upper(raw), '{v}') THEN '{v}'" for v in labels)
    return f"coalesce(nullif(regexp_extract(raw, '[Oo]dpowied[źz]:\\s*({'|'.join(labels)})', 1), ''), CASE {inside} ELSE 'ERROR' END)"


@query(
    "label_verbal",
    f"SELECT conv_id, turn, {_verbal_sql(lb.VERBAL_LABELS)} AS label, {_verbal_sql(sorted(lb.VERBAL_LABELS, key=len, reverse=True))} AS label_longest FROM v_answers",
)
def _(spark, sf_dir):
    return answers(spark, sf_dir).select(
        "conv_id", "turn", lb.label_verbal(F.col("raw")).alias("label"), lb.label_verbal(F.col("raw"), "longest").alias("label_longest"))


@query("label_json_field", "SELECT conv_id, turn, coalesce(CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.label') END, 'ERROR') AS label FROM v_answers")
def _(spark, sf_dir):
    return answers(spark, sf_dir).select("conv_id", "turn", lb.label_json_field(F.col("raw")).alias("label"))


_NUM = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"
_NORM = f"""coalesce(CASE WHEN regexp_matches(s, {_NUM}) THEN CASE WHEN abs(TRY_CAST(s AS DOUBLE) - round_even(TRY_CAST(s AS DOUBLE), 0)) < 0.01 AND round_even(TRY_CAST(s AS DOUBLE), 0) BETWEEN 0 AND 3
  THEN CAST(CAST(round_even(TRY_CAST(s AS DOUBLE), 0) AS INTEGER) AS VARCHAR) END END, nullif(regexp_extract(s, '\\b([0-3])\\b', 1), ''), s)"""


@query("normalize_uam_label", f"SELECT conv_id, turn, {_NORM} AS label FROM (SELECT conv_id, turn, {_T} AS s FROM v_answers)")
def _(spark, sf_dir):
    return answers(spark, sf_dir).select("conv_id", "turn", lb.normalize_uam_label(F.col("raw")).alias("label"))


# Runs: every conversation is one, its turns are the steps.
REACT_CTES = (
    ANSWER_CTES
    + """
fin AS (SELECT conv_id, turn, total_tokens, prompt_tokens, completion_tokens, CASE WHEN json_extract_string(block, '$.action') = 'final_answer' THEN coalesce(nullif(json_extract_string(block, '$.action_input.label'), ''), 'ERROR') END AS lab FROM parsed WHERE turn < 5),
ended AS (SELECT *, min(CASE WHEN lab IS NOT NULL THEN turn END) OVER (PARTITION BY conv_id) AS stop FROM fin),
"""
)


def steps(spark, sf_dir):
    return answers(spark, sf_dir).select(
        F.lit("uam_web").alias("agent_name"), F.col("conv_id").alias("claim_id"), F.col("turn").alias("step"),
        F.col("raw").alias("content"), "total_tokens", "prompt_tokens", "completion_tokens")


@query(
    "react_outcome",
    """SELECT 'uam_web' AS agent_name, conv_id AS claim_id, coalesce(max(lab), 'ERROR_MAX_STEPS') AS model_label, CAST(count(*) AS INTEGER) AS n_steps,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens
FROM ended WHERE stop IS NULL OR turn <= stop GROUP BY conv_id""",
    REACT_CTES,
)
def _(spark, sf_dir):
    return out.react_outcome(steps(spark, sf_dir))


@query(
    "react_outcome_web",
    """SELECT 'uam_web' AS agent_name, claim_id, coalesce(max(lab), 'ERROR_MAX_STEPS') AS model_label, CAST(count(*) AS INTEGER) AS n_steps, CAST(sum(length(content)) AS BIGINT) AS total_tokens,
  CAST(sum(turn) AS BIGINT) AS prompt_tokens, CAST(sum(length(content) - turn) AS BIGINT) AS completion_tokens
FROM (SELECT *, min(CASE WHEN lab IS NOT NULL THEN turn END) OVER (PARTITION BY claim_id) AS stop FROM (
  SELECT *, CASE WHEN content LIKE '<think>%' THEN CAST(claim_id % 5 AS VARCHAR) END AS lab FROM v_turns WHERE role = 'assistant' AND turn < 8))
WHERE stop IS NULL OR turn <= stop GROUP BY claim_id""",
)
def _(spark, sf_dir):
    turns = view(spark, sf_dir, "v_turns").filter("role = 'assistant'")
    n = F.length("content")
    rows = turns.select(
        F.lit("uam_web").alias("agent_name"), "claim_id", F.col("turn").alias("step"), "content", n.alias("total_tokens"),
        F.col("turn").alias("prompt_tokens"), (n - F.col("turn")).alias("completion_tokens"))
    return out.react_outcome(rows, out.WEB_MAX_STEPS, normalize=True)


@query(
    "score_predictions",
    f"""SELECT conv_id, turn, CASE WHEN {_T} = CAST(turn % 6 AS VARCHAR) THEN 1 ELSE 0 END AS exact, CASE WHEN upper(raw) = upper(text) THEN 1 ELSE 0 END AS any_case FROM v_answers""",
)
def _(spark, sf_dir):
    rows = answers(spark, sf_dir)
    return rows.select(
        "conv_id", "turn", out.is_correct(F.btrim("raw", F.lit(" \t\n\x0b\x0c\r")), (F.col("turn") % 6).cast("string")).alias("exact"),
        out.is_correct(F.col("raw"), F.col("text"), ignore_case=True).alias("any_case"))


# ---- votes -------------------------------------------------------------------------------

VOTE_CTES = """
per AS (SELECT claim_id, label, count(*) AS n, min(style_no) AS first FROM v_votes GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY n DESC, first) AS rn FROM per) WHERE rn = 1),
terms AS (SELECT DISTINCT doc_id AS claim_id, t AS term FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(concat('Doc ', doc_id, ' wniosek matematyka ', source)), '[^\\p{L}\\p{N}_]+')) AS t FROM documents) WHERE length(t) > 3),
scored AS (SELECT v.claim_id, v.style_no, v.label, count(t.term) AS score FROM v_votes v LEFT JOIN terms t ON t.claim_id = v.claim_id AND contains(lower(v.reasoning), t.term) GROUP BY 1, 2, 3),
panel AS (SELECT s.*, b.label AS maj, b.n AS maj_n, avg(CASE WHEN s.label = b.label THEN score END) OVER (PARTITION BY s.claim_id) AS maj_score FROM scored s JOIN best b USING (claim_id)),
"""


def votes(spark, sf_dir):
    return view(spark, sf_dir, "v_votes")


def _vote_evidence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("claim_id"), F.concat(F.lit("Doc "), "doc_id", F.lit(" wniosek matematyka")).alias("title"),
        F.col("source").alias("section"))


def _grounded(spark, sf_dir):
    return vt.evidence_grounding(votes(spark, sf_dir), _vote_evidence(spark, sf_dir))


@query(
    "vote_summary",
    """SELECT v.claim_id, string_agg(v.label, ',' ORDER BY style_no) AS labels, count(*) AS n_votes, count(DISTINCT v.label) AS n_labels, b.label AS majority_label, b.n AS majority_count
FROM v_votes v JOIN best b USING (claim_id) GROUP BY v.claim_id, b.label, b.n""",
    VOTE_CTES,
)
def _(spark, sf_dir):
    return vt.vote_summary(votes(spark, sf_dir))


@query(
    "unanimous_fast_path",
    """SELECT claim_id, CASE WHEN count(DISTINCT label) = 1 THEN 1 ELSE 0 END AS unanimous, CASE WHEN count(DISTINCT label) = 1 THEN min(label) END AS label,
  CASE WHEN count(DISTINCT label) = 1 THEN 0 ELSE 1 END AS needs_consolidation FROM v_votes GROUP BY claim_id""",
)
def _(spark, sf_dir):
    return vt.unanimous_fast_path(votes(spark, sf_dir))


@query("evidence_grounding", "SELECT claim_id, style_no, label, CAST(score AS INTEGER) AS score FROM scored", VOTE_CTES)
def _(spark, sf_dir):
    return _grounded(spark, sf_dir).select("claim_id", "style_no", "label", "score")


@query(
    "grounded_minority",
    "SELECT claim_id, maj AS majority_label, round(maj_score, 6) AS majority_score, style_no, label, CAST(score AS INTEGER) AS score FROM panel WHERE maj_n >= 2 AND label <> maj AND score > maj_score * 1.3",
    VOTE_CTES,
)
def _(spark, sf_dir):
    return vt.grounded_minority(_grounded(spark, sf_dir))


@query(
    "grounding_report",
    """SELECT claim_id, CASE WHEN max(maj_n) = count(*) OR (SELECT count(*) FROM terms t WHERE t.claim_id = p.claim_id) = 0 THEN '' ELSE concat_ws(chr(10), 'Wstępna analiza grounding''u (automatyczna):',
  string_agg(concat('  - Ekspert ', style_no, ': ', score, ' odwołań do artykułów z kontekstu, odpowiedź: ', label), chr(10) ORDER BY style_no),
  CASE WHEN max(maj_n) >= 2 THEN concat('  Większość (', max(maj_n), '/3) wybrała: ', max(maj), '.') END,
  string_agg(CASE WHEN maj_n >= 2 AND label <> maj AND score > maj_score * 1.3 THEN concat('  ⚠ Ekspert ', style_no, ' (mniejszość) ma wyższy grounding (', score, ') niż średnia większości (', CAST(round_even(maj_score, 0) AS INTEGER), '). Rozważ jakość argumentów.') END, chr(10) ORDER BY style_no)) END AS report
FROM panel p GROUP BY claim_id""",
    VOTE_CTES,
)
def _(spark, sf_dir):
    return vt.grounding_report(_grounded(spark, sf_dir))


@query("low_confidence_flag", "SELECT doc_id AS claim_id, CASE WHEN toxic = 1 THEN 0.25 WHEN quality = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS nli_score, CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS confident FROM labels")
def _(spark, sf_dir):
    scored = table(spark, sf_dir, "labels").selectExpr(
        "doc_id AS claim_id", "CAST(CASE WHEN toxic = 1 THEN 0.25 WHEN quality = 1 THEN 0.5 END AS DOUBLE) AS nli_score")
    return vt.low_confidence(scored)


# ---- prompts and debates -------------------------------------------------------------------

# Sub-claims of a claim: the user turns of its conversation; the context is the answer that follows.
_SUBS = "SELECT u.conv_id AS claim_id, CAST(u.turn AS INTEGER) AS pos, u.text AS sub_claim, CASE WHEN u.turn % 4 = 0 THEN a.text END AS context FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'"


def _subs(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    users = conv.filter("role = 'user'")
    said = conv.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows = users.join(said, ["conv_id", "turn"], "left")
    return rows.select(
        F.col("conv_id").alias("claim_id"), F.col("turn").cast("int").alias("pos"), F.col("text").alias("sub_claim"),
        F.when(F.col("turn") % 4 == 0, F.col("answer")).alias("context"))


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("claim_id")).distinct().withColumn(
        "question", F.concat(F.lit("Pytanie "), F.col("claim_id").cast("string")))


def _sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _sql_fill(template: str, **parts: str) -> str:
    sql = _sql_literal(template)
    for k, v in parts.items():
        sql = sql.replace("{" + k + "}", f"' || {v} || '")
    return f"({sql})"


def _sql_prompt(variant: str) -> str:
    t = pr.TEMPLATES[variant]
    head = _sql_fill(t.heading, i="CAST(pos + 1 AS VARCHAR)", s="sub_claim")
    bare = "NULL" if t.without is None else f"{head} || {_sql_literal(t.without)}"
    block = f"CASE WHEN coalesce(context, '') <> '' THEN {head} || {_sql_fill(t.context, c='context')} ELSE {bare} END"
    blocks = f"coalesce(string_agg({block}, {_sql_literal(t.glue)} ORDER BY pos), '')"
    if t.without is None:
        blocks = f"coalesce(nullif({blocks}, ''), '{pr.NO_EVIDENCE}')"
    listed = "'[' || string_agg(CAST(to_json(sub_claim) AS VARCHAR), ', ' ORDER BY pos) || ']'"
    return f"SELECT '{variant}' AS variant, claim_id, {_sql_fill(t.body, q=chr(39) + 'Pytanie ' + chr(39) + ' || CAST(claim_id AS VARCHAR)', b=blocks, l=listed)} AS prompt FROM subs GROUP BY claim_id"


@query("build_evidence_prompt", " UNION ALL ".join(_sql_prompt(v) for v in pr.TEMPLATES), f"subs AS ({_SUBS}),")
def _(spark, sf_dir):
    return pr.build_evidence_prompts(_subs(spark, sf_dir), _questions(spark, sf_dir))


@query(
    "consolidator_prompt",
    """SELECT claim_id, concat('Oryginalne pytanie:', chr(10), 'Pytanie ', claim_id, chr(10), chr(10), 'Analizy ekspertów:', chr(10), chr(10),
  string_agg(concat('=== Ekspert ', style_no, ' (styl ', style_no, ', temp=0.', style_no, ', top_p=0.9) ===', chr(10), 'Odpowiedź: ', label, chr(10), 'Rozumowanie:', chr(10), reasoning, chr(10)), '' ORDER BY style_no),
  chr(10), 'Oceń argumenty i jakość grounding''u, podaj finalną odpowiedź.') AS prompt FROM v_votes GROUP BY claim_id""",
)
def _(spark, sf_dir):
    v = votes(spark, sf_dir).selectExpr(
        "*", "concat('styl ', style_no) AS style", "CAST(style_no / 10 AS DOUBLE) AS temperature", "CAST(0.9 AS DOUBLE) AS top_p")
    q = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("claim_id")).withColumn(
        "question", F.concat(F.lit("Pytanie "), F.col("claim_id").cast("string")))
    return pr.consolidator_prompt(v, q)


_ENTRY = "concat('── ', CASE role WHEN 'proponent' THEN 'PROPONENT' ELSE 'OPONENT' END, ' (', coalesce(['Opening', 'Rebuttal', 'Closing'][round_no + 1], CAST(round_no AS VARCHAR)), ') ──', chr(10), argument, chr(10))"
_IN_ORDER = "round_no, CASE role WHEN 'proponent' THEN 0 ELSE 1 END"


@query("debate_transcript", f"SELECT claim_id, string_agg({_ENTRY}, chr(10) ORDER BY {_IN_ORDER}) AS transcript FROM v_debate GROUP BY claim_id")
def _(spark, sf_dir):
    return pr.debate_transcript(view(spark, sf_dir, "v_debate"))


@query(
    "debate_history",
    f"""SELECT r.claim_id, r.round_no, coalesce(string_agg(e.entry, chr(10) ORDER BY e.round_no, e.rno), '') AS history FROM (SELECT DISTINCT claim_id, round_no FROM v_debate) r
LEFT JOIN (SELECT claim_id, round_no, CASE role WHEN 'proponent' THEN 0 ELSE 1 END AS rno, {_ENTRY} AS entry FROM v_debate) e ON e.claim_id = r.claim_id AND e.round_no < r.round_no GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return pr.debate_history(view(spark, sf_dir, "v_debate"))


@query(
    "final_labels",
    """SELECT claim_id, role, arg_max(CASE WHEN failed THEN 'NIEWERYFIKOWALNE' ELSE label END, round_no) AS label, CAST(sum(CASE WHEN failed THEN 0 ELSE total_tokens END) AS BIGINT) AS tokens FROM v_debate GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return pr.final_labels(view(spark, sf_dir, "v_debate"))


@query(
    "rollup_tokens",
    """SELECT agent_name, claim_id, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens
FROM v_results GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return pr.rollup_tokens(view(spark, sf_dir, "v_results"))


@query(
    "evidence_provenance",
    """SELECT claim_id, concat('{"evidence":[{"sub_claim":', CAST(to_json(sub) AS VARCHAR), ',"chunks":[', string_agg(concat('{"chunk_id":', doc_id, ',"title":"Doc ', doc_id, '","section":"', source, '","score":', rn, '}'), ',' ORDER BY rn), ']}],"reasoner_votes":',
  coalesce(any_value(v.vj), '[]'), '}') AS provenance
FROM (SELECT r.query_id AS claim_id, concat('claim ', r.query_id) AS sub, r.doc_id, r.rn, d.source FROM bm25_ranked r JOIN documents d USING (doc_id) WHERE r.rn <= 5)
LEFT JOIN (SELECT claim_id, concat('[', string_agg(concat('{"style_no":', style_no, ',"label":"', label, '"}'), ',' ORDER BY style_no), ']') AS vj FROM v_votes GROUP BY 1) v USING (claim_id) GROUP BY claim_id, sub""",
    BM25_CTES,
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("section"))
    found = bm25_benchmark(spark, sf_dir).join(docs, "doc_id").select(
        F.col("query_id").alias("claim_id"), F.lit(0).alias("pos"), F.concat(F.lit("claim "), F.col("query_id").cast("string")).alias("sub_claim"),
        "rank", F.col("doc_id").alias("chunk_id"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), "section",
        F.col("rank").alias("score"))
    return pr.evidence_provenance(found, votes(spark, sf_dir))
