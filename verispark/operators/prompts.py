"""Prompts, debates and provenance put together from tables.

Sub-claims, reasoners and debate turns of a claim are few; each result is one text or row per claim.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Texts around the parts of a prompt; {q} question, {b} blocks, {i} number, {s} sub-claim, {c} context."""

    body: str
    heading: str = ""
    context: str = ""
    without: str | None = ""
    glue: str = ""


# Prompt texts.
TEMPLATES = {
    "verifier": Template(
        "Oryginalne pytanie/twierdzenie:\n{q}\n\nDekompozycja i zebrane dowody:\n{b}\n\nNa podstawie powyższych informacji wybierz odpowiedź.",
        "--- Pod-twierdzenie {i}: {s} ---\n", "Kontekst z Wikipedii:\n{c}\n", "Brak kontekstu w bazie wiedzy.\n", "\n"),
    "verifier_bm25": Template(
        "Oryginalne pytanie/twierdzenie:\n{q}\n\nDekompozycja i zebrane dowody:\n{b}\n\nNa podstawie powyższych informacji wybierz odpowiedź.",
        "--- Pod-twierdzenie {i}: {s} ---\n", "Kontekst z Wikipedii:\n{c}\n", "Brak kontekstu w bazie wiedzy.\n", ""),
    "reasoner": Template(
        "Pytanie/twierdzenie do weryfikacji:\n{q}\n\nDekompozycja i zebrane dowody:\n\n{b}\n"
        "Przeanalizuj krok po kroku i podaj odpowiedź. Odwołuj się do kontekstu z konkretnych artykułów.",
        "=== Pod-twierdzenie {i}: {s} ===\n", "Kontekst z Wikipedii:\n{c}\n",
        "⚠ Brak kontekstu w bazie wiedzy dla tego pod-twierdzenia.\n", ""),
    "reasoner_verbal": Template(
        "Pytanie/twierdzenie: {q}\n\nDowody:\n{b}\nPrzeanalizuj to krok po kroku.",
        "=== Pod-twierdzenie {i}: {s} ===\n", "Kontekst:\n{c}\n", "⚠ Brak kontekstu.\n", ""),
    "debater": Template(
        "Twierdzenie do weryfikacji:\n{q}\n\nPod-twierdzenia: {l}\n\n{b}",
        "=== Pod-twierdzenie {i}: {s} ===\n", "Kontekst z Wikipedii:\n{c}\n", "⚠ Brak kontekstu w bazie wiedzy.\n", "\n"),
    "judge": Template("{b}", "Pod-twierdzenie: {s}\n", "{c}\n", None, "\n"),
}
NO_EVIDENCE = "(brak)"  # fixed value: judge text without any context
ROLE_HEADERS = {"proponent": "PROPONENT", "opponent": "OPONENT"}  # fixed values
ROLE_ORDER = {"proponent": 0, "opponent": 1}  # fixed values
ROUNDS = ("Opening", "Rebuttal", "Closing")  # fixed values
FALLBACK_LABEL = "NIEWERYFIKOWALNE"  # fixed value: label of a debater that failed


# The consolidator's prompt and its part per expert.
CONSOLIDATOR = "Oryginalne pytanie:\n{q}\n\nAnalizy ekspertów:\n\n{b}\nOceń argumenty i jakość grounding'u, podaj finalną odpowiedź."
EXPERT_BLOCK = "=== Ekspert {i} ({s}, temp={t}, top_p={p}) ===\nOdpowiedź: {l}\nRozumowanie:\n{r}\n"


def fill(template: str, **parts: Column) -> Column:
    """Put columns into the named places of a text."""
    pieces: list[Column] = []
    rest = template
    while rest:
        at = min((p for p in (rest.find("{" + k + "}") for k in parts) if p >= 0), default=-1)
        if at < 0:
            pieces.append(F.lit(rest))
            break
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(parts[rest[at + 1]].cast("string"))
        rest = rest[at + 3 :]
    return F.concat(*pieces)


def _prompt(t: Template) -> Column:
    """The prompt of a row with `question` and the ordered `parts` (pos, sub, ctx) of a claim."""

    def block(p: Column) -> Column:
        head = fill(t.heading, i=p["pos"] + 1, s=p["sub"])
        bare = F.lit(None).cast("string") if t.without is None else F.concat(head, F.lit(t.without))
        return F.when(p["ctx"] != "", F.concat(head, fill(t.context, c=p["ctx"]))).otherwise(bare)

    blocks = F.array_join(F.array_compact(F.transform("parts", block)), t.glue)
    if t.without is None:
        blocks = F.when(blocks == "", F.lit(NO_EVIDENCE)).otherwise(blocks)
    quoted = F.transform("parts", lambda p: F.to_json(F.struct(p["sub"].alias("v"))))
    # JSON list with a blank after each comma.
    listed = F.concat(F.lit("["), F.array_join(F.transform(
        quoted, lambda j: F.substring(j, F.lit(6), F.length(j) - 6)), ", "), F.lit("]"))
    return fill(t.body, q=F.col("question"), b=blocks, l=listed)


def build_evidence_prompts(subclaims: DataFrame, questions: DataFrame, variants: Sequence[str] = tuple(TEMPLATES)) -> DataFrame:
    """(variant, claim_id, prompt) from (claim_id, pos, sub_claim, context) and (claim_id, question).

    A claim's parts are brought together once for all variants.
    """
    for v in variants:
        if v not in TEMPLATES:
            raise ValueError(f"unknown variant {v!r}; known: {sorted(TEMPLATES)}")
    part = F.struct("pos", F.col("sub_claim").alias("sub"), F.coalesce("context", F.lit("")).alias("ctx"))
    rows = subclaims.groupBy("claim_id").agg(F.array_sort(F.collect_list(part)).alias("parts")).join(questions, "claim_id")
    made = F.array(*[F.struct(F.lit(v).alias("variant"), _prompt(TEMPLATES[v]).alias("prompt")) for v in variants])
    return rows.select("claim_id", F.explode(made).alias("made")).select("made.variant", "claim_id", "made.prompt")


def build_evidence_prompt(subclaims: DataFrame, questions: DataFrame, variant: str = "reasoner") -> DataFrame:
    """(claim_id, prompt) of one variant."""
    return build_evidence_prompts(subclaims, questions, [variant]).drop("variant")


def consolidator_prompt(votes: DataFrame, questions: DataFrame) -> DataFrame:
    """(claim_id, prompt) from votes (style_no, style, temperature, top_p, label, reasoning)."""
    one = F.struct("style_no", "style", "temperature", "top_p", "label", "reasoning")
    rows = votes.groupBy("claim_id").agg(F.array_sort(F.collect_list(one)).alias("v")).join(questions, "claim_id")
    blocks = F.array_join(F.transform("v", lambda v, i: fill(
        EXPERT_BLOCK, i=i + 1, s=v["style"], t=v["temperature"], p=v["top_p"], l=v["label"], r=v["reasoning"])), "")
    text = fill(CONSOLIDATOR, q=F.col("question"), b=blocks)
    return rows.select("claim_id", text.alias("prompt"))


def _role_no() -> Column:
    roles = F.create_map(*[F.lit(x) for kv in ROLE_ORDER.items() for x in kv])
    return F.coalesce(F.try_element_at(roles, "role"), F.lit(len(ROLE_ORDER)))


def _entry() -> Column:
    names = F.create_map(*[F.lit(x) for kv in ROLE_HEADERS.items() for x in kv])
    rounds = F.array(*[F.lit(r) for r in ROUNDS])
    round_name = F.coalesce(F.get(rounds, F.col("round_no")), F.col("round_no").cast("string"))
    return F.concat(F.lit("── "), F.coalesce(F.try_element_at(names, "role"), F.upper("role")), F.lit(" ("), round_name,
                    F.lit(") ──\n"), F.col("argument"), F.lit("\n"))


def _said() -> Column:
    return F.array_sort(F.collect_list(F.struct("round_no", _role_no().alias("role_no"), _entry().alias("entry"))))


def debate_transcript(utterances: DataFrame) -> DataFrame:
    """(claim_id, transcript): all utterances in (round, role) order with role headers."""
    return utterances.groupBy("claim_id").agg(_said().alias("_s")).select(
        "claim_id", F.array_join(F.transform("_s", lambda e: e["entry"]), "\n").alias("transcript"))


def debate_history(utterances: DataFrame) -> DataFrame:
    """(claim_id, round_no, history): what each round hears, the transcript of all earlier rounds."""
    packed = utterances.groupBy("claim_id").agg(
        _said().alias("_s"), F.sort_array(F.collect_set("round_no")).alias("_rounds"))
    rows = packed.select("claim_id", "_s", F.explode("_rounds").alias("round_no"))
    earlier = F.filter("_s", lambda e: e["round_no"] < F.col("round_no"))
    return rows.select("claim_id", "round_no", F.array_join(F.transform(earlier, lambda e: e["entry"]), "\n").alias("history"))


def final_labels(utterances: DataFrame) -> DataFrame:
    """(claim_id, role, label, tokens): label of the last round; a failed debater gets the fallback and no tokens."""
    label = F.when(F.col("failed"), F.lit(FALLBACK_LABEL)).otherwise(F.col("label"))
    tokens = F.when(F.col("failed"), 0).otherwise(F.col("total_tokens"))
    return utterances.groupBy("claim_id", "role").agg(
        F.max_by(label, F.col("round_no")).alias("label"), F.sum(tokens).cast("bigint").alias("tokens"))


def rollup_tokens(steps: DataFrame, keys: tuple[str, ...] = ("agent_name", "claim_id")) -> DataFrame:
    return steps.groupBy(*keys).agg(*[
        F.sum(t).cast("bigint").alias(t) for t in ("total_tokens", "prompt_tokens", "completion_tokens")])


def evidence_provenance(evidence: DataFrame, votes: DataFrame) -> DataFrame:
    """(claim_id, provenance): JSON of sub-claims with their chunks, and of the votes."""
    chunk = F.struct("rank", "chunk_id", "title", "section", "score")
    per_sub = evidence.groupBy("claim_id", "pos", "sub_claim").agg(F.array_sort(F.collect_list(chunk)).alias("_c"))
    plain = F.transform("_c", lambda c: F.struct(
        c["chunk_id"].alias("chunk_id"), c["title"].alias("title"), c["section"].alias("section"), c["score"].alias("score")))
    subs = per_sub.groupBy("claim_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "sub_claim", plain.alias("chunks")))).alias("_e"))
    panel = votes.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("style_no", "label"))).alias("_v"))
    both = subs.join(panel, "claim_id", "left")
    body = F.struct(
        F.transform("_e", lambda e: F.struct(e["sub_claim"].alias("sub_claim"), e["chunks"].alias("chunks"))).alias("evidence"),
        F.coalesce("_v", F.array().cast("array<struct<style_no:int,label:string>>")).alias("reasoner_votes"))
    return both.select("claim_id", F.to_json(body).alias("provenance"))

