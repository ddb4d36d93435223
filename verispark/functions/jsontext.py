"""JSON inside free text: thinking blocks, fenced blocks, lists, trajectories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verispark.functions.text import strip

# Tags whose content is not part of the answer.
THINKING_TAGS = ("think", "reasoning", "scratchpad")


def strip_thinking(c: Column, tags: tuple[str, ...] = THINKING_TAGS) -> Column:
    pattern = "(?is)" + "|".join(f"<{t}>.*?</{t}>" for t in tags)
    return strip(F.regexp_replace(c, pattern, ""))


def _between_braces(c: Column) -> Column:
    """From the first `{` to the last `}`, NULL when either is missing or they cross."""
    return F.when(c.rlike(r"(?s)\{.*\}"), F.regexp_extract(c, r"(?s)\{.*\}", 0))


def json_block(c: Column) -> Column:
    """Content of the first fenced block, else the text between the outer braces, else NULL."""
    fence = r"(?s)```(?:json)?(.*?)```"
    return F.when(c.rlike(fence), strip(F.regexp_extract(c, fence, 1))).otherwise(_between_braces(c))


def is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def valid_json_block(answer: Column) -> Column:
    """JSON text of a model answer, NULL when it has none that parses."""
    block = json_block(strip_thinking(answer))
    return F.when(is_json(block), block)


def parse_json_list(c: Column) -> Column:
    """String list in a model answer; empty when there is none. Empty items are dropped."""
    clean = strip(F.btrim(F.regexp_replace(c, r"```(?:json)?\s*", ""), F.lit("`")))

    def items(x: Column) -> Column:
        return F.try_variant_get(F.try_parse_json(x), "$", "array<variant>")

    def text(v: Column) -> Column:
        shown = F.to_json(v)
        # Zero, false and empty containers are dropped like empty texts.
        kept = F.when(shown == "true", F.lit("True")).otherwise(F.try_variant_get(v, "$", "string"))
        return F.when(~shown.isin('""', "0", "0.0", "false", "null", "[]", "{}"), kept)

    found = F.coalesce(items(clean), items(F.regexp_extract(c, r"(?s)\[.*\]", 0)))
    return F.coalesce(F.array_compact(F.transform(found, text)), F.array().cast("array<string>"))


def mined_label(raw: Column) -> Column:
    """Label in a recorded trajectory: the last assistant turn that names one."""
    turns = F.from_json(raw, "array<struct<role:string,content:string>>")

    def from_turn(t: Column) -> Column:
        content = F.coalesce(t["content"], F.lit(""))
        fence = F.regexp_extract(content, r"(?s)```(?:json)?(.*?)```", 1)
        block = F.when(strip(fence) != "", strip(fence)).otherwise(_between_braces(content))
        final = F.get_json_object(block, "$.action") == "final_answer"
        named = F.when(is_json(block) & final, strip(F.get_json_object(block, "$.action_input.label")))
        found = F.regexp_extract(content, r'"label"\s*:\s*"([^"]+)"', 1)
        return F.coalesce(named, F.when(found != "", strip(found)))

    answers = F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), from_turn)
    return F.when(is_json(raw), F.get(F.filter(F.reverse(answers), lambda a: a.isNotNull()), F.lit(0)))
