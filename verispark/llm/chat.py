"""Chat formatting in budgeted windows, with column functions only.

Prefix sums of the turns' tokens place each turn in a span: with own room r = budget - history - system turn, a turn
that starts and ends between k * r and (k + 1) * r belongs to span (k, k); one that crosses a multiple of r is a span
of its own, (k, j). So the own turns of a span never take more than r tokens, but for a single longer turn, which
is kept whole. A window is: the conversation's system turn, the last turns before the span that fit into `history`
tokens, and the span's own turns. Only the text of own assistant turns is under the loss mask, so each is learned once.

Template of a turn: `<turn>role<turn-text>text</turn>` and a new line. Inside role and text a backslash is doubled and
`<turn` and `</turn` get a backslash after `<`; dropping each escaping backslash gives the text back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verispark.llm.tables import store

BUDGET, HISTORY = 2048, 512
TURN_OVERHEAD = 4
BLOCK = 256  # turn numbers per block of the two-level prefix sums

OPEN, BODY, CLOSE = "<turn>", "<turn-text>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"<(/?turn)", r"<\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def word_tokens(text: Column) -> Column:
    """Runs of letters and digits, and single other signs."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]")).cast("long")


def _prefix_sums(turns: DataFrame) -> DataFrame:
    """Adds _pos (place in the conversation) and _end (tokens up to and with the turn).

    Sums run within blocks of turn numbers first and then over the blocks, so that a very long conversation is spread
    over many tasks. Ties of the turn number are ordered by role and text.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    inner = Window.partitionBy("_key", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    blocks = turns.groupBy("_key", "_block").agg(F.sum("_tokens").alias("_t"), F.count("*").alias("_n"))
    outer = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(
        "_key", "_block", F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_t0"), F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_n0")
    )
    placed = turns.withColumn("_end", F.sum("_tokens").over(inner)).withColumn("_pos", F.count("*").over(inner) - 1)
    return placed.join(before, ["_key", "_block"]).withColumn("_end", F.col("_end") + F.col("_t0")).withColumn("_pos", F.col("_pos") + F.col("_n0")).drop("_t0", "_n0")


def format_chats(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[Column], Column] = word_tokens,
) -> DataFrame:
    """One row per window: conv_id, window (two numbers that order the windows), n_repeated, n_turns, text, loss_spans.

    The first n_repeated turns of `text` (system turn, history) stand in an earlier window too and are never under the
    mask. `loss_spans` are (start, end) in code points. A null role or text counts as empty, rows with a null conversation
    form one conversation, null turn numbers come first, repeated rows are turns of their own, an empty table gives no
    rows; other columns are ignored. A window is over the budget only if one turn or the system turn is.
    """
    key = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    turns = conversations.select(
        "conv_id", F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("_key"),
    )
    turns = turns.withColumn("_block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    # A leading system turn is repeated in every window and takes no room of its own span.
    first = Window.partitionBy("_key", "_block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    lead = turns.groupBy("_key").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn", "role", "text")).alias("_s"))
    lead = lead.filter("_s.role = 'system'").select("_key", F.col("_s.turn").alias("_s_turn"), F.col("_s.text").alias("_s_text"), (tokens(F.col("_s.text")) + TURN_OVERHEAD).alias("_s_tokens"))
    turns = turns.join(lead.select("_key", "_s_turn", "_s_text", "_s_tokens"), "_key", "left")
    turns = turns.withColumn("_nth", F.row_number().over(first))
    is_lead = F.col("_s_tokens").isNotNull() & (F.col("_nth") == 1) & F.col("turn").eqNullSafe(F.col("_s_turn"))
    turns = turns.withColumn("_lead", is_lead).withColumn("_tokens", F.when(is_lead, F.lit(0)).otherwise(tokens(F.col("text")) + TURN_OVERHEAD).cast("long"))
    room = F.greatest(F.lit(budget - history) - F.coalesce(F.col("_s_tokens"), F.lit(0)), F.lit(budget // 4))
    role, text = escape(F.col("role")), escape(F.col("text"))
    placed = _prefix_sums(turns.withColumn("_room", room).drop("_s_turn", "_nth"))
    placed = (
        placed.withColumn("_start", F.col("_end") - F.col("_tokens"))
        .withColumn("_a", F.floor(F.col("_start") / F.col("_room")))
        .withColumn("_b", F.floor(F.greatest(F.col("_end") - 1, F.col("_start")) / F.col("_room")))
        .withColumn("_turn", F.concat(F.lit(OPEN), role, F.lit(BODY), text, F.lit(CLOSE)))
        .withColumn("_from", F.length(role) + len(OPEN) + len(BODY))
        .withColumn("_len", F.length(text))
    )
    # Written once: spans, history and windows are all read off the placed turns.
    placed = store(placed, "turns")
    own = placed.select("conv_id", "_key", "_a", "_b", F.lit(2).alias("_kind"), "_pos", "_turn", "_from", "_len", (F.col("role") == "assistant").alias("_target"))
    windows = placed.groupBy("_key", "_a", "_b").agg(F.min("_start").alias("_s0"), F.min("_pos").alias("_p0"), F.first("conv_id").alias("conv_id"), F.max("_s_text").alias("_s_text"))
    system = escape(F.col("_s_text"))
    repeated = windows.filter("_s_text IS NOT NULL AND _p0 > 0").select(
        "conv_id", "_key", "_a", "_b", F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_pos"),
        F.concat(F.lit(OPEN + "system" + BODY), system, F.lit(CLOSE)).alias("_turn"), F.lit(0).alias("_from"), F.lit(0).alias("_len"), F.lit(False).alias("_target"),
    )
    parts = own.unionByName(repeated)
    if history > 0:
        # A turn is history of the windows that begin between its end and its start + history: at most two buckets.
        cells = F.sequence(F.floor(F.col("_end") / history), F.floor((F.col("_start") + history) / history))
        past = placed.filter(~F.col("_lead") & (F.col("_tokens") <= history)).select("_key", "_start", "_end", "_pos", "_turn", F.explode(cells).alias("_cell"))
        begun = windows.filter("_p0 > 0").select("_key", "conv_id", "_a", "_b", "_s0", "_p0", F.floor(F.col("_s0") / history).alias("_cell"))
        met = past.join(begun, ["_key", "_cell"]).filter((F.col("_pos") < F.col("_p0")) & (F.col("_start") >= F.col("_s0") - history))
        parts = parts.unionByName(met.select("conv_id", "_key", "_a", "_b", F.lit(1).alias("_kind"), "_pos", "_turn", F.lit(0).alias("_from"), F.lit(0).alias("_len"), F.lit(False).alias("_target")))
    ahead = Window.partitionBy("_key", "_a", "_b").orderBy("_kind", "_pos").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_at", F.coalesce(F.sum(F.length("_turn")).over(ahead), F.lit(0)))
    start = F.col("_at") + F.col("_from")
    # One window's turns: bounded by the budget.
    rows = parts.groupBy("_key", "_a", "_b").agg(
        F.first("conv_id").alias("conv_id"),
        F.count_if(F.col("_kind") < 2).alias("n_repeated"),
        F.count_if(F.col("_kind") == 2).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("_at", "_turn"))).alias("_turns"),
        F.array_sort(F.collect_list(F.when(F.col("_target"), F.struct(start.alias("start"), (start + F.col("_len")).alias("end"))))).alias("loss_spans"),
    )
    return rows.select("conv_id", F.struct(F.col("_a").alias("first"), F.col("_b").alias("last")).alias("window"), "n_repeated", "n_turns", F.array_join(F.col("_turns._turn"), "").alias("text"), "loss_spans")


def read_turns(window_text: Column, skip: Column) -> Column:
    """(role, text) of the turns of a formatted window after the first `skip`."""
    turns = F.split(window_text, CLOSE)
    own = F.slice(turns, skip + 1, F.greatest(F.size(turns) - 1 - skip, F.lit(0)))
    return F.transform(own, lambda t: F.struct(
        unescape(F.regexp_extract(t, f"(?s)\\A{OPEN}(.*?){BODY}", 1)).alias("role"), unescape(F.regexp_replace(t, f"(?s)\\A.*?{BODY}", "")).alias("text")))


def chat_digest(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted windows: turns and loss text, as counts and digests.

    The digests are over whole conversations, so one conversation's text meets in one row here.
    """
    key = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    turns = F.transform(read_turns(F.col("text"), F.col("n_repeated").cast("int")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    each = windows.select("conv_id", key.alias("_key"), "window", F.size(turns).alias("_n"), F.array_join(turns, "").alias("_turns"), F.array_join(loss, "").alias("_loss"), F.length("text").alias("_chars"))
    rows = each.groupBy("_key").agg(
        F.first("conv_id").alias("conv_id"), F.sum("_n").cast("long").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("window", "_turns", "_loss"))).alias("_w"), F.sum("_chars").cast("long").alias("formatted_chars"),
    )
    loss_text = F.array_join(F.col("_w._loss"), "")
    return rows.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.col("_w._turns"), ""), 256).alias("turns_sha256"),
        F.length(loss_text).cast("long").alias("loss_chars"), F.sha2(loss_text, 256).alias("loss_sha256"), "formatted_chars",
    )
