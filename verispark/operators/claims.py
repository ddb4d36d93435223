"""Claim records of different sources to the claims table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispark.functions.text import strip
from verispark.operators.ordered import with_ordinal

# Claims column -> field of the source.
EXAM_FIELDS: dict[str, str | None] = {
    "external_id": None, "claim_text": "question", "speaker": None, "speaker_role": None, "claim_date": "year",
    "label_original": "correct_answer_index", "topic": "name", "url": None,
}
STATEMENT_FIELDS: dict[str, str | None] = {
    "external_id": "id", "claim_text": "statement", "speaker": "person_name", "speaker_role": "person_function",
    "claim_date": "publication_date", "label_original": "rating", "topic": None, "url": "detail_url",
}

# Verbal verdict -> normal label.
STATEMENT_LABELS = {
    "prawda": "SUPPORTS",
    "fałsz": "REFUTES",
    "częściowa prawda": "PARTIALLY_TRUE",
    "częściowo prawda": "PARTIALLY_TRUE",
    "manipulacja": "PARTIALLY_TRUE",
    "nieweryfikowalne": "NOT_ENOUGH_INFO",
    "brak danych": "NOT_ENOUGH_INFO",
}
EXAM_LABELS: dict[str, str] = {}  # every exam question with its right answer is a true statement


def map_fields(df: DataFrame, fields: Mapping[str, str | None], keep: Sequence[str] = ()) -> DataFrame:
    """Rename source fields; an absent one becomes NULL. The rest goes to the struct `remainder`."""
    mapped = [
        (F.col(src).cast("string") if src in df.columns else F.lit(None).cast("string")).alias(dst)
        for dst, src in fields.items()
    ]
    used = {s for s in fields.values() if s}
    rest = [c for c in df.columns if c not in used and c not in keep]
    remainder = F.struct(*rest) if rest else F.lit(None)
    return df.select(*keep, *mapped, remainder.alias("remainder"))


def pack_metadata(values: Mapping[str, Column]) -> Column:
    """JSON object of the named values without NULL and empty ones; NULL when nothing is left."""
    pairs = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    kept = F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != ""))
    return F.when(F.size(kept) > 0, F.to_json(kept))


def drop_blank_claims(df: DataFrame, text: str = "claim_text") -> DataFrame:
    return df.filter(F.coalesce(strip(F.col(text)), F.lit("")) != "")


def blank_counts(df: DataFrame, text: str = "claim_text") -> DataFrame:
    """One row: records read, kept and skipped for want of a text."""
    blank = (F.coalesce(strip(F.col(text)), F.lit("")) == "").cast("int")
    return df.agg(F.count("*").alias("n_read"), F.sum(1 - blank).alias("n_kept"), F.sum(blank).alias("n_skipped"))


def assign_external_id(df: DataFrame, order: Sequence[Column | str], name: str = "external_id") -> DataFrame:
    """Number of the input row from 0, as text; give it before blank rows are dropped."""
    return with_ordinal(df, order, name).withColumn(name, F.col(name).cast("string"))


def normalize_label(label: Column, table: Mapping[str, str] = STATEMENT_LABELS, default: str = "NOT_ENOUGH_INFO") -> Column:
    key = F.lower(strip(F.coalesce(label, F.lit(""))))
    if not table:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def parse_pl_date(raw: Column) -> Column:
    """'25.02.2026 godz.16:28' to '2026-02-25'; other texts stay, empty ones become NULL."""
    day = strip(F.split_part(strip(F.split_part(raw, F.lit("godz."), F.lit(1))), F.lit(" "), F.lit(1)))
    parts = F.split(day, r"\.")
    iso = F.concat_ws("-", F.get(parts, F.lit(2)), F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))
    return F.when(raw != "", F.when(F.size(parts) == 3, iso).otherwise(raw))


def join_tags(tags: Column) -> Column:
    return F.when(F.size(tags) > 0, F.array_join(tags, ", "))


def claims_from_exams(records: DataFrame, order: Sequence[Column | str], source: str = "am_benchmark") -> DataFrame:
    """Exam questions (text columns) to claims; ids have gaps where a question is blank."""
    numbered = assign_external_id(records, order, "_row")
    extra = {c: F.col(c) for c in records.columns if c not in ("question", "year", "name", "answers", "correct_answer_index", "type")}
    named = {"answers": "answers", "correct_answer_index": "correct_answer_index", "exam_type": "type"}
    meta = {k: F.col(c) for k, c in named.items() if c in records.columns}
    out = numbered.select(
        F.lit(source).alias("source"), F.col("_row").alias("external_id"), F.col("question").alias("claim_text"),
        F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("string").alias("speaker_role"),
        F.nullif(strip(F.coalesce("year", F.lit(""))), F.lit("")).alias("claim_date"),
        normalize_label(F.col("correct_answer_index"), EXAM_LABELS, "SUPPORTS").alias("label"),
        strip(F.coalesce("correct_answer_index", F.lit(""))).alias("label_original"),
        F.col("name").alias("topic"), F.lit(None).cast("string").alias("url"),
        pack_metadata({**meta, **extra}).alias("metadata"),
    )
    return drop_blank_claims(out)


def claims_from_statements(records: DataFrame, source: str = "demagog") -> DataFrame:
    """Checked public statements to claims."""
    used = {s for s in STATEMENT_FIELDS.values() if s}
    extra = {
        c: (F.to_json(c) if t.startswith("array") else F.col(c)) for c, t in records.dtypes if c not in used
    }
    out = records.select(
        F.lit(source).alias("source"), F.col("id").cast("string").alias("external_id"), F.col("statement").alias("claim_text"),
        F.col("person_name").alias("speaker"), F.col("person_function").alias("speaker_role"),
        parse_pl_date(F.col("publication_date")).alias("claim_date"),
        normalize_label(F.col("rating")).alias("label"), strip(F.coalesce("rating", F.lit(""))).alias("label_original"),
        join_tags(F.col("tags")).alias("topic"), F.col("detail_url").alias("url"), pack_metadata(extra).alias("metadata"),
    )
    return drop_blank_claims(out)


def label_counts(claims: DataFrame) -> DataFrame:
    return claims.groupBy("label").agg(F.count("*").alias("n"))


def top_topics(claims: DataFrame, n: int = 10) -> DataFrame:
    return claims.groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("topic")).limit(n)


def claim_distributions(claims: DataFrame, n_topics: int = 10) -> DataFrame:
    """Rows per label, and the most frequent topics."""
    labels = label_counts(claims).select(F.lit("label").alias("kind"), F.col("label").alias("value"), "n")
    topics = top_topics(claims, n_topics).select(F.lit("topic").alias("kind"), F.col("topic").alias("value"), "n")
    return labels.unionByName(topics)


def question_with_answers(text: Column, metadata: Column) -> Column:
    """The question followed by its answers, when the metadata holds exactly four."""
    meta = F.when(F.try_parse_json(metadata).isNotNull(), metadata)
    answers = F.from_json(F.get_json_object(meta, "$.answers"), "array<string>", {"allowSingleQuotes": "true"})
    lines = F.transform(answers, lambda a, i: F.concat(i.cast("string"), F.lit(": "), a))
    listed = F.concat(text, F.lit("\n\nOdpowiedzi:\n"), F.array_join(lines, "\n"))
    return F.when(F.size(answers) == 4, listed).otherwise(text)


def ground_truth_label(label: Column, label_original: Column | None = None) -> Column:
    if label_original is None:
        return label
    return F.coalesce(F.nullif(label_original, F.lit("")), label)
