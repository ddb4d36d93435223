"""Table scans: the named presets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


# Table, text column and columns of each preset.
PRESETS: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "wiki_chunks": (
        "wiki_chunks",
        "text",
        ("chunk_id", "page_id", "title", "section_title", "paragraph_index", "text", "num_tokens"),
    ),
    "demagog": (
        "claims",
        "claim_text",
        ("id", "claim_text", "speaker", "speaker_role", "claim_date", "label", "label_original", "topic", "url"),
    ),
    "am_benchmark": (
        "claims",
        "claim_text",
        ("id", "claim_text", "label", "label_original", "topic", "claim_date", "metadata"),
    ),
}


def scan_preset(
    spark: SparkSession,
    preset: str,
    paths: dict[str, str] | None = None,
    tables: dict[str, DataFrame] | None = None,
    limit: int | None = None,
    order: str | None = None,
) -> DataFrame:
    """Columns of a preset from its table; unknown presets raise. `limit` takes the first by `order`."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; known: {sorted(PRESETS)}")
    name, _, columns = PRESETS[preset]
    df = tables[name] if tables else spark.read.parquet(paths[name])
    df = df.select(*columns)
    if limit is not None:
        df = df.orderBy(order or columns[0]).limit(limit)
    return df
