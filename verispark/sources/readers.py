"""Readers of claim and article files. Schemas are given, never guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the claims CSV; all are read as text.
CLAIM_CSV = ("question", "answers", "correct_answer_index", "name", "year", "type")

CLAIM_JSON = T.StructType(
    [T.StructField(c, T.StringType()) for c in (
        "id", "statement", "person_name", "person_function", "publication_date", "rating", "detail_url", "title",
        "category", "reading_time", "person_party", "person_image_url", "statement_source", "statement_source_url",
        "summary", "full_analysis", "scraped_at", "error")]
    + [T.StructField("tags", T.ArrayType(T.StringType()))]
)

ARTICLE = T.StructType([
    T.StructField("pageid", T.LongType()), T.StructField("title", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("content_length", T.LongType()),
    T.StructField("last_edited", T.StringType()), T.StructField("number_of_references", T.LongType()),
    T.StructField("categories", T.ArrayType(T.StringType())), T.StructField("id", T.LongType()),
    T.StructField("scraped_at", T.StringType()),
])

CHUNK = T.StructType([
    T.StructField("chunk_id", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("section_title", T.StringType()), T.StructField("paragraph_index", T.IntegerType()),
    T.StructField("sentence_indices", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType()),
    T.StructField("num_tokens", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
])

CORRUPT = "_corrupt"

# A quoted empty field is an empty text, a bare one is NULL; writers and readers must agree.
CSV_BLANKS = {"emptyValue": "", "nullValue": "\u0000"}


def read_claims_csv(spark: SparkSession, path: str, columns: tuple[str, ...] = CLAIM_CSV) -> DataFrame:
    """CSV with a header, quoted fields over several lines, every column as text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', **CSV_BLANKS)


def read_claims_json(spark: SparkSession, path: str, schema: T.StructType = CLAIM_JSON) -> DataFrame:
    """Files that each hold one JSON array of records."""
    return spark.read.schema(schema).json(path, multiLine=True)


def parse_articles(lines: DataFrame, schema: T.StructType = ARTICLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines (column `value`) to article columns plus `_corrupt`: the line when it is bad JSON.

    A byte order mark is cut and blank lines are left out; columns in `keep` stay. Works on batch and stream alike.
    """
    text = F.regexp_replace("value", r"^\x{FEFF}", "")
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("_line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    kept = lines.select(text.alias("_line"), *keep).filter(F.trim("_line") != "")
    return kept.select(parsed.alias("_a"), *keep).select("_a.*", *keep)


def read_articles_jsonl(spark: SparkSession, path: str, schema: T.StructType = ARTICLE) -> DataFrame:
    """Article lines; bad ones are left out (see `bad_articles`). `pageid` falls back to `id`."""
    rows = parse_articles(spark.read.text(path), schema).filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return rows.withColumn("pageid", F.coalesce("pageid", "id", F.lit(0).cast("bigint")))


def bad_articles(spark: SparkSession, path: str, schema: T.StructType = ARTICLE) -> DataFrame:
    """The lines that `read_articles_jsonl` leaves out."""
    return parse_articles(spark.read.text(path), schema).filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_chunks_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(path)
