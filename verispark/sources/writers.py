"""Writers. Every one writes a folder of part files, one task per partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verispark.operators.ordered import keep_first, without_ids


def _csv(df: DataFrame, path: str) -> None:
    df.write.csv(
        path, header=True, quote='"', escape='"', mode="overwrite", emptyValue='""',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def jsonl_to_csv(spark: SparkSession, source: str, target: str, schema: T.StructType) -> None:
    """JSON lines to CSV with a header; arrays and structs become JSON text."""
    df = spark.read.schema(schema).json(source)
    flat = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name)
        for f in df.schema.fields
    ]
    _csv(df.select(flat), target)


def write_chunks_jsonl(chunks: DataFrame, path: str) -> None:
    chunks.write.json(path, mode="overwrite")


def export_results_csv(results: DataFrame, path: str) -> None:
    """All rows in (agent_name, claim_id) order: part files in name order hold the total order."""
    _csv(results.orderBy("agent_name", "claim_id", "id"), path)


def replace_by_source(rows: DataFrame, path: str) -> None:
    """Replace the rows of the sources in `rows`; other sources in the folder stay.

    Each source is a partition folder, so a load touches only its own.
    """
    rows.write.partitionBy("source").option("partitionOverwriteMode", "dynamic").parquet(path, mode="overwrite")


def upsert_chunks(target: DataFrame, batch: DataFrame, order: Sequence[str] = ("_seq",)) -> DataFrame:
    """Target with the batch put over it: the last row per chunk_id wins. The target has one row per id already.

    A bitmap of the batch's ids, of fixed size, is looked up where the target's rows are. Only target rows that may be
    replaced meet the batch in a join, so texts and vectors of the others are not moved.
    """
    seq = [F.col(c).desc() for c in order if c in batch.columns]
    last = keep_first(batch, ["chunk_id"], seq) if seq else batch.dropDuplicates(["chunk_id"])
    return without_ids(target, last.select("chunk_id"), "chunk_id").unionByName(last, allowMissingColumns=True)


def append_new_chunks(target: DataFrame, batch: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of the batch whose chunk_id is new, the first per id; append these to the target."""
    fresh = keep_first(batch, ["chunk_id"], list(order))
    return fresh.join(target.select("chunk_id"), "chunk_id", "left_anti")
