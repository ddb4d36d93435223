"""Follow a folder of article lines and keep a chunk table up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from verispark.operators.chunking import build_chunks, pending_articles
from verispark.sources.readers import ARTICLE, CORRUPT, parse_articles

# Where a line stands: files in the order of their names, blocks of a file, lines of a block in the order they are read.
PLACE = ("file", "block", "line")


_PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("batch", T.LongType())])


def _stored_pages(spark: SparkSession, path: str, before: int) -> DataFrame:
    """Pages taken by earlier batches; a batch that runs again does not see itself."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):  # nothing stored yet
        return spark.createDataFrame([], "page_id long")
    return spark.read.schema(_PAGES).parquet(path).filter(F.col("batch") < before).select("page_id")


def take_batch(lines: DataFrame, batch: int, chunks_path: str, pages_path: str) -> None:
    """Chunk the new articles of one batch. Each batch owns a folder, so repeating it changes nothing.

    `lines` has value and, where there are several files, `file` and `block` of each line. The first line of a page counts, also when its text is blank:
    the page is then done and a later line does not replace it.
    """
    spark = lines.sparkSession
    for name, unknown in (("file", F.lit("")), ("block", F.lit(0))):
        if name not in lines.columns:
            lines = lines.withColumn(name, unknown)
    placed = lines.withColumn("line", F.monotonically_increasing_id())
    rows = parse_articles(placed, ARTICLE, PLACE).filter(F.col(CORRUPT).isNull())
    page = F.coalesce("pageid", "id", F.lit(0).cast("bigint"))
    named = rows.select(page.alias("page_id"), "title", "text", *PLACE)
    new = pending_articles(named, _stored_pages(spark, pages_path, batch), list(PLACE))
    build_chunks(new).write.parquet(f"{chunks_path}/batch={batch}", mode="overwrite")
    # Pages come last: a batch that stopped between the two writes is simply taken again.
    named.select("page_id").distinct().write.parquet(f"{pages_path}/batch={batch}", mode="overwrite")


def stream_ingest_articles(
    spark: SparkSession, source: str, chunks_path: str, pages_path: str, checkpoint: str, files_per_batch: int = 64
) -> StreamingQuery:
    """Take all files that are there (and, on the next start, only the ones added since)."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source)
    lines = files.select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return (
        lines.writeStream.foreachBatch(lambda df, batch: take_batch(df, batch, chunks_path, pages_path))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
