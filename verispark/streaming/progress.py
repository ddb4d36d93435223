"""Progress of running evaluations, for batch tables and for streams alike."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verispark.functions.labels import ERROR
from verispark.operators.ordered import join_small, running_sums, with_previous


def progress(results: DataFrame, totals: DataFrame) -> DataFrame:
    """Per agent and benchmark: done, correct, errors, tokens, accuracy, speed, share done and time left.

    `totals` holds (benchmark_name, total). `eta_s` is NULL when nothing is left or nothing moves.
    """
    ok = ~F.col("model_label").eqNullSafe(ERROR)
    sums = results.groupBy("agent_name", "benchmark_name").agg(
        F.count("*").alias("done"),
        F.sum(F.when(ok, F.col("is_correct")).otherwise(0)).cast("bigint").alias("correct"),
        F.count(F.when(~ok, 1)).alias("errors"),
        F.sum(F.when(ok, F.col("total_tokens")).otherwise(0)).cast("bigint").alias("tokens"),
        F.sum(F.when(ok, F.col("time_thought")).otherwise(0.0)).alias("elapsed"),
    )
    done, total = F.col("done"), F.coalesce("total", F.lit(0))
    rate = F.when(done > 0, done / F.greatest("elapsed", F.lit(0.01))).otherwise(0.0)
    return sums.join(totals, "benchmark_name", "left").select(
        "agent_name", "benchmark_name", "done", total.alias("total"), "correct", "errors", "tokens",
        F.round(F.col("correct") / F.greatest(done - F.col("errors"), F.lit(1)) * 100, 6).alias("accuracy_pct"),
        F.round(F.col("tokens") / F.greatest("elapsed", F.lit(0.1)), 6).alias("tok_per_s"),
        F.round(done / F.greatest(total, F.lit(1)) * 100, 6).alias("done_pct"),
        F.round(rate, 6).alias("rate"),
        F.round(F.when((rate > 0) & (total > done), (total - done) / rate), 6).alias("eta_s"),
    )


def follow(table: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write each batch of a changing table to its own folder `path/batch=n`."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.parquet(f"{path}/batch={batch}", mode="overwrite")

    return (
        table.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def latest(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last state per key of a table written by `follow`."""
    rest = [c for c in table.columns if c not in (*keys, "batch")]
    newest = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_s"))
    return newest.select(*keys, "_s.*")


def windowed_throughput(results: DataFrame, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Results, tokens and claims per second per window of `created_at`.

    On a stream, rows older than the watermark are dropped and their state is freed.
    """
    if late is not None and results.isStreaming:
        # A watermark needs an instant, not a local time.
        results = results.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    w = F.window("created_at", width)
    sums = results.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.sum("total_tokens").cast("bigint").alias("tokens"))
    seconds = pd.Timedelta(width).total_seconds()
    return sums.select(
        F.col("w.start").cast("string").alias("window_start"), "n", "tokens", F.round(F.col("n") / seconds, 9).alias("per_s"))


def phase_segments(updates: DataFrame, keys: Sequence[str] = ("job",), order: Sequence[Column | str] = ("at", "seq")) -> DataFrame:
    """Number the phases of each job: a new one starts when the name changes or `done` is 0 again."""
    seen = with_previous(updates, keys, order, ["phase"])
    starts = F.col("prev").isNull() | (F.col("prev.phase") != F.col("phase")) | (F.col("done") == 0)
    marked = seen.withColumn("_start", starts.cast("int")).drop("prev")
    return running_sums(marked, keys, order, {"phase_no": F.col("_start")}).drop("_start", "pos")


def phase_rates(segments: DataFrame, keys: Sequence[str] = ("job",)) -> DataFrame:
    """Per phase: updates, last `done`, seconds since its start and items per second."""
    spent = F.greatest(F.max("at_s") - F.min("at_s"), F.lit(0.01))
    done = F.max_by("done", F.struct("at_s", "seq"))
    return segments.groupBy(*keys, "phase_no", "phase").agg(
        F.count("*").alias("n_updates"), done.alias("done"), F.round(spent, 6).alias("seconds"),
        F.round(F.when(done > 0, done / spent).otherwise(0.0), 6).alias("rate"))


def stream_phase_segments(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Stream form of `phase_segments` for updates (job, seq, at_s, phase, done) whose batches come in order.

    Each batch is numbered like a table, range-sorted, so a job may hold all its rows, and written to `path/rows/batch=n`.
    `path/open/batch=n` has each job's last phase and number, one row per job; the next batch goes on from there. A batch
    that is run again replaces its own folders.
    """
    spark = updates.sparkSession
    fields = "job string, _phase string, _phase_no long"

    def put(batch: DataFrame, no: int) -> None:
        before = spark.read.schema(fields).parquet(f"{path}/open/batch={no - 1}") if no else spark.createDataFrame([], fields)
        seen = with_previous(batch.select("job", "seq", "at_s", "phase", "done"), ["job"], ["at_s", "seq"], ["phase"])
        first = F.col("prev").isNull()
        carried = join_small(seen, before, ["job"], "left")
        last = F.when(first, F.col("_phase")).otherwise(F.col("prev.phase"))
        starts = last.isNull() | (last != F.col("phase")) | (F.col("done") == 0)
        marked = carried.withColumn("_start", starts.cast("int")).drop("prev", "_phase")
        numbered = running_sums(marked, ["job"], ["at_s", "seq"], {"phase_no": F.col("_start")})
        rows = numbered.withColumn("phase_no", F.col("phase_no") + F.coalesce("_phase_no", F.lit(0))).drop("_start", "_phase_no", "pos")
        rows.write.parquet(f"{path}/rows/batch={no}", mode="overwrite")
        written = spark.read.schema(rows.schema).parquet(f"{path}/rows/batch={no}")
        ends = written.groupBy("job").agg(F.max_by(F.struct("phase", "phase_no"), F.struct("at_s", "seq")).alias("e")).select("job", "e.phase", "e.phase_no")
        ends.toDF("job", "_phase", "_phase_no").unionByName(before.join(ends.select("job"), "job", "left_anti")).write.parquet(f"{path}/open/batch={no}", mode="overwrite")
        if no > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/open/batch={no - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return updates.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failure_digest(failures: DataFrame) -> DataFrame:
    """Per context: failures, the latest message (300 characters, 80 in the headline) and its last lines."""
    last = F.max_by(F.struct("message", "traceback"), F.struct("at", "id"))
    rows = failures.groupBy("context").agg(F.count("*").alias("n"), last.alias("_l"))
    lines = F.filter(F.split("_l.traceback", r"\r?\n"), lambda x: F.trim(x) != "")
    tail = F.slice(lines, F.greatest(F.size(lines) - 4, F.lit(1)), F.lit(5))
    return rows.select(
        "context", "n", F.substring("_l.message", 1, 300).alias("message"), F.substring("_l.message", 1, 80).alias("headline"),
        F.array_join(tail, "\n").alias("traceback"))
