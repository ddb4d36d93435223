"""Streaming queries (group K): each runs a stream over the given tables and reads back its table.

The batch form of the same operator is a query of its own; both have the same check.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from verispark.plans.group_chunking import WINDOW_CTES
from verispark.plans.registry import query
from verispark.session import fresh_path
from verispark.streaming import ingest
from verispark.streaming import progress as pg
from verispark.views import project, table, table_stream, view

# ---- articles ------------------------------------------------------------------------------


@query("stream_ingest_articles", "SELECT chunk_id, page_id, num_tokens, text FROM chunks WHERE page_id IN (SELECT page_id FROM v_articles WHERE source NOT IN ('src3', 'src5'))", WINDOW_CTES)
def _(spark, sf_dir):
    """Article files arrive in two rounds; the second repeats pages of the first and has bad lines.

    Each line is followed by one with another text for its page. Pages of one source have a blank first line: they are done with it.
    """
    base = fresh_path(spark, "ingest")
    paths = {n: f"{base}/{n}" for n in ("lines", "chunks", "pages", "checkpoint")}
    arts = view(spark, sf_dir, "v_articles")
    good = arts.filter("source <> 'src3'")
    line = F.to_json(F.struct(F.col("page_id").alias("pageid"), "title", "text"))
    first = F.when(F.col("source") == "src5", F.lit(" ")).otherwise(F.col("text"))
    twice = F.array(*[F.to_json(F.struct(F.col("page_id").alias("pageid"), "title", t.alias("text"))) for t in (first, F.concat(F.lit("Abc. "), "text"))])
    rounds = [
        good.filter("lang = 'en'").select(F.explode(twice).alias("value")),
        good.select(F.explode(twice).alias("value")).union(arts.filter("source = 'src3'").select(F.substring(line, 1, 15).alias("value"))),
    ]
    for rows in rounds:
        rows.write.mode("append").text(paths["lines"])
        ingest.stream_ingest_articles(spark, paths["lines"], paths["chunks"], paths["pages"], paths["checkpoint"]).awaitTermination()
    return spark.read.parquet(paths["chunks"]).select("chunk_id", "page_id", "num_tokens", "text")


# ---- progress ------------------------------------------------------------------------------

_PROGRESS = """SELECT agent_name, benchmark_name, done, total, correct, errors, tokens, round(correct / greatest(done - errors, 1) * 100, 6) AS accuracy_pct, round(tokens / greatest(el, 0.1), 6) AS tok_per_s,
  round(done / greatest(total, 1) * 100, 6) AS done_pct, round(done / greatest(el, 0.01), 6) AS rate, round(CASE WHEN total > done THEN (total - done) / (done / greatest(el, 0.01)) END, 6) AS eta_s
FROM (SELECT agent_name, benchmark_name, count(*) AS done, CAST(sum(CASE WHEN model_label <> 'ERROR' THEN is_correct ELSE 0 END) AS BIGINT) AS correct, count(*) FILTER (model_label = 'ERROR') AS errors,
  CAST(sum(CASE WHEN model_label <> 'ERROR' THEN total_tokens ELSE 0 END) AS BIGINT) AS tokens, sum(CASE WHEN model_label <> 'ERROR' THEN time_thought ELSE 0 END) AS el FROM v_results GROUP BY 1, 2)
CROSS JOIN (SELECT count(*) AS total FROM documents)"""


def _totals(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.agg(F.count("*").alias("total")).select(F.lit("am_benchmark").alias("benchmark_name"), "total")


def _result_stream(spark, sf_dir):
    return project(table_stream(spark, sf_dir, "events"), "v_results")


def _run(spark, changing, mode="update"):
    base = fresh_path(spark, "follow")
    pg.follow(changing, f"{base}/rows", f"{base}/checkpoint", mode).awaitTermination()
    return spark.read.parquet(f"{base}/rows")


@query("progress", _PROGRESS)
def _(spark, sf_dir):
    return pg.progress(view(spark, sf_dir, "v_results"), _totals(spark, sf_dir))


@query("stream_progress", _PROGRESS)
def _(spark, sf_dir):
    rows = _run(spark, pg.progress(_result_stream(spark, sf_dir), _totals(spark, sf_dir)))
    return pg.latest(rows, ["agent_name", "benchmark_name"])


_WINDOWS = "SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(count(*) / 3600.0, 9) AS per_s FROM v_results GROUP BY 1"


@query("windowed_throughput", _WINDOWS)
def _(spark, sf_dir):
    return pg.windowed_throughput(view(spark, sf_dir, "v_results"))


@query("stream_windowed_throughput", _WINDOWS)
def _(spark, sf_dir):
    rows = _run(spark, pg.windowed_throughput(_result_stream(spark, sf_dir)))
    return pg.latest(rows, ["window_start"])


# Jobs report often; the phase is the kind of event, `done` returns to 0 now and then.
_UPDATE = (
    "concat('job-', CAST(user_id % 5 AS STRING)) AS job", "event_id AS seq", "CAST(event_id AS DOUBLE) * 2 AS at_s",
    "event_type AS phase", "CAST(floor(value) AS BIGINT) AS done",
)

PHASE_CTES = f"""
upd AS (SELECT {', '.join(_UPDATE)} FROM events),
flag AS (SELECT *, CASE WHEN lag(phase) OVER w IS NULL OR lag(phase) OVER w <> phase OR done = 0 THEN 1 ELSE 0 END AS st FROM upd WINDOW w AS (PARTITION BY job ORDER BY at_s, seq)),
seg AS (SELECT job, seq, at_s, phase, done, CAST(sum(st) OVER (PARTITION BY job ORDER BY at_s, seq) AS BIGINT) AS phase_no FROM flag),
"""


@query("phase_segments", "SELECT job, seq, phase, done, phase_no FROM seg", PHASE_CTES)
def _(spark, sf_dir):
    updates = table(spark, sf_dir, "events").selectExpr(*_UPDATE)
    return pg.phase_segments(updates, order=("at_s", "seq")).select("job", "seq", "phase", "done", "phase_no")


@query(
    "phase_rates",
    """SELECT job, phase_no, phase, count(*) AS n_updates, arg_max(done, seq) AS done, round(greatest(max(at_s) - min(at_s), 0.01), 6) AS seconds,
  round(CASE WHEN arg_max(done, seq) > 0 THEN arg_max(done, seq) / greatest(max(at_s) - min(at_s), 0.01) ELSE 0 END, 6) AS rate FROM seg GROUP BY 1, 2, 3""",
    PHASE_CTES,
)
def _(spark, sf_dir):
    updates = table(spark, sf_dir, "events").selectExpr(*_UPDATE)
    return pg.phase_rates(pg.phase_segments(updates, order=("at_s", "seq")))


@query("stream_phase_segments", "SELECT job, seq, phase, done, phase_no FROM seg", PHASE_CTES)
def _(spark, sf_dir):
    updates = table_stream(spark, sf_dir, "events").selectExpr(*_UPDATE)
    base = fresh_path(spark, "phases")
    pg.stream_phase_segments(updates, base, f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/rows").select("job", "seq", "phase", "done", "phase_no")


_TRACE = "concat('first', chr(10), '  ', chr(10), raw_output, chr(10), 'a', chr(10), chr(10), 'b', chr(10), 'c ', CAST(claim_id AS STRING), chr(10), 'd')"


@query(
    "failure_digest",
    f"""SELECT context, n, substr(message, 1, 300) AS message, substr(message, 1, 80) AS headline, array_to_string(ls[greatest(len(ls) - 4, 1):], chr(10)) AS traceback FROM (
  SELECT context, n, message, list_filter(string_split(tb, chr(10)), lambda x: trim(x) <> '') AS ls FROM (
    SELECT agent_name AS context, count(*) AS n, arg_max(raw_output, created_at) AS message, arg_max({_TRACE}, created_at) AS tb FROM v_results WHERE model_label IN ('ERROR', 'ERROR_MAX_STEPS') GROUP BY 1))""",
)
def _(spark, sf_dir):
    bad = view(spark, sf_dir, "v_results").filter("model_label IN ('ERROR', 'ERROR_MAX_STEPS')")
    rows = bad.selectExpr("agent_name AS context", "id", "created_at AS at", "raw_output AS message", f"{_TRACE} AS traceback")
    return pg.failure_digest(rows)
