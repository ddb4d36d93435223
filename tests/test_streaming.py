from __future__ import annotations

import json

from pyspark.sql import functions as F

from verispark.operators.chunking import build_chunks
from verispark.streaming import ingest
from verispark.streaming import progress as pg


def write_lines(folder, name, *articles):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(a if isinstance(a, str) else json.dumps(a) + "\n" for a in articles), encoding="utf-8")


def art(i, text=None):
    return {"pageid": i, "title": f"T{i}", "text": text or f"Zdanie {i} a. Zdanie b. Zdanie c. Zdanie d."}


def test_restart_adds_no_duplicates(spark, tmp_path):
    src, chunks, pages, check = tmp_path / "in", str(tmp_path / "chunks"), str(tmp_path / "pages"), str(tmp_path / "check")

    def run():
        ingest.stream_ingest_articles(spark, str(src), chunks, pages, check).awaitTermination()
        return spark.read.parquet(chunks)

    write_lines(src, "a.jsonl", art(1), art(2), art(1, "Inny tekst."), "{bad\n", "\n")
    first = run()
    assert {r.page_id for r in first.select("page_id").distinct().collect()} == {1, 2}
    write_lines(src, "b.jsonl", art(2, "Nowy tekst."), art(3), art(4, " "))
    second = run()
    n = second.count()
    assert {r.page_id for r in second.select("page_id").distinct().collect()} == {1, 2, 3}
    assert run().count() == n
    ids = [r.chunk_id for r in second.collect()]
    assert len(ids) == len(set(ids))
    batch = build_chunks(spark.createDataFrame([(3, "T3", art(3)["text"])], "page_id long, title string, text string"))
    want = {(r.chunk_id, r.text) for r in batch.collect()}
    assert {(r.chunk_id, r.text) for r in second.filter("page_id = 3").collect()} == want
    # The first line of a page counts: not the second one of page 1, and a blank one ends its page.
    assert not any("Inny" in r.text or "Nowy" in r.text for r in second.collect())
    write_lines(src, "c.jsonl", art(4, "Za późno."), art(5, "  "), art(5, "Za późno."), art(6, "Zebra pierwsza."), art(6, "Abc druga."))
    third = {r.page_id: r.text for r in run().filter("page_id > 3").collect()}
    assert third == {6: "Zebra pierwsza."}


def test_repeated_batch_changes_nothing(spark, tmp_path):
    lines = spark.createDataFrame([(json.dumps(art(i)),) for i in (1, 2)], "value string")
    chunks, pages = str(tmp_path / "c"), str(tmp_path / "p")
    for _ in range(2):
        ingest.take_batch(lines, 0, chunks, pages)
    assert spark.read.parquet(chunks).count() == 6
    ingest.take_batch(lines, 1, chunks, pages)
    assert spark.read.parquet(chunks).count() == 6


SCHEMA = "agent_name string, benchmark_name string, model_label string, is_correct int, total_tokens long, time_thought double, created_at timestamp"


def result_files(spark, folder, *groups):
    for i, rows in enumerate(groups):
        df = spark.createDataFrame([("a", "b", lab, ok, 10, 0.5, at) for lab, ok, at in rows], SCHEMA.replace("created_at timestamp", "created_at string"))
        df.withColumn("created_at", F.col("created_at").cast("timestamp")).coalesce(1).write.mode("append").json(str(folder / f"{i:02d}"))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(folder / "*"))


def test_progress_of_stream_equals_batch(spark, tmp_path):
    result_files(spark, tmp_path / "in", [("1", 1, "2026-01-01 00:00:00"), ("ERROR", 0, "2026-01-01 00:00:01")], [("2", 0, "2026-01-01 00:00:02")])
    totals = spark.createDataFrame([("b", 10)], "benchmark_name string, total long")
    pg.follow(pg.progress(stream(spark, tmp_path / "in"), totals), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = pg.latest(spark.read.parquet(str(tmp_path / "out")), ["agent_name", "benchmark_name"]).first()
    want = pg.progress(spark.read.schema(SCHEMA).json(str(tmp_path / "in" / "*")), totals).first()
    assert got.asDict() == want.asDict()
    assert (got.done, got.errors, got.accuracy_pct, got.done_pct, got.tok_per_s, got.rate, got.eta_s) == (3, 1, 50.0, 30.0, 20.0, 3.0, round(7 / 3, 6))


def test_progress_without_work_left(spark):
    df = spark.createDataFrame([("a", "b", "1", 1, 10, 0.5, None)], SCHEMA)
    totals = spark.createDataFrame([("b", 1)], "benchmark_name string, total long")
    assert pg.progress(df, totals).first().eta_s is None


def test_late_rows_are_dropped(spark, tmp_path):
    folder = tmp_path / "in"
    for i, at in enumerate(["2026-01-01 00:00:00", "2026-01-01 05:00:00", "2026-01-01 09:00:00"]):
        result_files(spark, folder / str(i), [("1", 1, at)])
    late = tmp_path / "late"
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run(path):
        rows = spark.readStream.schema(SCHEMA).json(path)
        pg.follow(pg.windowed_throughput(rows), out, check).awaitTermination()

    glob = str(tmp_path / "*" / "*" / "*")
    run(glob)
    result_files(spark, late / "0", [("1", 1, "2026-01-01 00:10:00"), ("1", 1, "2026-01-01 09:10:00")])
    run(glob)
    got = {r.window_start: r.n for r in pg.latest(spark.read.parquet(out), ["window_start"]).collect()}
    assert got["2026-01-01 00:00:00"] == 1
    assert got["2026-01-01 09:00:00"] == 2


UPDATES = [("j", 0, 0.0, "load", 0), ("j", 1, 1.0, "load", 5), ("j", 2, 2.0, "embed", 6), ("j", 3, 3.0, "embed", 9), ("j", 4, 4.0, "embed", 0), ("j", 5, 6.0, "embed", 4), ("k", 0, 0.0, "load", 3)]
UP = "job string, seq long, at_s double, phase string, done long"


def test_phases(spark):
    seg = pg.phase_segments(spark.createDataFrame(UPDATES, UP), order=("at_s", "seq"))
    assert {(r.job, r.seq): r.phase_no for r in seg.collect()} == {("j", 0): 1, ("j", 1): 1, ("j", 2): 2, ("j", 3): 2, ("j", 4): 3, ("j", 5): 3, ("k", 0): 1}
    rates = {(r.job, r.phase_no): (r.done, r.seconds, r.rate) for r in pg.phase_rates(seg).collect()}
    assert rates[("j", 3)] == (4, 2.0, 2.0) and rates[("j", 2)] == (9, 1.0, 9.0)


def test_phase_state_lasts_between_batches(spark, tmp_path):
    plain = spark.newSession()  # as any user may have it
    plain.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    for i in range(0, len(UPDATES), 2):
        spark.createDataFrame(UPDATES[i : i + 2], UP).coalesce(1).write.json(str(tmp_path / "in" / f"{i:02d}"))
        rows = plain.readStream.schema(UP).json(str(tmp_path / "in" / "*"))
        pg.stream_phase_segments(rows, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {(r.job, r.seq): r.phase_no for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect()}
    # One row per job, and not more than two batches of it.
    assert len(list((tmp_path / "out" / "open").iterdir())) <= 2
    want = pg.phase_segments(spark.createDataFrame(UPDATES, UP), order=("at_s", "seq"))
    assert got == {(r.job, r.seq): r.phase_no for r in want.collect()}


def test_one_job_with_all_updates_is_spread(spark, tmp_path):
    """A job that holds all rows is numbered over many partitions, batch after batch, and a batch run again changes nothing."""
    ups = [("hot", i, float(i), "ab"[i // 7 % 2], i % 5) for i in range(4000)]
    for k in range(2):
        spark.createDataFrame(ups[2000 * k : 2000 * (k + 1)], UP).coalesce(1).write.json(str(tmp_path / "in" / f"{k:02d}"))
        rows = spark.readStream.schema(UP).json(str(tmp_path / "in" / "*"))
        pg.stream_phase_segments(rows, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = [r.phase_no for r in spark.read.parquet(str(tmp_path / "out" / "rows")).orderBy("seq").collect()]
    want, no = [], 0
    for i, u in enumerate(ups):
        no += i == 0 or u[3] != ups[i - 1][3] or u[4] == 0
        want.append(no)
    assert got == want


def test_failures(spark):
    rows = [("c", 1, "t1", "old", "x"), ("c", 2, "t2", "m" * 400, "\n".join(["a", "", *"bcdefg"]))]
    row = pg.failure_digest(spark.createDataFrame(rows, "context string, id long, at string, message string, traceback string")).first()
    assert (row.n, len(row.message), len(row.headline), row.traceback) == (2, 300, 80, "c\nd\ne\nf\ng")


def test_table_stream_reads_folders_of_part_files(spark, sf, tmp_path):
    from verispark.views import table_stream

    rows = spark.read.parquet(f"{sf}/events.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for place in (sf, str(tmp_path)):
        name = f"seen_{abs(hash(place))}"
        query = table_stream(spark, place, "events", 1).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table(name).count() == rows.count()
