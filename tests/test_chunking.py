from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from verispark.operators import chunking as ch


def model(counts: list[int], max_sent: int, max_tokens: int, overlap: int) -> list[tuple[int, int]]:
    """Each window is the longest one allowed; the next begins `overlap` before its end, or one further."""
    at, out = 0, []
    while at < len(counts):
        allowed = [n for n in range(2, max_sent + 1) if at + n <= len(counts) and sum(counts[at : at + n]) <= max_tokens]
        size = max(allowed, default=1)
        out.append((at, size))
        at += max(size - overlap, 1)
    return out


@pytest.mark.parametrize(("params"), [(3, 256, 1), (3, 20, 1), (5, 30, 2), (2, 9, 0), (1, 5, 1), (4, 25, 3)])
def test_windows_follow_the_rule(spark, params):
    rng = random.Random(1)
    cases = [[rng.randint(1, 15) for _ in range(n)] for n in [1, 2, 3, 4, 5, 7, 40, 255, 256, 257, 600, 1100]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, counts array<int>")
    sizes = df.withColumn("sizes", ch.window_sizes(F.col("counts"), params[0], params[1]))
    rows = sizes.withColumn("starts", ch.window_starts(F.col("sizes"), params[2])).collect()
    for r in rows:
        assert [(s, r.sizes[s]) for s in r.starts] == model(cases[r.i], *params)


def article(spark, *texts):
    return spark.createDataFrame([(i, f"T{i}", t) for i, t in enumerate(texts)], "page_id long, title string, text string")


def test_small_paragraphs(spark):
    arts = article(spark, "A a.", "A a. B b.", "A a. B b. C c.", "A a. B b. C c. D d.")
    got: dict[int, list] = {}
    for r in ch.build_chunks(arts).orderBy("page_id", "chunk_index").collect():
        got.setdefault(r.page_id, []).append(r.sentence_indices)
    assert got == {0: [[0]], 1: [[0, 1], [1]], 2: [[0, 1, 2], [2]], 3: [[0, 1, 2], [2, 3], [3]]}


def test_drop_tail(spark):
    rows = ch.build_chunks(article(spark, "A a. B b. C c. D d."), drop_tail=True).orderBy("chunk_index").collect()
    assert [r.sentence_indices for r in rows] == [[0, 1, 2], [2, 3]]


def test_sections_paragraphs_and_ids(spark):
    text = "Wstęp jeden. Dwa.\n\nDrugi akapit.\n\n\nHistoria\nPierwsze. \n\n \n\nOstatnie.\n\n\n\nPrzypisy\n\n\nŁódź ŁÓDŹ\nX."
    rows = ch.build_chunks(article(spark, text)).collect()
    assert {r.chunk_id for r in rows} == {
        "0_wprowadzenie_0_0", "0_wprowadzenie_0_1", "0_wprowadzenie_1_0", "0_historia_0_0", "0_historia_1_0", "0_odz_odz_0_0"}
    assert {r.section_title for r in rows} == {"Wprowadzenie", "Historia", "Łódź ŁÓDŹ"}


def test_leading_blank_block_shifts_the_intro(spark):
    rows = ch.parse_sections(article(spark, "\n\n\nTytuł\nTreść.")).collect()
    assert [(r.section_title, r.body) for r in rows] == [("Tytuł", "Treść.")]


def test_long_sentence_stands_alone(spark):
    long = " ".join(["x"] * 300) + "."
    rows = ch.build_chunks(article(spark, f"A b. {long} C d.")).orderBy("chunk_index").collect()
    assert [r.sentence_indices for r in rows] == [[0], [1], [2]]
    assert rows[1].num_tokens == 300


def test_collisions_are_reported(spark):
    rows = ch.chunk_id_collisions(ch.build_chunks(article(spark, "I.\n\n\nA!\nx.\n\n\nA?\ny."))).collect()
    assert [(r.chunk_id, r.n) for r in rows] == [("0_a_0_0", 2)]


def test_pending_and_counters(spark):
    arts = spark.createDataFrame(
        [(1, "T", "A.", 1), (1, "T", "B.", 2), (2, "T", " ", 3), (3, "T", "C. D.", 4), (4, "T", "E.", 5)],
        "page_id long, title string, text string, line int")
    stored = spark.createDataFrame([(3,)], "page_id long")
    assert sorted(r.page_id for r in ch.pending_articles(arts, stored, ["line"]).collect()) == [1, 4]
    assert [r.page_id for r in ch.pending_articles(arts, stored, ["line"], limit=2).collect()] == [1]
    marked = ch.mark_articles(arts, stored, ["line"])
    row = ch.ingest_counters(marked, ch.build_chunks(marked.filter("status = 'new'"))).first()
    assert (row.articles_new, row.articles_skipped, row.articles_blank, row.chunks_inserted) == (2, 1, 1, 2)


def test_chunking_needs_no_shuffle(spark):
    plan = ch.build_chunks(article(spark, "A."))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
