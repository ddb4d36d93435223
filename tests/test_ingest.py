from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from verispark.operators import articles as art
from verispark.operators import claims as cl
from verispark.operators import pages as pg
from verispark.sources import readers as rd
from verispark.sources import tables as tb
from verispark.sources import writers as wr


def test_one_row_csv_becomes_one_claim(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        'question,answers,correct_answer_index,name,year,type\n"Ile to\n2+2, ""cztery""?","[\'1\', \'4\']",1,Matematyka,2015,matura\n', encoding="utf-8")
    row = cl.claims_from_exams(rd.read_claims_csv(spark, str(tmp_path)), ["question"]).first()
    assert row.claim_text == 'Ile to\n2+2, "cztery"?' and (row.label, row.label_original, row.topic) == ("SUPPORTS", "1", "Matematyka")
    assert json.loads(row.metadata) == {"answers": "['1', '4']", "correct_answer_index": "1", "exam_type": "matura"}


def test_external_ids_keep_the_gaps(spark):
    df = spark.createDataFrame([(i, " " if i == 2 else "q") for i in range(5)], "n int, question string").selectExpr(
        "*", "'' AS answers", "'0' AS correct_answer_index", "'t' AS name", "NULL AS year", "'x' AS type")
    got = cl.claims_from_exams(df, ["n"]).collect()
    assert sorted(r.external_id for r in got) == ["0", "1", "3", "4"]
    row = cl.blank_counts(df, "question").first()
    assert (row.n_read, row.n_kept, row.n_skipped) == (5, 4, 1)


def test_statements(spark, tmp_path):
    rec = {"id": 7, "statement": "S", "person_name": "P", "rating": "fałsz", "publication_date": "25.02.2026 godz.16:28", "tags": ["a", "b"], "category": "c", "reading_time": ""}
    (tmp_path / "d.json").write_text(json.dumps([rec, {"id": 8, "statement": " "}]), encoding="utf-8")
    rows = cl.claims_from_statements(rd.read_claims_json(spark, str(tmp_path))).collect()
    assert len(rows) == 1
    assert (rows[0].label, rows[0].claim_date, rows[0].topic, rows[0].speaker_role) == ("REFUTES", "2026-02-25", "a, b", None)
    assert json.loads(rows[0].metadata)["category"] == "c" and "reading_time" not in json.loads(rows[0].metadata)


@pytest.mark.parametrize(("raw", "want"), [("fałsz", "REFUTES"), ("Prawda", "SUPPORTS"), (" MANIPULACJA ", "PARTIALLY_TRUE"), ("xyz", "NOT_ENOUGH_INFO"), (None, "NOT_ENOUGH_INFO")])
def test_normal_labels(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "r string").select(cl.normalize_label(F.col("r")).alias("o")).first().o == want


@pytest.mark.parametrize(("raw", "want"), [("25.02.2026 godz.16:28", "2026-02-25"), ("1.2.2026", "2026-2-1"), ("wczoraj rano", "wczoraj rano"), ("", None), (None, None), ("a.b", "a.b")])
def test_dates(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "r string").select(cl.parse_pl_date(F.col("r")).alias("o")).first().o == want


def test_questions(one):
    build = cl.question_with_answers(F.col("t"), F.col("m"))
    four = json.dumps({"answers": "['a', \"b's\", 'c', 'd']"})
    assert one(build, t="Q", m=four) == "Q\n\nOdpowiedzi:\n0: a\n1: b's\n2: c\n3: d"
    assert one(build, t="Q", m=json.dumps({"answers": "['a', 'b', 'c']"})) == "Q"
    assert one(build, t="Q", m="{bad") == "Q"
    assert one(build, t="Q", m=json.dumps({"answers": ["a", "b", "c", "d"]})).endswith("3: d")


def test_truth(one):
    assert one(cl.ground_truth_label(F.lit("SUPPORTS"), F.lit("2"))) == "2"
    assert one(cl.ground_truth_label(F.lit("SUPPORTS"), F.lit(""))) == "SUPPORTS"


def test_mapped_fields(spark):
    df = spark.createDataFrame([("x", 1, "z")], "statement string, id int, other string")
    row = cl.map_fields(df, cl.STATEMENT_FIELDS).first()
    assert (row.claim_text, row.external_id, row.speaker, row.remainder.other) == ("x", "1", None, "z")


def test_article_lines(spark, tmp_path):
    lines = "﻿" + json.dumps({"pageid": 1, "title": "A", "text": "t"}) + "\n\n   \n{bad\n" + json.dumps({"id": 2, "title": "B"}) + "\n"
    (tmp_path / "a.jsonl").write_text(lines, encoding="utf-8")
    rows = rd.read_articles_jsonl(spark, str(tmp_path)).orderBy("pageid").collect()
    assert [(r.pageid, r.title) for r in rows] == [(1, "A"), (2, "B")]
    assert rd.bad_articles(spark, str(tmp_path)).collect()[0][0] == "{bad"


def test_article_url(one):
    assert one(art.article_url(F.col("t")), t="Łódź (miasto)") == "https://pl.wikipedia.org/wiki/%C5%81%C3%B3d%C5%BA_(miasto)"
    assert one(art.article_url(F.col("t")), t="a~b?/c:d+e%") == "https://pl.wikipedia.org/wiki/a~b%3F/c:d+e%25"


def test_articles(spark):
    parts = spark.createDataFrame(
        [(1, 1, False, ["a"], "x", None), (1, 2, False, ["b"], None, 5), (2, 1, True, ["z"], "q", 1), (3, 1, False, None, "w", 2)],
        "pageid long, part int, missing boolean, links array<string>, extract string, length int")
    rows = {r.pageid: r for r in art.merge_paged_articles(parts, "pageid", "part", ["links"], ["extract", "length"]).collect()}
    assert rows.keys() == {1, 3} and rows[1].links == ["a", "b"] and (rows[1].extract, rows[1].length) == ("x", 5)
    dup = spark.createDataFrame([(5, 1), (5, 2), (4, 3), (9, 4)], "pageid long, line int")
    got = [(r.pageid, r.id) for r in art.dedup_articles(dup, "pageid", ["line"]).orderBy("id").collect()]
    assert got == [(5, 1), (4, 2), (9, 3)]
    row = art.dedup_counts(dup, "pageid").first()
    assert (row.n_lines, row.n_kept, row.n_duplicates) == (4, 3, 1)


LISTING = """<div class="dg-item dg-item--mobile"><h3 class="dg-item__title"><a href="/m">M</a></h3></div>
<div class="dg-item dg-item--desktop"><h3 class="dg-item__title"><a href="/a">Tytuł <b>A</b></a></h3><p class="dg-item__person"><a>Jan</a></p>
<div class="dg-item__evaluation"><p> Fałsz </p></div><div class="dg-item__description">Opis</div><div class="dg-item__tags"><a>x</a><a>y</a></div></div>
<div class="dg-item dg-item--desktop"><h3 class="dg-item__title"><a href="/a">again</a></h3></div><div class="dg-item dg-item--desktop">no link</div>"""
DETAIL = """<html lang="pl"><body><div class="dg-post-content__title"><h2>T &amp; U</h2></div><div class="dg-post__info"><span>25.02.2026</span><span>9 min</span></div>
<div class="dg-post-person"><div class="dg-post-person__image"><img src="/p.jpg"></div><div class="dg-post-person__desc"><h4><a>Jan K</a></h4></div><p class="dg-post-person__function">Poseł</p></div>
<div class="dg-post-quote__statement"><img src="q"> Cytat </div><div class="dg-post-quote__source">FB <a href="http://s">link</a></div>
<div class="dg-post-quote__evaluation"><p>Prawda</p></div><div class="dg-post-content__tags"><a>E</a></div><div class="summary-text"><p>s1</p><p>s2</p></div>
<div class="dg-post-content__inner"><p>a</p><p>b</p></div><div class="dg-post-content__inner">c<script>x</script></div></body></html>"""


def test_pages(spark):
    pages = spark.createDataFrame([(1, "https://e.org/l", LISTING), (2, "https://e.org/d", DETAIL), (3, "https://e.org/n", "")], "page_id long, url string, html string")
    rows = pg.extract_listing(pages).collect()
    assert [(r.page_id, r.url, r.title, r.person, r.rating, r.snippet, r.tags) for r in rows] == [
        (1, "https://e.org/a", "TytułA", "Jan", "Fałsz", "Opis", ["x", "y"])]
    d = {r.page_id: r for r in pg.extract_detail(pages).collect()}
    two = d[2]
    assert (two.title, two.publication_date, two.reading_time, two.person_name, two.person_function) == ("T & U", "25.02.2026", "9 min", "Jan K", "Poseł")
    assert (two.person_image_url, two.statement, two.statement_source, two.statement_source_url, two.rating) == ("/p.jpg", "Cytat", "FBlink", "http://s", "Prawda")
    assert (two.summary, two.full_analysis, two.tags, two.lang) == ("s1\ns2", "a\nb\n\nc", ["E"], "pl")
    assert d[3].title is None and d[3].tags == []
    listing = spark.createDataFrame([("https://e.org/d",), ("https://e.org/x",), (None,)], "url string")
    full = pg.listing_to_detail(listing, pg.extract_detail(pages))
    assert {r.detail_url: r.error for r in full.collect()} == {"https://e.org/d": None, "https://e.org/x": "page not found"}
    assert tuple(pg.detail_counts(full).first()) == (1, 1)


def test_presets(spark, tmp_path):
    df = spark.range(5).selectExpr("id", *[f"'{c}' AS {c}" for c in ("claim_text", "label", "label_original", "topic", "claim_date", "metadata", "extra")])
    df.write.parquet(str(tmp_path / "claims"))
    got = tb.scan_preset(spark, "am_benchmark", paths={"claims": str(tmp_path / "claims")}, limit=2)
    assert [r.id for r in got.collect()] == [0, 1] and "extra" not in got.columns
    assert "extra" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        tb.scan_preset(spark, "other", paths={})


def test_upsert_append_replace(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "chunk_id string, v int, seq int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 3)], "chunk_id string, v int, seq int")
    assert {r.chunk_id: r.v for r in wr.upsert_chunks(old, new, ["seq"]).collect()} == {"a": 1, "b": 3, "c": 4}
    assert {r.chunk_id: r.v for r in wr.append_new_chunks(old, new, ["seq"]).collect()} == {"c": 4}
    path = str(tmp_path / "claims")
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, source string")
    wr.replace_by_source(df, path)
    for _ in range(2):
        wr.replace_by_source(spark.createDataFrame([(9, "x")], "id int, source string"), path)
    assert sorted((r.id, r.source) for r in spark.read.parquet(path).collect()) == [(3, "y"), (9, "x")]


def test_export_is_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f"a{i % 3}", i % 7, "x,\"y\"\n z ") for i in range(50)], "id int, agent_name string, claim_id int, raw_output string")
    wr.export_results_csv(df.repartition(5), str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*.csv"))
    rows = [r for f in files for r in rd.read_claims_csv(spark, str(f), ("id", "agent_name", "claim_id", "raw_output")).collect()]
    assert [(r.agent_name, int(r.claim_id)) for r in rows] == sorted((f"a{i % 3}", i % 7) for i in range(50))
    assert {r.raw_output for r in rows} == {"x,\"y\"\n z "}
