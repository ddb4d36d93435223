from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from verispark.operators import embedding as eb
from verispark.operators import evidence as ev
from verispark.operators import lexical as lx
from verispark.operators import vectors as vc

DOCS = [
    (1, "Warszawa jest stolicą Polski i największym miastem w kraju."),
    (2, "Kraków to dawna stolica Polski, znana z Wawelu."),
    (3, "Bałtyk to morze; polskie wybrzeże Bałtyku ma wiele plaż."),
    (4, "Tatry są najwyższymi górami w Polsce."),
    (5, "i w z na"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def search(spark, docs, *queries, k=5):
    q = spark.createDataFrame([(i, t) for i, t in enumerate(queries)], "query_id long, text string")
    return lx.bm25_search(docs, q, k=k).orderBy("query_id", "rank").collect()


def test_ranking(spark, docs):
    top = {r.query_id: r.doc_id for r in search(spark, docs, "Warszawa stolicą", "morze Bałtyk wybrzeże") if r["rank"] == 1}
    assert top == {0: 1, 1: 3}


def test_no_match_gives_no_rows(spark, docs):
    assert search(spark, docs, "i w z na", "nieobecneslowo") == []


def test_scores_against_the_formula(spark, docs, one):
    from verispark.functions.text import tokenize_pl

    rows = docs.select("doc_id", tokenize_pl(F.col("text")).alias("t")).collect()
    tokens = {r.doc_id: r.t for r in rows}
    query = "Polski stolica Polski"
    q = one(tokenize_pl(F.col("t")), t=query)
    avg = sum(map(len, tokens.values())) / len(tokens)
    want = {}
    for term in q:
        df = sum(term in t for t in tokens.values())
        idf = math.log((len(tokens) - df + 0.5) / (df + 0.5) + 1)
        for d, t in tokens.items():
            tf = t.count(term)
            if tf:
                want[d] = want.get(d, 0) + idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len(t) / avg))
    got = {r.doc_id: r.score for r in search(spark, docs, query)}
    assert got.keys() == want.keys()
    assert all(got[d] == pytest.approx(want[d]) for d in want)


def test_empty_documents_keep_length_zero(spark, docs):
    assert {r.doc_id: r.doc_len for r in lx.doc_lengths(docs, "doc_id", "text").collect()}[5] == 0
    assert lx.index_stats(docs, "doc_id", "text").first().corpus_size == 5


def test_stored_index_gives_the_same_ranks(spark, docs, tmp_path):
    q = spark.createDataFrame([(0, "stolica Polski"), (1, "morze Bałtyk"), (2, "zzz")], "query_id long, text string")
    lx.write_index(docs, "doc_id", "text", str(tmp_path / "index"), shards=4)
    got = {(r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in lx.search_index(spark, str(tmp_path / "index"), q).collect()}
    assert got == {(r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in lx.bm25_search(docs, q).collect()}


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_both_join_ways_give_the_same_ranks(spark, docs, limit, monkeypatch):
    want = search(spark, docs, "stolica Polski", "morze")
    monkeypatch.setattr(lx, "BROADCAST_ROWS", limit)
    assert search(spark, docs, "stolica Polski", "morze") == want


def test_sums_per_query_and_text_are_not_shuffled(spark, docs):
    q = spark.createDataFrame([(0, "stolica")], "query_id long, text string")
    plan = lx.bm25_search(docs, q)._jdf.queryExecution().executedPlan().toString()
    head = plan[: plan.index("REPARTITION_BY_COL")]
    assert head.count("Exchange hashpartitioning") == 2  # the ranks, and the texts' words by doc_id
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rrf(spark):
    a = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "query_id long, doc_id string, rank int")
    b = spark.createDataFrame([(0, "b", 1), (0, "c", 2)], "query_id long, doc_id string, rank int")
    got = {r.doc_id: (r.rrf_score, r["rank"]) for r in ev.rrf_fuse([a, b]).collect()}
    assert got["b"] == (pytest.approx(1 / 62 + 1 / 61, abs=1e-9), 1)
    assert got["a"][0] == pytest.approx(1 / 61, abs=1e-9) and got["c"][0] == pytest.approx(1 / 62, abs=1e-9)
    swapped = {r.doc_id: (r.rrf_score, r["rank"]) for r in ev.rrf_fuse([b, a]).collect()}
    assert swapped == got


@pytest.fixture(scope="module")
def clustered(spark):
    """One tight cluster holds most vectors; copies give ties."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=8)
    rows = [centre + 0.01 * rng.normal(size=8) for _ in range(300)] + list(rng.normal(size=(200, 8)))
    rows += [rows[0]] * 5 + [rows[400]] * 3
    m = np.array(rows).round(4)
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(m)], "chunk_id long, embedding array<double>")
    return df.repartition(4), m


def brute(m, k):
    d = np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(axis=2)).round(6)
    return {(i, int(j), r + 1) for i in range(len(m)) for r, j in enumerate(np.lexsort((np.arange(len(m)), d[i]))[:k])}


@pytest.mark.parametrize("strategy", ["scan", "blocks", "auto"])
def test_knn_is_exact(spark, clustered, strategy, monkeypatch):
    monkeypatch.setattr(vc, "BLOCK_ROWS", 90)
    df, m = clustered
    got = vc.knn_search(df, df.withColumnRenamed("chunk_id", "query_id"), 4, strategy=strategy).collect()
    assert {(r.query_id, r.doc_id, r["rank"]) for r in got} == brute(m, 4)


def test_knn_with_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 5.0])], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, embedding array<double>")
    for strategy in ("scan", "blocks"):
        rows = vc.knn_search(df, q, 5, strategy=strategy).orderBy("rank").collect()
        assert [(r.doc_id, r.distance) for r in rows] == [(1, 0.0), (2, 5.0)]
    with pytest.raises(ValueError):
        vc.knn_search(df, q, 5, strategy="other")


def test_lsh_recall(spark, clustered):
    df, _ = clustered
    q = df.withColumnRenamed("chunk_id", "query_id")
    row = vc.recall(vc.knn_search_lsh(df, q, 4), vc.knn_search(df, q, 4)).first()
    assert row.recall > 0.8


def test_normalize(one):
    got = one(eb.l2_normalize(F.col("v")), v=[3.0, 4.0])
    assert got == pytest.approx([0.6, 0.8])
    assert one(eb.l2_normalize(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]


def test_embedding_model_factory(spark):
    def factory():
        def encode(texts):
            return np.array([[float(len(t)), 1.0] for t in texts], dtype=np.float32)

        return encode

    df = spark.createDataFrame([("abc",), ("abc",), ("x",)], "text string")
    rows = eb.embed_distinct(df, factory=factory, normalize=False).collect()
    assert sorted(r.embedding[0] for r in rows) == [1.0, 3.0, 3.0]
    unit = eb.embed_chunks(df, dim=16).first().embedding
    assert sum(x * x for x in unit) == pytest.approx(1, abs=1e-5)


def context(entries: list[str], budget: int) -> str:
    """Whole entries while they fit; then the start of the next, if enough of it fits."""
    ends = list(accumulate(map(len, entries)))
    whole = sum(end <= budget for end in ends)
    room = budget - (ends[whole - 1] if whole else 0)
    cut = [e[:room] + "…" for e in entries[whole : whole + 1] if room > 50]
    return "\n".join(entries[:whole] + cut)


@pytest.mark.parametrize("budget", [10, 60, 100, 139, 140, 170, 260, 5000])
def test_context_budget(spark, budget):
    rows = [("q", i, f"d{i}", 1.0 / i, f"T{i}" if i != 2 else "", "S" if i % 2 else None, "słowo " * (i * 5)) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "query_id string, rank int, doc_id string, score double, title string, section string, text string")
    got = ev.format_context(df, budget, 4, with_id=True).first()
    entries = [
        f"[{i}]" + (f" {t}" if t else "") + (f" — {s}" if s else "") + f" (score: {sc:.4f}, id: {d})\n{x}\n" for _, i, d, sc, t, s, x in rows]
    assert got.context == context(entries, budget)
    assert got.num_results == 5


def test_modes_and_threshold(spark, docs):
    q = spark.createDataFrame([(0, "stolica Polski")], "query_id long, text string")
    assert ev.retrieve("bm25", 1, docs=docs, queries=q).count() == 1
    with pytest.raises(ValueError):
        ev.retrieve("other", 1)
    all_rows = ev.retrieve_two_stage("bm25", docs=docs, queries=q).collect()
    cut = ev.retrieve_two_stage("bm25", score_threshold=max(r.score for r in all_rows), docs=docs, queries=q).collect()
    assert len(cut) == 1 and cut[0]["rank"] == 1


def test_subclaims_without_hits_keep_a_row(spark, docs):
    subs = spark.createDataFrame([(7, 0, "stolica Polski"), (7, 1, "zzz")], "claim_id long, pos int, sub_claim string")
    titled = docs.withColumn("title", F.lit("T")).withColumn("section", F.lit("S"))
    _, got = ev.retrieve_subclaims(subs, titled)
    rows = {r.pos: r for r in got.collect()}
    assert rows[0].num_results > 0 and rows[0].context.startswith("[1] T — S (score: ")
    assert rows[1].num_results == 0 and rows[1].context == ""


def test_scan_search_does_not_shuffle_the_corpus(spark, clustered):
    df, _ = clustered
    plan = vc.knn_search(df, df.withColumnRenamed("chunk_id", "query_id"), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in plan


def test_other_tokenizer_splitter_counter_and_mode(spark):
    from pyspark.sql import functions as F

    from verispark.operators import chunking, embedding, evidence, lexical

    docs = spark.createDataFrame([(1, "w i z", "t", "s"), (2, "miasto i rzeka", "t", "s"), (3, "morze", "t", "s")], "doc_id long, text string, title string, section string")
    asked = spark.createDataFrame([(7, "i z")], "query_id long, text string")
    assert lexical.bm25_search(docs, asked).count() == 0  # function words are no terms
    found = lexical.bm25_search(docs, asked, tokenize=lambda c: F.split(c, " ")).orderBy("rank").collect()
    assert [r.doc_id for r in found] == [1, 2]
    article = spark.createDataFrame([(1, "T", "a b c\nd e\nf")], "page_id long, title string, text string")
    cut = chunking.build_chunks(article, overlap=0, max_tokens=4, splitter=lambda c: F.split(c, "\n"), counter=F.length).orderBy("chunk_index").collect()
    assert [(r.text, r.num_tokens) for r in cut] == [("a b c", 5), ("d e f", 4)]
    vectors = embedding.embed_chunks(docs).select("doc_id", "embedding")
    subs = spark.createDataFrame([(1, 0, "morze"), (1, 1, "rzeka miasto")], "claim_id long, pos int, sub_claim string")
    for mode in ("vector", "hybrid"):
        rows, contexts = evidence.retrieve_subclaims(subs, docs, mode=mode, vectors=vectors, embed=embedding.embed_chunks, k_final=1)
        assert {r.query_id: r.doc_id for r in rows.collect()} == {"1#0": 3, "1#1": 2}, mode
        assert contexts.filter("num_results = 1").count() == 2


def test_hybrid_gives_k_rows(spark):
    from verispark.operators import embedding, evidence

    docs = spark.createDataFrame([(i, f"morze słowo{i}") for i in range(80)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "morze")], "query_id long, text string")
    vectors = embedding.embed_chunks(docs).select("doc_id", "embedding")
    got = evidence.hybrid_search(docs, asked, vectors, embedding.embed_chunks(asked).select("query_id", "embedding"), k=60)
    assert got.count() == 60


def test_corpus_is_scanned_once(spark, sf):
    from verispark.operators import lexical

    docs, asked = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plan = lx._hits(docs, "doc_id", "text", lx.query_terms(asked, "item_id", "text").select("term").distinct(), True)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("documents.parquet") == 1


def test_bounded_search_equals_the_full_one_and_scores_fewer_pairs(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.substring("text", 1, 60).alias("text"))
    met, first = [], lx._met
    monkeypatch.setattr(lx, "_met", lambda *a: met.append(first(*a)) or met[0])
    key = ("query_id", "doc_id", "rank", F.round("score", 6))
    full = lx.bm25_search(docs, asked, query_id="item_id").select(*key).collect()
    bounded = lx.bm25_search(docs, asked, query_id="item_id", bounded=True).select(*key).collect()
    assert sorted(map(tuple, full)) == sorted(map(tuple, bounded))
    everything = lx.bm25_search(docs, asked, query_id="item_id", k=10**6).count()
    assert 0 < met[0].count() < everything


def test_bounded_search_with_few_texts_ties_and_repeated_words(spark):
    docs = spark.createDataFrame([(1, "kot pies"), (2, "pies kot"), (3, None), (4, ""), (5, "kot kot dom")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "kot"), (2, "kot kot pies dom"), (3, None), (4, "nieznane")], "query_id int, text string")
    rows = [
        sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in lx.bm25_search(docs, asked, k=2, bounded=b).collect())
        for b in (False, True)
    ]
    assert rows[0] == rows[1] and [r[:3] for r in rows[0]][:1] == [(1, 1, 5)]
    assert lx.bm25_search(docs.limit(0), asked, bounded=True).count() == 0


def test_an_index_of_segments_equals_one_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "kot pies dom"), (2, "pies las"), (3, ""), (4, "kot kot rzeka"), (5, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "kot las"), (2, "rzeka pies")], "query_id int, text string")
    path = str(tmp_path / "index")
    for ids in ((1, 2), (3, 5), (4,)):
        lx.append_index(docs.filter(F.col("doc_id").isin(*ids)), "doc_id", "text", path, shards=4)
    # A segment whose write did not end is not seen.
    lx.term_postings(docs, "doc_id", "text").withColumn("shard", F.lit(0)).write.parquet(f"{path}/postings/broken")
    key = ("query_id", "doc_id", "rank", F.round("score", 6))
    one = lx.bm25_search(docs, asked).select(*key).collect()
    assert sorted(map(tuple, lx.search_segments(spark, path, asked).select(*key).collect())) == sorted(map(tuple, one))
    lx.append_index(docs.filter("doc_id = 3"), "doc_id", "text", f"{path}2", shards=4)
    assert lx.search_segments(spark, f"{path}2", asked).count() == 0


def test_approximate_search_gives_k_rows_whatever_the_buckets(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(300)]
    corpus = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame(rows[:40] + [(999, [-90.0] * 8)], "query_id long, embedding array<double>")
    # So many planes that most buckets hold one row.
    got = vc.knn_search_lsh(corpus, asked, 5, tables=1, bits=14, probes=0).toPandas()
    assert (got.groupby("query_id").size() == 5).all() and got.query_id.nunique() == 41
    assert not got.duplicated(["query_id", "doc_id"]).any()
    assert vc.knn_search_lsh(corpus.limit(3), asked, 5).count() == 3 * 41
    assert vc.knn_search_lsh(corpus.limit(0), asked, 5).count() == 0
