"""Queries over the lexical index, vectors, fusion and evidence (groups D and E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from verispark.functions.text import STOPWORDS, SUFFIXES, split_sentences, stem_pl, tokenize_pl
from verispark.operators import embedding, evidence, lexical, vectors
from verispark.plans.group_chunking import WINDOW_CTES
from verispark.plans.registry import query
from verispark.session import cut_lineage, fresh_path
from verispark.views import table, view

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_STEM = "'^(.{4,}?)(" + "|".join(SUFFIXES) + ")$'"


def sql_words(text: str) -> str:
    """Kept words of a text, in DuckDB SQL."""
    return (
        f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'), "
        f"lambda w: length(w) >= 2 AND NOT list_contains({_STOP}, w))"
    )


def sql_terms(text: str) -> str:
    return f"list_transform({sql_words(text)}, lambda w: regexp_replace(w, {_STEM}, '\\1'))"


# Shared WITH items of the BM25 checks.
BM25_CTES = f"""
d_tok AS (SELECT doc_id, {sql_terms('text')} AS toks FROM documents),
d_len AS (SELECT doc_id, CAST(len(toks) AS BIGINT) AS dl FROM d_tok),
d_tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM d_tok) GROUP BY 1, 2),
d_idf AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM d_tok) - count(*) + 0.5) / (count(*) + 0.5) + 1.0) AS idf FROM d_tf GROUP BY 1),
d_avg AS (SELECT sum(dl) / count(*) AS avgdl FROM d_len),
q_tf AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({sql_terms('text')}) AS term FROM benchmark) GROUP BY 1, 2),
bm25_all AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS raw, round(raw, 6) AS score
  FROM q_tf JOIN d_tf USING (term) JOIN d_idf USING (term) JOIN d_len USING (doc_id) CROSS JOIN d_avg GROUP BY 1, 2),
bm25_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM bm25_all)
"""


def bm25_benchmark(spark, sf_dir, k=5):
    """Benchmark items as queries over all documents."""
    return lexical.bm25_search(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), query_id="item_id", k=k
    )


@query("tokenize_pl", f"SELECT doc_id, array_to_string({sql_terms('text')}, ' ') AS tokens, CAST(len({sql_terms('text')}) AS INTEGER) AS n FROM documents")
def _(spark, sf_dir):
    toks = table(spark, sf_dir, "documents").select("doc_id", tokenize_pl(F.col("text")).alias("t"))
    return toks.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n"))


@query(
    "stem_pl",
    f"""SELECT word, regexp_replace(word, {_STEM}, '\\1') AS stem, count(*) AS n
FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM documents) WHERE word <> '' GROUP BY word""",
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).withColumn("stem", stem_pl(F.col("word")))


@query("term_postings", "SELECT term, doc_id, tf, dl AS doc_len FROM d_tf JOIN d_len USING (doc_id)", BM25_CTES)
def _(spark, sf_dir):
    return lexical.term_postings(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "term_idf",
    "SELECT term, df, round(idf, 9) AS idf, round(avgdl, 6) AS avgdl FROM d_idf CROSS JOIN d_avg",
    BM25_CTES,
)
def _(spark, sf_dir):
    idf = lexical.term_idf(table(spark, sf_dir, "documents"), "doc_id", "text")
    return idf.select("term", "df", F.round("idf", 9).alias("idf"), F.round("avgdl", 6).alias("avgdl"))


@query("bm25_search", "SELECT query_id, doc_id, score, CAST(rn AS INTEGER) AS rank FROM bm25_ranked WHERE rn <= 5", BM25_CTES)
def _(spark, sf_dir):
    return bm25_benchmark(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("search_index", "SELECT query_id, doc_id, round(raw, 6) AS score, CAST(rn AS INTEGER) AS rank FROM bm25_ranked WHERE rn <= 5", BM25_CTES)
def _(spark, sf_dir):
    """The index is written first; the search reads it."""
    path = fresh_path(spark, "index")
    lexical.write_index(table(spark, sf_dir, "documents"), "doc_id", "text", path, shards=16)
    found = lexical.search_index(spark, path, table(spark, sf_dir, "benchmark"), query_id="item_id")
    return found.withColumn("score", F.round("score", 6))


_BM25_SQL = "SELECT query_id, doc_id, round(raw, 6) AS score, CAST(rn AS INTEGER) AS rank FROM bm25_ranked WHERE rn <= 5"


@query("bm25_bounded", _BM25_SQL, BM25_CTES)
def _(spark, sf_dir):
    """Score bounds: most texts that share a term with a query are never scored."""
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = lexical.bm25_search(docs, asked, query_id="item_id", bounded=True)
    return found.withColumn("score", F.round("score", 6))


@query("append_index", _BM25_SQL, BM25_CTES)
def _(spark, sf_dir):
    """Three batches are added one after the other; the search equals that of one index of all texts."""
    path, docs = fresh_path(spark, "segments"), table(spark, sf_dir, "documents")
    for batch in range(3):
        lexical.append_index(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == batch), "doc_id", "text", path, shards=16)
    found = lexical.search_segments(spark, path, table(spark, sf_dir, "benchmark"), query_id="item_id")
    return found.withColumn("score", F.round("score", 6))


@query(
    "index_stats",
    """SELECT (SELECT count(*) FROM d_tok) AS corpus_size, (SELECT count(*) FROM d_idf) AS unique_terms,
  (SELECT count(*) FROM d_tf) AS total_postings, round((SELECT count(*) FROM d_tf) / (SELECT count(*) FROM d_idf), 6) AS avg_postings_per_term""",
    BM25_CTES,
)
def _(spark, sf_dir):
    return lexical.index_stats(table(spark, sf_dir, "documents"), "doc_id", "text")


# ---- vectors -----------------------------------------------------------------------------
# Every vector is both a row of the corpus and a query.


def _vecs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


KNN_CTES = """
vv AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
near AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round(list_distance(q.e, c.e), 6) AS distance FROM vv q CROSS JOIN vv c),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rn FROM near),
"""


def _knn(spark, sf_dir, k=5, **options):
    v = _vecs(spark, sf_dir)
    return vectors.knn_search(v, v, k, corpus_id="vec_id", query_id="vec_id", **options)


@query("l2_normalize", "SELECT vec_id, i AS pos, round(e[i] * 3 / sqrt(list_sum(list_transform(e, lambda x: x * x * 9))), 6) AS value FROM (SELECT vec_id, e, generate_subscripts(e, 1) AS i FROM vv)", KNN_CTES)
def _(spark, sf_dir):
    v = _vecs(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("e"))
    unit = v.select("vec_id", F.posexplode(embedding.l2_normalize(F.col("e"))).alias("p", "value"))
    return unit.select("vec_id", (F.col("p") + 1).cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


def _measured(df):
    """Dimension and length of each vector; the hash of Spark's ML has no SQL."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return df.withColumn("dim", F.size("embedding")).withColumn("norm", F.round(norm, 4))


_UNIT = f"CAST(64 AS INTEGER) AS dim, CAST(CASE WHEN len({sql_terms('text')}) = 0 THEN 0 ELSE 1 END AS DOUBLE) AS norm"


@query("embed_chunks", f"SELECT chunk_id, {_UNIT} FROM chunks", WINDOW_CTES)
def _(spark, sf_dir):
    from verispark.operators.chunking import build_chunks

    chunks = build_chunks(view(spark, sf_dir, "v_articles")).select("chunk_id", "text")
    return _measured(embedding.embed_chunks(chunks)).select("chunk_id", "dim", "norm")


@query("embed_distinct_queries", f"SELECT conv_id, turn, {_UNIT} FROM conversations")
def _(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return _measured(embedding.embed_distinct(turns)).select("conv_id", "turn", "dim", "norm")


@query("knn_search", "SELECT query_id, doc_id, distance, CAST(rn AS INTEGER) AS rank FROM knn WHERE rn <= 5", KNN_CTES)
def _(spark, sf_dir):
    return _knn(spark, sf_dir)


@query("knn_search_blocks", "SELECT query_id, doc_id, distance, CAST(rn AS INTEGER) AS rank FROM knn WHERE rn <= 5", KNN_CTES)
def _(spark, sf_dir):
    return _knn(spark, sf_dir, strategy="blocks")


@query("knn_search_lsh", "SELECT count(*) AS n_exact, true AS found_nine_of_ten FROM knn WHERE rn <= 5", KNN_CTES)
def _(spark, sf_dir):
    """The neighbours depend on drawn planes, so what is checked is how many of the exact ones are found."""
    v = _vecs(spark, sf_dir)
    found = vectors.knn_search_lsh(v, v, 5, corpus_id="vec_id", query_id="vec_id")
    row = vectors.recall(found, _knn(spark, sf_dir))
    return row.select("n_exact", (F.col("recall") >= 0.9).alias("found_nine_of_ten"))


_PLAIN = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')"


@query(
    "bm25_search_words",
    "SELECT query_id, doc_id, score, CAST(rn AS INTEGER) AS rank FROM bm25_ranked WHERE rn <= 5",
    BM25_CTES.replace(sql_terms("text"), _PLAIN),
)
def _(spark, sf_dir):
    """With another tokenizer: words between blanks, no stems."""
    found = lexical.bm25_search(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), query_id="item_id",
        tokenize=lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
    return found.withColumn("score", F.round("score", 6))


@query("vector_score", "SELECT query_id, doc_id, round(1.0 / (1.0 + distance), 6) AS score FROM knn WHERE rn <= 5", KNN_CTES)
def _(spark, sf_dir):
    near = _knn(spark, sf_dir)
    return near.select("query_id", "doc_id", F.round(vectors.vector_score(F.col("distance")), 6).alias("score"))


# ---- fusion and evidence: benchmark items as queries, documents as chunks -------------------
# The vector of a document or item is the one with its id, where there is one.


def sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    v = _vecs(spark, sf_dir)
    ids = v.withColumnRenamed("vec_id", "query_id").join(items.select("query_id"), "query_id", "left_semi")
    return {"docs": docs, "queries": items, "vectors": v.withColumnRenamed("vec_id", "doc_id"), "query_vectors": ids}


def hybrid_ctes(fetch: int) -> str:
    return (
        BM25_CTES.rstrip() + "," + KNN_CTES
        + f"""
lists AS (SELECT query_id, doc_id, rn, score AS bm25_score, CAST(NULL AS DOUBLE) AS vector_score FROM bm25_ranked WHERE rn <= {fetch}
  UNION ALL SELECT query_id, doc_id, rn, NULL, 1.0 / (1.0 + distance) FROM knn WHERE rn <= {fetch} AND query_id IN (SELECT item_id FROM benchmark)),
fused AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rn)), 9) AS rrf_score, max(bm25_score) AS bm25_score, max(vector_score) AS vector_score FROM lists GROUP BY 1, 2),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS hrank FROM fused),
"""
    )


@query("rrf_fuse", "SELECT query_id, doc_id, rrf_score, round(bm25_score, 6) AS bm25_score, round(vector_score, 6) AS vector_score, CAST(hrank AS INTEGER) AS rank FROM hybrid", hybrid_ctes(20))
def _(spark, sf_dir):
    s = sources(spark, sf_dir)
    lists = [
        evidence.retrieve("bm25", 20, docs=s["docs"], queries=s["queries"]),
        evidence.retrieve("vector", 20, vectors=s["vectors"], query_vectors=s["query_vectors"]),
    ]
    fused = evidence.rrf_fuse(lists, payload=("bm25_score", "vector_score"))
    return fused.withColumn("vector_score", F.round("vector_score", 6)).withColumn("bm25_score", F.round("bm25_score", 6))


@query("hybrid_search", "SELECT query_id, doc_id, rrf_score, CAST(hrank AS INTEGER) AS rank FROM hybrid WHERE hrank <= 5", hybrid_ctes(10))
def _(spark, sf_dir):
    return evidence.hybrid_search(**sources(spark, sf_dir), k=5).select("query_id", "doc_id", "rrf_score", "rank")


@query(
    "retrieve",
    """SELECT 'bm25' AS mode, query_id, doc_id, CAST(rn AS INTEGER) AS rank FROM bm25_ranked WHERE rn <= 5
UNION ALL SELECT 'vector', query_id, doc_id, CAST(rn AS INTEGER) FROM knn WHERE rn <= 5 AND query_id IN (SELECT item_id FROM benchmark)
UNION ALL SELECT 'hybrid', query_id, doc_id, CAST(hrank AS INTEGER) FROM hybrid WHERE hrank <= 5""",
    hybrid_ctes(10),
)
def _(spark, sf_dir):
    s = sources(spark, sf_dir)
    parts = [
        evidence.retrieve(m, 5, **s).select(F.lit(m).alias("mode"), "query_id", "doc_id", "rank") for m in evidence.MODES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("retrieve_two_stage", "SELECT query_id, doc_id, rrf_score AS score, 'hybrid' AS source, CAST(hrank AS INTEGER) AS rank FROM hybrid WHERE hrank <= 5 AND rrf_score >= 0.0155", hybrid_ctes(40))
def _(spark, sf_dir):
    return evidence.retrieve_two_stage("hybrid", score_threshold=0.0155, **sources(spark, sf_dir))


def _titled(docs):
    return docs.withColumn("title", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")))


def sql_context(ranked: str, budget: int, digits: int, with_id: bool) -> str:
    """Contexts of a ranked relation (query_id, doc_id, score, rk), in DuckDB SQL."""
    tail = "', id: ', CAST(doc_id AS VARCHAR), " if with_id else ""
    return f"""SELECT query_id, coalesce(string_agg(piece, chr(10) ORDER BY rk), '') AS context, count(*) AS num_results FROM (
  SELECT query_id, rk, CASE WHEN upto <= {budget} THEN entry WHEN {budget} - (upto - length(entry)) > 50 THEN concat(substr(entry, 1, CAST({budget} - (upto - length(entry)) AS BIGINT)), '…') END AS piece FROM (
    SELECT query_id, rk, entry, sum(length(entry)) OVER (PARTITION BY query_id ORDER BY rk) AS upto FROM (
      SELECT r.query_id, r.rk, concat('[', r.rk, '] Doc ', CAST(doc_id AS VARCHAR), ' — ', d.source, ' (score: ', printf('%.{digits}f', r.score), {tail}')', chr(10), d.text, chr(10)) AS entry
      FROM ({ranked}) r JOIN documents d USING (doc_id)))) GROUP BY query_id"""


_TOP = "SELECT query_id, doc_id, raw AS score, rn AS rk FROM bm25_ranked WHERE rn <= 5"


@query(
    "format_context",
    " UNION ALL ".join(
        f"SELECT '{name}' AS variant, query_id, context, num_results FROM ({sql_context(_TOP, 3000, d, i)})"
        for name, d, i in (("bm25", 2, False), ("any", 4, False), ("provenance", 4, True))
    ),
    BM25_CTES,
)
def _(spark, sf_dir):
    docs = _titled(table(spark, sf_dir, "documents"))
    found = evidence.with_payload(bm25_benchmark(spark, sf_dir), docs, ["title", "source", "text"])
    found = cut_lineage(found)  # three variants from one search
    parts = [
        evidence.format_context(found, 3000, d, i, section="source").select(F.lit(name).alias("variant"), "query_id", "context", "num_results")
        for name, d, i in (("bm25", 2, False), ("any", 4, False), ("provenance", 4, True))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Sub-claims: the sentences of each benchmark item.
_SENT = "list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
SUB_CTES = (
    BM25_CTES.replace(
        f"(SELECT item_id AS query_id, unnest({sql_terms('text')}) AS term FROM benchmark)",
        f"(SELECT query_id, unnest({sql_terms('sub_claim')}) AS term FROM subs)",
    ).rstrip()
    + ","
)
SUB_CTES = (
    f"""subs AS (SELECT claim_id, CAST(i - 1 AS INTEGER) AS pos, ss[i] AS sub_claim, concat(claim_id, '#', i - 1) AS query_id FROM (
  SELECT claim_id, ss, generate_subscripts(ss, 1) AS i FROM (SELECT item_id AS claim_id, {_SENT} AS ss FROM benchmark))),
"""
    + SUB_CTES.lstrip()
)


def subclaims_of(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("claim_id"), F.posexplode(split_sentences(F.col("text"))).alias("pos", "sub_claim"))


@query(
    "retrieve_subclaims",
    f"SELECT s.claim_id, s.pos, s.sub_claim, coalesce(c.context, '') AS context, coalesce(c.num_results, 0) AS num_results FROM subs s LEFT JOIN ({sql_context(_TOP, 2000, 4, True)}) c USING (query_id)",
    SUB_CTES,
)
def _(spark, sf_dir):
    docs = _titled(table(spark, sf_dir, "documents"))
    return evidence.retrieve_subclaims(subclaims_of(spark, sf_dir), docs, section="source")[1]


# Known pairs: documents of good quality.
@query(
    "claims_evidence",
    """SELECT query_id AS claim_id, doc_id AS chunk_id, CAST(rn AS INTEGER) AS rank, score, CAST(CASE WHEN l.doc_id IS NOT NULL AND l.quality = 1 THEN 1 ELSE 0 END AS INTEGER) AS is_gold
FROM bm25_ranked LEFT JOIN labels l USING (doc_id) WHERE rn <= 5""",
    BM25_CTES,
)
def _(spark, sf_dir):
    s = sources(spark, sf_dir)
    found = evidence.retrieve_two_stage("bm25", docs=s["docs"], queries=s["queries"])
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("chunk_id"))
    pairs = found.select(F.col("query_id").alias("claim_id"), F.col("doc_id").alias("chunk_id"))
    known = pairs.join(good, "chunk_id", "left_semi")
    return evidence.claims_evidence(found, known).withColumn("score", F.round("score", 6))
