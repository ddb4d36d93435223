"""Rank fusion, retrieval modes, two-stage evidence and prompt contexts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verispark.operators.lexical import bm25_search
from verispark.operators.ordered import join_small
from verispark.operators.vectors import knn_search, vector_score

K_RRF = 60
RRF_DIGITS = 9
MODES = ("bm25", "vector", "hybrid")


def rrf_fuse(lists: Sequence[DataFrame], k_rrf: int = K_RRF, payload: Sequence[str] = ()) -> DataFrame:
    """Fuse ranked lists (query_id, doc_id, rank, payload..): score is the sum of 1/(k_rrf+rank).

    The payload comes from the first list that has the id.
    """
    parts = []
    for no, ranked in enumerate(lists):
        extra = [F.col(c) if c in ranked.columns else F.lit(None).alias(c) for c in payload]
        parts.append(ranked.select(F.lit(no).alias("_no"), "query_id", "doc_id", "rank", *extra))
    pool = parts[0]
    for p in parts[1:]:
        pool = pool.unionByName(p)
    kept = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_no"))).alias(c) for c in payload]
    fused = pool.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(1.0 / (k_rrf + F.col("rank"))), RRF_DIGITS).alias("rrf_score"), *kept)
    w = W.partitionBy("query_id").orderBy(F.col("rrf_score").desc(), F.col("doc_id"))
    return fused.withColumn("rank", F.row_number().over(w))


def _lexical(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return bm25_search(docs, queries, k=k).withColumnRenamed("score", "bm25_score")


def _vector(vectors: DataFrame, query_vectors: DataFrame, k: int) -> DataFrame:
    near = knn_search(vectors, query_vectors, k, corpus_id="doc_id", query_id="query_id")
    return near.withColumn("vector_score", vector_score(F.col("distance")))


def hybrid_search(
    docs: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, k: int = 5, fetch: int | None = None,
) -> DataFrame:
    """Lexical and vector lists of `fetch` rows each (2k, or 50 where that is less but still at least k), fused, cut to k."""
    fetch = fetch or max(k, min(2 * k, 50))
    lists = [_lexical(docs, queries, fetch), _vector(vectors, query_vectors, fetch)]
    fused = rrf_fuse(lists, payload=("bm25_score", "vector_score"))
    return fused.filter(F.col("rank") <= k)


def retrieve(
    mode: str, k: int, *, docs: DataFrame | None = None, queries: DataFrame | None = None,
    vectors: DataFrame | None = None, query_vectors: DataFrame | None = None,
) -> DataFrame:
    """Ranked list in the chosen mode; columns of the other scores are NULL."""
    if mode == "bm25":
        out = _lexical(docs, queries, k)
    elif mode == "vector":
        out = _vector(vectors, query_vectors, k)
    elif mode == "hybrid":
        out = hybrid_search(docs, queries, vectors, query_vectors, k)
    else:
        raise ValueError(f"unknown mode {mode!r}; known: {MODES}")
    for c in ("rrf_score", "bm25_score", "vector_score"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    return out.select("query_id", "doc_id", "rank", "rrf_score", "bm25_score", "vector_score")


def best_score() -> Column:
    """First score that is neither missing nor zero."""
    zero = F.lit(0.0)
    return F.coalesce(*[F.nullif(c, zero) for c in ("rrf_score", "bm25_score", "vector_score")], zero)


def retrieve_two_stage(
    mode: str, *, k_initial: int = 20, k_final: int = 5, score_threshold: float | None = None, **sources
) -> DataFrame:
    """Fetch k_initial, drop low scores, keep k_final: (query_id, doc_id, score, source, rank)."""
    first = retrieve(mode, k_initial, **sources).withColumn("score", best_score())
    if score_threshold is not None:
        first = first.filter(F.col("score") >= score_threshold)
    w = W.partitionBy("query_id").orderBy("rank")
    kept = first.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k_final)
    return kept.select("query_id", "doc_id", "score", F.lit(mode).alias("source"), F.col("_r").alias("rank"))


def with_payload(evidence: DataFrame, docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add columns of the document table to its few retrieved rows.

    The rows are written and counted; when they are few they go to the scan of the documents,
    whose texts are then not shuffled.
    """
    return join_small(docs.select("doc_id", *columns), evidence.drop(*columns), ["doc_id"])


def format_context(
    evidence: DataFrame, max_chars: int = 3000, digits: int = 4, with_id: bool = False,
    title: str = "title", section: str | None = "section", min_cut: int = 50,
) -> DataFrame:
    """(query_id, context, num_results): ranked entries up to a budget of characters.

    The entry that passes the budget is cut and marked when more than `min_cut` characters are
    left; nothing follows it.
    """
    name = F.coalesce(F.col(title).cast("string"), F.lit(""))
    sect = F.coalesce(F.col(section).cast("string"), F.lit("")) if section else F.lit("")
    score = F.format_string(f"%.{digits}f", F.col("score"))
    tail = F.concat(F.lit(", id: "), F.col("doc_id").cast("string")) if with_id else F.lit("")
    header = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("]"),
        F.when(name != "", F.concat(F.lit(" "), name)).otherwise(""),
        F.when(sect != "", F.concat(F.lit(" — "), sect)).otherwise(""),
        F.lit(" (score: "), score, tail, F.lit(")"))
    entry = F.concat(header, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    w = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    sized = evidence.select("query_id", "rank", entry.alias("entry")).withColumn("upto", F.sum(F.length("entry")).over(w))
    room = F.lit(max_chars) - (F.col("upto") - F.length("entry"))
    piece = (
        F.when(F.col("upto") <= max_chars, F.col("entry"))
        .when((room > min_cut) & (room < F.length("entry")),
              F.concat(F.substring(F.col("entry"), F.lit(1), room.cast("int")), F.lit("…")))
    )
    rows = sized.withColumn("piece", piece)
    # One query has at most k entries.
    packed = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("rank", "piece"))))
    return rows.groupBy("query_id").agg(
        F.array_join(F.transform(packed, lambda s: s["piece"]), "\n").alias("context"),
        F.count("*").alias("num_results"))


def retrieve_subclaims(
    subclaims: DataFrame, docs: DataFrame, *, k_initial: int = 20, k_final: int = 5,
    score_threshold: float | None = None, max_chars: int = 2000, title: str = "title", section: str = "section",
    mode: str = "bm25", vectors: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Evidence rows and one context per (claim_id, pos, sub_claim). Every sub-claim is searched once.

    For the modes `vector` and `hybrid`, `vectors` are the documents' and `embed` adds `embedding` to (query_id, text).
    """
    keyed = subclaims.withColumn("query_id", F.concat_ws("#", F.col("claim_id").cast("string"), F.col("pos").cast("string")))
    asked = keyed.select("query_id", F.col("sub_claim").alias("text"))
    found = retrieve_two_stage(
        mode, k_initial=k_initial, k_final=k_final, score_threshold=score_threshold, docs=docs, queries=asked,
        vectors=vectors, query_vectors=None if mode == "bm25" else embed(asked).select("query_id", "embedding"))
    evidence = with_payload(found, docs, [title, section, "text"])
    contexts = format_context(evidence, max_chars, with_id=True, title=title, section=section)
    full = keyed.join(contexts, "query_id", "left").select(
        "claim_id", "pos", "sub_claim", F.coalesce("context", F.lit("")).alias("context"),
        F.coalesce("num_results", F.lit(0)).alias("num_results"))
    return evidence, full


def claims_evidence(found: DataFrame, gold: DataFrame) -> DataFrame:
    """(claim_id, chunk_id, rank, score, is_gold); gold holds known (claim_id, chunk_id) pairs."""
    known = gold.select("claim_id", "chunk_id").distinct().withColumn("_g", F.lit(1))
    rows = found.select(F.col("query_id").alias("claim_id"), F.col("doc_id").alias("chunk_id"), "rank", "score")
    return rows.join(known, ["claim_id", "chunk_id"], "left").withColumn("is_gold", F.coalesce("_g", F.lit(0))).drop("_g")

