"""Nearest-neighbour search for a table of query vectors.

Few queries (their size is checked): they go to every task, the corpus is read once and not
shuffled, and each task hands on k rows per query. Many queries: corpus and queries are written
once in blocks of bounded size, by the distance to a set of pivots, and blocks meet where they lie;
cells that the triangle inequality rules out are never visited, so the result stays exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verispark.operators.lexical import top_k
from verispark.session import cut_lineage

DIST_DIGITS = 6
BROADCAST_BYTES = 32 * 1024 * 1024  # each Python worker holds the queries and a few tables of this size
PIVOTS = 64
BLOCK_ROWS = 8192
PART_ROWS = 1 << 16  # vectors of a partition that a task holds while the blocks of another pass
FIT_QUERIES = 256  # whose exact neighbours fit the approximate search
PROBE_COST = 500  # moving a query to one more bucket, in comparisons of vectors
_QUERY_SLICE = 256
_SLICE_ROWS = 4096  # handed back by a Python worker at once
_STEP_CELLS = 1 << 19  # numbers in one table of an inner step


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _slices(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The batches in pieces of bounded size, so that what a piece becomes stays small whatever Arrow's batches are."""
    for b in batches:
        for s in range(0, len(b), max(1, rows)):
            yield b.iloc[s : s + max(1, rows)]


def _best_of(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    return rows.sort_values(["query_id", "distance", "doc_id"], kind="stable").groupby("query_id", sort=False).head(k)


def _nearest(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, worst: np.ndarray | None = None) -> pd.DataFrame:
    """k nearest rows of a block per query, ties by id; only those not farther than `worst`, where it is given and finite.

    The matrix product finds candidates with a margin for its rounding; their distances are then
    computed from the differences.
    """
    parts = []
    c_sq = np.einsum("ij,ij->i", c, c)
    turned = -2.0 * c.T
    kk = min(k, len(c_ids))
    step = max(1, min(_QUERY_SLICE, _STEP_CELLS // len(c_ids)))
    pairs = max(1, _STEP_CELLS // c.shape[1])
    for s in range(0, len(q_ids), step):
        qs = q[s : s + step]
        q_sq = np.einsum("ij,ij->i", qs, qs)
        near = qs @ turned  # squared distance, less q_sq
        near += c_sq
        limit = np.full(len(qs), np.inf) if worst is None else worst[s : s + step].copy()
        fresh = np.isinf(limit)
        if fresh.any():
            kth = np.partition(near[fresh], kk - 1, axis=1)[:, kk - 1]
            limit[fresh] = np.sqrt(np.maximum(kth + q_sq[fresh], 0.0))
        slack = 2e-6 + 2.0 * np.sqrt(1e-14 * (q_sq.max() + c_sq.max()))
        at_q, at_c = np.divmod(np.flatnonzero(near <= ((limit + slack) ** 2 - q_sq)[:, None]), len(c_ids))  # nonzero takes ten times as long
        dist = np.empty(len(at_q))
        # Copies of a row are all within the limit, so there may be far more pairs than k a query.
        for p in range(0, len(at_q), pairs):
            gap = qs[at_q[p : p + pairs]] - c[at_c[p : p + pairs]]
            dist[p : p + pairs] = np.round(np.sqrt(np.einsum("ij,ij->i", gap, gap)), DIST_DIGITS)
        got = pd.DataFrame({"query_id": q_ids[s : s + step][at_q], "doc_id": c_ids[at_c], "distance": dist})
        parts.append(_best_of(got, k) if len(got) > 2 * k * len(qs) else got)
    return _best_of(pd.concat(parts, ignore_index=True), k)


class _Running:
    """The k nearest rows of some queries among the blocks met so far; queries are named by their place."""

    def __init__(self, q: np.ndarray, k: int) -> None:
        self.q, self.k = q, k
        self.worst = np.full(len(q), np.inf)  # of k rows that are known
        self.rows: pd.DataFrame | None = None
        self.more: list[pd.DataFrame] = []

    def meet(self, c_ids: np.ndarray, c: np.ndarray, asking: np.ndarray) -> None:
        self.more.append(_nearest(asking, self.q[asking], c_ids, c, self.k, self.worst[asking]))
        if sum(map(len, self.more)) > self.k * len(self.q) // 4:
            self._settle()

    def _settle(self) -> None:
        parts = [x for x in [self.rows, *self.more] if x is not None and len(x)]
        if parts:
            self.rows, self.more = _best_of(pd.concat(parts, ignore_index=True), self.k), []
            place = self.rows["query_id"].to_numpy()
            last = np.flatnonzero(np.diff(place, append=-1))
            full = last[np.diff(last, prepend=-1) == self.k]
            self.worst[place[full]] = self.rows["distance"].to_numpy()[full]

    def best(self, q_ids: np.ndarray) -> pd.DataFrame | None:
        self._settle()
        return None if self.rows is None else self.rows.assign(query_id=q_ids[self.rows["query_id"].to_numpy()])


def _out_schema(queries: DataFrame, corpus: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("doc_id", corpus.schema["doc_id"].dataType),
        T.StructField("distance", T.DoubleType()),
    ])


def _scan_join(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    rows = queries.toPandas()  # size checked by the caller
    shared = corpus.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy(), _matrix(rows["vec"])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q = shared.value
        running = _Running(q, k)
        for b in _slices(batches, BLOCK_ROWS):
            running.meet(b["doc_id"].to_numpy(), _matrix(b["vec"]), np.arange(len(q)))
        best = running.best(q_ids)
        if best is not None:
            yield best

    return corpus.mapInPandas(scan, _out_schema(queries, corpus))


def _pivot_gaps(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots; row by row the same whatever the batch, as cells depend on them."""
    out = np.empty((len(vectors), len(pivots)))
    step = max(1, _STEP_CELLS // pivots.size)
    for s in range(0, len(vectors), step):
        out[s : s + step] = np.sqrt(((vectors[s : s + step, None, :] - pivots[None]) ** 2).sum(axis=2))
    return out


def _cells_of(corpus: DataFrame, pivots: np.ndarray) -> DataFrame:
    schema = T.StructType([*corpus.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches, _SLICE_ROWS):
            gaps = _pivot_gaps(_matrix(b["vec"]), pivots)
            cell = gaps.argmin(axis=1)
            yield b.assign(cell=cell.astype("int32"), gap=gaps[np.arange(len(b)), cell])

    return corpus.mapInPandas(assign, schema)


def _blocks(rows: DataFrame, id_col: str, n_rows: int) -> DataFrame:
    """One row per block of rows of one cell: ids and vectors, and the cells that its queries `visit`, if there is such a column.

    Ranges of (cell, id) keep the cells of a partition together and split big ones, so partitions are even whatever the
    cells' sizes. The blocks are written, as each partition of one side meets each of the other.
    """
    spark = rows.sparkSession
    parts = max(-(-n_rows // PART_ROWS), math.isqrt(3 * spark.sparkContext.defaultParallelism))
    visiting = "visit" in rows.columns
    schema = T.StructType([
        T.StructField("cell", T.IntegerType()),
        T.StructField("ids", T.ArrayType(rows.schema[id_col].dataType)),
        T.StructField("vecs", rows.schema["vec"].dataType),
        *([T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("visits", T.ArrayType(T.IntegerType())),
           T.StructField("n_visits", T.ArrayType(T.IntegerType()))] if visiting else []),
    ])

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches, BLOCK_ROWS):
            cells = [(cell, part) for cell, part in b.groupby("cell")]
            block = {
                "cell": [cell for cell, _ in cells],
                "ids": [part[id_col].to_numpy() for _, part in cells],
                "vecs": [np.concatenate(list(part["vec"])) for _, part in cells],
            }
            if visiting:
                visits = [np.concatenate(list(part["visit"])) for _, part in cells]
                lengths = [part["visit"].map(len).to_numpy("int32") for _, part in cells]
                block |= {"cells": [np.unique(v) for v in visits], "visits": visits, "n_visits": lengths}
            yield pd.DataFrame(block)

    dealt = rows.repartitionByRange(parts, "cell", F.xxhash64(id_col)).sortWithinPartitions("cell")
    return cut_lineage(dealt.mapInPandas(packed, schema).withColumn("block", F.monotonically_increasing_id()))


def _meet(corpus: DataFrame, queries: DataFrame, n_corpus: int, n_queries: int, k: int) -> DataFrame:
    """Top k per query and partition of the corpus. Corpus rows carry their `cell`; queries the cells they `visit`, and a `cell` by
    which those with like visits are together.

    The blocks meet where they lie, partition by partition: no vector is shuffled or copied for the sake of a visit, so
    the disk needed grows with the rows, not with the visits.
    """
    schema = _out_schema(queries, corpus)
    have = _blocks(corpus, "doc_id", n_corpus).select("cell", F.col("ids").alias("c_ids"), F.col("vecs").alias("c_vecs"))
    asking = _blocks(queries, "query_id", n_queries).drop("cell")
    pairs = asking.join(have.hint("shuffle_replicate_nl"), F.array_contains("cells", F.col("cell"))).drop("cells")

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, ids, running = None, None, None
        for b in batches:
            for at in b.itertuples(index=False):
                if at.block != block:
                    if running is not None:
                        yield running.best(ids)
                    block, ids = at.block, np.asarray(at.ids)
                    running = _Running(np.asarray(at.vecs, dtype=np.float64).reshape(len(ids), -1), k)
                    visits, of = np.asarray(at.visits), np.repeat(np.arange(len(ids)), at.n_visits)
                c_ids = np.asarray(at.c_ids)
                running.meet(c_ids, np.asarray(at.c_vecs, dtype=np.float64).reshape(len(c_ids), -1), of[visits == at.cell])
        if running is not None:
            yield running.best(ids)

    return pairs.mapInPandas(nearest, schema)


def _pivot_join(corpus: DataFrame, queries: DataFrame, n_queries: int, k: int) -> DataFrame:
    chosen = corpus.orderBy(F.xxhash64("doc_id"), "doc_id").limit(PIVOTS).select("vec").toPandas()
    pivots = _matrix(chosen["vec"])
    placed = _cells_of(corpus, pivots)
    # At most one row per pivot.
    stats = placed.groupBy("cell").agg(F.min("gap").alias("lo"), F.max("gap").alias("hi"), F.count("*").alias("n")).toPandas()
    cells, lo, hi, n = (stats[c].to_numpy() for c in ("cell", "lo", "hi", "n"))
    schema = T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("visit", T.ArrayType(T.IntegerType()))])

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches, _SLICE_ROWS):
            gaps = _pivot_gaps(_matrix(b["vec"]), pivots)[:, cells]
            far = gaps + hi[None, :]
            order = far.argsort(axis=1, kind="stable")
            enough = n[order].cumsum(axis=1) >= k
            at = np.where(enough.any(axis=1), enough.argmax(axis=1), len(cells) - 1)
            bound = np.take_along_axis(far, order, axis=1)[np.arange(len(b)), at]
            bound = np.where(enough.any(axis=1), bound, np.inf)
            near = np.maximum(np.maximum(gaps - hi[None, :], lo[None, :] - gaps), 0.0)
            # The margin covers rounding of distances to DIST_DIGITS.
            open_cells = near <= bound[:, None] + 2e-6
            yield b.assign(cell=cells[gaps.argmin(axis=1)].astype("int32"), visit=[cells[row].astype("int32") for row in open_cells])

    return _meet(placed, queries.mapInPandas(candidates, schema), int(n.sum()), n_queries, k)


def _named(df: DataFrame, id_col: str, vec_col: str, name: str) -> DataFrame:
    return df.select(F.col(id_col).alias(name), F.col(vec_col).alias("vec")).filter(F.col("vec").isNotNull())


def knn_search(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 5,
    *,
    corpus_id: str = "chunk_id",
    query_id: str = "query_id",
    vec: str = "embedding",
    strategy: str = "auto",
) -> DataFrame:
    """(query_id, doc_id, distance, rank): exact k nearest by L2 distance, ties by id."""
    if strategy not in ("auto", "scan", "blocks"):
        raise ValueError(f"unknown strategy {strategy!r}")
    c, q = _named(corpus, corpus_id, vec, "doc_id"), _named(queries, query_id, vec, "query_id")
    size = q.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    small = size.n * max(size.d or 0, 2 * k) * 8 <= BROADCAST_BYTES
    if size.n == 0:
        found = c.sparkSession.createDataFrame([], _out_schema(q, c))
    elif strategy == "scan" or (strategy == "auto" and small):
        found = _scan_join(c, q, k)
    else:
        found = _pivot_join(c, q, size.n, k)
    return top_k(found, k, "distance", "doc_id", ascending=True)


def _flips(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Every way to change one or two of `bits` signs: as rows of 0 and 1, and as numbers."""
    masks = np.array([[int(j in (a, b)) for j in range(bits)] for a in range(bits) for b in range(a, bits)], np.float64)
    return masks, (masks @ (1 << np.arange(bits))).astype(np.int64)


def _codes(vectors: np.ndarray, planes: np.ndarray, tables: int, bits: int, probes: int) -> np.ndarray:
    """(row, table, 1 + probes) bucket numbers: the row's own bucket, then those behind the planes nearest to it."""
    gaps = (vectors @ planes.T).reshape(len(vectors), tables, bits)
    own = ((gaps > 0) * (1 << np.arange(bits))).sum(axis=2)[:, :, None]
    if not probes:
        return own
    masks, numbers = _flips(bits)
    nearest = np.argsort(gaps**2 @ masks.T, axis=2, kind="stable")[:, :, :probes]
    return np.concatenate([own, own ^ numbers[nearest]], axis=2)


def _planes(seed: int, tables: int, bits: int, dim: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables * bits, dim))


def _probes_needed(asked: np.ndarray, near: np.ndarray, planes: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Per pair of a query and its neighbour: the probes a table at least needs until one meets the neighbour (inf: never)."""
    out = []
    for s in range(0, len(asked), _QUERY_SLICE):
        met = _codes(asked[s : s + _QUERY_SLICE], planes, tables, bits, len(_flips(bits)[1])) == _codes(near[s : s + _QUERY_SLICE], planes, tables, bits, 0)
        out.append(np.where(met.any(axis=2), met.argmax(axis=2), np.inf).min(axis=1))
    return np.concatenate(out)


def _fitted(
    corpus: DataFrame, queries: DataFrame, n_corpus: int, k: int, dim: int, tables: int, bits: int | None, probes: int | None,
    seed: int, bucket_rows: int, least_recall: float,
) -> tuple[int, int] | None:
    """The cheapest bits and probes that find enough neighbours of FIT_QUERIES queries, chosen by a hash of the id; None where
    the exact search costs no more.

    The neighbours of these queries are found exactly, over the whole corpus. They must be met to the middle between
    `least_recall` and 1, so that all queries together stay above it.
    """
    chosen = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(FIT_QUERIES).toPandas()
    few = corpus.sparkSession.createDataFrame(chosen, queries.schema)
    pairs = cut_lineage(top_k(_scan_join(corpus, few, k), k, "distance", "doc_id", ascending=True))
    met = corpus.join(F.broadcast(pairs.select("query_id", "doc_id")), "doc_id").select("query_id", "vec").toPandas()  # FIT_QUERIES * k rows
    if not len(met):
        return None
    of = dict(zip(chosen["query_id"], chosen["vec"]))
    asked, near = _matrix(met["query_id"].map(of)), _matrix(met["vec"])
    share = (1 + least_recall) / 2
    most = max(1, min(20, (max(1, n_corpus) // bucket_rows).bit_length()))
    best, least = None, float(n_corpus + PIVOTS * PROBE_COST)
    for b in [bits] if bits is not None else range(most, 0, -1):
        needed = np.sort(_probes_needed(asked, near, _planes(seed, tables, b, dim), tables, b))
        p = needed[max(0, int(np.ceil(share * len(needed))) - 1)]
        if np.isinf(p) or (probes is not None and p > probes):
            continue
        p = int(p) if probes is None else probes
        cost = tables * (1 + p) * (n_corpus / 2**b + PROBE_COST)
        if cost < least:
            best, least = (b, p), cost
    return best


def knn_search_lsh(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 5,
    *,
    corpus_id: str = "chunk_id",
    query_id: str = "query_id",
    vec: str = "embedding",
    tables: int = 8,
    bits: int | None = None,
    seed: int = 7,
    bucket_rows: int = 128,
    probes: int | None = None,
    least_recall: float = 0.9,
) -> DataFrame:
    """Approximate neighbours: a query meets the rows of its random-projection bucket in each table and of `probes` buckets
    beside it, those behind the planes nearest to the query.

    Bits and probes that are not given are fitted: the neighbours of a bounded set of queries are found exactly, and the
    cheapest numbers that meet enough of them are taken (`_fitted`), at most as many bits as leave about `bucket_rows` rows
    in a bucket. Every row is in the tables. Where vectors are so alike or so scattered that this costs as much as
    the exact search, the exact search is made. Queries that meet fewer than k rows are searched exactly, so each gets k rows
    (all, if the corpus has fewer); `recall` measures what is found.
    """
    c, q = _named(corpus, corpus_id, vec, "doc_id"), _named(queries, query_id, vec, "query_id")
    head = q.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    if head.n == 0:
        return top_k(c.sparkSession.createDataFrame([], _out_schema(q, c)), k, "distance", "doc_id", ascending=True)
    n_corpus = c.count()
    if bits is None or probes is None:
        fitted = _fitted(c, q, n_corpus, k, head.d, tables, bits, probes, seed, bucket_rows, least_recall)
        if fitted is None:
            return knn_search(c, q, k, corpus_id="doc_id", query_id="query_id", vec="vec")
        bits, probes = fitted
    planes = _planes(seed, tables, bits, head.d)

    def buckets(df: DataFrame, table: int, visiting: bool) -> DataFrame:
        fields = [*df.schema.fields, T.StructField("cell", T.IntegerType())]
        if visiting:
            fields.append(T.StructField("visit", T.ArrayType(T.IntegerType())))

        def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in _slices(batches, _SLICE_ROWS):
                codes = _codes(_matrix(part["vec"]), planes[table * bits : (table + 1) * bits], 1, bits, probes if visiting else 0)[:, 0].astype("int32")
                part = part.assign(cell=codes[:, 0])
                yield part.assign(visit=list(codes)) if visiting else part

        return df.mapInPandas(hashed, T.StructType(fields))

    # One table at a time: only its copy of the rows is on disk, and k rows per query of those before.
    met = [
        cut_lineage(top_k(_meet(buckets(c, t, False), buckets(q, t, True), n_corpus, head.n, k), k, "distance", "doc_id", ascending=True))
        for t in range(tables)
    ]
    both = reduce(DataFrame.unionByName, met).groupBy("query_id", "doc_id").agg(F.min("distance").alias("distance"))
    found = cut_lineage(top_k(both, k, "distance", "doc_id", ascending=True))
    full = found.groupBy("query_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min(k, n_corpus)).select("query_id")
    rest = cut_lineage(q.join(full, "query_id", "left_anti"))
    if not rest.limit(1).count():
        return found
    exact = knn_search(c, rest, k, corpus_id="doc_id", query_id="query_id", vec="vec")
    return found.join(full, "query_id", "left_semi").unionByName(exact.select(*found.columns))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: share of the exact neighbours that were found."""
    hits = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id").withColumn("_hit", F.lit(1)),
                                                   ["query_id", "doc_id"], "left")
    return hits.agg(F.count("*").alias("n_exact"), F.count("_hit").alias("n_found"),
                    F.round(F.count("_hit") / F.count("*"), 6).alias("recall"))


def vector_score(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)
