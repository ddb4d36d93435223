"""Embedding whitening from a bit-sliced scatter matrix.

Components become integers x = floor(scale * c) + offset. Each dimension is shifted by its smallest value, and bit p of all
shifted values of a block of rows is packed into 64-bit words: a bit plane. The sum of products of two dimensions is the
sum over pairs of their planes of 2^(p + q) times the number of common bits, so it is counted with AND and popcount,
without rounding. Spark adds the tasks' sums as limbs of 40 bits; the driver sees only one number per pair of dimensions,
centres as integers (n times the sum of products, less the product of the sums) and takes eigenvectors of that.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verispark.llm.tables import store

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
BLOCK = 4096  # rows of one set of bit planes
LIMB = 40  # bits; sums of 2^23 tasks fit
LIMBS = 4
_LARGEST = float(1 << 52)  # of |scale * c|: beyond, a long would not hold what is derived from x


def integers(vectors: pa.Array, dims: int) -> np.ndarray:
    """The x of each row."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat.reshape(len(vectors), dims) * SCALE).astype(np.int64) + OFFSET


def bit_planes(shifted: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(planes, words): for each dimension its `bits` planes, lowest first; bit r of a plane is row r's."""
    rows = -(-len(shifted) // 64) * 64
    out = np.empty((int(bits.sum()), rows // 64), np.uint64)
    at = 0
    for d, n in enumerate(bits):
        column = np.zeros(rows, np.int64)
        column[: len(shifted)] = shifted[:, d]
        for p in range(n):
            out[at] = np.packbits(((column >> p) & 1).astype(np.uint8), bitorder="little").view(np.uint64)
            at += 1
    return out


def common_bits(planes: np.ndarray) -> np.ndarray:
    """Number of common bits of each pair of planes (upper triangle)."""
    out = np.zeros((len(planes), len(planes)), np.int64)
    for p in range(len(planes)):
        out[p, p:] = np.bitwise_count(planes[p:] & planes[p]).sum(axis=1, dtype=np.int64)
    return out


def weighted(common: np.ndarray, bits: np.ndarray) -> list[tuple[int, int, int]]:
    """(i, j, sum of products) for i <= j from the counts of common bits."""
    first = np.concatenate([[0], np.cumsum(bits)])
    whole = np.triu(common) + np.triu(common, 1).T
    wide = 2 * int(bits.max(initial=0)) + int(whole.max(initial=0)).bit_length() + 12 > 63
    weight = [np.array([1 << p for p in range(n)], object if wide else np.int64) for n in bits]
    out = []
    for i in range(len(bits)):
        half = weight[i] @ whole[first[i] : first[i + 1], :] if bits[i] else np.zeros(whole.shape[1], np.int64)
        out += [(i, j, int(half[first[j] : first[j + 1]] @ weight[j]) if bits[i] and bits[j] else 0) for j in range(i, len(bits))]
    return out


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > F.lit(_LARGEST / SCALE)))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).filter(F.col("vec").isNotNull() & (F.size("vec") > 0) & ~bad)


def ranges(rows: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, and the smallest and largest x of each dimension."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, lo, hi = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = integers(batch.column(0), dims)
                n += len(x)
                lo = x.min(axis=0) if lo is None else np.minimum(lo, x.min(axis=0))
                hi = x.max(axis=0) if hi is None else np.maximum(hi, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, n)), pa.array(lo), pa.array(hi)], ["d", "n", "lo", "hi"])

    got = rows.select("vec").mapInArrow(scan, "d long, n long, lo long, hi long").groupBy("d").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = sorted(got.collect())  # one row per dimension
    return found[0]["n"], np.array([r["lo"] for r in found]), np.array([r["hi"] for r in found])


def scatter(rows: DataFrame, lo: np.ndarray, hi: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Sums of y = x - lo per dimension, and sums of products per pair, as Python integers.

    A plane of ones stands for the number 1, so the products with it are the sums themselves.
    """
    dims = len(lo)
    bits = np.array([*[int(h - v).bit_length() for v, h in zip(lo, hi)], 1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((int(bits.sum()), int(bits.sum())), np.int64)
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                x = integers(batch.column(0).slice(s, BLOCK), dims) - lo
                total += common_bits(bit_planes(np.hstack([x, np.ones((len(x), 1), np.int64)]), bits))
        sums = weighted(total, bits)
        limbs = [[v >> (LIMB * k) & ((1 << LIMB) - 1) for _, _, v in sums] for k in range(LIMBS)]
        yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in sums]), pa.array([s[1] for s in sums]), *[pa.array(x, pa.int64()) for x in limbs]], ["i", "j", *[f"l{k}" for k in range(LIMBS)]])

    sent = rows.select("vec").mapInArrow(count, "i long, j long, " + ", ".join(f"l{k} long" for k in range(LIMBS)))
    found = sent.groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]).collect()  # one row per pair of dimensions
    value = {(r["i"], r["j"]): sum(r[f"l{k}"] << (LIMB * k) for k in range(LIMBS)) for r in found}
    return [value[i, dims] for i in range(dims)], [[value[min(i, j), max(i, j)] for j in range(dims)] for i in range(dims)]


def components(n: int, sums: list[int], products: list[list[int]], wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Largest eigenvalues with their unit eigenvectors (columns), and the trace. Directions without variance are left out."""
    dims = len(sums)
    cov = np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
    real = values > max(values[0], 0.0) * dims * 1e-14
    return values[real], vectors[:, real], sum((n * products[i][i] - sums[i] ** 2) / (n * n) for i in range(dims))


def whiten(df: DataFrame, wanted: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_wide; one row per vector and component.

    Left out: vectors that are null or empty or hold null or non-finite entries, or entries of more than 2^42 (1024 times that
    is past what stays exact), and vectors of another length than the most frequent one (ties: the longer). Directions
    without variance have no component, so equal vectors, a single vector and an empty table give no rows. `deviation` is
    null where it passes 64 bits; `deviation_wide` holds it as a decimal. Rows with a null or repeated id keep their rows.
    Of equal eigenvalues any basis may come, the same for all rows. Other columns are ignored.
    """
    spark = df.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_wide decimal(38,0)"
    usable = _usable(df, id_col, vec_col)
    common = usable.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dims = common["dims"]
    rows = usable.filter(F.size("vec") == dims)
    n, lo, hi = ranges(rows, dims)
    sums, products = scatter(rows, lo, hi)
    values, vectors, trace = components(n, sums, products, wanted)
    if len(values) == 0:
        return spark.createDataFrame([], schema)
    # n x - S of a dimension is n y - (sum of y): both shifts are the same.
    narrow = dims * (n * int((hi - lo).max())) ** 2 < 1 << 63
    totals = np.array(sums, np.int64 if narrow else object)
    whitener = vectors / np.sqrt(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = integers(batch.column(1), dims) - lo
            off = n * (y if narrow else y.astype(object)) - totals
            square = (off * off).sum(axis=1) if len(off) else np.zeros(0, np.int64)
            white = (off.astype(np.float64) / n) @ whitener
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
            wide = [Decimal(int(v)) if abs(int(v)) < 10**38 else None for v in square]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(wide, pa.decimal128(38, 0)), flat], ["vec_id", "wide", "white"])

    placed = store(rows.mapInArrow(project, "vec_id long, wide decimal(38,0), white array<double>"), "whitened")
    k = len(values)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = placed.agg(*[F.covar_pop(F.col("white")[i], F.col("white")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    shares = F.array(*[F.lit(float(v / trace)) for v in values])
    fits = F.col("wide") <= F.lit(Decimal((1 << 63) - 1)).cast("decimal(38,0)")
    return placed.select("vec_id", "wide", F.posexplode("white").alias("pos", "whitened")).select(
        "vec_id", (F.col("pos") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), F.when(fits, F.col("wide")).cast("long").alias("deviation"),
        "whitened", F.get(shares, F.col("pos")).alias("explained"), F.lit(float(error)).alias("identity_error"), F.col("wide").alias("deviation_wide"))
