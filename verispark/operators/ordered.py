"""Order-dependent work that stays spread over the cluster.

A window over one big key puts that key into one task. Here rows are range-partitioned on
(keys, order), numbered inside each partition, and the partition totals - one row per partition
and key - give the offsets. A key that holds a third of all rows is spread over many partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from verispark.session import cut_lineage

BITMAP_BITS = 1 << 23  # of the id bitmap: at most BITMAP_BITS / 64 rows are sent to every executor
BROADCAST_ROWS = 1_000_000  # rows of a checked table sent to every executor at most
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def range_sorted(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Rows with `_bucket` (range partition) and `_local` (0-based place in it).

    The number of partitions follows the data (adaptive execution joins small neighbours). The
    checkpoint fixes the bounds: both later uses see the same buckets.
    """
    mid = F.monotonically_increasing_id()
    tagged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", mid)
        .withColumn("_bucket", F.shiftright("_mid", _LOCAL_BITS))
        .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("_mid")
    )
    return cut_lineage(tagged)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key. Spark cuts to one row per key before the shuffle, so a hot key is small."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a table of one row per key that is usually short.

    It is written and counted first. A short one is sent to every task, so a key with very many
    rows stays spread over its tasks; a long one is joined by shuffle with skew splitting.
    """
    small = cut_lineage(small)
    if small.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, list(on), how)


def with_ordinal(df: DataFrame, order: Sequence[Column | str], name: str = "ordinal", start: int = 0) -> DataFrame:
    """Consecutive numbers over the whole table in `order`."""
    placed = range_sorted(df, order)
    totals = placed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    # One row per partition: small enough for one task whatever the table size.
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        placed.join(offsets, "_bucket")
        .withColumn(name, (F.col("_off") + F.col("_local") + start).cast("bigint"))
        .drop("_bucket", "_local", "_off")
    )


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column], pos: str = "pos"
) -> DataFrame:
    """Position (1-based) and running sums per key, in `order`."""
    lead = [F.col(k) for k in keys]
    work = df
    for name, expr in sums.items():
        work = work.withColumn(name, expr)
    placed = range_sorted(work, [*lead, *order])
    totals = placed.groupBy("_bucket", *keys).agg(
        F.count("*").alias("_n"), *[F.sum(s).alias(f"_t_{s}") for s in sums]
    )
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "_bucket",
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
    )
    inside = W.partitionBy("_bucket", *keys).orderBy("_local")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    out = placed.withColumn(pos, F.row_number().over(inside))
    for s in sums:
        out = out.withColumn(s, F.sum(s).over(upto))
    out = out.join(offsets, ["_bucket", *keys])
    out = out.withColumn(pos, (F.col(pos) + F.col("_off")).cast("bigint"))
    for s in sums:
        out = out.withColumn(s, F.col(s) + F.col(f"_o_{s}"))
    return out.drop("_bucket", "_local", "_off", *[f"_o_{s}" for s in sums])


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: Sequence[str]) -> DataFrame:
    """Add `prev`: a struct of `columns` of the row before, NULL on the first row of a key."""
    placed = range_sorted(df, [*keys, *order])
    row = F.struct(*columns)
    last = placed.groupBy("_bucket", *keys).agg(F.max_by(row, "_local").alias("_last"))
    before = last.select("_bucket", *keys, F.lag("_last").over(W.partitionBy(*keys).orderBy("_bucket")).alias("_carry"))
    inside = W.partitionBy("_bucket", *keys).orderBy("_local")
    out = placed.withColumn("prev", F.lag(row).over(inside)).join(before, ["_bucket", *keys])
    return out.withColumn("prev", F.coalesce("prev", "_carry")).drop("_bucket", "_local", "_carry")


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    before: int,
    after: int,
    aggs: dict[str, Column],
    block: int = 20_000,
) -> DataFrame:
    """Aggregates over rows pos-before .. pos+after per key."""
    spread = _blocks(df, keys, order, before, after, block)
    frame = W.partitionBy(*keys, "_block").orderBy("pos").rowsBetween(-before, after)
    out = spread
    for name, agg in aggs.items():
        out = out.withColumn(name, agg.over(frame))
    return out.filter("_block = _home").drop("_home", "_block")


def _blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], before: int, after: int, block: int
) -> DataFrame:
    """Rows by blocks of consecutive positions per key.

    Rows near an edge are copied to the neighbour, so a frame never needs a row of another block.
    """
    placed = running_sums(df, keys, order, {})
    lo = F.floor((F.col("pos") - 1 - after) / block)
    hi = F.floor((F.col("pos") - 1 + before) / block)
    return placed.withColumn("_home", F.floor((F.col("pos") - 1) / block)).withColumn(
        "_block", F.explode(F.sequence(lo, hi)))


def rolling_median(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, window: int, least: int, name: str,
    block: int = 20_000,
) -> DataFrame:
    """Median over a centred frame of `window` rows per key; NULL below `least` values.

    A frame aggregate would sort each frame anew; pandas moves one sorted frame along the block.
    """
    half = window // 2
    spread = _blocks(df, keys, order, half, window - half - 1, block)
    schema = T.StructType([f for f in spread.schema.fields if f.name not in ("_home", "_block")])
    schema = schema.add(name, T.DoubleType())
    columns = schema.fieldNames()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        rows[name] = rows[value].astype("float64").rolling(window, center=True, min_periods=least).median()
        # A float column would show a missing median as NaN.
        rows[name] = rows[name].astype(object).where(rows[name].notna(), None)
        return rows.loc[rows["_block"] == rows["_home"], columns]

    return spread.groupBy(*keys, "_block").applyInPandas(run, schema)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation per key, one column per name in `ps`.

    Equal values are counted before the shuffle; the running count then tells which value
    holds a rank, without bringing a key into one task.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranked = running_sums(counted, keys, [F.col(value)], {"_upto": F.col("_c")}, pos="_p")
    sizes = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    joined = join_small(ranked, sizes, keys) if keys else ranked.crossJoin(sizes)  # one row of sizes
    picks = []
    for i, p in enumerate(ps.values()):
        at = (F.col("_n") - 1) * F.lit(float(p))
        for tag, rank in (("l", F.floor(at)), ("h", F.ceil(at))):
            # rank is 0-based: the value covers ranks [_upto - _c, _upto - 1]
            holds = (rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto"))
            picks.append(F.max(F.when(holds, F.col(value))).alias(f"_{tag}{i}"))
    got = joined.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    outs = []
    for i, (name, p) in enumerate(ps.items()):
        at = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.col(f"_l{i}").cast("double"), F.col(f"_h{i}").cast("double")
        outs.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return got.select(*keys, *outs)


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id is not in `ids` (its first column); all columns stay. Null ids stay.

    A bitmap of fixed size (at most BITMAP_BITS / 64 rows, so its broadcast has a proven bound) clears most rows at once
    where they are; only rows whose bit is set are moved to the exact join.
    """
    named = ids.select(F.col(ids.columns[0]).alias("_id")).filter("_id IS NOT NULL").distinct()

    def slot(name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(BITMAP_BITS))

    def bit(name: str) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), slot(name).bitwiseAND(F.lit(63)).cast("int"))

    words = named.groupBy(F.shiftright(slot("_id"), 6).alias("_word")).agg(F.bit_or(bit("_id")).alias("_bits"))
    marked = docs.withColumn("_word", F.shiftright(slot(id_col), 6)).join(F.broadcast(words), "_word", "left")
    hit = F.coalesce(F.col(id_col).isNotNull() & (F.col("_bits").bitwiseAND(bit(id_col)) != 0), F.lit(False))
    sure = marked.filter(~hit).select(*docs.columns)
    asked = marked.filter(hit).select(*docs.columns)
    left = asked.join(named, F.col(id_col) == F.col("_id"), "left_anti")
    return sure.unionByName(left)
