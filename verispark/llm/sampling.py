"""Bounded training samples, chosen by a hash of the row's id so that every run takes the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_STEPS = 1_000_000


def class_sample(rows: DataFrame, id_col: str, class_col: str, per_class: int) -> DataFrame:
    """About `per_class` rows of each class, never over twice as many of one; the bound grows with the classes.

    The class counts cover all rows; a row stays if the hash of its id falls below its class's share, in the order of
    that hash where more than twice `per_class` do. Rows of a null class are left out.
    """
    known = rows.filter(F.col(class_col).isNotNull())
    shares = known.groupBy(F.col(class_col).alias("_class")).agg(F.least(F.lit(_STEPS), F.ceil(F.lit(_STEPS * per_class) / F.count("*"))).alias("_share"))
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(_STEPS))
    # One row per class; the sample itself, which the caller holds whole, has many for each.
    near = known.withColumn("_place", place).join(F.broadcast(shares), F.col(class_col) == F.col("_class")).filter("_place < _share")
    order = Window.partitionBy("_class").orderBy("_place", F.xxhash64(*rows.columns))
    return near.withColumn("_no", F.row_number().over(order)).filter(F.col("_no") <= 2 * per_class).select(*rows.columns)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus
