"""Vectors for texts: hashed word counts by default, any model through a factory."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verispark.functions.text import tokenize_pl

BATCH = 64

# A factory runs once per Python worker and returns texts -> matrix.
Factory = Callable[[], Callable[[np.ndarray], np.ndarray]]


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    wide = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    # The norm is put into a struct once per element list, not once per element.
    pair = F.transform(F.array(F.struct(wide.alias("w"), norm.alias("n"))), lambda p: F.transform(
        p["w"], lambda x: F.when(p["n"] > 0, x / p["n"]).otherwise(x)))
    return F.element_at(pair, 1)


def embed_chunks(
    df: DataFrame,
    text_col: str = "text",
    out_col: str = "embedding",
    dim: int = 64,
    factory: Factory | None = None,
    batch_size: int = BATCH,
    normalize: bool = True,
) -> DataFrame:
    """Add a vector column.

    Without a factory the vector counts hashed index terms and nothing leaves the JVM. With one,
    texts go to Python in Arrow batches and the model is made once per worker.
    """
    if factory is None:
        words = df.withColumn("_words", tokenize_pl(F.col(text_col)))
        raw = HashingTF(numFeatures=dim, inputCol="_words", outputCol="_vec").transform(words)
        vec = raw.withColumn(out_col, vector_to_array("_vec", "float64")).drop("_words", "_vec")
    else:
        predict = predict_batch_udf(factory, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
        vec = df.withColumn(out_col, predict(F.col(text_col)))
    if normalize:
        # The generator keeps the model's output from being computed twice.
        vec = vec.withColumn(out_col, F.explode(F.array(F.col(out_col)))).withColumn(out_col, l2_normalize(F.col(out_col)))
    return vec.withColumn(out_col, F.col(out_col).cast("array<float>"))


def embed_distinct(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Embed each distinct text once and give the vector to every row that has the text."""
    out = options.get("out_col", "embedding")
    keyed = df.withColumn("_text", F.sha2(text_col, 256))
    # One row per text is kept before the shuffle; only digest and vector meet the rows again, so no text is moved twice.
    first = keyed.filter(F.col(text_col).isNotNull()).groupBy("_text").agg(F.any_value(text_col).alias(text_col))
    once = embed_chunks(first, text_col, **options).select("_text", out)
    return keyed.join(once, "_text", "left").drop("_text")


