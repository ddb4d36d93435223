"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verispark.llm.tables import store


def connected(edges: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(doc, comp): the smallest node each node of `edges` (a, b) can reach.

    With `classes`, an earlier result, it is the result for the edges of that call and these together: its classes
    are single nodes then, so edges inside of them cost no round. Each round takes the smallest label among neighbours and
    then the label of that label, so long chains shrink to a logarithm of their length. Labels are written to the shared
    folder after each round.
    """
    if classes is not None:
        for side in ("a", "b"):
            at = classes.select(F.col("doc").alias(side), F.col("comp").alias("_comp"))
            edges = edges.select("a", "b").join(at, side, "left").withColumn(side, F.coalesce("_comp", side))
    # Turned round row by row: a union with itself would put the edges' plan twice into one query.
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    both = store(edges.select(ways).select("e.a", "e.b").filter("a <> b").distinct(), "edges")
    if classes is not None and not both.limit(1).count():
        return classes
    labels = store(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "doc"), "labels")
    while True:
        near = both.join(labels.select(F.col("doc").alias("b"), F.col("comp").alias("_c")), "b").groupBy("a").agg(F.min("_c").alias("_near"))
        met = labels.join(near, labels["doc"] == near["a"]).select("doc", F.col("comp").alias("_old"), F.least("comp", "_near").alias("_step"))
        jump = labels.select(F.col("doc").alias("_step"), F.col("comp").alias("_jump"))
        new = store(met.join(jump, "_step").select("doc", "_old", F.least("_step", "_jump").alias("comp")), "labels")
        changed = new.filter("comp <> _old").limit(1).count()
        labels = new.select("doc", "comp")
        if not changed:
            break
    if classes is None:
        return labels
    moved = classes.join(labels.select(F.col("doc").alias("comp"), F.col("comp").alias("_comp")), "comp", "left")
    added = labels.join(classes.select("doc"), "doc", "left_anti")
    return store(moved.select("doc", F.coalesce("_comp", "comp").alias("comp")).unionByName(added), "labels")
