"""Near duplicates of embeddings by spherical k-means cells.

1. Equal vectors of a label become one node, so copies never meet each other.
2. Spherical k-means, fitted on a bounded sample of each large label, gives unit centroids; every node belongs to the cell
   of its nearest one. A pair at cosine t is sqrt(2 - 2 t) apart, so a partner of v can be at home only in cells A with
   v (h - A) <= sqrt(2 - 2 t) |h - A|, h being v's own centroid: v also visits those cells. No link is lost whatever the
   centroids are; they only decide how few cells a vector visits.
3. In each cell the members are compared with members and visitors, block by block: cosine products of two blocks of
   bounded size in one task. Back come the number of links of each member and one edge per node to its block's class.
4. Connected components of the edges are the groups; the vector with a group's smallest id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verispark.llm.components import connected
from verispark.llm.tables import store

COSINE = 0.98
CELL_ROWS = 1024  # nodes of a cell on average
MAX_CELLS = 1024  # of all labels together; larger cells are cut into more blocks
SAMPLE_PER_CELL = 32  # rows the centroids are fitted on, per cell
BLOCK = 1024
ROUNDS = 10
_SLACK = 1e-9
_SLICE = 256


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Rows of length 1 from vectors of one length, none of them zero."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small entries would leave the range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most k unit centroids of unit rows: first the row least like those chosen, again and again, then means."""
    chosen, best = [0], x @ x[0]
    while len(chosen) < min(k, len(x)):
        far = int(best.argmin())
        if best[far] > 1 - 1e-12:
            break
        chosen.append(far)
        best = np.maximum(best, x @ x[far])
    centres = x[chosen]
    for _ in range(rounds):
        cell = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def _cells(nodes: DataFrame, cell_rows: int) -> dict[tuple[object, int], np.ndarray]:
    """Centroids of the labels with several cells; labels whose share is under two of MAX_CELLS have one cell."""
    n = nodes.count()
    least = max(cell_rows, 2 * n // MAX_CELLS)
    # At most MAX_CELLS / 2 rows.
    big = nodes.groupBy("label", "dims").agg(F.count("*").alias("rows")).filter(F.col("rows") > least)
    cells = F.ceil(F.col("rows") / F.lit(least)).cast("int")
    big = store(big.withColumn("cells", cells), "large-labels")
    share = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("rows") < F.lit(2 * SAMPLE_PER_CELL) * F.col("cells")
    order = W.partitionBy("label", "dims").orderBy(F.xxhash64("node"), "node")
    sample = nodes.join(F.broadcast(big), ["label", "dims"]).filter(share)
    sample = sample.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= SAMPLE_PER_CELL * F.col("cells")).select("label", "dims", "cells", "r", "vec")

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by("r").combine_chunks()
        found = spherical_kmeans(unit_rows(group["vec"].combine_chunks()), group["cells"][0].as_py())
        return pa.table({"label": group["label"].slice(0, 1), "dims": group["dims"].slice(0, 1), "centres": pa.array([found.astype(np.float64).tobytes()], pa.binary())})

    schema = f"label {nodes.schema['label'].dataType.simpleString()}, dims int, centres binary"
    got = sample.groupBy("label", "dims").applyInArrow(fit, schema).collect()  # at most MAX_CELLS centroids
    return {(r["label"], r["dims"]): np.frombuffer(r["centres"], np.float64).reshape(-1, r["dims"]) for r in got}


def placements(u: np.ndarray, centres: np.ndarray, apart: np.ndarray, cosine: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Home cell of each row, and the cells it is a member or a visitor of; `apart` holds the centroids' distances."""
    homes, visits = [], []
    step = max(1, (1 << 21) // len(centres))
    for s in range(0, len(u), step):
        near = u[s : s + step] @ centres.T
        home = near.argmax(axis=1)
        lead = near[np.arange(len(near)), home][:, None] - near
        open_ = lead <= np.sqrt(2 - 2 * cosine) * apart[home] + _SLACK
        homes.append(home)
        visits += [np.flatnonzero(row) for row in open_]
    return np.concatenate(homes), visits


def block_classes(members: np.ndarray, others: np.ndarray, own: np.ndarray, theirs: np.ndarray, copies: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member (copies of the others counted), and the smallest node each of members and others reaches.

    `own` and `theirs` are node numbers; a node does not link with itself.
    """
    nodes = np.concatenate([own, theirs])
    names, place = np.unique(nodes, return_inverse=True)
    comp = np.arange(len(names))
    links = np.zeros(len(own), np.int64)
    columns = place[len(own) :]
    for s in range(0, len(own), _SLICE):
        rows = place[s : min(s + _SLICE, len(own))]
        link = (members[s : s + _SLICE] @ others.T >= cosine) & (rows[:, None] != columns[None, :])
        links[s : s + _SLICE] = link @ copies
        at, to = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
        if len(at) == 0:
            continue
        link, rows, cols = link[np.ix_(at, to)], rows[at], columns[to]
        while True:
            low = np.minimum(comp[rows], np.where(link, comp[cols][None, :], len(names)).min(axis=1))
            back = np.minimum(comp[cols], np.where(link, low[:, None], len(names)).min(axis=0))
            jump = np.arange(len(names))
            np.minimum.at(jump, comp[rows], low)
            np.minimum.at(jump, comp[cols], back)
            if (jump[comp] == comp).all():
                break
            comp = jump[comp]
    return links, names[comp[place]]


def _compared(placed: DataFrame, vectors: DataFrame, cosine: float, block: int) -> DataFrame:
    """node, links, root: one row per member and tile with its links, one per visitor with links."""
    key = ["label", "dims", "cell"]
    sizes = placed.groupBy(*key).agg(F.ceil(F.sum(F.col("member").cast("int")) / block).cast("int").alias("a_blocks"), F.ceil(F.count("*") / block).cast("int").alias("b_blocks"))
    sizes = store(sizes.filter("a_blocks > 0"), "cell-sizes")
    slim = placed.join(sizes, key)

    def spread(n: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def number(n: str) -> F.Column:
        return F.pmod(F.xxhash64("node", F.lit(3)), n).cast("int")

    a = slim.filter("member").select("node", *key, F.lit(True).alias("asks"), number("a_blocks").alias("a_no"), spread("b_blocks").alias("b_no"))
    b = slim.select("node", *key, F.lit(False).alias("asks"), number("b_blocks").alias("b_no"), spread("a_blocks").alias("a_no"))
    tiles = a.unionByName(b).join(vectors, "node")

    def meet(tile: pa.Table) -> pa.Table:
        asks = tile["asks"].to_numpy().astype(bool)
        if asks.all() or not asks.any():
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        u = unit_rows(tile["vec"].combine_chunks())
        node, copies = tile["node"].to_numpy(), tile["copies"].to_numpy()
        links, root = block_classes(u[asks], u[~asks], node[asks], node[~asks], copies[~asks], cosine)
        names, counts = np.concatenate([node[asks], node[~asks]]), np.concatenate([links, np.zeros((~asks).sum(), np.int64)])
        told = (counts > 0) | (root != names)
        return pa.table({"node": names[told], "links": counts[told], "root": root[told]})

    return tiles.groupBy(*key, "a_no", "b_no").applyInArrow(meet, "node long, links long, root long")


def near_duplicate_vectors(
    df: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; no pair at or over `cosine` is missed.

    Vectors meet only within one label and one length. A vector that is null, empty or zero or holds null or non-finite
    entries, a null label and a null id link with nothing; the row with a null id is kept with a null component. Rows with
    one id are one node of the groups, and each counts its own links (copies of it under the same id included). An empty
    table gives no rows; other columns are ignored.
    """
    vec = F.col(vec_col).cast("array<double>")
    sound = vec.isNotNull() & ~F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))) & F.exists(vec, lambda c: c != 0)
    takes_part = F.coalesce(sound & F.col(label_col).isNotNull() & F.col(id_col).isNotNull(), F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vec.alias("vec"), takes_part.alias("part"))
    # Adding 0.0 makes the two zeros one; digests of the array in both directions tell vectors apart.
    digest = F.transform("vec", lambda c: c + F.lit(0.0))
    marked = rows.withColumn("d1", F.xxhash64(digest)).withColumn("d2", F.xxhash64(F.lit(5), F.reverse(digest)))
    same = marked.filter("part").groupBy("label", "d1", "d2").agg(F.min(F.struct("vec_id", "vec")).alias("one"), F.count("*").alias("copies"))
    nodes = same.select(F.monotonically_increasing_id().alias("node"), "label", "d1", "d2", F.col("one.vec_id").alias("rep"), "copies", F.size("one.vec").alias("dims"), F.col("one.vec").alias("vec"))
    nodes = store(nodes, "nodes")
    centres = df.sparkSession.sparkContext.broadcast(_cells(nodes, cell_rows))  # at most MAX_CELLS centroids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = {key: np.sqrt(np.maximum(2 - 2 * c @ c.T, 0)) for key, c in centres.value.items()}
        for batch in batches:
            labels, dims = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            cells: list[list[int]] = [[0]] * len(labels)
            home = np.zeros(len(labels), np.int64)
            groups: dict[tuple[object, int], list[int]] = {}
            for i, key in enumerate(zip(labels, dims)):
                if key in centres.value:
                    groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                homes, visits = placements(unit_rows(batch.column(3).take(pa.array(at))), centres.value[key], apart[key], cosine)
                home[at] = homes
                for i, mine in zip(at, visits):
                    cells[i] = mine
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(home.astype(np.int32)), pa.array(cells, pa.list_(pa.int32()))], ["node", "label", "dims", "home", "cells"])

    kind = nodes.schema["label"].dataType.simpleString()
    placed = nodes.select("node", "label", "dims", "vec").mapInArrow(place, f"node long, label {kind}, dims int, home int, cells array<int>")
    placed = store(placed.select("node", "label", "dims", "home", F.explode("cells").alias("cell")).select("node", "label", "dims", "cell", (F.col("home") == F.col("cell")).alias("member")), "cells")
    met = store(_compared(placed, nodes.select("node", "copies", "vec"), cosine, block), "met")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    edges = met.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    # Rows with one id hang together.
    slim = nodes.select("node", "label", "d1", "d2", "rep", "copies")
    known = store(marked.filter("part").select("vec_id", "label", "d1", "d2").join(slim, ["label", "d1", "d2"]).select("vec_id", "node", "rep", "copies"), "known")
    twice = known.groupBy("vec_id").agg(F.min("node").alias("b"), F.max("node").alias("z")).filter("b <> z")
    edges = edges.unionByName(known.join(twice.select("vec_id", "b"), "vec_id").select(F.col("node").alias("a"), "b").filter("a <> b"))
    classes = connected(edges)
    least = classes.join(nodes.select(F.col("node").alias("doc"), "rep"), "doc").groupBy("comp").agg(F.min("rep").alias("least"))
    of_node = classes.join(least, "comp").select(F.col("doc").alias("node"), "least")
    linked = known.join(links, "node", "left").join(of_node, "node", "left").select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    alone = rows.filter(~F.col("part")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
