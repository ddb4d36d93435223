"""Exact top-k inner product search with a dual-tree walk over cover trees.

Queries and data share the top of one cover tree: a bounded sample of rows gives its points, every row of both kinds
belongs to the nearest one (its cell), and each node keeps the covering radius of all rows below it. Cells are split
into chunks of bounded size. For a query group with centre c and radius r and a data node with centre d and radius s no
inner product is above <c, d> + r|d| + s|c| + rs. Each group first gets k scores from the chunks nearest to it; then it
walks down the shared tree and leaves out nodes whose bound is below the worst k-th score of its queries. The chunks
that are left meet the groups in tasks, where both sides get cover trees of their own and are walked in pairs in the
same way. All scores are integers; bounds only leave out what cannot be among the first k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verispark.llm.tables import store

PIVOTS = 64  # rows sampled for the top of the tree
CHUNK = 8192  # data rows of a chunk
GROUP = 256  # queries of a group
GROUPS_PER_TASK = 16
LEAF = 128
FIRST_ROWS = 512  # data rows that some queries meet before the other leaves are judged again
FANOUT = 16
SCALE = 256
_LOW = np.iinfo(np.int64).min


def to_integers(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part, and their floor(SCALE * x) as rows; shorter ones are filled with 0."""
    usable = np.array([v is not None and len(v) > 0 for v in vectors], bool)
    lengths = np.array([len(v) for v in vectors[usable]], np.int64)
    out = np.zeros((len(lengths), lengths.max(initial=0)))
    for n in np.unique(lengths):
        out[lengths == n, :n] = np.concatenate([np.asarray(v, dtype=np.float64) for v in vectors[usable][lengths == n]]).reshape(-1, n)
    good = np.isfinite(out).all(axis=1)
    usable[np.flatnonzero(usable)[~good]] = False
    out = np.floor(SCALE * out[good, : lengths[good].max(initial=0)])
    if len(out) and np.abs(out).max() >= 2.0**62:
        raise OverflowError("a scaled component does not fit a long")
    return usable, out.astype(np.int64)


def unpack(packed: pd.Series, width: int) -> np.ndarray:
    lengths = packed.map(len).to_numpy() // 8
    out = np.zeros((len(packed), width), np.int64)
    for n in np.unique(lengths):
        out[lengths == n, :n] = np.frombuffer(b"".join(packed[lengths == n]), np.int64).reshape(-1, n)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows; raises where one might not fit a long."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2.0**63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if max(abs(int(v)) for v in exact.ravel()) >= 1 << 63:
        raise OverflowError("a score does not fit a long")
    return exact.astype(np.int64)


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    rows: np.ndarray
    children: list["Node"] = field(default_factory=list)


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """Cover tree over rows of `points`: each child's centre is a row, far from its siblings' centres.

    Centres are picked farthest first until half the covering radius is reached or FANOUT children are there; every
    row goes to its nearest centre, and a node's radius is what its own rows need.
    """
    rows = np.arange(len(points)) if rows is None else rows
    points = points.astype(np.float64)
    centre = points[rows[0]]
    away = _gaps(points[rows], centre)
    node = Node(centre, float(away.max()), rows)
    todo = [(node, away)]
    while todo:
        parent, away = todo.pop()
        if len(parent.rows) <= leaf or parent.radius == 0:
            continue
        at = points[parent.rows]
        off = at - parent.centre
        squares = np.einsum("ij,ij->i", off, off)
        nearest, owner = away**2, np.zeros(len(at), np.int64)
        n = 1
        while n < FANOUT and nearest.max() > (parent.radius / 2) ** 2:
            far = int(nearest.argmax())
            to_far = np.maximum(squares - 2 * (off @ off[far]) + squares[far], 0)  # rounded; it only chooses owners
            closer = to_far < nearest
            closer[far] = True  # and the parent's centre, at 0, stays where it is, so a node is always split
            owner[closer], nearest[closer] = n, to_far[closer]
            nearest[far] = 0
            n += 1
        if n == 1:
            continue
        for c in range(n):
            mine = np.flatnonzero(owner == c)
            if len(mine):
                head = at[mine[int(nearest[mine].argmin())]]
                gap = _gaps(at[mine], head)
                child = Node(head, float(gap.max()), parent.rows[mine])
                parent.children.append(child)
                todo.append((child, gap))
    return node


def _gaps(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = points - centre
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def bound(q: Node, d: Node) -> float:
    """No inner product between rows of the two nodes is above this."""
    q_norm, d_norm = float(np.linalg.norm(q.centre)), float(np.linalg.norm(d.centre))
    best = float(q.centre @ d.centre) + q.radius * d_norm + d.radius * q_norm + q.radius * d.radius
    return best + 1 + 1e-9 * (abs(best) + q_norm * d_norm)  # slack for rounding


def bounds(q: list[Node], d: list[Node]) -> np.ndarray:
    """`bound` of each node of `q` with each of `d`."""
    q_at, d_at = np.stack([x.centre for x in q]), np.stack([x.centre for x in d])
    q_norm, d_norm = np.linalg.norm(q_at, axis=1)[:, None], np.linalg.norm(d_at, axis=1)[None]
    q_radius, d_radius = np.array([x.radius for x in q])[:, None], np.array([x.radius for x in d])[None]
    best = q_at @ d_at.T + q_radius * d_norm + d_radius * q_norm + q_radius * d_radius
    return best + 1 + 1e-9 * (np.abs(best) + q_norm * d_norm)


def _leaves(node: Node, rows: int) -> list[Node]:
    """The nodes below which no more than `rows` rows are, or that have no children, in the order of the tree."""
    if not node.children or len(node.rows) <= rows:
        return [node]
    return [x for child in node.children for x in _leaves(child, rows)]


def open_leaves(root: Node, queries: list[Node], worst: np.ndarray) -> tuple[list[Node], np.ndarray]:
    """Leaves below `root` that can hold one of the first k of some of the query nodes, best bound first; and their bounds, node by node.

    Walks down level by level: a node that is ruled out for all query nodes is left with all that is below it.
    """
    leaves, found, level = [], [], [root]
    while level:
        high = bounds(queries, level)
        kept = np.flatnonzero((high >= worst[:, None]).any(axis=0))
        for at in kept:
            if not level[at].children:
                leaves.append(level[at])
                found.append(high[:, at])
        level = [child for at in kept for child in level[at].children]
    if not leaves:
        return [], np.zeros((len(queries), 0))
    high = np.stack(found, axis=1)
    order = np.argsort(-high.max(axis=0), kind="stable")
    return [leaves[x] for x in order], high[:, order]


def walk(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, d_ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector id, score) of all pairs that can be among the first k: the dual-tree walk of one chunk.

    `floor` has a known lower bound of each query's k-th score. Neighbouring query nodes walk down the data's tree together and
    meet the leaves that are left in one product, the best ones first; what these give rules out more of the others.
    """
    d_root = cover_tree(d)
    worst = floor.copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    batches: list[list[Node]] = [[]]
    for node in _leaves(cover_tree(q), GROUP):
        if batches[-1] and sum(len(x.rows) for x in batches[-1]) + len(node.rows) > GROUP:
            batches.append([])
        batches[-1].append(node)
    for nodes in batches:
        rows = np.concatenate([x.rows for x in nodes])
        asked, asked_ids = q[rows], q_ids[rows]
        starts = np.cumsum([0, *(len(x.rows) for x in nodes[:-1])])
        leaves, high = open_leaves(d_root, nodes, np.minimum.reduceat(worst[rows], starts))
        sizes = np.array([len(x.rows) for x in leaves], np.int64)
        top = tuple(np.zeros(0, np.int64) for _ in range(3))
        left, step = np.arange(len(leaves)), FIRST_ROWS
        while len(left):
            n = int(np.searchsorted(np.cumsum(sizes[left]), step)) + 1
            have = np.concatenate([leaves[x].rows for x in left[:n]])
            scores = products(asked, d[have])
            hit = np.flatnonzero(scores >= worst[rows][:, None])
            i, j = np.divmod(hit, len(have))
            other = asked_ids[i] != d_ids[have[j]]
            i, j, hit = i[other], j[other], hit[other]
            top = _first(np.concatenate([top[0], i]), np.concatenate([top[1], d_ids[have[j]]]), np.concatenate([top[2], scores.ravel()[hit]]), k)
            last = np.flatnonzero(np.diff(top[0], append=-1))
            full = last[np.diff(last, prepend=-1) == k]
            worst[rows[top[0][full]]] = np.maximum(worst[rows[top[0][full]]], top[2][full])
            still = (high[:, left[n:]] >= np.minimum.reduceat(worst[rows], starts)[:, None]).any(axis=0)
            left, step = left[n:][still], CHUNK
        found.append((rows[top[0]], top[1], top[2]))
    row, ids, score = (np.concatenate(x) for x in zip(*found))
    return _first(row, ids, score, k)


def _first(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each row, ties to smaller ids."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
    return row[place < k], ids[place < k], score[place < k]


class Top:
    """The shared top of the tree: cells with their covering radii, below a few inner nodes."""

    def __init__(self, pivots: np.ndarray, radius: np.ndarray, count: np.ndarray) -> None:
        self.pivots, self.count = pivots, count
        self.root = cover_tree(pivots, leaf=1)
        self._cover(self.root, radius)
        self.cells = [Node(p.astype(np.float64), float(r), np.array([k])) for k, (p, r) in enumerate(zip(pivots, radius))]

    def _cover(self, node: Node, radius: np.ndarray) -> None:
        for child in node.children:
            self._cover(child, radius)
        node.radius = float((np.linalg.norm(self.pivots[node.rows] - node.centre, axis=1) + radius[node.rows]).max())

    def nearest(self, group: Node, least: int) -> list[int]:
        """Cells with data in the order of their bounds, until they hold `least` rows."""
        out, rows = [], 0
        for cell in sorted(np.flatnonzero(self.count), key=lambda c: (-float(group.centre @ self.cells[c].centre), c)):
            out.append(int(cell))
            rows += int(self.count[cell])
            if rows >= least:
                break
        return out

    def open_cells(self, group: Node, worst: float) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if bound(group, node) < worst:
                continue
            if node.children:
                todo += node.children
            else:
                out += [int(c) for c in node.rows if self.count[c] and bound(group, self.cells[c]) >= worst]
        return out


def _group_node(vectors: np.ndarray) -> Node:
    centre = vectors.mean(axis=0)
    return Node(centre, float(np.linalg.norm(vectors - centre, axis=1).max()), np.arange(len(vectors)))


def top_k(
    data: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS, chunk: int = CHUNK, group: int = GROUP,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with the rows of other ids.

    Components become floor(256 * x); ties go to the smaller id; fewer than k rows are all returned. Vectors that are
    null, empty or hold null, NaN or infinite components, and rows with a null id, take no part; shorter vectors count
    as filled with 0. Rows with one id and equal vectors count once, and with different vectors each for itself; scores
    beyond a long raise. Empty tables give no rows; other columns are ignored.
    """
    kinds = data.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.lit(False).alias("is_query")).unionByName(
        queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.lit(True).alias("is_query")))

    def scaled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            usable, rows = to_integers(frame["v"])
            kept = frame[usable]
            yield pd.DataFrame({"id": kept["id"], "is_query": kept["is_query"], "vec": [r.tobytes() for r in rows]})

    spark = data.sparkSession
    vectors = store(kinds.filter("id IS NOT NULL AND v IS NOT NULL").mapInPandas(scaled, "id long, is_query boolean, vec binary"), "vectors")
    shape = vectors.agg(F.max(F.length("vec")), F.count_if(~F.col("is_query"))).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not shape[0] or not shape[1]:
        return spark.createDataFrame([], result)
    width, n_data = shape[0] // 8, shape[1]
    share = min(1.0, 4 * pivots / n_data)
    sampled = vectors.filter("NOT is_query").filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    some = sampled.select("vec").distinct().orderBy(F.xxhash64("vec")).limit(pivots).toPandas()
    if some.empty:
        some = vectors.filter("NOT is_query").select("vec").limit(1).toPandas()
    points = unpack(some["vec"], width)

    def to_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, squares = points.astype(np.float64), (points.astype(np.float64) ** 2).sum(axis=1)
        for frame in frames:
            rows = unpack(frame["vec"], width).astype(np.float64)
            cell = (squares[None] - 2 * rows @ at.T).argmin(axis=1)
            yield frame.assign(cell=cell.astype(np.int32), away=np.linalg.norm(rows - at[cell], axis=1))

    placed = vectors.mapInPandas(to_cells, "id long, is_query boolean, vec binary, cell int, away double")
    stats = placed.groupBy("cell", "is_query").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect()
    radius, count, asked = np.zeros(len(points)), np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    for s in stats:
        if s["is_query"]:
            asked[s["cell"]] = s["n"]
        else:
            radius[s["cell"]], count[s["cell"]] = s["r"], s["n"]
    top = Top(points, radius, count)
    n_chunks, n_groups = -(-count // chunk), -(-asked // group)
    splits = F.array(*[F.lit(int(max(1, c))) for c in n_chunks])
    rows = placed.filter("NOT is_query").select("id", "vec", "cell", F.pmod(F.xxhash64("id", "vec"), splits[F.col("cell")]).cast("int").alias("chunk")).distinct()
    firsts = F.array(*[F.lit(int(c)) for c in np.concatenate([[0], np.cumsum(n_groups)[:-1]])])
    parts = F.array(*[F.lit(int(max(1, c))) for c in n_groups])
    asking = placed.filter("is_query").select("id", "vec", (firsts[F.col("cell")] + F.pmod(F.xxhash64("id", F.lit(5)), parts[F.col("cell")])).cast("int").alias("grp")).distinct()

    def visits(seeds: bool):
        def plan(frame: pd.DataFrame) -> pd.DataFrame:
            node = _group_node(unpack(frame["vec"], width).astype(np.float64))
            if seeds:
                at = [(c, 0) for c in top.nearest(node, 4 * k + 4)]
            else:
                at = [(c, x) for c in top.open_cells(node, float(frame["floor"].min())) for x in range(int(n_chunks[c]))]
            return pd.DataFrame({"grp": [int(frame["grp"].iloc[0])] * len(at), "cell": [c for c, _ in at], "chunk": [x for _, x in at]})

        return plan

    def search(asking_with_floor: DataFrame, seeds: bool) -> DataFrame:
        pairs = asking_with_floor.groupBy("grp").applyInPandas(visits(seeds), "grp int, cell int, chunk int")
        pairs = pairs.withColumn("part", F.floor(F.col("grp") / GROUPS_PER_TASK).cast("int"))
        left = pairs.join(asking_with_floor, "grp").select("cell", "chunk", "part", "id", "vec", "floor")
        right = pairs.select("cell", "chunk", "part").distinct().join(rows, ["cell", "chunk"])
        right = right.select(F.col("cell").alias("to_cell"), F.col("chunk").alias("to_chunk"), F.col("part").alias("to_part"), "id", "vec")

        def evaluate(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
            if ask.empty or have.empty:
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
            q_ids = ask["id"].to_numpy()
            row, ids, score = walk(q_ids, unpack(ask["vec"], width), ask["floor"].to_numpy(), have["id"].to_numpy(), unpack(have["vec"], width), k)
            return pd.DataFrame({"query_id": q_ids[row], "vec_id": ids, "score": score})

        here = left.groupBy("cell", "chunk", "part").cogroup(right.groupBy("to_cell", "to_chunk", "to_part"))
        return here.applyInPandas(evaluate, "query_id long, vec_id long, score long")

    first = search(asking.withColumn("floor", F.lit(_LOW + 1)), seeds=True).distinct()
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    floors = ranked.filter(F.col("_n") == k).select(F.col("query_id").alias("id"), F.col("score").alias("_floor"))
    known = asking.join(floors, "id", "left").select("id", "vec", "grp", F.coalesce("_floor", F.lit(_LOW + 1)).alias("floor"))
    found = search(store(known, "floors"), seeds=False).distinct()
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return best.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
