"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct shingles (runs of five words; a shorter text is one shingle). Two documents link
when intersection / union >= 0.8. All sets share one order of shingles. A set of n shingles may miss at most
m = n - ceil(0.8 n) of a partner's common part, so among the first m + l shingles of both there are at least l common
ones, for any l: the l-match prefix. A longer prefix costs more to look up and demands more matches.

1. Equal sets become one representative, so copies never meet each other.
2. Short prefixes: l = 1 + n / 20, in hash order. Their shingles are counted over all representatives; a document with
   fewer than the smallest possible l repeated shingles links with nothing and goes. Of the others only the rarest
   (repeated - l + 1) shingles are looked up, as one of the common ones must be among them.
3. The candidate cost of a document is the sum of those shingles' frequencies. Up to MAX_COST, its partners are
   looked up directly: no shingle in use is then frequent. Pairs with fewer than l common prefix shingles go before
   verification.
4. Costlier documents get the longest prefix: the whole set, counted anew among them and in order of frequency, where
   one of the rarest m + 1 shingles must be common. Frequent groups are near copies of each other, so in each shingle's
   group all are first verified against one leader; what links is one class and needs no pairs. Only documents outside
   their group's largest class are then compared with the others, block by block.
5. Pairs are verified with exact set sizes; connected components of the links give the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispark.llm.components import connected
from verispark.llm.tables import store, text_batches
from verispark.llm.textbytes import Texts, lower_ascii, mix, sequence_hashes, slices, span_hashes, word_spans
from verispark.operators.ordered import without_ids

SHINGLE = 5
SIMILARITY = 80  # percent
SHORT = 20  # one more match for each SHORT shingles
MAX_COST = 64
LEADER_ROUNDS = 2
BLOCK = 512  # sets of a block in the exact comparison of what leaders left
BITMAP_BITS = 1 << 23


def shingle_sets(texts: Texts, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, by document and hash."""
    data = lower_ascii(texts.data)
    starts, ends, doc = word_spans(data, texts.offsets)
    words = span_hashes(data, starts, ends)
    sizes = np.bincount(doc, minlength=len(texts))
    hashes, owner, _ = sequence_hashes(words, doc, width)
    parts, owners = [hashes], [owner]
    for n in range(1, width):
        short, whose, _ = sequence_hashes(words, doc, n)
        whole = sizes[whose] == n
        parts.append(mix(short[whole] + np.uint64(n)))
        owners.append(whose[whole])
    hashes, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return owner[first], hashes[first]


def _per_doc(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    if len(owner):
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[starts]] = np.add.reduceat(values, starts)
    return out


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def signatures(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc, n, two digests of the set, and its short prefix."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                owner, hashes = shingle_sets(texts)
                n = np.bincount(owner, minlength=len(texts))
                firsts = np.concatenate([[0], np.cumsum(n)])[:-1]
                length = n - -(-n * similarity // 100) + 1 + n // SHORT
                short = np.arange(len(owner)) - firsts[owner] < length[owner]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(texts.first, len(texts)), pa.array(n, pa.int64()),
                    pa.array(_per_doc(owner, mix(hashes), len(texts)).view(np.int64)),
                    pa.array(_per_doc(owner, mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), len(texts)).view(np.int64)),
                    _lists(owner[short], hashes[short], len(texts)),
                ], ["doc", "n", "d1", "d2", "prefix"])

    return docs.mapInArrow(sign, "doc long, n long, d1 long, d2 long, prefix array<long>")


def set_keys(df: DataFrame) -> list[str]:
    """Columns that tell sets apart: an id with several different sets has a digest k for each of them."""
    return [c for c in ("doc", "n", "k") if c in df.columns]


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The key of each `wanted` set (doc, n and, if it has that, k) and all its shingles.

    A bitmap of fixed size keeps most other texts from being cut again; the join with `wanted` is exact.
    """
    keys = set_keys(wanted)
    slot = F.pmod(F.xxhash64("doc"), F.lit(BITMAP_BITS))
    bits = wanted.select(F.shiftright(slot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    bitmap = np.zeros(BITMAP_BITS >> 6, np.uint64)
    for r in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # at most BITMAP_BITS / 64 rows
        bitmap[r["word"]] = np.uint64(r["bits"] & ((1 << 64) - 1))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            may = (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            batch = batch.filter(pa.array(may))
            for texts in slices(batch.column(1)):
                owner, hashes = shingle_sets(texts)
                n = np.bincount(owner, minlength=len(texts))
                k = pa.array(_per_doc(owner, mix(hashes), len(texts)).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(texts)), pa.array(n, pa.int64()), k, _lists(owner, hashes, len(texts))], ["doc", "n", "k", "tokens"])

    sets = docs.withColumn("slot", slot).mapInArrow(cut, "doc long, n long, k long, tokens array<long>")
    if "k" in keys:  # 0 for documents with one set
        several = wanted.filter("k <> 0").select("doc").distinct().withColumn("several", F.lit(True))
        sets = sets.join(several, "doc", "left").withColumn("k", F.when(F.col("several"), F.col("k")).otherwise(0))
    return sets.select(*keys, "tokens").join(wanted.select(*keys).distinct(), keys, "left_semi").dropDuplicates(keys)


def _compatible(a: Column, b: Column, similarity: int) -> Column:
    """Sets of these sizes can reach the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * similarity


def _enough_in_common(a_n: Column, a_c: Column, b_n: Column, b_c: Column, similarity: int) -> Column:
    """No more can be common than either set has repeated shingles (a_c, b_c); the similarity asks for a share of both sizes."""
    return F.least(a_c, b_c) * (100 + similarity) >= (a_n + b_n) * similarity


def verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    left = sets.select(F.col("doc").alias("a"), F.col("n").alias("a_n"), F.col("tokens").alias("a_tokens"))
    right = sets.select(F.col("doc").alias("b"), F.col("n").alias("b_n"), F.col("tokens").alias("b_tokens"))
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "a_n", "b_n", common.alias("c"))
    return both.filter(F.col("c") * 100 >= (F.col("a_n") + F.col("b_n") - F.col("c")) * similarity).select("a", "b")


def _least_matches(n: Column, similarity: int) -> Column:
    """Matches any partner of a set of n shingles must show at least."""
    return F.floor(F.ceil(n * similarity / 100) / SHORT) + 1


def repeated_prefixes(reps: DataFrame, similarity: int) -> DataFrame:
    """doc, n, repeated: (frequency, shingle) of the repeated shingles of the short prefix, rarest first.

    Documents with too few of them to link with anything are left out.
    """
    keys = set_keys(reps)
    posts = reps.select(*keys, F.explode("prefix").alias("token"))
    counts = posts.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    # One document's prefix is one row: bounded by the document.
    rows = posts.join(counts, "token").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("repeated"))
    return rows.filter(F.size("repeated") >= _least_matches(F.col("n"), similarity))


def _direct_pairs(found: DataFrame, similarity: int, max_cost: int) -> DataFrame:
    """Candidates of documents with rare shingles, after the count of common prefix shingles."""
    posts = found.select("doc", "n", "costly", F.explode("kept").alias("k")).select("doc", "n", "costly", F.col("k.token").alias("token"), F.col("k.df").alias("df"))
    # A document of low cost holds no shingle above this frequency, so costly ones need not offer theirs.
    posts = posts.filter(F.col("df") <= max_cost + 1)
    a = posts.select("token", F.col("doc").alias("a"), F.col("n").alias("a_n"), F.col("costly").alias("a_costly"))
    b = posts.select("token", F.col("doc").alias("b"), F.col("n").alias("b_n"), F.col("costly").alias("b_costly"))
    pairs = a.join(b, "token").filter((F.col("a") < F.col("b")) & ~(F.col("a_costly") & F.col("b_costly")) & _compatible(F.col("a_n"), F.col("b_n"), similarity))
    pairs = pairs.select("a", "b").distinct()
    tokens = F.transform("repeated", lambda r: r["token"])
    left = found.select(F.col("doc").alias("a"), F.col("n").alias("a_n"), tokens.alias("a_t"))
    right = found.select(F.col("doc").alias("b"), F.col("n").alias("b_n"), tokens.alias("b_t"))
    met = pairs.join(left, "a").join(right, "b")
    needed = F.floor(F.least("a_n", "b_n") / SHORT) + 1
    return met.filter(F.size(F.array_intersect("a_t", "b_t")) >= needed).select("a", "b")


def _long_prefixes(sets: DataFrame, similarity: int) -> tuple[DataFrame, DataFrame]:
    """Shingle rows of the rarest m + 1 of each whole set, and the sets cut to their repeated shingles."""
    keys = set_keys(sets)
    posts = sets.select(*keys, F.explode("tokens").alias("token"))
    counts = posts.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    rows = posts.join(counts, "token").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("r"))
    rows = store(rows.filter(F.size("r") * 100 >= F.col("n") * similarity), "long-prefixes")
    # The shingles of one document alone come first in the order, so they take up places.
    kept = F.size("r") - F.ceil(F.col("n") * similarity / 100).cast("int") + 1
    long = rows.select("doc", "n", F.size("r").alias("c"), F.explode(F.slice("r", 1, F.greatest(kept, F.lit(1)))).alias("k"))
    long = long.select("doc", "n", "c", F.col("k.token").alias("token"))
    return long, rows.select("doc", "n", F.col("r.token").alias("tokens"))


def _with_classes(posts: DataFrame, classes: DataFrame | None) -> DataFrame:
    if classes is None:
        return posts.withColumn("comp", F.col("doc"))
    return posts.join(classes, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))


def _leader_pairs(posts: DataFrame, turn: int, similarity: int) -> DataFrame:
    """Each document with the leader of its shingle's group, where their classes differ.

    A group is split by size first, as sets of very different size cannot link; the split moves with each turn.
    """
    step = math.log(100 / similarity)
    sized = posts.withColumn("size", F.floor(F.log("n") / (2 * step) + F.lit(turn / LEADER_ROUNDS)))
    leaders = sized.groupBy("token", "size").agg(F.min(F.struct(F.xxhash64("doc", F.lit(turn)).alias("h"), "doc", "n", "c", "comp")).alias("l"))
    met = sized.join(leaders, ["token", "size"])
    met = met.filter((F.col("comp") != F.col("l.comp")) & _enough_in_common(F.col("n"), F.col("c"), F.col("l.n"), F.col("l.c"), similarity))
    return met.select(F.least("doc", "l.doc").alias("a"), F.greatest("doc", "l.doc").alias("b")).distinct()


def _size_class(n: Column, similarity: int) -> Column:
    """Classes of half the largest compatible ratio: sets that can link are at most two apart (three with rounding)."""
    return F.floor(F.log(n) * (2 / math.log(100 / similarity))).cast("int")


def block_links(ask: pd.DataFrame, have: pd.DataFrame, similarity: int) -> pd.DataFrame:
    """Links between two blocks of sets: for each asking set one partner in each other class.

    Shingles that many sets of both blocks hold are counted by a matrix product, the others by their few pairs.
    """
    sizes = [np.array([len(t) for t in x["tokens"]], np.int64) for x in (ask, have)]
    tokens = [np.concatenate([np.asarray(t, np.int64) for t in x["tokens"]]) for x in (ask, have)]
    rows = [np.repeat(np.arange(len(s)), s) for s in sizes]
    both = np.intersect1d(tokens[0], tokens[1])
    found = []
    for t, r in zip(tokens, rows):
        at = np.minimum(np.searchsorted(both, t), max(len(both) - 1, 0))
        keep = both[at] == t if len(both) else np.zeros(len(t), bool)
        order = np.lexsort((r[keep], at[keep]))
        found.append((at[keep][order], r[keep][order]))
    (a_token, a_row), (b_token, b_row) = found
    a_df, b_df = np.bincount(a_token, minlength=len(both)), np.bincount(b_token, minlength=len(both))
    common = np.zeros((len(ask), len(have)), np.float32)
    dense = np.flatnonzero(a_df * b_df >= 1024)
    for at in range(0, len(dense), 2048):
        part = dense[at : at + 2048]
        sides = []
        for token, row, n in ((a_token, a_row, len(ask)), (b_token, b_row, len(have))):
            place = np.minimum(np.searchsorted(part, token), len(part) - 1)
            mine = part[place] == token
            side = np.zeros((n, len(part)), np.float32)
            side[row[mine], place[mine]] = 1
            sides.append(side)
        common += sides[0] @ sides[1].T
    a_first, b_first = np.cumsum(a_df) - a_df, np.cumsum(b_df) - b_df
    sparse = np.setdiff1d(np.arange(len(both)), dense)
    for at in range(0, len(sparse), 4096):
        part = sparse[at : at + 4096]
        pairs = a_df[part] * b_df[part]
        token = np.repeat(part, pairs)
        k = np.arange(len(token)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        np.add.at(common, (a_row[a_first[token] + k // b_df[token]], b_row[b_first[token] + k % b_df[token]]), 1)
    a_n, b_n = ask["n"].to_numpy()[:, None], have["n"].to_numpy()[None, :]
    link = (common * 100 >= (a_n + b_n - common) * similarity) & (ask["comp"].to_numpy()[:, None] != have["comp"].to_numpy()[None, :])
    i, j = np.nonzero(link)
    out = pd.DataFrame({"a": ask["doc"].to_numpy()[i], "b": have["doc"].to_numpy()[j], "comp": have["comp"].to_numpy()[j]})
    return out.drop_duplicates(["a", "comp"])[["a", "b"]]


def _rest_links(posts: DataFrame, sets: DataFrame, similarity: int, block: int = BLOCK) -> DataFrame:
    """The links that leaders did not show: documents outside their group's largest class against all of their cluster.

    A cluster holds what shares prefix shingles, directly or through others. It is cut into blocks of bounded size by
    size class and hash; asking blocks meet the blocks of compatible classes, each pair of blocks in one task, and only
    links come back. A document whose repeated shingles leave no room for any partner of its cluster asks nothing.
    """
    per_class = posts.groupBy("token", "comp").agg(F.count("*").alias("k"))
    groups = per_class.groupBy("token").agg(F.count("*").alias("classes"), F.max(F.struct("k", "comp")).alias("big")).filter("classes > 1")
    mixed = posts.join(groups.select("token", F.col("big.comp").alias("big")), "token")
    heads = mixed.groupBy("token").agg(F.min("doc").alias("head"))
    clusters = connected(mixed.join(heads, "token").select(F.col("doc").alias("a"), F.col("head").alias("b")))
    asks = mixed.groupBy("doc", "n", "c", "comp").agg(F.max((F.col("comp") != F.col("big")).cast("int")).alias("outside"))
    docs = asks.join(clusters.withColumnRenamed("comp", "cluster"), "doc").withColumn("size", _size_class(F.col("n"), similarity))
    docs = store(docs, "rest")
    # A partner of a set with c repeated shingles has at most c * (100 + s) / s - n shingles, and no fewer than the least of its cluster.
    least = docs.groupBy("cluster").agg(F.min("n").alias("least_n"))
    room = F.col("c") * (100 + similarity) >= (F.col("n") + F.greatest(F.col("least_n"), F.ceil(F.col("n") * similarity / 100))) * similarity
    # Written, as each side below reads it again: the driver keeps the whole plan of a query, with one more copy for each use.
    asking = store(docs.filter("outside = 1").join(least, "cluster").filter(room).drop("least_n"), "asking")

    def blocks(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("cluster", "size").agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    ask_blocks, have_blocks = store(blocks(asking, "a_blocks"), "blocks"), store(blocks(docs, "b_blocks"), "blocks")
    near = F.explode(F.sequence(F.col("size") - 3, F.col("size") + 3))
    a = asking.join(ask_blocks, ["cluster", "size"]).select("cluster", F.col("size").alias("a_size"), F.pmod(F.xxhash64("doc"), "a_blocks").cast("int").alias("a_no"), near.alias("b_size"), "doc", "n", "comp")
    a = a.join(have_blocks.withColumnRenamed("size", "b_size"), ["cluster", "b_size"]).withColumn("b_no", F.explode(F.sequence(F.lit(0), F.col("b_blocks") - 1)))
    b = docs.join(have_blocks, ["cluster", "size"]).select("cluster", F.col("size").alias("b_size"), F.pmod(F.xxhash64("doc"), "b_blocks").cast("int").alias("b_no"), near.alias("a_size"), "doc", "n", "comp")
    b = b.join(ask_blocks.withColumnRenamed("size", "a_size"), ["cluster", "a_size"]).withColumn("a_no", F.explode(F.sequence(F.lit(0), F.col("a_blocks") - 1)))
    keys = ["cluster", "a_size", "a_no", "b_size", "b_no"]
    tokens = sets.select("doc", "n", "tokens")
    left = a.select(*keys, "doc", "n", "comp").join(tokens, ["doc", "n"])
    right = b.select(*keys, "doc", "n", "comp").join(tokens, ["doc", "n"])
    right = right.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "doc", "n", "comp", "tokens")])

    def meet(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        if ask.empty or have.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        return block_links(ask, have.rename(columns=lambda c: c.removeprefix("_")), similarity)

    tiles = left.groupBy(*keys).cogroup(right.groupBy(*[f"_{k}" for k in keys]))
    return tiles.applyInPandas(meet, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, max_cost: int = MAX_COST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest id a document reaches by links, itself included.

    A null or empty text has no shingles and links with nothing; a row with a null id has a null component; rows with
    one id are one node that has the links of all its texts; an empty table gives no rows; other columns are ignored.
    """
    text_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    signed = store(signatures(texts, similarity), "signatures")
    known = signed.filter("n > 0 AND doc IS NOT NULL")
    copies = known.groupBy("d1", "d2", "n").agg(F.min(F.struct("doc", "prefix")).alias("rep"))
    reps = copies.select(F.col("rep.doc").alias("doc"), "n", "d1", F.col("rep.prefix").alias("prefix"))
    several = store(known.groupBy("doc").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).filter("lo <> hi").select("doc", F.lit(True).alias("several")), "several")
    if several.limit(1).count():
        reps = reps.join(several, "doc", "left").withColumn("k", F.when(F.col("several"), F.col("d1")).otherwise(0)).drop("several")
    reps = reps.drop("d1")
    found = repeated_prefixes(reps, similarity)
    kept = F.slice("repeated", 1, (F.size("repeated") - _least_matches(F.col("n"), similarity) + 1).cast("int"))
    cost = F.aggregate("kept", F.lit(0).cast("long"), lambda s, k: s + k["df"] - 1)
    found = store(found.withColumn("kept", kept).withColumn("costly", cost > max_cost), "prefixes")
    direct = store(_direct_pairs(found, similarity, max_cost), "candidates")
    ends = direct.select(F.col("a").alias("doc")).unionByName(direct.select(F.col("b").alias("doc"))).distinct()
    wanted = found.join(ends.withColumn("in_pair", F.lit(True)), "doc", "left").filter("costly OR in_pair")
    keys = set_keys(wanted)
    wanted = wanted.select(*keys, "costly")
    sets = store(full_sets(texts, wanted).join(wanted.distinct(), keys), "sets")
    links, classes = [verified(direct, sets, similarity)], None
    costly = sets.filter("costly").drop("costly")
    if costly.limit(1).count():
        posts, cut = _long_prefixes(costly, similarity)
        posts = store(posts, "posts")
        for turn in range(LEADER_ROUNDS):
            more = store(verified(_leader_pairs(_with_classes(posts, classes), turn, similarity), cut, similarity), "links")
            classes = connected(more, classes)
        links.append(_rest_links(store(_with_classes(posts, classes), "posts"), cut, similarity))
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    # Copies hang on their representative, and a node with several rows on all of their sets.
    same = known.select("doc", "d1", "d2", "n").join(copies.select("d1", "d2", "n", F.col("rep.doc").alias("rep")), ["d1", "d2", "n"])
    twice = same.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a <> z")
    extra = same.join(twice.select("doc"), "doc").select(F.col("doc").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    classes = connected(store(edges, "links").unionByName(extra), classes)
    own = same.groupBy("doc").agg(F.min("rep").alias("rep")).join(classes.withColumnRenamed("doc", "rep"), "rep", "left")
    own = own.select(F.col("doc").alias("_doc"), F.coalesce("comp", "rep").alias("_comp"))
    out = signed.select("doc", "n").join(own, F.col("doc") == F.col("_doc"), "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("_comp", "doc").alias("component_id"))


def one_of_each(docs: DataFrame, similarity: int = SIMILARITY, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` without near duplicates: of each class the row with the smallest id; all columns stay.

    Rows that repeat an id are cut to one as well, the one with the least text; rows with a null id all stay.
    """
    found = near_duplicates(docs, similarity, id_col=id_col)
    per_id = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("comp"), F.count("*").alias("k"))
    per_id = store(per_id.filter("doc_id <> comp OR k > 1"), "doubles")
    kept = without_ids(docs, per_id.select("doc_id"), id_col)
    repeated = per_id.filter("doc_id = comp").select(F.col("doc_id").alias("_doc"))
    if not repeated.limit(1).count():
        return kept
    rows = docs.join(repeated, F.col(id_col) == F.col("_doc"), "left_semi")
    first = rows.groupBy(id_col).agg(F.min(F.struct(F.col("text"), *[c for c in docs.columns if c not in (id_col, "text")])).alias("_r"))
    return kept.unionByName(first.select(id_col, "_r.*").select(*docs.columns))
