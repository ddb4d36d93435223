"""Phrase collocation mining with Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), cut at `.,;:!?` and line ends into pieces and those into words. Prefix polynomials over the
word hashes of a slice of texts give the fingerprint of every run of n words by one subtraction and one product; the
language is mixed in, so everything is counted per language.

1. Levels. Each task counts the fingerprints of its texts and sends one row per different fingerprint: count and a pointer
   to the document of an occurrence. Spark adds them up; what reaches the least count goes into a bitmap of fixed size.
   A phrase is only as frequent as its parts, so pairs are sent if both words are in the bitmap, runs of three and four if
   all their pairs are. A false bit costs rows, never results.
2. Text. Frequent phrases, and no others, are made into text at the occurrence their pointer leads to. One more pass holds
   every occurrence of a frequent fingerprint against that text, by a digest of its words that has nothing in common with
   the fingerprint. If a fingerprint stands for several texts, all its occurrences are counted anew by their words.
3. Scores, containment and ranks are joins and aggregates over the phrase table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verispark.llm.tables import store, text_batches
from verispark.llm.textbytes import Texts, lower_ascii, mix, slices, span_hashes

MAX_WORDS = 4
LEAST = 30  # occurrences of a candidate
CONTAINED = 80  # percent of a phrase's occurrences within a longer candidate, from which it goes
SCALE = 2_000_000
TOP = 2000
UNKNOWN = "und"
BITS = 27  # of the bitmap's size: 16 MB
SLICE = 2 << 20  # bytes of text at once
MERGE_ROWS = 1_500_000  # different fingerprints a task holds before it sends them

_BASE = 0x9E3779B97F4A7C55  # odd: it has an inverse modulo 2^64
_ALL = (1 << 64) - 1
_NO_DOC = np.iinfo(np.int64).max  # a pointer to a document without an id
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
_APART = _ENDS.copy()
_APART[[9, 32]] = True


@dataclass
class Words:
    """The words of a slice in order: byte spans, document, number of their piece, prefix polynomials."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    run: np.ndarray
    sums: np.ndarray
    inverse: np.ndarray
    seeds: np.ndarray  # per document
    mask: int  # bits of a fingerprint

    def places(self, n: int) -> np.ndarray:
        """Words that begin a run of n words within one piece."""
        if len(self.run) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.run[: len(self.run) - n + 1] == self.run[n - 1 :])

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the n words from each of `at`."""
        poly = (self.sums[at + n] - self.sums[at]) * self.inverse[at]
        return mix(poly + self.seeds[self.doc[at]] + np.uint64(n)) & np.uint64(self.mask)


def _geometric(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def cut_words(texts: Texts, seeds: np.ndarray, mask: int = _ALL) -> Words:
    data = lower_ascii(texts.data)
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, none, np.zeros(1, np.uint64), np.zeros(0, np.uint64), seeds, mask)
    inside = ~_APART[data]
    first = np.zeros(len(data) + 1, bool)  # of a document
    first[texts.offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~first[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~first[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(texts.offsets, starts, side="right") - 1
    piece = np.cumsum(_ENDS[data])[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
    power = _geometric(_BASE, len(starts))
    sums = np.zeros(len(starts) + 1, np.uint64)
    np.cumsum(span_hashes(data, starts, ends) * power, out=sums[1:])
    return Words(data, starts, ends, doc, np.cumsum(new), sums, _geometric(pow(_BASE, -1, 1 << 64), len(starts)), seeds, mask)


def _seeds(langs: pa.Array) -> np.ndarray:
    """A number for each row's language."""
    coded = langs.dictionary_encode()
    names = [x.encode() + b"\n" for x in coded.dictionary.to_pylist()]
    if not names:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b"".join(names), np.uint8)
    ends = np.cumsum([len(x) for x in names]).astype(np.int64)
    return span_hashes(data, ends - [len(x) for x in names], ends)[coded.indices.to_numpy(zero_copy_only=False)]


def _merge(prints: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry per fingerprint: summed counts and the smallest document."""
    if len(prints) == 0:
        return prints, counts, docs
    order = np.argsort(prints)
    prints = prints[order]
    starts = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
    return prints[starts], np.add.reduceat(counts[order], starts), np.minimum.reduceat(docs[order], starts)


def _has(bitmap: np.ndarray, keys: np.ndarray, low: bool = False) -> np.ndarray:
    at = keys & np.uint64((1 << BITS) - 1) if low else keys >> np.uint64(64 - BITS)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _open_places(words: Words, n: int, bitmap: np.ndarray | None) -> np.ndarray:
    """Runs of n words whose parts (words for n = 2, pairs beyond) are in the bitmap of the level before."""
    at = words.places(n)
    if n == 1:
        return at
    part = 1 if n == 2 else 2
    known = np.zeros(len(words.doc) + n, bool)
    parts = words.places(part)
    known[parts] = _has(bitmap, words.prints(parts, part))
    for k in range(n - part + 1):
        at = at[known[at + k]]
    return at


def _level(docs: DataFrame, sizes: tuple[int, ...], bitmap: np.ndarray | None, least: int, mask: int) -> DataFrame:
    """print, f, doc: the fingerprints of runs of `sizes` words with at least `least` occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # of fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def merged() -> tuple[np.ndarray, ...]:
            return _merge(*[np.concatenate(x) for x in zip(*held)])

        def send() -> Iterator[pa.RecordBatch]:
            prints, counts, ids = merged()
            for s in range(0, len(prints), 100_000):
                e = s + 100_000
                yield pa.RecordBatch.from_arrays([pa.array(prints[s:e].view(np.int64)), pa.array(counts[s:e]), pa.array(ids[s:e])], ["print", "f", "doc"])

        for batch in batches:
            seeds, ids = _seeds(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
            for texts in slices(batch.column(2), SLICE):
                part = slice(texts.first, texts.first + len(texts))
                words = cut_words(texts, seeds[part], mask)
                for n in sizes:
                    at = _open_places(words, n, shared.value)
                    held.append(_merge(words.prints(at, n), np.ones(len(at), np.int64), ids[part][words.doc[at]]))
                    n_held += len(held[-1][0])
                if n_held > MERGE_ROWS:
                    held = [merged()]
                    n_held = len(held[0][0])
                    if n_held > MERGE_ROWS // 2:
                        yield from send()
                        held, n_held = [], 0
        if held:
            yield from send()

    sent = docs.mapInArrow(count, "print long, f long, doc long")
    return sent.groupBy("print").agg(F.sum("f").alias("f"), F.min("doc").alias("doc")).filter(F.col("f") >= least)


def _bitmap(found: DataFrame, key: str, low: bool = False) -> np.ndarray:
    """Bits of the leading (or the low) digits of 64-bit keys: 2^BITS of them, whatever the table's size."""
    at = F.expr(key).bitwiseAND(F.lit((1 << BITS) - 1)) if low else F.shiftrightunsigned(F.expr(key), 64 - BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    words = found.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most 2^BITS / 64 rows
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def word_digests(words: Words) -> np.ndarray:
    """A digest of each word's bytes and their places; not a polynomial."""
    if len(words.starts) == 0:
        return np.zeros(0, np.uint64)
    sizes = words.ends - words.starts
    at = np.flatnonzero(~_APART[words.data])
    place = (at - np.repeat(words.starts, sizes)).astype(np.uint64)
    firsts = np.cumsum(sizes) - sizes
    return np.add.reduceat(mix(words.data[at].astype(np.uint64) + (place << np.uint64(8)) + np.uint64(1)), firsts)


def run_digests(words: Words, digests: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of runs of n words and their language, from the words' digests."""
    out = mix(words.seeds[words.doc[at]] + np.uint64(n))
    for k in range(n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + digests[at + k])
    return out


def _spaced(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each, and where they begin and end in that."""
    sizes = words.ends - words.starts
    begin = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(int((sizes + 1).sum()), 32, np.uint8)
    at = np.flatnonzero(~_APART[words.data])
    out[at + np.repeat(begin - words.starts, sizes)] = words.data[at]
    return out, begin, begin + sizes


def _strings(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans of `text` as an array of strings."""
    sizes = end - begin
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = text[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], sizes)]
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _first_of(prints: np.ndarray, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different (fingerprint, digest), and how often it stands there."""
    if len(prints) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((digests, prints))
    prints, digests = prints[order], digests[order]
    starts = np.flatnonzero(np.concatenate([[True], (prints[1:] != prints[:-1]) | (digests[1:] != digests[:-1])]))
    return order[starts], np.diff(np.concatenate([starts, [len(order)]]))


class _Slice:
    """A slice's words with the runs whose fingerprint is in both bitmaps of the frequent ones."""

    def __init__(self, batch: pa.RecordBatch, texts: Texts, seeds: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], max_words: int, mask: int = _ALL) -> None:
        part = slice(texts.first, texts.first + len(texts))
        self.words = cut_words(texts, seeds[part], mask)
        self.langs = batch.column(1).slice(texts.first, len(texts)).dictionary_encode()
        self.codes = self.langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids = batch.column(0).to_numpy(zero_copy_only=False)[part]
        self.digests, self.spaced = word_digests(self.words), None
        self.frequent, self.max_words = frequent, max_words

    def runs(self, chained: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """n, places, fingerprints and digests of runs of n words with a frequent fingerprint; chained: whose shorter runs have one too."""
        keep = np.ones(len(self.words.doc) + 1, bool)
        for n in range(1, self.max_words + 1):
            at = self.words.places(n)
            at = at[keep[at] & keep[at + 1]] if chained and n > 1 else at
            prints = self.words.prints(at, n)
            hit = _has(self.frequent[0], prints)
            hit[hit] = _has(self.frequent[1], prints[hit], low=True)
            at, prints = at[hit], prints[hit]
            keep = np.zeros(len(self.words.doc) + 1, bool)
            keep[at] = True
            yield n, at, prints, run_digests(self.words, self.digests, at, n)

    def named(self, n: int, at: np.ndarray) -> list[pa.Array]:
        """Language, n and phrase of the runs at `at`."""
        if self.spaced is None:
            self.spaced = _spaced(self.words)
        text, begin, end = self.spaced
        return [self.langs.dictionary.take(pa.array(self.codes[self.words.doc[at]])), pa.array(np.full(len(at), n, np.int32)), _strings(text, begin[at], end[at + n - 1])]


def _pointed(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], pointers: np.ndarray, max_words: int, mask: int) -> DataFrame:
    """lang, n, phrase, print, doc, digest, key: text of frequent runs in the documents their pointers name."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, pointers))  # of fixed size
    names = ["lang", "n", "phrase", "print", "doc", "digest", "key"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = _seeds(batch.column(1))
            for texts in slices(batch.column(2), SLICE):
                cut = _Slice(batch, texts, seeds, shared.value[0], max_words, mask)
                for n, at, prints, digests in cut.runs(chained=True):
                    ids = cut.ids[cut.words.doc[at]]
                    hit = np.flatnonzero(_has(shared.value[1], prints ^ ids.view(np.uint64), low=True))
                    one, _ = _first_of(prints[hit] ^ mix(ids[hit].view(np.uint64)), digests[hit])
                    hit = hit[one]
                    keys = mix(prints[hit] ^ digests[hit])
                    rows = [prints[hit].view(np.int64), ids[hit], digests[hit].view(np.int64), keys.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([*cut.named(n, at[hit]), *map(pa.array, rows)], names)

    return docs.mapInArrow(read, "lang string, n int, phrase string, print long, doc long, digest long, key long")


def _unlike(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], texts_of: np.ndarray, max_words: int, mask: int) -> DataFrame:
    """lang, n, phrase, print, f of runs with a frequent fingerprint and another text than the pointed one; n = 0 counts all words."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, texts_of))  # of fixed size
    names = ["lang", "n", "phrase", "print", "f"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            seeds = _seeds(batch.column(1))
            for texts in slices(batch.column(2), SLICE):
                cut = _Slice(batch, texts, seeds, shared.value[0], max_words, mask)
                for lang, n in zip(cut.langs.dictionary.to_pylist(), np.bincount(cut.codes[cut.words.doc], minlength=len(cut.langs.dictionary)).tolist()):
                    total[lang] = total.get(lang, 0) + n
                for n, at, prints, digests in cut.runs():
                    bad = np.flatnonzero(~_has(shared.value[1], mix(prints ^ digests)))
                    if len(bad):
                        one, f = _first_of(prints[bad], digests[bad])
                        yield pa.RecordBatch.from_arrays([*cut.named(n, at[bad[one]]), pa.array(prints[bad[one]].view(np.int64)), pa.array(f)], names)
        langs = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([0] * len(langs), pa.int32()), pa.array([""] * len(langs), pa.string()),
                                          pa.array([0] * len(langs), pa.int64()), pa.array([total[x] for x in langs], pa.int64())], names)

    return docs.mapInArrow(check, "lang string, n int, phrase string, print long, f long").groupBy(*names[:4]).agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, id_col: str = "doc_id", mask: int = _ALL) -> tuple[DataFrame, DataFrame]:
    """Table (lang, n, phrase, f, first_doc) of all phrases of up to `max_words` words with f >= least, and words per language.

    first_doc is the smallest id of a document that holds the phrase; null where none of them has an id, or for phrases
    that share their fingerprint with another one. `mask` keeps some bits of the fingerprints only, to try that.
    """
    text_batches(docs.sparkSession)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))
    read = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(_NO_DOC))).alias("doc"), lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    every, bitmap = None, None
    for sizes in [s for s in ((1,), (2,), tuple(range(3, max_words + 1))) if s and max(s) <= max_words]:
        found = store(_level(read, sizes, bitmap, least, mask), "prints")
        bitmap = _bitmap(found, "print")
        every = found if every is None else every.unionByName(found)
    # Runs of different lengths may have one fingerprint.
    every = store(every.groupBy("print").agg(F.sum("f").alias("f"), F.min("doc").alias("doc")), "prints")
    frequent = (_bitmap(every, "print"), _bitmap(every, "print", low=True))
    texts = _pointed(read, frequent, _bitmap(every, "print ^ doc", low=True), max_words, mask).join(every, ["print", "doc"])
    texts = store(texts.groupBy("print", "f", "doc").agg(F.min(F.struct("lang", "n", "phrase", "key")).alias("t")).select("print", "f", "doc", "t.*"), "phrases")
    unlike = store(_unlike(read, frequent, _bitmap(texts, "key"), max_words, mask), "unlike")
    words = unlike.filter("n = 0").select("lang", F.col("f").alias("n"))
    shared = store(unlike.filter("n > 0").join(every.select("print"), "print", "left_semi").select("print").distinct(), "shared-prints")
    own = texts.select("print", "lang", "n", "phrase", "f", F.nullif("doc", F.lit(int(_NO_DOC))).alias("first_doc"))
    if shared.limit(1).count():
        no_text = np.zeros(1 << (BITS - 6), np.uint64)
        again = _unlike(read, (_bitmap(shared, "print"), _bitmap(shared, "print", low=True)), no_text, max_words, mask)
        again = store(again.filter("n > 0").join(shared, "print", "left_semi").filter(F.col("f") >= least), "recounted")
        own = own.join(shared, "print", "left_anti").unionByName(again.withColumn("first_doc", F.lit(None).cast("long")))
    return own.drop("print"), words


def _joined(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(
    docs: DataFrame, *, least: int = LEAST, max_words: int = MAX_WORDS, contained: int = CONTAINED, top: int = TOP, id_col: str = "doc_id",
) -> DataFrame:
    """Each language's `top` phrases: lang, rank, phrase, a, l, r, n, score, first_doc.

    a, l and r are the occurrences of the phrase and of its two parts at the cut with the lowest score
    floor(2000000 a / (l + r)), the smallest such cut; n counts all words of the language. A phrase goes if its words
    stand in a longer candidate with at least `contained` percent of its occurrences. Order: score and a falling, phrase.
    A null language is `und`; a null or empty text has no words; repeated rows and ids count again; a language without
    candidates and an empty table give no rows; other columns are ignored. A text longer than a slice is one slice.
    """
    table, words = phrase_counts(docs, least, max_words, id_col)
    table = store(table, "phrase-table")
    candidates = table.filter("n > 1").withColumn("w", F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", "n", F.col("f").alias("a"), "first_doc", "w", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.withColumn("head", _joined(F.col("w"), F.lit(1), F.col("k"))).withColumn("rest", _joined(F.col("w"), F.col("k") + 1, F.col("n") - F.col("k")))
    known = table.select("lang", "phrase", "f")
    cuts = cuts.drop("w").join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = "decimal(20,0)"
    score = F.expr(f"(CAST({SCALE} AS decimal(7,0)) * CAST(a AS {wide})) div (CAST(l AS {wide}) + CAST(r AS {wide}))")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "first_doc").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # Shorter runs of two words or more inside each candidate, with the largest count around them.
    inner = candidates.filter("n > 2").select("lang", "n", "f", "w", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("m"))
    inner = inner.select("lang", "f", "w", "m", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1)).alias("s"))
    inner = inner.select("lang", _joined(F.col("w"), F.col("s"), F.col("m")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    share = F.expr(f"CAST(100 AS {wide}) * CAST(coalesce(around, 0) AS {wide}) < CAST({contained} AS {wide}) * CAST(a AS {wide})")
    kept = worst.join(inner, ["lang", "phrase"], "left").filter(share)
    kept = kept.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"), "first_doc")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "first_doc")
