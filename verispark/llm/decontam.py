"""Benchmark decontamination by template canonicalisation.

Words become template words: numbers, units and names turn into typed placeholders, all else is lower-cased and
stripped of punctuation. Windows of template words of the benchmark and of the documents meet in a hash join, so an
item is found even if its numbers or names were changed. Plain windows of all words in lower case, without types and
with any number of literal words, meet in the same join: a passage that stands there word for word is found whatever it
is made of. The matched windows of one passage are then checked: a slot value that stands twice in the item must have
been replaced by one and the same value, unless a plain window holds it. What is left must cover a share of the item.

A bitmap of the benchmark's window hashes (of fixed size) goes to every task and keeps other windows out of the join;
the join itself is exact, and works for a benchmark of any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verispark.llm.textbytes import Texts, lower_ascii, mix, sequence_hashes, slices, span_hashes, word_spans
from verispark.operators.ordered import without_ids

WIDTH = 8  # words of a window; a shorter item is one window of its own length
MIN_LITERALS = 4  # a template window with fewer words that are not placeholders says too little
MIN_COVERAGE = 0.6
BITMAP_WORDS = 1 << 17  # 64-bit words of the bitmap: 1 MB
CLUSTER_GAP = 16  # words by which the alignment may shift within one passage

LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
PLAIN, TEMPLATE = 0, 1  # forms of windows
FORMS = (PLAIN, TEMPLATE)

# Words for units of measure and money.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres",
    "kilometer", "kilometers", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ounce", "ounces", "ton", "tons",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days",
    "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "degrees", "mph", "kmh",
)

_CLASS = np.zeros(256, np.uint8)  # 1: ASCII punctuation, 2: digit
for _b in range(33, 127):
    _CLASS[_b] = 2 if chr(_b).isdigit() else 0 if chr(_b).isalpha() else 1


def _hash_words(words: tuple[str, ...]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return np.sort(span_hashes(data, starts, ends))


_UNIT_HASHES = _hash_words(UNITS)
_TYPE_HASHES = mix(np.array([0, 101, 102, 103], np.uint64))


class Templates:
    """Template words of a slice of documents: document, type, value hash (what stands there), template hash."""

    def __init__(self, texts: Texts) -> None:
        raw = texts.data
        data = lower_ascii(raw)
        after_c3 = np.zeros(len(raw), bool)
        if len(raw):
            after_c3[1:] = raw[:-1] == 0xC3
            capital_latin = after_c3 & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
            data = np.where(capital_latin, data + np.uint8(32), data)  # É is É's small letter 32 further
        starts, ends, doc = word_spans(raw, texts.offsets)
        kind = _CLASS[raw]
        if len(starts):
            at = np.arange(len(raw))
            # Strip punctuation from both ends: next and previous byte that is none.
            following = np.minimum.accumulate(np.where(kind != 1, at, len(raw))[::-1])[::-1]
            before = np.maximum.accumulate(np.where(kind != 1, at, -1))
            left, right = following[starts], before[ends - 1] + 1
            closes = np.isin(raw[ends - 1], np.frombuffer(b".!?:", np.uint8))
            keep = left < right
            keep &= (left < ends) & (right > starts)
            opens = np.ones(len(starts), bool)
            opens[1:] = closes[:-1] | (doc[1:] != doc[:-1])
            starts, ends, doc, opens = left[keep], right[keep], doc[keep], opens[keep]
        else:
            opens = np.zeros(0, bool)
        self.doc = doc
        self.value = span_hashes(data, starts, ends)
        digits = np.concatenate([[0], np.cumsum(kind == 2)])
        first = raw[starts] if len(starts) else np.zeros(0, np.uint8)
        second = raw[np.minimum(starts + 1, len(raw) - 1)] if len(starts) else first
        capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
        # A word all in capitals is no name: such texts write every word so.
        small = np.concatenate([[0], np.cumsum(((raw >= 97) & (raw <= 122)) | (after_c3 & (raw >= 0xA0)))]) if len(raw) else np.zeros(1, np.int64)
        capital &= small[ends] > small[starts]
        found = np.searchsorted(_UNIT_HASHES, self.value)
        unit = _UNIT_HASHES[np.minimum(found, len(_UNIT_HASHES) - 1)] == self.value
        self.type = np.select([digits[ends] > digits[starts], unit, capital & ~opens], [NUMBER, UNIT, NAME], LITERAL).astype(np.int8)
        self.template = np.where(self.type == LITERAL, self.value, _TYPE_HASHES[self.type])

    def windows(self, width: int, form: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, document and first word of each window of a form.

        A template window without a placeholder is the plain window of the same words, so it is left to that form.
        """
        if form == PLAIN:
            hashes, doc, at = sequence_hashes(self.value, self.doc, width)
        else:
            hashes, doc, at = sequence_hashes(self.template, self.doc, width)
            before = np.concatenate([[0], np.cumsum(self.type == LITERAL)])
            literals = before[at + width] - before[at]
            kept = (literals >= min(MIN_LITERALS, width)) & (literals < width)
            hashes, doc, at = hashes[kept], doc[kept], at[kept]
        return hashes ^ np.uint64(width + 16 * form), doc, at


def _rows(values: np.ndarray, at: np.ndarray, width: int, kind: pa.DataType) -> pa.Array:
    return pa.array(list(values[at[:, None] + np.arange(width)]), pa.list_(kind))


_WINDOW_FIELDS = "{0} {1}, hash long, {2}_form byte, {2}_at int, {2}_words int, {2}_types array<byte>, {2}_values array<long>"


def _windows_of(rows: DataFrame, id_name: str, side: str, shapes: list[tuple[int, int]] | None, bitmap: np.ndarray | None) -> DataFrame:
    """Windows of (id, text) rows, of the widths and forms of `shapes`.

    Without `shapes` each text has all forms of WIDTH or, if shorter, of its own length.
    """
    schema = _WINDOW_FIELDS.format(id_name, rows.schema[id_name].dataType.simpleString(), side)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                t = Templates(texts)
                sizes = np.bincount(t.doc, minlength=len(texts))
                firsts = np.concatenate([[0], np.cumsum(sizes)])
                for width, form in shapes or product(range(1, WIDTH + 1), FORMS):
                    hashes, doc, at = t.windows(width, form)
                    if shapes is None:
                        mine = (sizes[doc] == width) if width < WIDTH else sizes[doc] >= WIDTH
                    else:
                        slot = hashes % np.uint64(64 * BITMAP_WORDS)
                        mine = (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                    if not mine.any():
                        continue
                    hashes, doc, at = hashes[mine], doc[mine], at[mine]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(doc + texts.first)), pa.array(hashes.view(np.int64)), pa.array(np.full(len(at), form, np.int8)), pa.array((at - firsts[doc]).astype(np.int32)),
                        pa.array(sizes[doc].astype(np.int32)), _rows(t.type, at, width, pa.int8()), _rows(t.value.view(np.int64), at, width, pa.int64()),
                    ], [id_name, "hash", f"{side}_form", f"{side}_at", f"{side}_words", f"{side}_types", f"{side}_values"])

    return rows.mapInArrow(cut, schema)


def _coverage(matches: pd.DataFrame) -> tuple[float, int, int, int]:
    """Best passage of one document and item: covered share of the item, first and last word, changed slots."""
    matches = matches.assign(shift=matches["doc_at"] - matches["item_at"]).sort_values(["shift", "doc_at", "item_at"])
    passage = (matches["shift"].diff().fillna(0) > CLUSTER_GAP).cumsum()
    best = (-1.0, 0, 0, 0)
    for _, rows in matches.groupby(passage):
        slots: dict[tuple[int, int], set[int]] = {}
        covered: dict[int, tuple[int, int, int]] = {}
        plain: set[int] = set()  # words that stand there unchanged
        for r in rows.itertuples():
            for k, (kind, theirs, ours) in enumerate(zip(r.item_types, r.item_values, r.doc_values)):
                if r.item_form == PLAIN:
                    plain.add(r.item_at + k)
                    covered[r.item_at + k] = (kind, theirs, ours)
                else:
                    covered.setdefault(r.item_at + k, (kind, theirs, ours))
        for kind, theirs, ours in covered.values():
            if kind != LITERAL:
                slots.setdefault((kind, theirs), set()).add(ours)
        # A repeated slot that got several values is no consistent change: none of its words counts but those of plain windows.
        good = [v for at, v in covered.items() if v[0] == LITERAL or at in plain or len(slots[v[:2]]) == 1]
        width = len(rows["item_types"].iloc[0])
        share = len(good) / max(1, int(rows["item_words"].iloc[0]))
        changed = sum(1 for kind, theirs, ours in good if theirs != ours)
        best = max(best, (share, -int(rows["doc_at"].min()), int(rows["doc_at"].max()) + width - 1, changed))
    return best[0], -best[1], best[2], best[3]


def contaminated(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, coverage, first_word, last_word, changed_slots.

    Documents without any item have no row. Null texts hold nothing; an item without words is never found,
    and one without enough literal words only where its words stand unchanged but for their case. Rows with one id count as one document, null ids too. Only the id and text columns are read.
    """
    asked = docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string")).filter("text IS NOT NULL")
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col("text").cast("string")).filter("text IS NOT NULL")
    item_windows = _windows_of(items, "item_id", "item", None, None)
    width = F.size("item_types").alias("width")
    slot = F.pmod(F.col("hash").bitwiseAND(F.lit((1 << 63) - 1)), F.lit(64 * BITMAP_WORDS))  # the size is a power of two
    # At most BITMAP_WORDS rows for each width and form, whatever the benchmark's size.
    bits = item_windows.select(width, F.col("item_form").alias("form"), F.shiftright(slot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    words = bits.groupBy("width", "form", "word").agg(F.bit_or("bit").alias("bits")).collect()
    bitmap = np.zeros(BITMAP_WORDS, np.uint64)
    for r in words:
        bitmap[r["word"]] |= np.uint64(r["bits"] & ((1 << 64) - 1))
    shapes = sorted({(r["width"], r["form"]) for r in words})
    doc_windows = _windows_of(asked, "doc_id", "doc", shapes or [(WIDTH, PLAIN)], bitmap)
    # Template windows without a change are plain windows too: one row is enough.
    same_words, same_types = F.col("doc_values") == F.col("item_values"), F.col("doc_types") == F.col("item_types")
    met = doc_windows.join(item_windows, "hash").filter(F.col("doc_form") == F.col("item_form")).filter(
        F.when(F.col("item_form") == PLAIN, same_words).otherwise(same_types & ~same_words))
    schema = f"doc_id {asked.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, coverage double, first_word int, last_word int, changed_slots int"

    def check(group: pd.DataFrame) -> pd.DataFrame:
        share, first, last, changed = _coverage(group)
        return pd.DataFrame({"doc_id": group["doc_id"].iloc[:1], "item_id": group["item_id"].iloc[:1], "coverage": [share], "first_word": [first], "last_word": [last], "changed_slots": [changed]})

    return met.drop("hash", "doc_form", "doc_types", "doc_words").groupBy("doc_id", "item_id").applyInPandas(check, schema).filter(F.col("coverage") >= min_coverage)


def clean_documents(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` that hold no benchmark item; all their columns are kept, and so are rows with a null id."""
    return without_ids(docs, contaminated(docs, benchmark, min_coverage, id_col).select("doc_id"), id_col)
