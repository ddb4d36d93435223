"""Best-fit packing of documents into sequences of a fixed number of tokens.

Method: exact-complement hashing over the lengths. The pieces' lengths are counted (at most `capacity`
different ones, whatever the corpus), and a plan is made on the counts: for the longest open length the gap is
looked up among the single lengths, the sums of pairs and the sums of triples that are still available; a
combination that fills the gap is used as often as its counts allow. Where none fills it, the largest length
that fits goes in (best fit) and the rest of the gap is looked up again. Every step uses up at least one
length, so the plan has a bounded number of patterns. Spark then ranks the pieces of each length and reads
sequence and offset off the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verispark.llm.tables import store
from verispark.llm.wordids import word_ids

# Rows of one (length, salt) group that are ranked in one task.
GROUP_ROWS = 100_000

PIECE_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of every document's ids and the separator; only documents longer than `capacity` are cut.

    A null text counts as empty and gives one piece with the separator alone. `with_ids` adds the ids.
    Repeated rows are documents of their own; other columns are ignored.
    """
    end = int(separator).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            ids_rows: list[bytes] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        ids_rows.append(part)
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, np.uint32).astype(np.int32).tolist() for x in ids_rows], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)
        encoder.known.forget()  # the worker goes on to other tasks

    return docs.mapInArrow(cut, PIECE_COLUMNS + (", ids array<int>" if with_ids else ""))


def make_plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence, longest first) and how often each is used."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns: list[tuple[list[int], int]] = []

    def usable(reduced: dict[int, int]) -> np.ndarray:
        have = left > 0
        for length, n in reduced.items():
            have[length] = left[length] > n
        return have

    def complement(gap: int, taken: dict[int, int]) -> list[int] | None:
        """One, two or three available lengths that fill the gap exactly, larger ones first."""
        have = usable(taken)
        if have[gap]:
            return [gap]

        def fits(parts: list[int]) -> bool:
            return all(left[x] - taken.get(x, 0) >= parts.count(x) for x in parts)

        def pair(total: int, most: int) -> list[int] | None:
            low = np.flatnonzero(have[1 : total // 2 + 1] & have[total - 1 : total - total // 2 - 1 : -1]) + 1 if total > 1 else []
            for small in low:
                large = total - int(small)
                if large <= most and fits([large, int(small)]):
                    return [large, int(small)]
            return None

        found = pair(gap, gap)
        if found:
            return found
        for first in np.flatnonzero(have[: gap - 1])[::-1]:
            first = int(first)
            if first * 3 < gap:
                break
            rest = pair(gap - first, first)
            if rest and fits([first, *rest]):
                return [first, *rest]
        return None

    for length in range(capacity, 0, -1):
        while left[length] > 0:
            pattern, taken, gap = [length], {length: 1}, capacity - length
            while gap:
                parts = complement(gap, taken)
                if parts is None:
                    fitting = np.flatnonzero(usable(taken)[: gap + 1])
                    if not len(fitting):
                        break
                    parts = [int(fitting[-1])]
                for x in parts:
                    pattern.append(x)
                    taken[x] = taken.get(x, 0) + 1
                    gap -= x
            times = min(int(left[x]) // n for x, n in taken.items())
            for x, n in taken.items():
                left[x] -= n * times
            patterns.append((pattern, times))
    return patterns


def plan_slots(patterns: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, first sequence, offset, repetitions in a pattern), by rank."""
    used: dict[int, int] = {}
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for pattern, times in patterns:
        runs: dict[int, int] = {}
        for x in pattern:
            runs[x] = runs.get(x, 0) + 1
        offset = 0
        for x in sorted(runs, reverse=True):
            at = used.get(x, 0)
            slots.setdefault(x, []).append((at, sequence, offset, runs[x]))
            used[x] = at + runs[x] * times
            offset += x * runs[x]
        sequence += times
    return {x: np.array(rows, np.int64) for x, rows in slots.items()}


def place(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces."""
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan_slots(make_plan(counts, capacity))
    salts = max(16, -(-max(counts.values(), default=0) // GROUP_ROWS) * 4)
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    base = (
        salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
        .withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"))
        .drop("_n")
    )
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(within)).join(base, ["length", "_salt"])
    ranked = ranked.select(*cut.columns, (F.col("_rank") + F.col("_base") - 1).cast("long").alias("_rank"))
    schema = StructType(list(cut.schema.fields)).add("sequence_id", "long").add("offset", "long")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            ranks = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for x in np.unique(lengths):
                at = np.flatnonzero(lengths == x)
                table = slots[int(x)]
                row = table[np.searchsorted(table[:, 0], ranks[at], side="right") - 1]
                k = ranks[at] - row[:, 0]
                sequence[at] = row[:, 1] + k // row[:, 3]
                offset[at] = row[:, 2] + (k % row[:, 3]) * x
            arrays = [*batch.columns[:-1], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return ranked.mapInArrow(assign, schema)


def best_fit_packing(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece with its sequence and its place in it; offsets of a sequence have no gaps.

    Columns: doc_id, piece, start, length, ids_crc32, ids (when asked for), sequence_id, offset. Null and empty
    texts give the separator alone, an empty table no rows, repeated rows are packed each for itself; a null id stays null.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return place(store(pieces(chosen, tokenizer, capacity, separator, with_ids), "pieces"), capacity)
