"""Edit-aware token counts.

Each document's text is cut into segments at places where no pre-token can cross: before a single space that stands
between two signs. A segment tree holds the characters and tokens of the segments and their sums. An edit finds its
segments by descending on the character sums, and only they are encoded again, with a neighbour where the edit made
the cut between them unsafe; the sums on the way to the root follow. The root is the document's count.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT = 256  # characters after which a segment ends at the next safe cut

_SAFE = re.compile(r"(?<=\S) (?=\S)")


def load_encoding(path: str, pattern: str):
    """A byte-level vocabulary of ranks; strings of special tokens are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_LOADED: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """One encoder per Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = load_encoding(path, pattern)
    return _LOADED[path, pattern]


def segments(text: str, size: int = SEGMENT) -> list[str]:
    out, at = [], 0
    while at < len(text):
        cut = _SAFE.search(text, at + size)
        end = cut.start() if cut else len(text)
        out.append(text[at:end])
        at = end
    return out or [""]


class TokenTree:
    """Segments of one text with sums of characters and tokens; leaf k is node `size + k`, node 1 the root."""

    def __init__(self, text: str, encoder, size: int = SEGMENT) -> None:
        self.encoder = encoder
        self.texts = segments(text, size)
        self.size = 1 << (len(self.texts) - 1).bit_length()
        self.chars = [0] * (2 * self.size)
        self.tokens = [0] * (2 * self.size)
        for k, part in enumerate(self.texts):
            self.chars[self.size + k] = len(part)
            self.tokens[self.size + k] = len(encoder.encode_ordinary(part))
        for node in range(self.size - 1, 0, -1):
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
        self.encoded = 0

    @property
    def count(self) -> int:
        return self.tokens[1]

    def leaf(self, at: int) -> tuple[int, int]:
        """Segment that holds character `at` and where it begins; past the end: the last one with text."""
        at = max(0, min(at, self.chars[1] - 1))
        node, begins = 1, 0
        while node < self.size:
            left = self.chars[2 * node]
            if at < begins + left:
                node = 2 * node
            else:
                begins, node = begins + left, 2 * node + 1
        return min(node - self.size, len(self.texts) - 1), begins

    def _set(self, k: int, text: str) -> None:
        self.texts[k] = text
        node = self.size + k
        self.chars[node] = len(text)
        self.tokens[node] = len(self.encoder.encode_ordinary(text)) if text else 0
        self.encoded += len(text)
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, at: int, drop: int, put: str) -> None:
        """Replace `drop` characters from `at` by `put`; places outside the text are moved to its ends."""
        total = self.chars[1]
        at = max(0, min(at, total))
        end = max(at, min(at + drop, total))
        if total == 0:
            self._set(0, put)
            return
        first, begins = self.leaf(at)
        last, last_begins = self.leaf(max(at, end - 1))
        stop = last_begins + len(self.texts[last])
        text = "".join(self.texts[first : last + 1])
        text = text[: at - begins] + put + text[end - begins :]
        # Boundary context: a neighbour joins while the cut towards it is not safe any more.
        while begins > 0 and not self._cut_holds(self.texts[self.leaf(begins - 1)[0]], text, stop):
            first, begins = self.leaf(begins - 1)
            text = self.texts[first] + text
        while stop < total and not (text and not text[-1].isspace()):
            last, _ = self.leaf(stop)
            text += self.texts[last]
            stop += len(self.texts[last])
        for k in range(first + 1, last + 1):
            if self.texts[k]:
                self._set(k, "")
        self._set(first, text)

    def _cut_holds(self, before: str, text: str, stop: int) -> bool:
        head = text[:2]
        if not text and stop < self.chars[1]:
            head = self.texts[self.leaf(stop)[0]][:2]
        return not before[-1].isspace() and len(head) == 2 and head[0] == " " and not head[1].isspace()


EDIT_TYPE = "array<struct<at:int,drop:int,put:string>>"


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Documents with the edits of an edit table (doc_id, edit_no, at, drop, put) as a list in order.

    One document's edits form one row, as they depend on each other.
    """
    packed = edits.groupBy(F.col("doc_id").alias("_doc")).agg(F.array_sort(F.collect_list(F.struct("edit_no", "at", "drop", "put"))).alias("_e"))
    lists = packed.select("_doc", F.transform("_e", lambda e: F.struct(e["at"].cast("int").alias("at"), e["drop"].cast("int").alias("drop"), e["put"].cast("string").alias("put"))).alias("edits"))
    return docs.join(lists, docs["doc_id"].eqNullSafe(F.col("_doc")), "left").drop("_doc")


def edited_token_counts(
    docs: DataFrame, ranks: str, pattern: str, edits_col: str = "edits", id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT,
) -> DataFrame:
    """doc_id, n_edits, tokens_before, tokens_after, reencoded_chars, chars_after for every document.

    Edits (at, drop, put) apply one after the other, each to the text the last one left; `at` counts characters. A null
    text counts as empty, null lists and null edits are skipped, a null `put` inserts nothing, places outside the text
    move to its ends, repeated rows give repeated results, an empty table none; other columns are ignored.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(edits_col).cast(EDIT_TYPE).alias("edits"), F.col(text_col).cast("string").alias("text"))
    schema = chosen.select("doc_id").schema
    for name, kind in (("n_edits", "integer"), ("tokens_before", "long"), ("tokens_after", "long"), ("reencoded_chars", "long"), ("chars_after", "long")):
        schema = schema.add(name, kind)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(ranks, pattern)
        for batch in batches:
            rows = []
            for edits, text in zip(batch.column(1), batch.column(2)):
                tree = TokenTree(text.as_py() or "", encoder, segment)
                before = tree.count
                todo = [e for e in edits.as_py() or [] if e is not None]
                for e in todo:
                    tree.edit(e["at"] or 0, max(0, e["drop"] or 0), e["put"] or "")
                rows.append((len(todo), before, tree.count, tree.encoded, tree.chars[1]))
            columns = list(zip(*rows)) or [()] * 5
            arrays = [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema.names)

    return chosen.mapInArrow(count, schema)


def scrub_edits(text: Column, doc_id: Column) -> Column:
    """Edits a cleaning step makes: a title line, the first e-mail address and phone number masked, the end cut off."""
    email, phone = r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", r"\+[0-9][-0-9 ()]{7,}[0-9]"
    title = F.concat(F.lit("# "), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"))

    def mask(pattern: str, sign: str) -> Column:
        at = F.regexp_instr(text, F.lit(pattern))
        return F.when(at > 0, F.struct((at - 1 + F.length(title)).alias("at"), F.length(F.regexp_extract(text, pattern, 0)).alias("drop"), F.lit(sign).alias("put")))

    # Later places first, so that an earlier edit does not move them.
    masks = F.reverse(F.array_sort(F.array_compact(F.array(mask(email, "<mail>"), mask(phone, "<phone>")))))
    ends = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("drop"), title.alias("put")))
    tail = F.array(F.struct((F.length(text) + F.length(title) - 20).alias("at"), F.lit(20).alias("drop"), F.lit("\n").alias("put")))
    return F.concat(ends, tail, masks)
