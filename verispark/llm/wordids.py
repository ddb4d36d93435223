"""Ids of the word vocabulary for whole texts, with one encoding per different word.

The vocabulary lower-cases, drops white space and never joins across it, so a text's ids are the ids of its
words in a row. A task keeps the ids of the words it has met, bounded in bytes, and encodes only new ones. New words of
Latin letters go through a merge engine fed with the file's own merges, where the mark of a word's end is one
extra byte; all others go through the `tokenizers` library itself. Tests hold both against that library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable

CACHE_BYTES = 32 << 20
_ENTRY = 190  # bytes of a dictionary's place and two short objects, besides their contents

# The pre-token pattern of the vocabulary file, in the classes of the standard library.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\s\w]+|_+")
# Words for the merge engine: printable ASCII and composed Latin letters, without numeric signs such as ², ½.
_PLAIN = re.compile(r"[!-~À-ſ]+\Z")
_PLAIN_UNDERSCORE = re.compile(r"[^\s\w]_|_[^\s\w]")
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c\x85\xa0  -     　]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class WordIds:
    """Little-endian unsigned 32-bit ids of texts, as bytes."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, signs = model["vocab"], _byte_signs()
        end = model["end_of_word_suffix"]
        by_byte = {b: s for s, b in signs.items()}
        # The engine merges the pair whose result has the lowest rank, so ids that follow the merge order serve as ranks.
        ranks = {bytes([b]): vocab[by_byte[b]] for b in range(256)} | {bytes([b, 255]): vocab[by_byte[b] + end] for b in range(255)}
        last = max(ranks.values())
        for merge in model["merges"]:
            first, second = merge.split(" ") if isinstance(merge, str) else merge
            whole = first + second
            if vocab[whole] <= last:
                raise ValueError("the vocabulary's ids must follow the order of its merges")
            last = vocab[whole]
            ended = whole.endswith(end)
            ranks[bytes(signs[s] for s in whole.removesuffix(end)) + (b"\xff" if ended else b"")] = last
        self.engine = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
        self.known = _Known(self._new, cache_bytes)
        self.marks = {m: array("I", piece_ids).tobytes() for m in ".,;:!?" for piece_ids in [self.engine._encode_single_piece(m.encode() + b"\xff")]}

    def _new(self, word: str) -> bytes:
        piece_ids = self.engine._encode_single_piece
        if word.isascii():
            low = word.lower()
            if low.isalpha():
                return array("I", piece_ids(low.encode() + b"\xff")).tobytes()
            if low[-1] in self.marks and low[:-1].isalpha():
                return self.known[low[:-1]] + self.marks[low[-1]]
        else:
            low = unicodedata.normalize("NFC", word).lower()
        if not _PLAIN.match(word) or ("_" in word and _PLAIN_UNDERSCORE.search(word)):
            return array("I", self.exact.encode(word, add_special_tokens=False).ids).tobytes()
        out = array("I")
        for piece in _PIECES.findall(low):
            out.extend(piece_ids(piece.encode() + b"\xff"))
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        words = _SPACE.split(text) if _ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.known.__getitem__, words))


class _Known(dict):
    """Ids of the words met so far; emptied when they have grown to the bound in bytes."""

    def __init__(self, new: Callable[[str], bytes], limit: int) -> None:
        self.new, self.limit, self.held = new, limit, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.new(word) if word else b""
        self.held += 4 * len(word) + len(ids) + _ENTRY
        if self.held > self.limit:
            self.forget()
        self[word] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.held = 0


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One encoder per Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]
