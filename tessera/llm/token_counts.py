"""Token counts: byte-pair merging with a heap and a linked list.

A text is cut into pieces by the tokenizer's pattern (special strings first, as
the library does by default).  For a piece, its bytes are the initial symbols of
a linked list; a heap of adjacent pairs gives the lowest-ranked pair again and
again, which merges two neighbours into one.  The count is the number of bytes
minus the number of merges; no identifiers are made.

Each worker remembers the counts of at most ``REMEMBER`` pieces, which changes
speed alone.  Ranks come from the tokenizer's file, whose path is a parameter.

Edge cases: null and empty texts have 0 bytes and 0 tokens.  Very long texts
form slices of their own and a piece's cost grows as n log n.  Repeated rows
are counted one by one; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, free_name

LIMIT = 512
REMEMBER = 500_000
RESULT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

#: Fixed: the pattern of the byte-level tokenizer, with white space spelled out as Unicode's property.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1
    for itself, the others in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PieceCounts(dict):
    """Piece (as str) -> number of tokens."""

    def __init__(self, path: str):
        super().__init__()
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        code = lambda s: bytes(letters[c] for c in s)
        number = {bytes([b]): b for b in range(256)}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> (rank, merged symbol)
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = map(code, pair if isinstance(pair, list) else pair.split(" "))
            merged = number.setdefault(a + b, len(number))
            self.merges.setdefault((number[a], number[b]), (rank, merged))
        self.whole = set(number)
        self.pattern = regex.compile(PATTERN)
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        self[piece] = n = self.merge(piece.encode())
        return n

    def merge(self, piece: bytes) -> int:
        n = len(piece)
        if n < 2:
            return n
        symbol, merges = list(piece), self.merges
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(*found, i) for i in range(n - 1) if (found := merges.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        count = n
        while heap:
            rank, merged, i = heapq.heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j < 0 or merges.get((symbol[i], symbol[j])) != (rank, merged):
                continue  # one of the two has been merged meanwhile
            count -= 1
            symbol[i], symbol[j] = merged, -1
            k = after[i] = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if found := merges.get((merged, symbol[k])):
                    heapq.heappush(heap, (*found, i))
            h = before[i]
            if h >= 0 and (found := merges.get((symbol[h], merged))):
                heapq.heappush(heap, (*found, h))
        return count

    def count(self, text: str) -> int:
        total, parts = 0, [text]
        for s in self.special:
            if s in text:
                parts = [x for p in parts for x in p.split(s)]
                total += len(parts) - 1
        find, get = self.pattern.findall, self.__getitem__
        return total + sum(sum(map(get, find(p))) for p in parts)


_loaded: dict[str, PieceCounts] = {}


def _counts(path: str) -> PieceCounts:
    if path not in _loaded:
        _loaded[path] = PieceCounts(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT, carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` (or its columns ``carry``) with a struct of RESULT's fields, and
    the name of that column.  ``path``: the tokenizer's file, on every executor."""

    def run(texts: list[bytes]) -> dict[str, object]:
        counts = _counts(path)
        n = np.fromiter((counts.count(t.decode()) for t in texts), np.int64, len(texts))
        return {"n_bytes": [len(t) for t in texts], "n_tokens": n, "over_limit": n > limit}

    name = free_name(docs, "tokens")
    return annotate(docs, run, RESULT, name, carry, text), name
