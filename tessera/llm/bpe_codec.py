"""BPE encoding and decoding: dynamic programming over prefixes.

A text is cut into pieces by the tokenizer's pattern (added tokens first, as the
library does by default).  Every prefix of a piece has one encoding, and that of a
shorter prefix is its beginning, so one token a prefix says it all: its last one.
An automaton over the vocabulary, whose suffix links chain all tokens that end at a
byte, gives the candidates; the one that may stand after the last token of what is
before it is kept.  Two tokens may stand side by side if no merge crosses their seam
when both are undone merge by merge, latest first.  Back-pointers then give the ids.
Work grows with the bytes, whatever the length of a piece.

``encode`` gives ids as unsigned 32-bit little-endian integers in a binary column (the
form of token shards; ``numpy.frombuffer(ids, "<u4")`` reads it), ``decode`` takes that
column.  Each worker remembers the ids of at most ``REMEMBER`` short pieces and the
answers of at most as many seams, which changes speed alone.

Edge cases: a null text counts as empty and has no ids; an empty table gives no rows.
Bytes that are no UTF-8 decode to U+FFFD, ids out of the vocabulary to nothing, both as
the library does.  Very long texts form slices of their own.  Repeated rows are worked
one by one, null ids and columns of any name pass through; a column named like the
result gets its name, the result another, which is returned.  A vocabulary in which a
token has two merges, or none though it is longer than a byte, is refused: there the
last token of a prefix says less.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import annotate, free_name
from .token_counts import PATTERN, _byte_letters

REMEMBER = 500_000
#: Pieces up to this length are remembered.
SHORT = 64
NEVER = 1 << 60


class Codec:
    """The tokenizer of one file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        code = lambda s: bytes(letters[c] for c in s)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take white space or need word ends are not supported")
        number = {code(s): i for s, i in spec["model"]["vocab"].items() if s not in added}
        size = 1 + max([*number.values(), *added.values()])
        #: id -> bytes; of merges: id -> rank (bytes: -1), left and right part; (left, right) -> rank.
        self.bytes: list[bytes] = [b""] * size
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pairs: dict[tuple[int, int], int] = {}
        for token, i in [*number.items(), *((s.encode(), i) for s, i in added.items())]:
            self.bytes[i] = token
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = map(code, pair if isinstance(pair, list) else pair.split(" "))
            i = number[a + b]
            if self.rank[i] >= 0:
                raise ValueError(f"two merges make token {i}")
            self.rank[i], self.left[i], self.right[i] = rank, number[a], number[b]
            self.pairs[number[a], number[b]] = rank
        if any(bytes([b]) not in number for b in range(256)) or any(len(t) > 1 and self.rank[i] < 0 for t, i in number.items()):
            raise ValueError("every byte must be a token, and every longer token have a merge")
        self.length = [len(t) for t in self.bytes]
        self.whole: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in number.items():
            if self.is_whole(i):
                self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pattern = regex.compile(PATTERN)
        self.added = added
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.known: dict[str, bytes] = {}
        self.seams: dict[tuple[int, int], bool] = {}

    def quiet(self, a: int, b: int, upto: int = NEVER) -> bool:
        """No merge below rank ``upto`` crosses the seam of ``a`` and ``b`` while they are made.

        ``x`` and ``y`` are the symbols on either side, taken back in time; each stands
        until the merge that takes it in.  Of merges of one rank the left one comes first,
        so at an equal rank the seam loses to the left side and beats the right one."""
        pairs, rank = self.pairs, self.rank
        x, y, x_until, y_until = a, b, upto, upto
        while True:
            seam = pairs.get((x, y))
            if seam is not None and seam < x_until and seam <= y_until:
                return False
            if rank[x] > rank[y]:
                x_until, x = rank[x], self.right[x]
            elif rank[y] >= 0:
                y_until, y = rank[y], self.left[y]
            else:
                return True

    def is_whole(self, token: int) -> bool:
        """The token's own bytes are encoded as this token."""
        if token not in self.whole:
            stack = [token]
            while stack:
                t = stack[-1]
                if self.rank[t] < 0:
                    self.whole[t] = True
                elif missing := [p for p in (self.left[t], self.right[t]) if p not in self.whole]:
                    stack += missing
                    continue
                else:
                    l, r = self.left[t], self.right[t]
                    self.whole[t] = self.whole[l] and self.whole[r] and self.quiet(l, r, self.rank[t])
                stack.pop()
        return self.whole[token]

    def last_tokens(self, piece: bytes) -> list[int]:
        """The last token of the encoding of each prefix."""
        last, length, seams = [-1] * len(piece), self.length, self.seams
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            if last[end] >= 0:
                continue
            before = end - length[token]
            if before < 0:
                last[end] = token
                continue
            pair = (last[before], token)
            fits = seams.get(pair)
            if fits is None:
                if len(seams) >= REMEMBER:
                    seams.clear()
                fits = seams[pair] = self.quiet(*pair)
            if fits:
                last[end] = token
        return last

    def piece_ids(self, piece: bytes) -> bytes:
        last, out, at = self.last_tokens(piece), [], len(piece) - 1
        while at >= 0:
            out.append(last[at])
            at -= self.length[last[at]]
        return np.array(out[::-1], "<u4").tobytes()

    def _ids(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            found = self.piece_ids(piece.encode())
            if len(piece) <= SHORT:
                if len(self.known) >= REMEMBER:
                    self.known.clear()
                self.known[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        find, ids = self.pattern.findall, self._ids
        if self.split_added is None or not any(s in text for s in self.added):
            return b"".join(map(ids, find(text)))
        out = []
        for i, part in enumerate(self.split_added.split(text)):
            out += [self.added[part].to_bytes(4, "little")] if i % 2 else map(ids, find(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4")
        numbers = numbers[numbers < len(self.bytes)]
        return b"".join(map(self.bytes.__getitem__, numbers.tolist())).decode("utf-8", "replace")


_loaded: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, text: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` (or its columns ``carry``) with a struct column that holds ``ids``, and that
    column's name.  ``path``: the tokenizer's file, on every executor."""

    def run(texts: list[bytes]) -> dict[str, object]:
        codec = _codec(path)
        return {"ids": [codec.encode(t.decode()) for t in texts]}

    return _made(docs, run, "ids", T.BinaryType(), carry, text)


def decode(tokens: DataFrame, path: str, ids: str = "ids", carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """``tokens`` (or its columns ``carry``) with a struct column that holds ``decoded``, the
    text of the binary column ``ids``, and that column's name."""

    def run(rows: list[bytes]) -> dict[str, object]:
        codec = _codec(path)
        return {"decoded": [codec.decode(r) for r in rows]}

    return _made(tokens, run, "decoded", T.StringType(), carry, ids)


def _made(df: DataFrame, run: Callable[[list[bytes]], dict[str, object]], field: str, kind: T.DataType, carry: list[str] | None, column: str) -> tuple[DataFrame, str]:
    name = free_name(df, field)
    return annotate(df, run, T.StructType([T.StructField(field, kind)]), name, carry, column), name
