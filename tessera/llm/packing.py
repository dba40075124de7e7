"""Packing by vector bin packing, for instruction data.

A sequence holds at most ``max_tokens`` tokens, ``max_segments`` pieces and
``max_loss`` loss-bearing tokens.  Each task packs what it reads: texts longer than a
sequence are cut, the remainders wait in a bounded pool, and a sequence is filled
by the dot-product heuristic: of the pieces that fit all three limits, the one
whose demand has the largest dot product with what is left.  A gap that no piece
fits is filled by cutting one.  A sequence that cannot be filled to the end, and a task's
last pieces, are closed at powers of two, which need no padding.

There is no shuffle: a task's memory is one slice of texts and the pool.
Sequence ids are (task, number within it), so reruns agree.

Edge cases: null and empty texts are the single end token.  Very long texts are
cut as often as needed.  Repeated rows are packed once each; an empty table
gives no rows.  A task's last pieces form a few short sequences.
"""

from __future__ import annotations

import string
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lean, small_batches, text_bytes

MAX_TOKENS = 2048
MAX_SEGMENTS = 512
MAX_LOSS = 2048
POOL = 512
END_ID = 1
REMEMBER = 500_000
KEEP_IDS = 1 << 24
PUNCTUATION = string.punctuation.encode()


class _Places(dict):
    """Word -> where its ids lie (start and length in one integer); a new word is
    encoded on the way."""

    def __init__(self, add: Callable[[bytes], int]):
        super().__init__()
        self.add = add

    def __missing__(self, word: bytes) -> int:
        self[word] = at = self.add(word)
        return at


class WordIds:
    """Ids of words, as the tokenizer gives them for any text that is cut at white
    space (its own first step).  Words are looked up with A-Z lower-cased, which the
    tokenizer's normalizer does as well.  A word of letters goes straight to the
    tokenizer's merge model, and ASCII punctuation after a letter or digit is a piece of
    its own; any other word goes through the whole tokenizer.  Memory is bounded by
    REMEMBER words and KEEP_IDS ids, besides those of one slice."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        from .token_counts import _byte_letters

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = {b: c for c, b in _byte_letters().items()}
        self.reset()

    def reset(self) -> None:
        self.places = _Places(self._add)
        self.flat = array("I", [0])

    def _put(self, ids: Iterable[int]) -> int:
        start = len(self.flat)
        self.flat.extend(ids)
        return start << 32 | len(self.flat) - start

    def _known(self, word: bytes) -> array:
        at = self.places[word]
        return self.flat[at >> 32 : (at >> 32) + (at & 0xFFFFFFFF)]

    def _add(self, word: bytes) -> int:
        if word.isalpha():  # ASCII letters
            return self._put([t.id for t in self.model.tokenize(word.decode())])
        run = word.rstrip(PUNCTUATION)
        if run:
            text = unicodedata.normalize("NFC", run.decode())
            low = "".join(c.lower() for c in text)
            if len(run) < len(word):
                if low[-1].isalnum():
                    return self._put(self._known(run) + self._known(word[len(run) :]))
            elif low.isalpha():
                return self._put([t.id for t in self.model.tokenize(low.encode().decode("latin-1").translate(self.letters))])
        return self._put(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.places) > REMEMBER or len(self.flat) > KEEP_IDS:
            self.reset()
        words = [t.lower().split() if self._plain(t) else None for t in texts]
        flat = list(chain.from_iterable(ws for ws in words if ws))
        at = np.fromiter(map(self.places.__getitem__, flat), np.int64, len(flat))
        start, length = at >> 32, at & 0xFFFFFFFF
        end = np.cumsum(length)
        ids = np.frombuffer(self.flat, np.uint32)[np.repeat(start - end + length, length) + np.arange(end[-1] if len(end) else 0)]
        edges = np.concatenate([[0], end])
        out, n = [], 0
        for text, ws in zip(texts, words, strict=True):
            if ws is None:
                out.append(np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32))
            else:
                out.append(ids[edges[n] : edges[n + len(ws)]])
                n += len(ws)
        return out

    @staticmethod
    def _plain(text: bytes) -> bool:
        """No special string: those are found before the text is cut, in any case of use."""
        return b"<|" not in text


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def _loss(item: tuple) -> int:
    """Loss-bearing tokens of an item or piece."""
    return len(item[2]) if item[4] is None else int(item[4][-1] - item[4][0])


def _fitting(ids: np.ndarray, loss: np.ndarray | None, tokens: int, most: int) -> int:
    """How many of the ids, from the first, are ``tokens`` at most and bear no more loss
    than ``most``."""
    n = min(len(ids), tokens)
    return min(n, most) if loss is None else min(n, int(np.searchsorted(loss, loss[0] + most, "right")) - 1)


class Packer:
    """Pieces of one task.  Items are (row of the slice's bookkeeping, start, ids,
    doc_tokens, loss); ``loss`` counts the loss-bearing tokens before each of the ids and
    after the last, or is None where all bear loss."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, first_id: int):
        self.cap = np.array([max_tokens, max_segments, max_loss], np.float64)
        self.next_id = first_id
        self.items: list[tuple] = []  # key, start, ids, total
        self.rows: list[tuple] = []
        self.losses: list[int] = []  # of the rows

    def add(self, key: object, ids: np.ndarray, bears: np.ndarray | None = None) -> None:
        """``bears``: whether each token bears loss (default: all do)."""
        loss = None if bears is None else np.concatenate([[0], np.cumsum(bears)])
        tokens, most, at, total = int(self.cap[0]), int(self.cap[2]), 0, len(ids)
        while at < total:
            n = _fitting(ids[at:], None if loss is None else loss[at:], tokens, most)
            own = (key, at, ids[at : at + n], total, None if loss is None else loss[at : at + n + 1])
            if at + n == total and n < tokens and _loss(own) < most:
                self.items.append(own)
            else:
                self._close([own])
            at += n

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            key, start, ids, total, _ = piece
            self.losses.append(_loss(piece))
            crc = zlib.crc32(ids.astype("<u4", copy=False).tobytes())
            self.rows.append((key, start, len(ids), crc, total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def pack(self, keep: int) -> None:
        """Close sequences until at most ``keep`` items wait."""
        items = self.items
        size = np.fromiter((len(i[2]) for i in items), np.float64, len(items))
        demand = np.stack([size, np.ones(len(items)), np.fromiter(map(_loss, items), np.float64, len(items))], 1) / self.cap
        open_ = np.ones(len(items), bool)
        while np.count_nonzero(open_) > keep:
            self._fill(items, demand, open_)
        self.items = [items[i] for i in np.flatnonzero(open_)]

    def _fill(self, items: list[tuple], demand: np.ndarray, open_: np.ndarray) -> None:
        """Close one sequence: full, or at the largest power of two.  What it does not take
        of an item stays open."""
        left, chosen = np.ones(3), []
        at = np.flatnonzero(open_)
        while len(at := at[(demand[at] <= left + 1e-9).all(1)]):
            k = int(np.argmax(demand[at] @ left))
            best = int(at[k])
            chosen.append(best)
            open_[best] = False
            left = left - demand[best]
            at = np.delete(at, k)
        total, loss = sum(len(items[i][2]) for i in chosen), sum(_loss(items[i]) for i in chosen)
        rest = np.flatnonzero(open_)
        if total < self.cap[0] and len(rest) and len(chosen) < self.cap[1]:  # nothing fits whole: cut one
            cut = items[rest[-1]]
            if n := _fitting(cut[2], cut[4], int(self.cap[0]) - total, int(self.cap[2]) - loss):
                chosen.append(int(rest[-1]))
                open_[rest[-1]] = False
                total += n
        target = total if total == self.cap[0] else 1 << (total.bit_length() - 1)
        pieces, have = [], 0
        for i in chosen:
            key, start, ids, all_, loss = items[i]
            take = min(len(ids), target - have)
            if take:
                pieces.append((key, start, ids[:take], all_, None if loss is None else loss[: take + 1]))
                have += take
            if take < len(ids):
                items[i] = (key, start + take, ids[take:], all_, None if loss is None else loss[take:])
                demand[i, 0], demand[i, 2] = (len(ids) - take) / self.cap[0], _loss(items[i]) / self.cap[2]
                open_[i] = True
        self._close(pieces)


def _bears(n: int, spans: list) -> np.ndarray:
    """Whether each of n tokens lies in one of the spans (start, end)."""
    out = np.zeros(n, bool)
    for a, b in (s.values() for s in spans):
        out[a:b] = True
    return out


def pack(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int = MAX_LOSS,
    loss: str | None = None,
) -> DataFrame:
    """One row per piece: (key, start, length, ids_crc32, doc_tokens, sequence_id,
    offset).  ``path``: the tokenizer's file, on every executor.  ``loss``: a column of
    arrays of (start, end), the token places of a row that bear loss, as in the answers of
    a conversation (the end token stands after the text's last); where it is null, or without
    such a column, all do.  With it, rows also have ``loss_tokens``."""
    kind = docs.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    schema += ", loss_tokens long" if loss else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(path)
        packer = Packer(max_tokens, max_segments, max_loss, TaskContext.get().partitionId() << 36)
        names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["loss_tokens"] if loss else [])]
        types = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) if packer.rows else [[]] * 7
            columns += [packer.losses] if loss else []
            packer.rows, packer.losses = [], []
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            types = types or [batch.schema.field(key).type, *[pa.int64()] * (len(names) - 1)]
            for part in chunks(batch, text):
                keys = part.column(key).to_pylist()
                spans = part.column(loss).to_pylist() if loss else [None] * len(keys)
                for k, own, bearing in zip(keys, ids.of(text_bytes(part.column(text))), spans, strict=True):
                    own = np.append(own, np.uint32(END_ID))
                    packer.add(k, own, None if bearing is None else _bears(len(own), bearing))
                    if len(packer.items) >= 2 * POOL:
                        packer.pack(POOL)
                yield out()
        if types:
            packer.pack(0)
            yield out()

    need = list(dict.fromkeys([key, text, *([loss] if loss else [])]))
    return small_batches(docs).select(*(F.col(f"`{c}`") for c in need)).mapInArrow(lean(run), schema)
