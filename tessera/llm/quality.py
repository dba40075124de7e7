"""Quality rules by suffix-array repetition.

Every text gets base counts and, from a suffix array over its words, the
longest-common-prefix (LCP) intervals: a word position is covered when its suffix
shares at least ``MIN_REPEAT`` words with a neighbour in the array, which are
just the spans of the maximal repeated substrings.  Their union gives the
covered share of the text, the largest LCP the longest repeat.

The array is built for a slice of texts at once by prefix doubling in numpy.
Words carry their text's number, so no repeat crosses texts.  A text without a
repeated window of MIN_REPEAT words (most) is settled before the full sort.

Edge cases: null and empty texts have counts of 0, fail the base rule and are
not kept.  Very long texts form slices of their own; memory follows the longest
text.  Repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, free_name

MIN_WORDS = 20
WINDOW = 8
#: Per cent of the words that may lie in repeated windows.
MAX_REPEAT_WORDS = 30
#: Shortest repeat, in words, that the suffix array reports.
MIN_REPEAT = 4
#: Largest share of a text that repeats may cover, and largest share of it that
#: one repeat may be long (counted from LONGEST words up).
MAX_COVERED = 0.40
MAX_LONGEST = 0.25
LONGEST = 40

RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "n_repeats")]
    + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]
)

_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))
_IN_WORD = ~_SPACE & ((np.arange(256) & 0xC0) != 0x80)  # one for each code point of a word
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order-preserving ranks, and how often each position's key occurs."""
    n = len(key)
    bits = n.bit_length()
    if n and int(key.max()) < 1 << (63 - bits):  # one sort of (key, position) in a single integer
        packed = np.sort((key << bits) | np.arange(n))
        at, key = packed & ((1 << bits) - 1), packed >> bits
        group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        rank = np.empty(n, np.int64)
        rank[at] = group
        return rank, np.bincount(group)[rank]
    _, rank, times = np.unique(key, return_inverse=True, return_counts=True)
    return rank, times[rank]


def _repeated(rank: np.ndarray, doc: np.ndarray, upto: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For h = 2, 4, ... upto: positions whose h-gram occurs again in the same
    text, and the gram's number.  Words that do not (rank -1) are in no such gram,
    and only survivors of h go on to 2h."""
    n = len(rank)
    at = np.flatnonzero(rank >= 0)
    group = rank[at]
    out, h = {}, 1
    while h < upto:
        nxt = at + h
        full = np.full(n, -1, np.int64)
        full[at] = group
        ok = nxt < n
        ok[ok] = (full[nxt[ok]] >= 0) & (doc[nxt[ok]] == doc[at[ok]])
        at, key = at[ok], full[at[ok]] * n + full[nxt[ok]]
        group, times = _dense(key) if len(key) else (key, key)
        at, group = at[times > 1], group[times > 1]
        h *= 2
        out[h] = at, group
    return out


def _longest_common(rank: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of texts whose words start as ``rank`` (distinct across
    texts), and the LCP in words of each suffix with the one before it."""
    n = len(rank)
    last = np.append(np.flatnonzero(np.diff(doc)), n - 1)
    end = last[np.searchsorted(last, np.arange(n))] + 1
    levels, h = [rank], 1
    while True:
        nxt = np.arange(n) + h
        inside = nxt < end
        second = np.zeros(n, np.int64)
        second[inside] = levels[-1][nxt[inside]] + 1
        new, times = _dense(levels[-1] * (n + 1) + second)
        levels.append(new)
        h *= 2
        if times.max(initial=1) == 1:
            break
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, np.int64)
    same = np.zeros(n - 1, np.int64)
    end_a, end_b = end[a], end[b]
    for k in range(len(levels) - 2, -1, -1):  # binary lifting over the levels' ranks
        step = 1 << k
        can = (a + step <= end_a) & (b + step <= end_b)
        eq = can.copy()
        eq[can] = levels[k][a[can]] == levels[k][b[can]]
        same[eq] += step
        a[eq] += step
        b[eq] += step
        live = (a < end_a) & (b < end_b)
        a, b = np.where(live, a, order[:-1]), np.where(live, b, order[1:])
        end_a, end_b = np.where(live, end_a, 0), np.where(live, end_b, 0)
    lcp[1:] = same
    return order, lcp


def _cover(at: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Mask of the positions in any span [at, at + length)."""
    edge = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + length, minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The fields of RESULT for some texts."""
    m = len(texts)
    words = [t.split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, m)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = int(starts[-1])
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, m))])

    def per_text(mask: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[edges[1:]] - total[edges[:-1]]

    out = {
        "n_words": sizes,
        "word_chars": per_text(_IN_WORD[buffer], at),
        "n_symbols": per_text(_SYMBOL[buffer], at),
        "n_dup_lines": np.fromiter(map(_dup_lines, texts), np.int64, m),
        **{k: np.zeros(m, np.int64) for k in ("n_repeat_words", "covered_words", "longest_repeat", "n_repeats")},
    }
    if n:
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, n)
        doc = np.repeat(np.arange(m), sizes)
        key = doc * len(number) + ids
        first, times = _dense(key)
        first = np.where(times > 1, first, -1)
        grams = _repeated(first, doc, WINDOW)
        out["n_repeat_words"] = per_text(_cover(grams[WINDOW][0], WINDOW, n), starts)
        hit = np.unique(doc[grams[MIN_REPEAT][0]])
        if len(hit):  # the suffix array of the texts that repeat anything
            own = np.flatnonzero(np.isin(doc, hit))
            rank, _ = _dense(key[own])
            order, lcp = _longest_common(rank, doc[own])
            best = np.maximum(lcp, np.append(lcp[1:], 0))
            inside = best >= MIN_REPEAT
            span_at, span = order[inside], best[inside]
            covered = np.zeros(n, bool)
            covered[own] = _cover(span_at, span, len(own))
            out["covered_words"] = per_text(covered, starts)
            where = doc[own][span_at]
            np.maximum.at(out["longest_repeat"], where, span)
            # an interval opens where the LCP rises to MIN_REPEAT
            opens = (lcp >= MIN_REPEAT) & (np.concatenate([[0], lcp[:-1]]) < MIN_REPEAT)
            out["n_repeats"] = np.bincount(doc[own][order[opens]], minlength=m)
    base = (sizes < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_WORDS * sizes)
    repeats = (out["covered_words"] > MAX_COVERED * sizes) | (
        (out["longest_repeat"] >= LONGEST) & (out["longest_repeat"] > MAX_LONGEST * sizes)
    )
    return out | {"base_failed": base, "kept": ~base & ~repeats}


def judge(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` (or its columns ``carry``) with a struct of RESULT's fields, and
    the name of that column."""
    name = free_name(docs, "quality")
    return annotate(docs, measure, RESULT, name, carry, text), name


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that the rules keep, with their own columns."""
    judged, name = judge(docs, text)
    return judged.where(F.col(f"`{name}`.kept")).select(*(F.col(f"`{c}`") for c in docs.columns))
