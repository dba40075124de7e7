"""Suffix-array dedup with a sparse suffix array.

Suffixes are kept only where a text's ``K``-gram of words has the smallest hash of
``SPAN`` consecutive ones (content-selected minimiser positions), so that every
passage of ``MIN_WORDS`` = K + SPAN - 1 words holds a suffix at the same place
wherever it occurs.

1. Minimisers of all texts; those whose K-gram occurs once are done with (the count
   aggregates before its shuffle).
2. The others get what the comparison needs: their next and previous words, as
   far as a match of MIN_WORDS can reach, in 16 bits a word.
3. Suffixes are sorted over the cluster by range of (K-gram, following words), so
   a passage that a third of all texts share is spread over many tasks.
   Neighbours in the array (up to ``NEAR`` apart) are compared and extended to the right
   and left.  Where more suffixes than that begin with one K-gram, the best partner may
   stand farther off, so the windows of MIN_WORDS around each suffix are held against
   those of all others of the K-gram; of K-grams that several tasks hold, each task
   gives the windows of its smallest id to a join between tasks.  No repeated
   window is lost.
4. Spans of a text are united.

Where ids repeat, are null or no whole numbers, rows are numbered in the order of their
ids (nulls last) and compared by number, so each row counts.

Edge cases: null and empty texts and those below MIN_WORDS have no spans.  Rows that
repeat wholly are texts that match each other, each reported under its id.  A match of a
text with itself counts only where MIN_WORDS words do not overlap.  Very long texts form
slices of their own.  An empty table gives no rows.  Columns other than id and text are
not read; their names may clash with any used here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, chunks, free_name, gram_hashes, lean, mix64, names_rows, small_batches, stash, text_bytes

MIN_WORDS = 50
K = 10
SPAN = MIN_WORDS - K + 1
#: Words to either side that a match of MIN_WORDS around a K-gram may need.
REACH = MIN_WORDS - K
NEAR = 4
#: Suffixes that a task compares at a time.
PIECE = 20_000
#: Distance in words up to which a repeated gram counts as a run.
TIGHT = 4
#: Words at either end of such a run where all suffixes stay.
RIM = 2 * MIN_WORDS + K


def minimisers(grams: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Positions of the smallest of every ``span`` consecutive hashes (the
    leftmost of equal ones).  Inside a long run of equal ones, one in a span stays:
    all windows there are alike, and the run's ends hold a partner for each."""
    n = len(grams)
    if n == 0:
        return np.empty(0, np.int64)
    if n < span:
        at = np.array([int(grams.argmin())], np.int64)
    else:
        best = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(1)
        at = np.unique(best + np.arange(len(best)))
    equal = (grams[at[1:]] == grams[at[:-1]]) & (np.diff(at) <= TIGHT)
    if equal.any():  # a gram that repeats at once (one word over and over): thin out what is far from both ends
        run = np.concatenate([[0], np.cumsum(~equal)])
        first, last = at[np.searchsorted(run, run)], at[np.searchsorted(run, run, "right") - 1]
        inner = (at - first > RIM) & (last - at > RIM)
        keep, before = [], -span
        for p, thin in zip(at.tolist(), inner.tolist(), strict=True):
            if not thin or p - before > span - TIGHT:
                keep.append(p)
                before = p
        at = np.array(keep, np.int64)
    return at


def _rows_of_minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for part in chunks(batch, "text"):
            ids, pos, gram = [], [], []
            for i, t in zip(part.column("id").to_pylist(), text_bytes(part.column("text")), strict=True):
                g = gram_hashes(hashes.of(t.split()), K)
                if len(g) >= SPAN:
                    at = minimisers(g)
                    ids.append(np.full(len(at), i, np.int64))
                    pos.append(at)
                    gram.append(g[at].view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, pos, gram)], ["id", "pos", "gram"])


def _rows_of_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the suffixes in ``at``: the REACH words after the K-gram and, nearest first,
    before it; how many there are."""
    hashes = WordHashes()
    names = ["gram", "after", "before", "id", "pos", "n_after", "n_before"]
    for batch in batches:
        for part in chunks(batch, "text"):
            out = []
            for i, t, at in zip(part.column("id").to_pylist(), text_bytes(part.column("text")), part.column("at"), strict=True):
                words = hashes.of(t.split())
                p = np.unique(np.asarray(at.values.field("pos")))
                p = p[p + K <= len(words)]
                short = np.pad((words >> np.uint64(48)).astype(">u2"), REACH)
                win = np.lib.stride_tricks.sliding_window_view(short, REACH)
                g = gram_hashes(words, K)[p].view(np.int64)
                out.append((g, win[p + K + REACH], win[p][:, ::-1], np.full(len(p), i, np.int64), p, np.minimum(REACH, len(words) - p - K), np.minimum(REACH, p)))
            if out:
                cols = [np.concatenate(x) for x in zip(*out, strict=True)]
                kind = pa.binary(2 * REACH)
                arrays = [pa.FixedSizeBinaryArray.from_buffers(kind, len(c), [None, pa.py_buffer(np.ascontiguousarray(c).tobytes())]).cast(pa.binary()) if c.ndim == 2 else pa.array(c) for c in cols]
                yield pa.RecordBatch.from_arrays(arrays, names)


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(-1, REACH)


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Leading equal words of rows, ``most`` at most."""
    differ = a != b
    return np.minimum(np.where(differ.any(1), differ.argmax(1), REACH), most)


class _Rows:
    """Sorted suffixes as columns."""

    def __init__(self, batch: pa.RecordBatch):
        self.gram, self.id, self.pos, self.n_after, self.n_before = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "id", "pos", "n_after", "n_before"))
        self.after, self.before = _words(batch.column("after")), _words(batch.column("before"))

    def spans(self) -> tuple[np.ndarray, ...]:
        """(id, start, end, id matched) for each near neighbour that a row matches.  Rows
        of K-grams that more than NEAR + 1 hold are left to :meth:`windows`."""
        n = len(self.gram)
        run = np.cumsum(np.concatenate([[True], self.gram[1:] != self.gram[:-1]])) - 1
        few = np.bincount(run)[run] <= NEAR + 1
        found = [(np.empty(0, np.int64),) * 4]
        for d in range(1, min(NEAR, n - 1) + 1):
            i = np.flatnonzero((self.gram[:-d] == self.gram[d:]) & few[d:])
            j = i + d
            r = _common(self.after[i], self.after[j], np.minimum(self.n_after[i], self.n_after[j]))
            l_ = _common(self.before[i], self.before[j], np.minimum(self.n_before[i], self.n_before[j]))
            whole = r + l_ + K
            ok = (whole >= MIN_WORDS) & ((self.id[i] != self.id[j]) | (np.abs(self.pos[i] - self.pos[j]) >= MIN_WORDS))
            for x, y in ((i[ok], j[ok]), (j[ok], i[ok])):
                found.append((self.id[x], self.pos[x] - l_[ok], self.pos[x] + K + r[ok], self.id[y]))
        return _united(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def windows(self, split: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """Spans as above from the windows of MIN_WORDS around the rows of K-grams that
        more than NEAR + 1 rows hold; and (gram, window, id, pos, right) of the smallest
        ids' windows in K-grams of ``split``, which other tasks may hold too."""
        run = np.cumsum(np.concatenate([[True], self.gram[1:] != self.gram[:-1]])) - 1
        shared = np.isin(self.gram, split)
        rows = np.flatnonzero((np.bincount(run)[run] > NEAR + 1) | shared)
        after, before = _prefix_hashes(self.after[rows], self.gram[rows]), _prefix_hashes(self.before[rows], ~self.gram[rows])
        window = mix64(after ^ (before[:, ::-1] * np.uint64(0xD6E8FEB86659FD93)))
        at = np.arange(REACH + 1)
        row, right = np.nonzero((at <= self.n_after[rows][:, None]) & (REACH - at <= self.n_before[rows][:, None]))
        h, row = window[row, right], rows[row]
        order = np.argsort(h)
        twice = np.concatenate([[False], h[order][1:] == h[order][:-1], [False]])
        order = order[twice[1:] | twice[:-1] | shared[row[order]]]
        h, row, right = h[order], row[order], right[order]
        order = np.lexsort((self.pos[row], self.id[row], h))
        h, row, right = h[order], row[order], right[order]
        id_, pos = self.id[row], self.pos[row]
        if not len(h):
            none = np.empty(0, np.int64)
            return (none,) * 4, (none,) * 5
        new = np.concatenate([[True], h[1:] != h[:-1]])
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        last = np.append(first[1:], len(h)) - 1
        least = id_[first][group]
        second = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(second, group[id_ != least], id_[id_ != least])
        second = np.where(second == np.iinfo(np.int64).max, least[first], second)
        far = np.maximum(pos - pos[first][group], pos[last][group] - pos) >= MIN_WORDS
        ok = (id_[last] != id_[first])[group] | far
        spans = (id_[ok], pos[ok] - REACH + right[ok], pos[ok] + K + right[ok], np.where(id_ == least, second[group], least)[ok])
        give = (id_ == least) & shared[row]
        return _united(*spans), (self.gram[row[give]], h[give].view(np.int64), id_[give], pos[give], right[give])


def _prefix_hashes(words: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... REACH words of each row."""
    out = np.empty((len(words), REACH + 1), np.uint64)
    out[:, 0] = mix64(seed.view(np.uint64))
    for i in range(REACH):
        out[:, i + 1] = mix64(out[:, i] + words[:, i].astype(np.uint64))
    return out


def _united(id_: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of an id that share ``other``, united where that leaves no window of
    MIN_WORDS that none of them holds: ``other`` has every window of the result."""
    order = np.lexsort((start, other, id_))
    id_, start, end, other = id_[order], start[order], end[order], other[order]
    if not len(id_):
        return id_, start, end, other
    pair = np.cumsum(np.concatenate([[True], (id_[1:] != id_[:-1]) | (other[1:] != other[:-1])]))
    reach = np.maximum.accumulate(end + (pair << 32)) - (pair << 32)  # largest end so far
    new = np.ones(len(id_), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (start[1:] > reach[:-1] - MIN_WORDS + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(id_)) - 1
    return id_[first], start[first], reach[last], other[first]


_SUFFIX = "gram long, after binary, before binary, id long, pos long, n_after long, n_before long"
_NAMES = ["gram", "after", "before", "id", "pos", "n_after", "n_before"]
#: A span has an end; a window for the join between tasks has a hash instead.
_FOUND = "id long, start long, end long, other long, gram long, window long, pos long, right long"


def _compare(piece: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spans of a task's sorted suffixes, and windows for the join between tasks.  Rows
    are taken up to ``piece`` at a time, whole K-grams if they are shorter than that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(table: pa.Table, split: list[int]) -> pa.RecordBatch:
            rows = _Rows(table.combine_chunks().to_batches()[0])
            more, windows = rows.windows(np.array(split, np.int64))
            spans = [np.concatenate(x) for x in zip(rows.spans(), more, strict=True)]
            n, m = len(spans[0]), len(windows[0])
            gram, window, id_, pos, right = (pa.array(x, pa.int64()) for x in windows)
            i, a, b, o = (pa.array(x, pa.int64()) for x in spans)
            no, nm = pa.nulls(n, pa.int64()), pa.nulls(m, pa.int64())
            cols = [(i, id_), (a, nm), (b, nm), (o, nm), (no, gram), (no, window), (no, pos), (no, right)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in cols], ["id", "start", "end", "other", "gram", "window", "pos", "right"])

        waiting: list[pa.RecordBatch] = []
        held, open_gram, started = 0, None, False
        for batch in (b.slice(at, piece) for b in batches for at in range(0, b.num_rows, piece)):
            if not started:
                started, open_gram = True, batch.column("gram")[0].as_py()
            waiting.append(batch)
            held += batch.num_rows
            if held < piece:
                continue
            table = pa.Table.from_batches(waiting)
            gram = table.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))
            if cut:
                yield compared(table.slice(0, cut), [open_gram])
                waiting = table.slice(cut).combine_chunks().to_batches()
            else:  # one K-gram fills the piece
                open_gram = int(gram[-1])
                yield compared(table, [open_gram])
                waiting = []
            held = sum(x.num_rows for x in waiting)
        if waiting:
            yield compared(pa.Table.from_batches(waiting), [open_gram, waiting[-1].column("gram")[-1].as_py()])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite the spans of each text (a text's spans are bounded by its length)."""
    for batch in batches:
        out = []
        for i, spans in zip(batch.column("id").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            own: list[list[int]] = []
            for s in sorted(spans, key=lambda s: (s["a"], s["b"])):
                if own and s["a"] <= own[-1][1]:
                    own[-1][1], own[-1][2] = max(own[-1][1], s["b"]), min(own[-1][2], s["o"])
                else:
                    own.append([s["a"], s["b"], s["o"]])
            out += [(i, a, b, b - a, o) for a, b, o in own]
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "start_word", "end_word", "n_words", "other"])


def _numbered(docs: DataFrame, key: str) -> tuple[DataFrame, str]:
    """``docs`` and a column of different whole numbers that grow with ``key`` (nulls last)."""
    if names_rows(docs, key):
        return docs, key
    name = free_name(docs, "_row")
    return stash(docs.orderBy(F.asc_nulls_last(f"`{key}`")).withColumn(name, F.monotonically_increasing_id()), "suffix-rows"), name


def _spans(docs: DataFrame, key: str, text: str, piece: int = PIECE) -> DataFrame:
    """(id, a, b, o): repeated spans, which may overlap, and another id that holds every
    window of MIN_WORDS in them.  Of a window's other ids the smallest is always named."""
    rows = small_batches(docs).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null and text is not null")
    all_ = stash(rows.mapInArrow(lean(_rows_of_minimisers), "id long, pos long, gram long"), "suffix-minimisers")
    again = stash(all_.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "suffix-repeated")
    kept = all_.join(again, "gram", "left_semi")
    places = stash(kept.groupBy("id").agg(F.collect_list(F.struct("pos")).alias("at")), "suffix-places")
    suffixes = stash(rows.join(places, "id").select("id", "text", "at").mapInArrow(lean(_rows_of_contexts), _SUFFIX), "suffix-contexts")
    order = ["gram", "after", "before", "id", "pos"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = suffixes.repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = stash(ranged.mapInArrow(lean(_compare(piece)), _FOUND), "suffix-spans")
    windows = found.where("end is null").select("gram", "window", "id", "pos", "right")
    held = windows.groupBy("gram", "window").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    held = held.where(f"least <> most or last - first >= {MIN_WORDS}")
    far = f"least <> most or last - pos >= {MIN_WORDS} or pos - first >= {MIN_WORDS}"
    between = windows.join(held, ["gram", "window"]).where(far).select(
        "id", (F.col("pos") + F.col("right") - REACH).alias("a"), (F.col("pos") + F.col("right") + K).alias("b"), F.when(F.col("id") == F.col("least"), F.col("most")).otherwise(F.col("least")).alias("o")
    )
    return found.where("end is not null").select("id", F.col("start").alias("a"), F.col("end").alias("b"), F.col("other").alias("o")).union(between).distinct()


def _united_spans(spans: DataFrame) -> DataFrame:
    grouped = spans.groupBy("id").agg(F.collect_list(F.struct("a", "b", "o")).alias("spans"))
    return grouped.mapInArrow(lean(_merge), "id long, start_word long, end_word long, n_words long, other long")


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", piece: int = PIECE) -> DataFrame:
    """(key, start_word, end_word, n_words, other_<key>): the passages of at least
    MIN_WORDS words that occur elsewhere, and the smallest id that holds one of
    their parts (another one if that is the row's own)."""
    named, row = _numbered(docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text)), key)
    merged = _united_spans(_spans(named, row, text, piece))
    if row == key:
        return merged.select(F.col("id").alias(key), "start_word", "end_word", "n_words", F.col("other").alias(f"other_{key}"))
    name = lambda number, wish: named.select(F.col(f"`{row}`").alias(number), F.col(f"`{key}`").alias(wish))
    found = merged.join(name("id", "_name"), "id").join(name("other", "_other"), "other")
    return found.select(F.col("_name").alias(key), "start_word", "end_word", "n_words", F.col("_other").alias(f"other_{key}"))


def _superfluous(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each text that lie in a window which a smaller id holds, and in no repeated
    window of which the text is itself the smallest id."""
    for batch in batches:
        out = []
        for i, spans in zip(batch.column("id").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            n = max(s["b"] for s in spans)
            starts, gone, keep = np.zeros((2, n + 1), np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
            for s in spans:
                smaller = int(s["o"] < i)
                starts[smaller, s["a"]] += 1
                starts[smaller, s["b"] - MIN_WORDS + 1] -= 1
                if smaller:
                    gone[s["a"]] += 1
                    gone[s["b"]] -= 1
            held = starts.cumsum(1) > 0
            first = np.flatnonzero(held[0] & ~held[1])  # windows that stay
            np.add.at(keep, first, 1)
            np.add.at(keep, first + MIN_WORDS, -1)
            cut = np.diff(((gone.cumsum() > 0) & (keep.cumsum() == 0)).astype(np.int8), prepend=0)
            out += [(i, a, b) for a, b in zip(np.flatnonzero(cut == 1).tolist(), np.flatnonzero(cut == -1).tolist(), strict=True)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "start_word", "end_word"])


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every repeated passage cut out but for the one in the
    smallest id, where each window of MIN_WORDS stays whole, also if a smaller id has a
    part of it; the words that stay are joined by single spaces where a text changes."""
    named, row = _numbered(docs, key)
    own, marks = free_name(named, "_id"), free_name(named, "_spans")
    grouped = _spans(named, row, text).groupBy("id").agg(F.collect_list(F.struct("a", "b", "o")).alias("spans")).where(F.exists("spans", lambda s: s["o"] < F.col("id")))
    spans = grouped.mapInArrow(lean(_superfluous), "id long, start_word long, end_word long")
    spans = spans.groupBy(F.col("id").alias(own)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(marks))
    words = F.filter(F.split(F.col(f"`{text}`"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    keep = F.filter(words, lambda w, i: ~F.exists(F.col(f"`{marks}`"), lambda s: (s["start_word"] <= i) & (i < s["end_word"])))
    changed = F.when(F.col(f"`{marks}`").isNull(), F.col(f"`{text}`")).otherwise(F.array_join(keep, " "))
    return named.join(spans, F.col(f"`{row}`") == F.col(f"`{own}`"), "left").withColumn(text, changed).select(*(F.col(f"`{c}`") for c in docs.columns))
