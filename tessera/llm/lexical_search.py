"""Ranked lexical search: the Best Position Algorithm on impact lists.

1. One pass over the texts writes, for every row, how many terms it has and how often it
   has those that some item asks for.  The number of rows with a term, of all terms and of
   the rows of each asked term are sums over that table.
2. Each task takes its rows in blocks of about ``BLOCK_POSTINGS`` postings.  A block has,
   for each term, its list by falling impact.  An item reads its lists from the top; each
   row that turns up is looked up in all its lists (direct access), which gives its score
   and its positions there.  The best position of a list ends its unbroken run of
   positions seen, by whatever access.  No unseen row can score above the sum of the
   impacts that follow the best positions; once this bound lies strictly below the kth
   score, the item is done (at equality a row with a smaller id might tie).  What an item
   has found stays its bar in the next blocks of the task.
3. The best rows of all tasks meet in two ranks, by item and a salt, then by item.

Items go in blocks of about ``ITEM_TERMS`` terms, so what a task holds of them is bounded
whatever their number; blocks change speed alone.

A row's score sums weight * (1000000000 * tf div (1000 * tf + 8 * m)), where weight is
floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m is 10 + 90 * n * N div L.

Edge cases: null and empty texts have no term and are not counted; items without terms
have no rows.  Rows that share an id are rows of their own and rank next to each other;
a null id comes last among equal scores.  Items that share an id are one, with the terms
of both; a null item id is an item like others.  Very long texts are read whole, one at a
time.  Empty tables give no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, chunks, lean, small_batches, stash, text_bytes

K = 10
BLOCK_POSTINGS = 4_000_000
ITEM_TERMS = 200_000
#: First number of positions that an item reads of each list; doubles from round to round.
STEP = 32
#: Groups in which the rows of one item are ranked first.
SALT = 64

#: Java class of what is part of a term.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes to bytes: letters to lower case, what separates terms to a space.
TABLE = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def asked_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, terms): the different terms of each item."""
    found = F.array_distinct(F.regexp_extract_all(ascii_lower(F.col(f"`{text}`")), F.lit(TERM), 0))
    rows = items.select(F.col(f"`{item}`").alias("item"), F.explode(found).alias("term"))
    return rows.groupBy("item").agg(F.collect_set("term").alias("terms"))


def postings(docs: DataFrame, key: str, text: str, number: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs) of every row with a term: its terms that ``number`` has."""
    held = docs.sparkSession.sparkContext.broadcast(number)
    fields = [T.StructField("id", docs.schema[key].dataType), T.StructField("n", T.LongType())]
    schema = T.StructType([*fields, T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = held.value.get
        for batch in batches:
            for part in chunks(batch, "_text"):
                n, terms, tfs = [], [], []
                for t in text_bytes(part.column("_text")):
                    words = t.translate(TABLE).split()
                    count = Counter(map(get, words))
                    count.pop(None, None)
                    n.append(len(words))
                    terms.append(list(count))
                    tfs.append(list(count.values()))
                made = [part.column("_id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
                made = pa.RecordBatch.from_arrays(made, schema.names)
                yield made.filter(pa.compute.greater(made.column("n"), 0))

    rows = small_batches(docs).select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(lean(run), schema)


class Block:
    """The impact lists of some rows."""

    def __init__(self, parts: list[pa.RecordBatch], weight: np.ndarray, n_all: int, n_terms: int):
        table = pa.Table.from_batches(parts)
        self.ids = table.column("id").combine_chunks()
        self.rows = n = len(self.ids)
        lists = table.column("terms").combine_chunks()
        doc = np.repeat(np.arange(n), pa.compute.list_value_length(lists).to_numpy())
        term = lists.flatten().to_numpy()
        tf = table.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        m = np.array([10 + 90 * x * n_all // n_terms for x in table.column("n").to_pylist()], np.int64)
        impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        key = term.astype(np.int64) * n + doc
        by_key = np.argsort(key, kind="stable")
        self.key, self.impact_at = key[by_key], impact[by_key]  # for direct access
        term = term[by_key]
        self.start = np.searchsorted(term, np.arange(len(weight) + 1))  # of each term's list
        fall = np.lexsort((-self.impact_at, term))
        self.impact, self.doc = self.impact_at[fall], self.key[fall] % n  # the lists, for sorted access
        self.position = np.empty(len(fall), np.int64)
        self.position[fall] = np.arange(len(fall)) - self.start[term]
        order = pa.compute.sort_indices(pa.table({"id": self.ids}), [("id", "ascending")], null_placement="at_end")
        self.place = np.empty(n, np.int64)  # of each row among the ids
        self.place[order.to_numpy()] = np.arange(n)

    def best(self, terms: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the ``k`` best for an item; those that can't reach ``bar``
        (the kth score so far, 0 for none) may be missing."""
        begin, size = self.start[terms], self.start[terms + 1] - self.start[terms]
        begin, size, terms = begin[size > 0], size[size > 0], terms[size > 0]
        base = np.concatenate([[0], np.cumsum(size)])
        seen = np.zeros(base[-1] + 1, bool)  # positions of all lists, one after the other; the last stays unseen
        met = np.zeros(self.rows, bool)
        best_position, depth, step = np.zeros(len(terms), np.int64), 0, STEP
        rows, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        while True:
            open_lists = best_position < size
            bound = int(self.impact[(begin + best_position)[open_lists]].sum())
            if bound == 0 or bound < bar:
                return rows, scores
            read = np.concatenate([self.doc[b + depth : b + min(s, depth + step)] for b, s in zip(begin.tolist(), size.tolist(), strict=True) if s > depth])
            depth, step = depth + step, 2 * step
            new = np.unique(read[~met[read]])
            met[new] = True
            if len(new):
                wanted = terms.astype(np.int64)[:, None] * self.rows + new
                at = np.searchsorted(self.key, wanted.ravel())
                at[at == len(self.key)] = 0
                there = self.key[at] == wanted.ravel()
                total = np.where(there, self.impact_at[at], 0).reshape(wanted.shape).sum(axis=0)
                seen[(np.repeat(base[:-1], len(new)) + self.position[at])[there]] = True
                rows, scores = np.concatenate([rows, new[total > 0]]), np.concatenate([scores, total[total > 0]])
                top = np.lexsort((self.place[rows], -scores))[:k]
                rows, scores = rows[top], scores[top]
                if len(scores) == k:
                    bar = max(bar, int(scores[-1]))
            for i in np.flatnonzero(best_position < size).tolist():  # on to the first position not seen
                a = base[i] + best_position[i]
                run = seen[a : base[i + 1]]
                best_position[i] += len(run) if run.all() else int(run.argmin())


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = K) -> DataFrame:
    """(item, rank, key, score): the ``k`` best rows of ``docs`` for each item."""
    asked = stash(asked_terms(items, item, item_text), "asked-terms")
    size = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(size / ITEM_TERMS))
    found = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()  # about ITEM_TERMS terms
        one = _search_block(docs, {r["item"]: r["terms"] for r in part}, items.schema[item].dataType, key, text, k)
        found = one if found is None else found.unionByName(one)
    by_rank = [F.desc("score"), F.asc_nulls_last("id")]
    salted = Window.partitionBy("item", F.pmod(F.xxhash64("id"), F.lit(SALT))).orderBy(*by_rank)
    last = Window.partitionBy("item").orderBy(*by_rank)
    first = found.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def _search_block(docs: DataFrame, asked: dict[object, list[str]], item_type: T.DataType, key: str, text: str, k: int) -> DataFrame:
    """(item, id, score): the best rows of each task for the items of one block."""
    number = {t: i for i, t in enumerate(sorted({t for terms in asked.values() for t in terms}))}
    table = stash(postings(docs, key, text, {t.encode(): i for t, i in number.items()}), "postings")
    n_all, n_terms = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(number), np.int64)
    for r in table.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow().to_pylist():  # a row for each asked term
        df[r["term"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    terms = [(i, np.array([number[t] for t in ts], np.int32)) for i, ts in asked.items()]
    held = docs.sparkSession.sparkContext.broadcast((weight, terms))
    schema = T.StructType([T.StructField("item", item_type), table.schema["id"], T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, items = held.value
        top: list[list[tuple[int, bool, object]]] = [[] for _ in items]  # -score, id is null, id

        def take(parts: list[pa.RecordBatch]) -> None:
            block = Block(parts, weight, n_all, n_terms)
            for i, (_, ts) in enumerate(items):
                bar = -top[i][-1][0] if len(top[i]) == k else 0
                rows, scores = block.best(ts, k, bar)
                ids = block.ids.take(pa.array(rows)).to_pylist()
                top[i] = sorted([*top[i], *((-s, x is None, x) for s, x in zip(scores.tolist(), ids, strict=True))], key=lambda e: (e[0], e[1], 0 if e[1] else e[2]))[:k]

        parts, size = [], 0
        for batch in batches:
            parts.append(batch)
            size += batch.num_rows + len(batch.column("terms").flatten())
            if size >= BLOCK_POSTINGS:
                take(parts)
                parts, size = [], 0
        if size:
            take(parts)
        made = [(items[i][0], e[2], -e[0]) for i, best in enumerate(top) for e in best]
        columns = zip(*made, strict=True) if made else ([], [], [])
        kinds = [_arrow(f.dataType) for f in schema]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], schema.names)

    return table.mapInArrow(lean(run), schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
