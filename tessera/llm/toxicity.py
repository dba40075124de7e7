"""Toxicity by nearest labelled examples.

* Examples: at most ``PER_LABEL`` labelled texts of each label, chosen by a hash of
  the id (a documented bound).  Tasks count the terms of the whole texts; ids never
  enter a score.
* Terms: runs of letters.  All terms of the examples make the vector space (others
  would scale a document's cosines alike).  A term weighs (1 + ln tf) * idf * sqrt(1 + chi²):
  inverse document frequencies are counted over all documents, chi² says how unevenly the
  examples' labels hold the term, so that a few telling words outweigh a long text's others.
  No term is left out, and one that tells nothing keeps its TF-IDF.
* Search: the ``NEIGHBOURS`` examples with the largest TF-IDF cosine, exactly, by
  a block-max inverted index.  The lists of the rarer terms are read in full; the ``HEAD``
  longest lists are cut into blocks of examples and keep their largest weight in each.  A
  block's bound is the best rare part in it plus the frequent terms' maxima; blocks are opened by
  their bound, in growing steps, until it falls below the k-th best score.  Texts are searched
  ``TOGETHER``, so that an opened block serves all that want it.
* Score: the neighbours vote with their cosine as weight, and votes are
  calibrated (monotone bins of the distinct votes) on the examples themselves, each left
  out of its own vote.  The ids of the neighbours are the evidence.

The index is of bounded size and broadcast; scoring is one pass over the texts.

Edge cases: null and empty texts, and those without any term, get the rate of examples
without terms.  Without examples of both labels the score is the labels'
mean (0 if there are none).  Ties among neighbours go to the smaller example
number.  Null labels teach nothing; a document with several labels counts as
toxic if any of them is 1.  Very long texts form slices of their own;
repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, chunks, free_name, lean, small_batches, text_bytes

PER_LABEL = 3_000
NEIGHBOURS = 15
BLOCK = 32
#: Terms whose lists are kept in blocks, a weight for each example: 8 * HEAD * examples bytes.
HEAD = 512
#: Blocks that the first step of a search opens, and by how much a step is larger than the one before.
FIRST, GROWTH = 8, 4
#: Texts of one search.
TOGETHER = 128
#: Above the rounding of a sum; cosines are ranked in units of 1e-12.
SLACK = 1e-9
BINS = 10
REMEMBER = 50_000

def result(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(id_type))])


_TERM_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if chr(b).isalpha() or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters (lower-cased) and non-ASCII characters."""
    return text.translate(_TERM_BYTES).split()


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers lo .. hi - 1 of every row, one after the other, and how many each has."""
    n = hi - lo
    end = np.cumsum(n)
    return np.repeat(lo - end + n, n) + np.arange(end[-1] if len(end) else 0), n


@dataclass
class Index:
    vocabulary: dict[bytes, int]
    worth: np.ndarray  # of a term: its idf times its contrast
    ids: np.ndarray  # of the examples, in index order
    toxic: np.ndarray
    vote: np.ndarray  # an example's class weight
    rate: float
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # postings of a term, none in the head
    example: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.empty(0))
    place: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))  # of a term in the head, or -1
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, BLOCK, 0)))  # weights by block, example, head term
    block_max: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    edges: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rates: np.ndarray = field(default_factory=lambda: np.zeros(0))
    none: float = 0.0
    id_type: T.DataType = field(default_factory=T.LongType)

    def counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a text, ascending, and how often each occurs."""
        tf = Counter(words)
        at = np.fromiter(map(self.vocabulary.get, tf, repeat(-1)), np.int64, len(tf))
        n = np.fromiter(tf.values(), np.int64, len(tf))
        order = np.argsort(at)
        order = order[np.searchsorted(at[order], 0) :]
        return at[order], n[order]

    def weigh(self, at: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit weights: (1 + ln tf) * worth."""
        w = (1 + np.log(tf)) * self.worth[at]
        return at, w / (np.linalg.norm(w) or 1.0)

    def vector(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.weigh(*self.counts(words))

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        size = len(self.vocabulary)
        term = np.concatenate([at for at, _ in vectors]) if vectors else np.empty(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.empty(0)
        example = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(at) for at, _ in vectors])
        head = np.argsort(-np.bincount(term, minlength=size), kind="stable")[:HEAD]
        self.place = np.full(size, -1, np.int32)
        self.place[head] = np.arange(len(head))
        self.blocks = np.zeros((-(-len(vectors) // BLOCK), BLOCK, len(head)))
        place = self.place[term]
        top = place >= 0
        self.blocks[example[top] // BLOCK, example[top] % BLOCK, place[top]] = weight[top]
        self.block_max = self.blocks.max(axis=1)
        order = np.flatnonzero(~top)
        order = order[np.argsort(term[order], kind="stable")]
        self.example, self.weight = example[order], weight[order]
        self.starts = np.searchsorted(term[order], np.arange(size + 1))

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the k examples of largest cosine (above 0), and their cosines;
        ``skip`` names an example for each that is not compared."""
        n_blocks, rows = len(self.blocks), np.arange(len(vectors))
        head = np.zeros((len(vectors), self.blocks.shape[2]))
        rare = np.zeros((len(vectors), n_blocks, BLOCK))
        for i, (at, w) in enumerate(vectors):
            place = self.place[at]
            head[i, place[place >= 0]] = w[place >= 0]
            at, w = at[place < 0], w[place < 0]
            postings, n = _ranges(self.starts[at], self.starts[at + 1])
            rare[i] = np.bincount(self.example[postings], np.repeat(w, n) * self.weight[postings], n_blocks * BLOCK).reshape(n_blocks, BLOCK)
        bound = rare.max(axis=2) + head @ self.block_max.T
        order = np.argsort(-bound, axis=1, kind="stable")
        score, least = np.zeros_like(rare), np.zeros(len(vectors))
        flat = score.reshape(len(vectors), n_blocks * BLOCK)
        done, step = 0, FIRST
        while done < n_blocks:
            visit = order[:, done : done + step]
            bounds = np.take_along_axis(bound, visit, axis=1)
            of, column = np.nonzero((bounds > 0) & (bounds + SLACK >= least[:, None]))
            if not len(of):
                break
            done, step = done + step, GROWTH * step
            block = visit[of, column]
            by_block = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[by_block])) + 1
            for own in np.split(by_block, cuts):
                b, q = block[own[0]], of[own]
                score[q, b] = rare[q, b] + head[q] @ self.blocks[b].T
            if skip is not None:
                flat[rows, skip] = 0
            if flat.shape[1] > k:
                least = np.partition(flat, -k, axis=1)[:, -k]
        found = []
        for row, bar in zip(flat, least, strict=True):
            hit = np.flatnonzero(row >= bar - SLACK if bar > SLACK else row > 0)
            cosine = np.round(row[hit], 12)
            keep = np.lexsort((hit, -cosine))[:k]
            found.append((hit[keep], cosine[keep]))
        return found

    def votes(self, near: np.ndarray, cosine: np.ndarray) -> float:
        w = cosine * self.vote[near]
        return float((w * self.toxic[near]).sum() / w.sum())

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Monotone bins of leave-one-out votes -> weighted share of toxic examples."""
        raw = np.full(len(vectors), -1.0)
        for a in range(0, len(vectors), TOGETHER):
            part = vectors[a : a + TOGETHER]
            for i, (near, cosine) in enumerate(self.nearest(part, skip=np.arange(a, a + len(part))), a):
                if len(near):
                    raw[i] = self.votes(near, cosine)
        share = lambda m: float(((self.vote * self.toxic)[m].sum() + self.rate) / (self.vote[m].sum() + 1))
        empty = np.array([not len(at) for at, _ in vectors], bool)
        self.none = share(empty)
        seen = raw >= 0
        # of the distinct votes: most are the same (0), which would leave one bin to all others
        self.edges = np.unique(np.quantile(np.unique(raw[seen]), np.linspace(0, 1, BINS + 1)[1:-1])) if seen.any() else np.zeros(0)
        bins = np.searchsorted(self.edges, raw, side="right")
        groups = [[share(seen & (bins == b)), float(self.vote[seen & (bins == b)].sum()) + 1e-9, 1] for b in range(len(self.edges) + 1)]
        merged: list[list[float]] = []
        for g in groups:  # pool neighbours that are out of order
            merged.append(list(g))
            while len(merged) > 1 and merged[-2][0] > merged[-1][0]:
                b, a = merged.pop(), merged.pop()
                merged.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
        self.rates = np.array([r for r, _, n in merged for _ in range(int(n))])

    def score(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[int]]]:
        out = []
        for a in range(0, len(vectors), TOGETHER):
            for near, cosine in self.nearest(vectors[a : a + TOGETHER]):
                p = self.rates[np.searchsorted(self.edges, self.votes(near, cosine), side="right")] if len(near) else self.none
                out.append((float(p), self.ids[near].tolist()))
        return out


def contrast(counts: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, size: int) -> np.ndarray:
    """sqrt(1 + chi²) of each term: chi² of its presence in the examples against their labels."""
    bad, good = (np.bincount(np.concatenate([at for (at, _), y in zip(counts, toxic, strict=True) if y == label]), minlength=size) for label in (1, 0))
    n_bad, n = float(toxic.sum()), float(len(toxic))
    n_good, held = n - n_bad, (bad + good).astype(float)
    part = held * (n - held) * n_bad * n_good
    chi = np.divide(n * (bad * n_good - good * n_bad) ** 2, part, out=np.zeros(size), where=part > 0)
    return np.sqrt(1 + chi)


def document_frequencies(docs: DataFrame, vocabulary: dict[bytes, int], text: str = "text") -> tuple[np.ndarray, int]:
    """Documents with each term, over all of ``docs``, and their number.  Tasks send one
    row per term; what comes to the driver is bounded by the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        n = np.zeros(len(vocab) + 1, np.int64)
        for batch in batches:
            for part in chunks(batch, text):
                for t in text_bytes(part.column(text)):
                    n[[vocab[w] for w in vocab.keys() & set(terms(t))]] += 1
                    n[-1] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["term", "n"])

    rows = small_batches(docs).select(F.col(f"`{text}`")).mapInArrow(lean(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    out[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return out[:-1], int(out[-1])


def example_terms(docs: DataFrame, chosen: list[tuple], key: str = "doc_id", text: str = "text") -> pa.Table:
    """(_id, _y, terms, counts, digest) of a row for each id in ``chosen`` (id, label), over
    whole texts; of rows that share an id, the one whose text has the least MD5."""
    id_ = T.StructField("_id", docs.schema[key].dataType)
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen, T.StructType([id_, T.StructField("_y", T.IntegerType())])))
    schema = T.StructType([id_, T.StructField("_y", T.IntegerType()), T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("digest", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_t"):
                texts = text_bytes(part.column("_t"))
                own = [sorted(Counter(terms(t)).items()) for t in texts]
                lists = [pa.array([[x[i] for x in o] for o in own], pa.list_(kind)) for i, kind in enumerate((pa.binary(), pa.int64()))]
                digest = pa.array([hashlib.md5(t).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_y"), *lists, digest], ["_id", "_y", "terms", "counts", "digest"])

    rows = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_t")).join(picked, "_id").select("_id", "_t", "_y")
    counted = small_batches(rows).mapInArrow(lean(run), schema)
    one = counted.groupBy("_id").agg(F.min(F.struct("digest", "_y", "terms", "counts")).alias("one")).select("_id", "one.*")
    return one.toArrow().sort_by([("_id", "ascending")]).combine_chunks()


def learn(docs: DataFrame, labels: DataFrame, teach: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Index:
    """Build the index from labelled rows that ``teach`` (a condition on the
    key) allows.  Ids are chosen first, with a rank filter per label that Spark
    applies before it shuffles; only the term counts of the chosen texts come to the driver."""
    marked = labels.where(teach & F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("_id")).agg(F.max(F.when(F.col(f"`{label}`") == 1, 1).otherwise(0)).alias("_y"))
    totals = {r["_y"]: r["count"] for r in marked.groupBy("_y").count().collect()}
    everything = sum(totals.values())
    rate = totals.get(1, 0) / everything if everything else 0.0
    order = Window.partitionBy("_y").orderBy(F.xxhash64("_id"), "_id")
    chosen = [(r["_id"], r["_y"]) for r in marked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= PER_LABEL).collect()]
    rows = example_terms(docs, chosen, key, text) if chosen else None
    ids, toxic = (np.array(rows.column(c).to_pylist() if rows else []) for c in ("_id", "_y"))
    vocabulary, counts = {}, []
    if 0 < toxic.sum() < len(toxic):
        lists = rows.column("terms").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        vocabulary = {w: i for i, w in enumerate(sorted(coded.dictionary.to_pylist()))}
        number = np.array([vocabulary[w] for w in coded.dictionary.to_pylist()], np.int64)
        at, tf = number[coded.indices.to_numpy()], rows.column("counts").combine_chunks().flatten().to_numpy()
        cuts = np.cumsum(pa.compute.list_value_length(lists).to_numpy())[:-1]
        counts = list(zip(np.split(at, cuts), np.split(tf, cuts), strict=True))
    df, n = document_frequencies(docs, vocabulary, text) if vocabulary else (np.empty(0), 0)
    part = toxic.mean() if len(toxic) else 0.0
    vote = np.where(toxic == 1, rate / part if part else 0.0, (1 - rate) / (1 - part) if part < 1 else 0.0)
    worth = (np.log((1 + n) / (1 + df)) + 1.0) * (contrast(counts, toxic, len(vocabulary)) if vocabulary else 1.0)
    index = Index(vocabulary, worth, ids, toxic, vote, rate, none=rate, id_type=docs.schema[key].dataType)
    if vocabulary:
        vectors = [index.weigh(*c) for c in counts]
        # neighbours in the index share their heaviest term, which keeps block maxima tight
        near = sorted(range(len(vectors)), key=lambda i: (vectors[i][0][int(np.argmax(vectors[i][1]))] if len(vectors[i][0]) else -1, i))
        vectors = [vectors[i] for i in near]
        index.ids, index.toxic, index.vote = ids[near], toxic[near], vote[near]
        index.build(vectors)
        index.calibrate(vectors)
    return index


def score(docs: DataFrame, index: Index, text: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` (or its columns ``carry``) with a struct (score, predicted,
    evidence), and the name of that column."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    known: dict[bytes, tuple[float, list[int]]] = {}

    def run(texts: list[bytes]) -> dict[str, object]:
        index = shared.value
        if len(known) >= REMEMBER:
            known.clear()
        keys, new = [], {}
        for t in texts:
            at, tf = index.counts(terms(t))
            keys.append(hashlib.md5(np.concatenate([at, tf]).tobytes()).digest())
            if keys[-1] not in known:
                new[keys[-1]] = index.weigh(at, tf)
        known.update(zip(new, index.score(list(new.values())), strict=True))
        out = [known[key] for key in keys]
        scores = [min(1.0, max(0.0, s)) for s, _ in out]
        return {"score": scores, "predicted": [int(s >= 0.5) for s in scores], "evidence": [e for _, e in out]}

    name = free_name(docs, "toxicity")
    return annotate(docs, run, result(index.id_type), name, carry, text), name
