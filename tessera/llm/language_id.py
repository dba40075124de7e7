"""Language identification by a byte convolutional network.

Filters of several widths run over a text's UTF-8 bytes, each is max-pooled over
a fixed-length window, and a softmax over the pooled values gives the window's
languages; a text's answer is the mean over all of its windows.  A filter of
width w is a table of w x 256 weights, so convolving is looking up and adding;
for speed, pairs of adjacent bytes are looked up at once.

The network is trained in numpy on at most ``PER_LANGUAGE`` labelled texts for each
language and ``MAX_ROWS`` of all (chosen by a hash of the id; a documented bound), on all
their windows, and broadcast: its size depends on the number of languages alone.  Prediction
reads every byte.

Edge cases: a null text or one without a letter is ``und`` with score 0.  A text shorter
than a window is one padded window.  Very long texts form slices of their own.
Without any labelled text every language is ``und``.  Null languages teach
nothing; of rows that share an id and a language the least text teaches; repeated rows are
predicted alike; languages of equal probability tie by name.  Other columns pass through, and
one named like the result keeps its name.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, free_name

#: Rows that training uses: of a language, and of all (where there are many languages, each gets
#: an equal part, down to one row; the most frequent come first).
PER_LANGUAGE, MAX_ROWS = 100, 20_000
WIDTHS = (2, 3, 4)
FILTERS = 12
WINDOW = 256
EPOCHS, RATE, BATCH = 12, 0.05, 64

RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All texts in windows of ``size`` bytes plus the overlap that the widest
    filter needs, and each window's text.  Bytes 0 pad the last one."""
    extra = max(WIDTHS) - 1
    each = np.array([max(1, -(-len(t) // size)) for t in texts], np.int64)
    buffer = b"".join(t.ljust(n * size, b"\0") for t, n in zip(texts, each.tolist(), strict=True)) + b"\0" * extra
    flat = np.frombuffer(buffer, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(flat, size + extra)[::size] if len(texts) else np.empty((0, size + extra), np.uint8)
    return rows, np.repeat(np.arange(len(texts)), each)


@dataclass
class Network:
    languages: list[str]
    tables: list[np.ndarray]  # for each width: (width, 256, FILTERS)
    weights: np.ndarray
    bias: np.ndarray

    def pooled(self, rows: np.ndarray, at: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Max over the window of every filter, and where it is."""
        out, where = [], []
        pairs = rows[:, :-1].astype(np.int32) * 256 + rows[:, 1:]
        for table in self.tables:
            w, total = len(table), None
            for j in range(0, w, 2):
                if j + 1 < w:
                    part = self._pair(table, j)[pairs[:, j : j + WINDOW]]
                else:
                    part = table[j][rows[:, j : j + WINDOW]]
                total = part if total is None else np.add(total, part, out=total)
            if at:
                where.append(total.argmax(1))
            out.append(total.max(1))
        return np.concatenate(out, 1), where

    def _pair(self, table: np.ndarray, j: int) -> np.ndarray:
        return (table[j][:, None] + table[j + 1][None]).reshape(65536, -1) if not hasattr(self, "ready") else self.ready[id(table), j]

    def freeze(self) -> Network:
        ready = {(id(t), j): self._pair(t, j) for t in self.tables for j in range(0, len(t) - 1, 2)}
        self.ready = ready
        return self

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(rows)[0], 0) @ self.weights + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(texts: list[bytes], labels: list[str], seed: int = 7) -> Network:
    """A network from all windows of texts."""
    rows, own = windows(texts)
    return fit(rows, [labels[i] for i in own.tolist()], seed)


def fit(rows: np.ndarray, labels: list[str], seed: int = 7) -> Network:
    """Fit windows by minibatch gradient steps (Adagrad); a pooled filter passes its gradient to
    the bytes under its maximum alone."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    net = Network(languages, tables, rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    if len(languages) < 2:
        return net
    goal = np.array([languages.index(x) for x in labels])
    weight = (len(goal) / len(languages) / np.bincount(goal, minlength=len(languages)))[goal].astype(np.float32)
    squares = [np.full_like(t, 1e-3) for t in tables]
    w_sq, b_sq = np.full_like(net.weights, 1e-3), np.full_like(net.bias, 1e-3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            part = rows[own]
            raw, where = net.pooled(part, at=True)
            h = np.maximum(raw, 0)
            z = np.exp((z := h @ net.weights + net.bias) - z.max(1, keepdims=True))
            d = z / z.sum(1, keepdims=True)
            d[np.arange(len(own)), goal[own]] -= 1
            d *= (weight[own] / len(own))[:, None]
            back = (d @ net.weights.T) * (raw > 0)
            for value, grad, square in ((net.weights, h.T @ d, w_sq), (net.bias, d.sum(0), b_sq)):
                square += grad**2
                value -= RATE * grad / np.sqrt(square)
            for i, (table, best, square) in enumerate(zip(net.tables, where, squares, strict=True)):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                grad = np.zeros_like(table)
                f = np.broadcast_to(np.arange(FILTERS), g.shape)
                for j in range(len(table)):
                    np.add.at(grad[j], (np.take_along_axis(part, best + j, 1), f), g)
                square += grad**2
                table -= RATE * grad / np.sqrt(square)
    return net


def learn(docs: DataFrame, teach: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network:
    """Train on all windows of at most PER_LANGUAGE texts of each language among the rows
    that ``teach`` allows.  The choice looks at ids and languages alone, and Spark limits
    each group before it shuffles (a rank filter).  The chosen rows, one for each id, come to
    the driver, where training takes seconds."""
    usable = docs.where(teach & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    ids = usable.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{lang}`").alias("_lang"))
    languages = [r["_lang"] for r in ids.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(MAX_ROWS).collect()]
    each = min(PER_LANGUAGE, MAX_ROWS // max(1, len(languages)))
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    ranked = ids.where(F.col("_lang").isin(languages)).withColumn("_n", F.row_number().over(order))
    chosen = [(r["_id"], r["_lang"]) for r in ranked.where(F.col("_n") <= each).collect()]
    if not chosen:
        return train([], [])
    kinds = [T.StructField("_id", docs.schema[key].dataType), T.StructField("_lang", docs.schema[lang].dataType)]
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen, T.StructType(kinds)))

    taught = usable.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{lang}`").alias("_lang"), F.col(f"`{text}`").alias("_t"))
    taught = taught.join(picked, ["_id", "_lang"], "left_semi").groupBy("_id", "_lang").agg(F.min("_t").alias("_t"))  # one text for an id
    rows = sorted(taught.collect(), key=lambda r: (r["_id"], r["_lang"]))
    return train([r["_t"].encode() for r in rows], [r["_lang"] for r in rows])


def _has_letter(text: bytes) -> bool:
    low = text[:256].lower()
    return any(97 <= b <= 122 for b in low) or any(c.isalpha() for c in text.decode())


_frozen: dict[int, Network] = {}


def predict(docs: DataFrame, net: Network, text: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` (or its columns ``carry``) with a struct (lang_pred, score), and
    the name of that column."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    names = np.array([*net.languages, "und"], dtype=object)

    def run(texts: list[bytes]) -> dict[str, object]:
        model = shared.value
        if not hasattr(model, "ready"):
            model.freeze()
        ok = np.fromiter(map(_has_letter, texts), bool, len(texts))
        best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
        if len(names) > 1 and ok.any():
            rows, own = windows(texts)
            parts = [model.probabilities(rows[a : a + 512]) for a in range(0, len(rows), 512)]
            p = np.concatenate(parts)
            cuts = np.flatnonzero(np.diff(own, prepend=-1))
            mean = np.add.reduceat(p, cuts, axis=0) / np.diff(np.append(cuts, len(own)))[:, None]
            best = np.where(ok, mean.argmax(1), best)
            score = np.where(ok, mean.max(1), 0.0)
        return {"lang_pred": names[best].tolist(), "score": score.astype(float).clip(0, 1)}

    name = free_name(docs, "language")
    return annotate(docs, run, RESULT, name, carry, text), name
