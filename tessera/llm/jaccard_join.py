"""N-gram Jaccard self-join by count-vector R-trees.

A text's set holds its distinct 5-word shingles.  Two texts link when their
Jaccard similarity is at least ``NUM``/``DEN``.  The join is exact:

1. *Points.*  Shingles are hashed into ``GROUPS`` groups; the counts per group are a
   set's point.  Equal sets are one class, for which the smallest id stands.
2. *Units.*  Trees over a whole corpus rule nothing out, so sets meet in blocks first.  Two
   sets that link share a shingle among the first n - ceil(t n) + 1 of each, in any
   one order of shingles.  The order puts shingles that look frequent last (a table of
   bounded size, which changes speed alone) and else goes by hash.  A block has the
   sets with one such shingle; blocks of equal members are one unit, with the number of
   shingles it stands for.
3. *Search.*  In each unit the points stand in an R-tree; the summed minima of a point and
   a node's upper corner bound the overlap with anything below.  Units of FANOUT
   sets (one node) give all pairs that the bound leaves; larger ones give the BEST of
   each set, and those of over CHUNK sets are cut in chunks for this.
4. *Counts.*  Pairs are added up over units.  How many shingles two prefixes share, with
   what is left behind them, bounds the overlap as well; most pairs end here.
5. *Verification.*  Pairs that survive are verified on the whole texts, and links give
   components.
6. *The rest.*  Units in which candidates were left out are searched again, now for
   pairs of components: a component is a node with its members' upper corner, so a
   group of near copies is one entry, whatever its size.  Members of components that the
   bound can't keep apart are searched against each other, in chunks, and all pairs that
   are left are verified.  No link between components is lost.

Edge cases: null and empty texts have no shingle, link with nothing, and are their own
component; fewer than five words make one shingle.  Rows that repeat with an id are
one document: what links with any of its texts is in its component.  A row with a
null id is a document of its own; its component is the smallest id that it reaches, null
if there is none.  Ids may be of any type that has an order.  Very long texts form
slices of their own.  An empty table gives no rows.  Columns other than id and text
are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, broadcast_if_small, chunks, free_name, gram_hashes, lean, mix64, named_rows, small_batches, stash, text_bytes
from .components import components

SHINGLE = 5
NUM, DEN = 75, 100
GROUPS = 128
#: Shingles that the order may know as frequent, and how often they must be seen.
FREQUENT, OFTEN = 1 << 18, 8
#: Texts from which on a shingle's block is not formed in one task.
HOT = 1 << 16
#: Sets in a chunk of a unit, and entries of an R-tree's node.
CHUNK = 512
FANOUT = 16
#: Candidates that a set has at most in a unit of more than one node, before components are known.
BEST = 4
_ENDLESS = 1 << 30


def shingles(words: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    n = len(words)
    found = np.sort(gram_hashes(words, SHINGLE if n >= SHINGLE else max(n, 1))) if n else np.empty(0, np.uint64)
    return found[np.append(True, found[1:] != found[:-1])] if n else found


def prefix_length(n: int) -> int:
    return n - -(-n * NUM // DEN) + 1 if n else 0


def _sets(texts: list[bytes], hashes: WordHashes) -> list[np.ndarray]:
    return [shingles(hashes.of(t.lower().split())) for t in texts]


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that two or more texts of one slice share, with their number."""
    hashes = WordHashes()
    for batch in batches:
        for part in chunks(batch, "text"):
            own = _sets(text_bytes(part.column("text")), hashes)
            every = np.sort(np.concatenate(own)) if own else np.empty(0, np.uint64)
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, np.int64)
            n = np.diff(np.append(first, len(every)))
            keep = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(every[first[keep]].view(np.int64)), pa.array(n[keep].astype(np.int64))], ["h", "n"])


def _points(frequent: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, n, h1, h2, keys, point) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = frequent.value
        hashes = WordHashes()
        for batch in batches:
            for part in chunks(batch, "text"):
                n, h1, h2, keys, points = [], [], [], [], []
                for s in _sets(text_bytes(part.column("text")), hashes):
                    n.append(len(s))
                    h1.append(int((s * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    h2.append(int(((s ^ (s >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    k = prefix_length(len(s))
                    if len(known) and len(s):
                        at = np.searchsorted(known, s)
                        at[at == len(known)] = 0
                        df = np.where(known[at] == s, often[at], 0)
                        s_first = s[np.lexsort((s, df))[:k]] if df.any() else s[:k]
                    else:
                        s_first = s[:k]
                    keys.append(s_first.view(np.int64))
                    count = np.bincount((s >> np.uint64(20)).astype(np.int64) % GROUPS, minlength=GROUPS)
                    points.append(np.minimum(count, 65535).astype("<u2").tobytes())
                edges = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat)), pa.array(points, pa.binary())],
                    ["id", "n", "h1", "h2", "keys", "point"],
                )

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, n, id) -> (unit, id, n, pos, size) of the keys that several sets
    have.  The unit of a block of up to CHUNK sets is a hash of its members, so that
    blocks of equal members fall together; a larger block goes by its key, with size 0.
    At most CHUNK rows are carried from batch to batch."""
    columns = ["key", "id", "n", "pos"]
    held = [np.empty(0, np.int64)] * 4
    going_on = None  # key of a large block whose rows have gone out so far
    for batch in itertools.chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        new = [] if batch is None else [[batch.column(c).to_numpy(zero_copy_only=False) for c in columns]]
        rows = [np.concatenate(x) for x in zip(held, *new, strict=True)]
        key, ids = rows[0], rows[1]
        if not len(key):
            continue
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(starts, len(key)))
        large = size > CHUNK
        large[0] |= going_on is not None and key[0] == going_on
        out = large | (size > 1)
        going_on, keep = None, len(key)
        if batch is not None:  # the last key may go on
            if large[-1]:
                going_on = key[-1]
            else:
                out[-1], keep = False, starts[-1]
        held = [x[keep:] for x in rows]
        members = mix64(np.add.reduceat(mix64(ids.view(np.uint64)), starts) + size.astype(np.uint64)).view(np.int64)
        unit, shown = np.where(large, key[starts], members), np.where(large, 0, size)
        rows_out = np.repeat(out, size)
        arrays = [np.repeat(unit, size), *rows[1:], np.repeat(shown, size)]
        yield pa.RecordBatch.from_arrays([pa.array(x[rows_out]) for x in arrays], ["unit", "id", "n", "pos", "size"])


def _needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The overlap from which sets of n and m shingles link."""
    return -(-NUM * (n + m) // (NUM + DEN))


def _load(points: list[bytes]) -> np.ndarray:
    out = np.frombuffer(b"".join(points), "<u2").reshape(-1, GROUPS).astype(np.int32)
    out[out == 65535] = _ENDLESS // GROUPS
    return out


class RTree:
    """Points in nodes of FANOUT; a node keeps its upper corner and smallest n."""

    def __init__(self, points: np.ndarray, n: np.ndarray):
        self.order = np.lexsort((points.argmax(1), n))
        self.levels = [(points[self.order], n[self.order])]
        while len(self.levels[-1][1]) > FANOUT:
            top, least = self.levels[-1]
            cuts = np.arange(0, len(least), FANOUT)
            self.levels.append((np.maximum.reduceat(top, cuts), np.minimum.reduceat(least, cuts)))

    def search(self, points: np.ndarray, n: np.ndarray, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry, bound) where the overlap can reach what a link needs:
        (DEN + NUM) * overlap >= NUM * (n + m).  A query may stand for several sets of
        n to ``most`` shingles."""
        most = n if most is None else most
        k = len(self.levels[-1][1])
        q, at = np.repeat(np.arange(len(n)), k), np.tile(np.arange(k), len(n))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least = self.levels[depth]
            ok = NUM * least[at] <= DEN * most[q]
            q, at = q[ok], at[ok]
            bound = _bounds(top, at, points, q)
            ok = (DEN + NUM) * bound >= NUM * (n[q] + least[at])
            q, at, bound = q[ok], at[ok], bound[ok]
            if depth:
                q, at = np.repeat(q, FANOUT), (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                ok = at < len(self.levels[depth - 1][1])
                q, at = q[ok], at[ok]
        return q, self.order[at], bound


def _bounds(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Summed minima of a[i] and b[j]."""
    parts = [np.minimum(a[i[s : s + step]], b[j[s : s + step]]).sum(1) for s in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _behind(n: np.ndarray) -> np.ndarray:
    """Shingles behind the prefix."""
    return -(-NUM * n // DEN) - 1


def _runs(table: pa.Table, marks: list[str]) -> np.ndarray:
    """Where rows with other ``marks`` than the row before begin."""
    m = np.stack([table.column(c).to_numpy() for c in marks], 1)
    return np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]).any(1)]))


def _by_unit(fn: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], marks: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` over whole units of rows sorted by ``marks``, given where units begin.  A unit
    has a few chunks of rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*waiting, batch]).combine_chunks()
            starts = _runs(table, marks)
            if last := int(starts[-1]):
                yield from fn(table.slice(0, last), starts[:-1])
            waiting = table.slice(last).combine_chunks().to_batches()
        if waiting:
            table = pa.Table.from_batches(waiting).combine_chunks()
            yield from fn(table, _runs(table, marks))

    return run


def _pairs(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Units (chunks of them, if large) -> (a, b, shared, left, spare): pairs that the trees
    cannot rule out, with the number of shared prefix shingles that the unit shows, what
    positions leave beyond the overlap needed, and what may be shared elsewhere beyond it;
    (unit) alone where pairs were left out."""
    t = {c: table.column(c).to_numpy() for c in ("unit", "id", "n", "pos", "mult", "apart", "size")}
    points = _load(table.column("point").to_pylist())
    count = np.diff(np.append(starts, len(t["id"])))
    block = np.repeat(np.arange(len(count)), count)
    one_node = (t["size"][starts] > 0) & (t["size"][starts] <= FANOUT)
    got, cut = [], [t["unit"][starts[t["size"][starts] == 0]]]

    rows = np.flatnonzero(one_node[block])
    for d in range(1, int(count[one_node].max(initial=1))):  # the entries of each node, d places apart
        same = block[rows[:-d]] == block[rows[d:]]
        i, j = rows[:-d][same], rows[d:][same]
        ok = (NUM * np.maximum(t["n"][i], t["n"][j]) <= DEN * np.minimum(t["n"][i], t["n"][j])) & (t["id"][i] != t["id"][j])
        i, j = i[ok], j[ok]
        ok = _bounds(points, i, points, j) >= _needed(t["n"][i], t["n"][j])
        got.append((i[ok], j[ok], t["mult"][i[ok]]))

    for u in np.flatnonzero(~one_node & (count > 1)):
        rows = np.arange(starts[u], starts[u] + count[u])
        tree = RTree(points[rows], t["n"][rows])
        for first in range(0, len(rows), 64):
            q = rows[first : first + 64]
            k, hit, bound = tree.search(points[q], t["n"][q])
            i, j = q[k], rows[hit]
            left = np.minimum(t["n"][i] - t["pos"][i], t["n"][j] - t["pos"][j])
            ok = (i != j) & (left >= _needed(t["n"][i], t["n"][j]))
            i, j, share = i[ok], j[ok], (bound[ok] / (t["n"][i[ok]] + t["n"][j[ok]]))
            order = np.lexsort((t["id"][j], -share, i))
            i, j = i[order], j[order]
            new = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.empty(0, bool)
            rank = np.arange(len(i)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            if (rank >= BEST).any():
                cut.append(t["unit"][rows[:1]])
            i, j = i[rank < BEST], j[rank < BEST]
            got.append((i, j, np.zeros(len(i), np.int64)))

    i, j, mult = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (zip(*got, strict=True) if got else ((), (), ())))
    n, m = t["n"][i], t["n"][j]
    need = _needed(n, m)
    left = np.minimum(n - t["pos"][i], m - t["pos"][j]) - need
    spare = np.minimum(t["apart"][i], t["apart"][j]) + np.maximum(_behind(n), _behind(m)) - need
    cols = [np.minimum(t["id"][i], t["id"][j]), np.maximum(t["id"][i], t["id"][j]), mult, left, spare]
    cut_units = np.unique(np.concatenate(cut))
    none = pa.nulls(len(cut_units), pa.int64())
    arrays = [pa.concat_arrays([pa.array(c, pa.int64()), none]) for c in cols]
    unit = pa.concat_arrays([pa.nulls(len(i), pa.int64()), pa.array(cut_units, pa.int64())])
    yield pa.RecordBatch.from_arrays([*arrays, unit], ["a", "b", "shared", "left", "spare", "unit"])


def _corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (component, least, most, members, point) -> one for each component of a batch and,
    if rows are sorted, of a task: smallest and largest n, and the upper corner of the points."""
    names = ["component", "least", "most", "members", "point"]
    held: list[pa.RecordBatch] = []
    for rows in batches:
        if not rows.num_rows:
            continue
        batch = pa.Table.from_batches([x.cast(rows.schema) for x in held] + [rows]).combine_chunks().to_batches()[0]
        component, least, most, members = (batch.column(c).to_numpy() for c in ("component", "least", "most", "members"))
        order = np.argsort(component, kind="stable")
        component = component[order]
        starts = np.flatnonzero(np.concatenate([[True], component[1:] != component[:-1]]))
        points = np.frombuffer(b"".join(batch.column("point").to_pylist()), "<u2").reshape(-1, GROUPS)[order]
        top = np.maximum.reduceat(points, starts)
        cols = [component[starts], np.minimum.reduceat(least[order], starts), np.maximum.reduceat(most[order], starts), np.add.reduceat(members[order], starts)]
        made = pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array([x.tobytes() for x in top], pa.binary())], names)
        yield made.slice(0, made.num_rows - 1)
        held = [made.slice(made.num_rows - 1)]
    yield from held


def _node_pairs(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Components of a unit, or members of two components -> (a, b) that the tree can't keep
    apart, nor, of members, what their prefixes share.  Where ``lo`` and ``hi`` are equal all
    meet, else only rows of other sides."""
    keys: list[np.ndarray] = []
    if "keys" in table.column_names:
        lists = table.column("keys").combine_chunks()
        edges, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        keys = [np.sort(values[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    t = {c: table.column(c).to_numpy() for c in ("lo", "hi", "side", "node", "least", "most")}
    points = _load(table.column("point").to_pylist())
    for first, end in zip(starts, [*starts[1:], len(t["node"])], strict=True):
        rows = np.arange(first, end)
        alike = t["lo"][first] == t["hi"][first]
        left, right = (rows, rows) if alike else (rows[t["side"][rows] == 0], rows[t["side"][rows] == 1])
        if not len(left) or not len(right):
            continue
        tree = RTree(points[right], t["least"][right])
        for at in range(0, len(left), 64):
            q = left[at : at + 64]
            k, hit, _ = tree.search(points[q], t["least"][q], t["most"][q])
            i, j = q[k], right[hit]
            a, b = t["node"][i], t["node"][j]
            ok = (a < b) if alike else (a != b)
            ok &= NUM * t["least"][i] <= DEN * t["most"][j]
            if keys:
                n, m = t["least"][i], t["least"][j]
                least = _needed(n, m) - np.maximum(_behind(n), _behind(m))
                for x in np.flatnonzero(ok):
                    ok[x] = len(np.intersect1d(keys[i[x]], keys[j[x]], assume_unique=True)) >= least[x]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok])], ["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for part in chunks(batch, "text_a"):
            sets: dict[bytes, np.ndarray] = {}
            ok = []
            for x, y in zip(text_bytes(part.column("text_a")), text_bytes(part.column("text_b")), strict=True):
                p, q = (sets[t] if t in sets else sets.setdefault(t, _sets([t], hashes)[0]) for t in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both > 0 and DEN * both >= NUM * (len(p) + len(q) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])


def linked(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b), stashed, whose texts link.  Texts of ``b`` move once for each pair,
    those of ``a`` once; Spark splits the join where one text has many partners."""
    ids = broadcast_if_small(pairs.select("a").distinct())
    hubs = rows.join(ids, rows["id"] == ids["a"], "left_semi").select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    some = broadcast_if_small(pairs)
    movers = rows.join(some, rows["id"] == some["b"]).select("a", "b", F.col("text").alias("text_b"))
    return movers.join(hubs, "a").select("a", "b", "text_a", "text_b").mapInArrow(lean(_verify), "a long, b long")


def _of_components(cut: DataFrame, units: DataFrame, labels: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets in other components that meet in a ``cut`` unit."""
    rows = units.join(broadcast_if_small(cut), "unit", "left_semi").select("unit", "id", "n")
    label = labels.select(F.col("id").alias("_i"), "component")
    rows = stash(rows.join(broadcast_if_small(label), F.col("id") == F.col("_i"), "left").select("unit", "id", "n", F.coalesce("component", "id").alias("component")), "jaccard-rows")
    mixed = rows.groupBy("unit").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.approx_count_distinct("component").alias("nodes")).where("x <> y")
    mixed = stash(mixed.select("unit", "nodes"), "jaccard-mixed")
    if mixed.isEmpty():
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    rows = rows.join(broadcast_if_small(mixed), "unit")
    members = stash(rows.select("component", "id", "n").distinct().join(points.withColumnRenamed("id", "_p"), F.col("id") == F.col("_p")).select("component", "id", "n", "point", "keys"), "jaccard-members")
    shape = "component long, least long, most long, members long, point binary"
    corners = members.select("component", F.col("n").alias("least"), F.col("n").alias("most"), F.lit(1).cast("long").alias("members"), "point").mapInArrow(_corners, shape)
    corners = stash(corners.repartition("component").sortWithinPartitions("component").mapInArrow(_corners, shape), "jaccard-corners")

    kind = "a long, b long"
    marks = ["unit", "lo", "hi"]
    nodes = rows.select("unit", "component", "nodes").distinct().join(corners, "component")
    n_chunks = F.ceil(F.col("nodes") / CHUNK)
    nodes = nodes.withColumn("own", F.pmod(F.xxhash64("component"), n_chunks)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), n_chunks - 1)))
    nodes = nodes.select("unit", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), (F.col("own") > F.col("with")).cast("int").alias("side"), F.col("component").alias("node"), "least", "most", "point")
    close = stash(nodes.repartition(*marks).sortWithinPartitions(*marks).mapInArrow(lean(_by_unit(_node_pairs, marks)), kind).distinct(), "jaccard-close")

    # the larger of two components is searched by the members of all that are close to it
    number = corners.select("component", "members")
    for x in "ab":
        close = close.join(number.select(F.col("component").alias(x), F.col("members").alias(f"n_{x}")), x)
    a_first = F.col("n_a") >= F.col("n_b")
    close = close.select(F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("component"))
    partners = stash(close.join(members.select("component", "id"), "component").select("hub", "id"), "jaccard-partners")
    hubs = partners.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("p")).join(number, F.col("hub") == F.col("component"))
    hubs = stash(hubs.select("hub", "p", F.ceil(F.col("members") / CHUNK).alias("m")), "jaccard-hubs")
    chunk = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    row = [F.col("id").alias("node"), F.col("n").alias("least"), F.col("n").alias("most"), "point", "keys"]
    mine = hubs.join(members, F.col("hub") == F.col("component")).withColumn("own", chunk("m")).withColumn("with", every("p"))
    theirs = partners.join(hubs, "hub").join(members, "id").withColumn("own", chunk("p")).withColumn("with", every("m"))
    # chunks of the two sides are numbered apart: lo and hi differ
    mine = mine.select("hub", F.col("own").alias("lo"), (-1 - F.col("with")).alias("hi"), F.lit(0).alias("side"), *row)
    theirs = theirs.select("hub", F.col("with").alias("lo"), (-1 - F.col("own")).alias("hi"), F.lit(1).alias("side"), *row)
    marks = ["hub", "lo", "hi"]
    return mine.union(theirs).repartition(*marks).sortWithinPartitions(*marks).mapInArrow(lean(_by_unit(_node_pairs, marks)), kind).distinct()


def _components_of(rows: DataFrame, united: DataFrame | None = None) -> DataFrame:
    """(id, n, component) of every row of ``rows`` (id, text), whose ids are different whole
    numbers.  Rows in ``united`` (a, b) are in one component anyway."""
    spark = rows.sparkSession
    seen = rows.select("text").mapInArrow(lean(_frequent), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    top = seen.orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    known = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    frequent = spark.sparkContext.broadcast((known[order], top["n"].to_numpy(np.int64)[order]))
    sets = stash(rows.mapInArrow(lean(_points(frequent)), "id long, n long, h1 long, h2 long, keys array<long>, point binary"), "jaccard-sets")
    same = ["h1", "h2", "n"]
    classes = stash(sets.where("n > 0").groupBy(*same).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size"), "jaccard-classes")
    copies = stash(sets.select("id", *same).join(broadcast_if_small(classes), same).where("id <> first").select("id", "first"), "jaccard-copies")
    one = sets.where("n > 0").join(broadcast_if_small(copies), "id", "left_anti")

    keyed = one.select(F.posexplode("keys").alias("pos", "key"), "id", "n").select("key", "id", "n", F.col("pos").cast("long").alias("pos"))
    form = "unit long, id long, n long, pos long, size long"
    hot = [(int(h),) for h in top["h"][top["n"] >= HOT]]
    hot_keys = F.broadcast(spark.createDataFrame(hot, "key long"))  # at most FREQUENT
    cold = keyed.join(hot_keys, "key", "left_anti") if hot else keyed
    blocks = cold.repartition("key").sortWithinPartitions("key", "n", "id").mapInArrow(lean(_blocks), form)
    if hot:
        blocks = blocks.union(keyed.join(hot_keys, "key").select(F.col("key").alias("unit"), "id", "n", "pos", F.lit(0).cast("long").alias("size")))
    units = blocks.groupBy("unit", "id").agg(F.first("n").alias("n"), F.min("pos").alias("pos"), F.min("size").alias("size"), F.count(F.lit(1)).alias("mult"))
    units = stash(units, "jaccard-units")
    large = units.where(f"size = 0 or size > {FANOUT}")
    apart = large.groupBy("id").agg(F.sum("mult").alias("apart"))
    total = stash(large.where("size = 0").groupBy("unit").agg(F.count(F.lit(1)).alias("total")), "jaccard-totals")
    points = sets.select("id", "point")
    some = units.join(points.join(apart, "id", "left"), "id").join(broadcast_if_small(total), "unit", "left")
    n_chunks = F.coalesce(F.ceil(F.col("total") / CHUNK), F.lit(1))
    some = some.select("unit", F.pmod(F.xxhash64("unit", "id"), n_chunks).alias("chunk"), "id", "n", "pos", "mult", F.coalesce("apart", F.lit(0)).cast("long").alias("apart"), "size", "point")
    marks = ["unit", "chunk"]
    search = lean(_by_unit(_pairs, marks))
    found = stash(some.repartition(*marks).sortWithinPartitions(*marks).mapInArrow(search, "a long, b long, shared long, left long, spare long, unit long"), "jaccard-found")

    summed = found.where("a is not null").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("left").alias("left"), F.max("spare").alias("spare"))
    tried = stash(summed.where("left >= 0 and shared + spare >= 0").select("a", "b"), "jaccard-pairs")
    links = stash(linked(tried, rows), "jaccard-links")
    labels = components(links)
    cut = stash(found.where("a is null").select("unit").distinct(), "jaccard-cut")
    if not cut.isEmpty():
        more = _of_components(cut, units, labels, sets.select("id", "point", "keys"))
        more = stash(more.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
        late = stash(linked(more, rows), "jaccard-links")
        if not late.isEmpty():
            links = links.union(late)
            labels = components(links)
    if united is not None:
        for x in "ab":
            united = united.join(copies.select(F.col("id").alias(x), F.col("first").alias(f"first_{x}")), x, "left")
        labels = components(links.union(united.select(F.coalesce("first_a", "a").alias("a"), F.coalesce("first_b", "b").alias("b"))))

    out = sets.select("id", "n").join(broadcast_if_small(copies), "id", "left").withColumn("_of", F.coalesce("first", "id"))
    label = broadcast_if_small(labels.select(F.col("id").alias("_l"), "component"))
    return out.join(label, F.col("_of") == F.col("_l"), "left").select("id", "n", F.coalesce("component", "_of").alias("component"))


def _rows(docs: DataFrame, row: str, text: str) -> DataFrame:
    return small_batches(docs).select(F.col(f"`{row}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``docs``: the size of its set
    and the smallest id that links reach."""
    named, row = named_rows(docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text)), key)
    if row == key:
        return _components_of(_rows(named, row, text)).select(F.col("id").cast(docs.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"), F.col("component").cast(docs.schema[key].dataType).alias("component_id"))
    own = named.select(F.col(f"`{row}`").alias("id"), F.col(f"`{key}`").alias("_name"))
    first = own.where("_name is not null").groupBy("_name").agg(F.min("id").alias("a"))
    united = stash(own.join(first, "_name").where("id <> a").select("a", F.col("id").alias("b")), "jaccard-united")
    found = stash(_components_of(_rows(named, row, text), united), "jaccard-components").join(own, "id")
    least = found.groupBy("component").agg(F.min("_name").alias("_least"))
    return found.join(least, "component").select(F.col("_name").alias(key), F.col("n").alias("n_shingles"), F.col("_least").alias("component_id"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked texts: the one with the smallest id (nulls
    last), whether ids repeat or not."""
    named, row = named_rows(docs, key)
    found = _components_of(_rows(named, row, text))
    if row == key:
        mark = free_name(docs, "_gone")
        gone = stash(found.where("component <> id").select(F.col("id").alias(mark)), "jaccard-gone")
        return docs.join(broadcast_if_small(gone), F.col(f"`{key}`") == F.col(f"`{mark}`"), "left_anti")
    own = named.select(F.col(f"`{row}`").alias("id"), F.col(f"`{key}`").alias("_name"))
    first = F.min(F.struct(F.col("_name").isNull().alias("x"), F.col("_name").alias("y"), F.col("id").alias("stays")))
    mark = free_name(named, "_stays")
    stay = stash(found.join(own, "id").groupBy("component").agg(first.alias("m")).select(F.col("m.stays").alias(mark)), "jaccard-stay")
    left = named.join(stay, F.col(f"`{row}`") == F.col(f"`{mark}`"), "left_semi")
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
