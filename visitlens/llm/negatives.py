"""Hard negatives of anchor vectors, by bounds along a spanning tree of the anchors.

A row's score is the integer inner product of its vector with the anchor's. An anchor's positives are its best other rows of the same
label; for each of them the hard negatives are the best rows of other labels whose score lies in a window of shares of the positive's.

Anchors (a stated query set) are taken in blocks of bounded bytes; a block and its minimum spanning tree are broadcast, and all rows are read against it
where they lie, so no row is shuffled. A row is scored with the root of the tree. From an anchor to its child the score moves by the edge's distance
times the row's norm at most, so the child's score has bounds before it is computed; only rows whose bounds still reach what is
looked for are scored again, the others hand wider bounds on. What is looked for narrows as a task goes on: the least of its best positives, or in each
window the least of its best negatives. Each block is two passes: positives, then negatives. Their best rows are merged over parts of the tasks first, then over all.

Defined results: rows with a null label or vector, or a component that is null or not finite, take no part. Rows of another dimension than the anchor's
are not compared with it. A row that repeats another is a row of its own, but an anchor that is there several times gives its rows once, and
its copies are other rows to it. A null vec_id is no anchor; such a row comes after all others of its score. Scores beyond 2^62 count as 2^62. Equal
scores go by the smaller vec_id. Only vec_id, label and embedding are read. Without anchors no row is returned.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, shared_dir, written

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
ANCHORS, LABELS, CLASSES = 100, 7, 10
#: Anchors of a block at most, and their bytes.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
SCALE = 256
LARGEST = 1 << 62
NO_ID = np.iinfo(np.int64).max
EXACT = 1 << 53
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_FOUND = pa.schema([("node", pa.int32()), ("place", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])


# ---- rows and scores ------------------------------------------------------------------------


def usable(rows: DataFrame, labels: int = LABELS, classes: int = CLASSES) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part, every ``labels``-th with the label after its own."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    moved = F.when(F.col("vec_id") % labels == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), moved.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))


@dataclass
class Rows:
    """Rows of one dimension as arrays; whole numbers in doubles."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    largest: float = 0.0
    norms: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        self.largest = float(np.abs(self.vectors).max()) if self.vectors.size else 0.0
        self.norms = np.sqrt((self.vectors**2).sum(1)) * (1 + 1e-9)

    @staticmethod
    def of(table: pa.Table | pa.RecordBatch) -> dict[int, Rows]:
        """Rows by their dimension."""
        column = table.column("embedding")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        sizes = np.diff(column.offsets.to_numpy())
        flat, ends = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE), np.cumsum(sizes)
        ids, labels = table.column("vec_id").fill_null(NO_ID).to_numpy(), table.column("label").to_numpy()
        out = {}
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            out[dim] = Rows(ids[at], labels[at], flat[(ends[at] - dim)[:, None] + np.arange(dim)])
        return out

    def scores(self, at: np.ndarray | slice, vector: np.ndarray) -> np.ndarray:
        """Inner products of some rows with a vector, exact."""
        reach = self.largest * (np.abs(vector).max() if len(vector) else 0.0) * max(len(vector), 1)
        if reach < EXACT:
            return (self.vectors[at] @ vector).astype(np.int64)
        whole = [int(x) for x in vector]
        return np.array([max(-LARGEST, min(LARGEST, sum(int(x) * y for x, y in zip(row, whole, strict=True)))) for row in self.vectors[at]], np.int64)


# ---- the tree of a block --------------------------------------------------------------------


@dataclass
class Block:
    """Anchors of one dimension and the edges of their tree: (anchor, parent, distance) from the root on, the deepest branch first."""

    anchors: Rows
    edges: list[tuple[int, int, float]]

    @staticmethod
    def of(anchors: Rows) -> Block:
        """Prim's tree over the Gram matrix of the block."""
        n, v = len(anchors.ids), anchors.vectors
        square = (v**2).sum(1)
        gram = v @ v.T
        parent, near, todo = np.zeros(n, np.int64), np.full(n, np.inf), np.ones(n, bool)
        children: list[list[int]] = [[] for _ in range(n)]
        node = 0
        for _ in range(n - 1):
            todo[node] = False
            apart = square + square[node] - 2 * gram[node]
            closer = todo & (apart < near)
            near[closer], parent[closer] = apart[closer], node
            node = int(np.where(todo, near, np.inf).argmin())
            children[parent[node]].append(node)
        edges, stack = [], [(0, -1)]
        while stack:
            node, above = stack.pop()
            edges.append((node, above, 0.0 if above < 0 else float(np.sqrt(((v[node] - v[above]) ** 2).sum())) * (1 + 1e-9)))
            stack += [(c, node) for c in children[node]]
        return Block(anchors, edges)

    def walk(self, rows: Rows, wanted: Callable[[int], tuple[float, float]], same: bool, take: Callable[[int, np.ndarray, np.ndarray], None]) -> None:
        """Give ``take`` each anchor's exact scores of the rows (of its own label or of others) that may lie between what is ``wanted``."""
        left = np.zeros(len(self.edges), np.int64)
        for _, above, _ in self.edges[1:]:
            left[above] += 1
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        every = np.arange(len(rows.ids))
        # bounds hold for scores that doubles hold
        bounded = rows.largest * self.anchors.largest * max(rows.vectors.shape[1], 1) < EXACT
        for node, above, distance in self.edges:
            least, most = wanted(node)
            of_label = (rows.labels == self.anchors.labels[node]) == same
            if above < 0:
                at, scores = every, rows.scores(slice(None), self.anchors.vectors[node])
                low, high = scores.astype(np.float64), scores.astype(np.float64)
            else:
                # one more for what doubles round
                reach = distance * rows.norms + 1 if bounded else np.inf
                low, high = bounds[above][0] - reach, bounds[above][1] + reach
                at = np.flatnonzero(of_label & (high >= least) & (low <= most))
                scores = rows.scores(at if 4 * len(at) < len(every) else slice(None), self.anchors.vectors[node])
                scores = scores if len(scores) == len(at) else scores[at]
                low[at] = high[at] = scores
                left[above] -= 1
                if not left[above]:
                    del bounds[above]
            if left[node]:
                bounds[node] = low, high
            use = (scores >= least) & (scores <= most) & of_label[at]
            take(node, at[use], scores[use])


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by score, then id."""
    return np.lexsort((ids, -scores))[:k]


class Best:
    """The first ``k`` rows of each anchor in each of its windows so far."""

    def __init__(self, block: Block, windows: list[list[tuple[int, int]]], k: int, same: bool):
        self.block, self.windows, self.k, self.same = block, windows, k, same
        none = np.zeros(0, np.int64)
        self.held = [[(none, none)] * len(w) for w in windows]
        self.least = [[low for low, _ in w] for w in windows]

    def wanted(self, node: int) -> tuple[float, float]:
        open_ = [(least, high) for least, (_, high) in zip(self.least[node], self.windows[node], strict=True) if least <= high]
        return (min(x for x, _ in open_), max(x for _, x in open_)) if open_ else (np.inf, -np.inf)

    def meet(self, rows: Rows) -> None:
        def take(node: int, at: np.ndarray, scores: np.ndarray) -> None:
            if not len(at):
                return
            for i, (_, high) in enumerate(self.windows[node]):
                inside = (scores >= self.least[node][i]) & (scores <= high)
                if inside.any():
                    s, ids = self.held[node][i]
                    s, ids = np.concatenate([s, scores[inside]]), np.concatenate([ids, rows.ids[at[inside]]])
                    first = _first(s, ids, self.k)
                    self.held[node][i] = s[first], ids[first]
                    if len(first) == self.k:
                        self.least[node][i] = int(s[first[-1]])

        self.block.walk(rows, self.wanted, self.same, take)

    def table(self) -> pa.RecordBatch:
        found = [(node, i, s, ids) for node, held in enumerate(self.held) for i, (s, ids) in enumerate(held) if len(s)]
        many = lambda values: np.repeat(np.array(values, np.int32), [len(x[2]) for x in found])
        together = lambda j: np.concatenate([x[j] for x in found]) if found else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(many([x[0] for x in found]), pa.int32()), pa.array(many([x[1] for x in found]), pa.int32()), pa.array(together(2)), pa.array(together(3))], schema=_FOUND)


def _search(rows: DataFrame, block: Block, windows: list[list[tuple[int, int]]], k: int, same: bool) -> DataFrame:
    """(node, place, score, id, nth) of the first k rows of each anchor's windows over all rows."""
    sent = rows.sparkSession.sparkContext.broadcast((block, windows))
    dim = block.anchors.vectors.shape[1]

    def search(batches):
        best = Best(*sent.value, k, same)
        for batch in batches:
            found = Rows.of(batch)
            if dim in found:
                best.meet(found[dim])
        yield best.table()

    nth = lambda *by: F.expr(f"row_number() over (partition by {', '.join(by)} order by score desc, id)")
    found = rows.mapInArrow(search, "node int, place int, score long, id long")
    parts = found.withColumn("_part", F.spark_partition_id() % 64).withColumn("nth", nth("node", "place", "_part")).filter(F.col("nth") <= k)
    return parts.withColumn("nth", nth("node", "place")).filter(F.col("nth") <= k).drop("_part")


# ---- mining ---------------------------------------------------------------------------------


def _positives(rows: DataFrame, block: Block, k: int) -> list[list[tuple[int, int]]]:
    """(id, score) of each anchor's positives in order: k + 1 rows of its label, less itself."""
    anchors = block.anchors
    found: list[list[tuple[int, int]]] = [[] for _ in anchors.ids]
    everything = [[(-2 * LARGEST, 2 * LARGEST - 1)]] * len(anchors.ids)
    for r in _search(rows, block, everything, k + 1, same=True).orderBy("node", "nth").toArrow().to_pylist():
        found[r["node"]].append((r["id"], r["score"]))
    for node, listed in enumerate(found):
        itself = (int(anchors.ids[node]), int(Rows(anchors.ids, anchors.labels, anchors.vectors[node : node + 1]).scores(slice(None), anchors.vectors[node])[0]))
        if itself in listed:
            listed.remove(itself)
        del listed[k:]
    return found


def mine_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, every: int = ANCHORS, labels: int = LABELS, block: int = BLOCK) -> DataFrame:
    """The hard negatives of each anchor (vec_id divisible by ``every``) and positive: scores from ``low`` to ``high`` percent of the positive's, best first.

    Blocks of anchors are worked through one after the other; their rows are written to a table in the shared folder.
    """
    spark = prepare(rows.sparkSession)
    kept = usable(rows, labels)
    anchors = kept.filter(F.col("vec_id") % every == 0).distinct().withColumn("dim", F.size("embedding"))
    anchors = written(anchors)
    path = f"{shared_dir(spark).rstrip('/')}/negatives-{uuid.uuid4()}"
    spark.createDataFrame([], RESULT).write.parquet(path)
    sizes = anchors.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").toArrow().to_pylist()
    for dim, n in ((r["dim"], r["n"]) for r in sizes):
        blocks = -(-n // max(1, min(block, BLOCK_BYTES // (8 * max(dim, 1)))))
        dealt = anchors.filter(F.col("dim") == dim).withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(blocks)))
        for b in range(blocks):
            found = Rows.of(dealt.filter(F.col("block") == b).toArrow())
            if dim in found:
                _mine_block(kept, Block.of(found[dim]), positives, negatives, low, high).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)


def _mine_block(rows: DataFrame, block: Block, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    listed = _positives(rows, block, positives)
    windows = [[(-(-low * s // 100), high * s // 100) for _, s in of_anchor] for of_anchor in listed]
    known = [(node, i, int(block.anchors.ids[node]), p, s) for node, of_anchor in enumerate(listed) for i, (p, s) in enumerate(of_anchor)]
    pairs = rows.sparkSession.createDataFrame(known, "node int, place int, anchor_id long, positive_id long, positive_score long")
    named = lambda c: F.when(F.col(c) != F.lit(int(NO_ID)), F.col(c)).alias(c)
    found = _search(rows, block, windows, negatives, same=False).withColumnsRenamed({"id": "negative_id", "score": "negative_score", "nth": "rank"})
    return found.join(pairs, ["node", "place"]).select("anchor_id", named("positive_id"), F.col("rank").cast("int").alias("rank"), named("negative_id"), "positive_score", "negative_score")
