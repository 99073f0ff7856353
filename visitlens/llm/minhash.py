"""Near-duplicate classes by circulant MinHash, banding and exact Jaccard verification.

Signatures use two permutations of the 32-bit integers. SIGMA scatters the shingles; coordinate k is
the least value of PI after a circular shift by k, so one pass of PI per coordinate serves the whole
signature. BANDS bands of ROWS coordinates each: at a similarity of 0.75 a pair shares no band
with a probability of (1 - 0.75**5)**56, about 2.6e-7.

Documents with equal sets are one class with one representative. No pairs are made from band groups:

1. Band entries are dealt by ranges of (band code, class), so a group of any size spreads over tasks, and each task links
   the members of a group to the group's first there; the links' components are the *clusters*. Every pair that shares a
   band lies in one cluster.
2. A cluster is verified inside tasks. It is cut into blocks of at most about MEMBERS classes and SHINGLES shingles,
   and each class's text is sent to its block once. There an inverted index of shingles gives the exact intersection of
   one set with all that are not reached yet, and a search from set to set gives the block's components.
3. Blocks of one cluster meet twice: all members with the cluster's HUBS best linked ones; then the members
   that are still outside the largest component, in lots of LOOSE, with all members of all blocks. Only links
   between different components leave a task. Every pair of a cluster is so either compared or already connected.

Most clusters are a single block. Step 3 costs a copy of a block for each lot of loose members; a cluster
whose members are mostly unlinked (pages with half their text in common) is therefore compared block by block, in
bounded tasks, at a cost that grows with the square of its members. Comparisons use the full sets, as 64-bit codes of shingles:
two different shingles of a pair of sets with n shingles agree with a probability below n**2 / 2**64.

Joins on keys that one group may dominate have plain shuffles of checkpointed frames on both sides, so Spark can
split a skewed partition of either.

Defined results: a document without words has an empty set, is linked with nothing and is kept. Rows
that repeat a doc_id each carry the result of their own text. A null doc_id represents no component:
its row takes the least id of its component and goes, or null and stays if there is none.
Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDED_CODES, Runs, as_bytes, cut, prepare, slices, word_codes, written

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 56, 5
#: Limits of a block, and of the shingles that a task gets in whole blocks.
MEMBERS, SHINGLES, TASK_SHINGLES = 2048, 1 << 20, 1 << 21
HUBS, LOOSE = 64, 512
SETS = "doc_id long, code long, n_shingles long, set_key long, bands array<long>"


def scattered(x: np.ndarray, keys: tuple[int, int, int]) -> np.ndarray:
    """A permutation of the 32-bit integers."""
    x = x ^ np.uint32(keys[0])
    x ^= x >> np.uint32(16)
    x *= np.uint32(keys[1])
    x ^= x >> np.uint32(13)
    x *= np.uint32(keys[2])
    x ^= x >> np.uint32(16)
    return x


SIGMA = (0x5BD1E995, 0x7FEB352D, 0x846CA68B)
PI = (0x2545F491, 0x85EBCA6B, 0xC2B2AE35)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Per text: sorted distinct codes of its word runs; of all words if there are fewer; nothing without words."""
    codes, starts = word_codes(texts, FOLDED_CODES)
    runs = Runs(codes)
    all_runs = runs.of(size)
    whole = runs.between(starts[:-1], starts[1:])
    out = []
    for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        out.append(np.unique(all_runs[a : b - size + 1]) if b - a >= size else whole[i : i + (b > a)])
    return out


def signature_bands(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS codes per set; the sets are not empty."""
    values = scattered((np.concatenate(sets) >> np.uint64(32)).astype(np.uint32), SIGMA)
    ends = np.cumsum([len(s) for s in sets])
    starts = np.r_[0, ends[:-1]]
    out = np.zeros((len(sets), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        least = np.minimum.reduceat(scattered(values + np.uint32(k), PI), starts)
        band = out[:, k // ROWS]
        band *= np.uint64(0x9E3779B97F4A7C15)
        band += least + np.uint64(k + 1)
        band ^= band >> np.uint64(29)
    return out.view(np.int64)


def set_key(items: np.ndarray) -> int | None:
    return int.from_bytes(md5(items.tobytes()).digest()[:8], "little", signed=True) if len(items) else None


def _signed(batches):
    for batch in batches:
        texts, ids, codes = as_bytes(batch.column("text")), batch.column("doc_id"), batch.column("code")
        for a, b in slices(texts, 1 << 20):
            sets = shingle_sets(texts[a:b])
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            if full:
                for i, row in zip(full, signature_bands([sets[i] for i in full]), strict=True):
                    bands[i] = row
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([ids[a:b], codes[a:b], *columns], names=["doc_id", "code", "n_shingles", "set_key", "bands"])


# ---- candidates -----------------------------------------------------------------------------


def _starred(batches):
    """Sorted (bucket, id) entries: a link from each to the first of its bucket here, and the first and last bucket."""
    at, first = None, None
    for batch in batches:
        buckets, ids = (batch.column(c).to_numpy() for c in ("bucket", "id"))
        if not len(buckets):
            continue
        head = np.flatnonzero(np.diff(buckets, prepend=~buckets[:1]) != 0)
        firsts = np.repeat(ids[head], np.diff(np.r_[head, len(ids)]))
        if buckets[0] == at:
            firsts[buckets == at] = first
        ends = [(int(buckets[0]), int(firsts[0]))] if at is None else []
        at, first = int(buckets[-1]), int(firsts[-1])
        yield _linked(np.unique(np.stack([firsts, ids], 1)[firsts != ids], axis=0), ends)
    if at is not None:
        yield _linked(np.zeros((0, 2), np.int64), [(at, first)])


def _linked(links: np.ndarray, ends: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = [[*links[:, 0].tolist(), *(i for _, i in ends)], [*links[:, 1].tolist(), *(None for _ in ends)], [*(None for _ in links), *(b for b, _ in ends)]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "bucket"])


def candidate_links(classes: DataFrame) -> DataFrame:
    """(a, b) links that connect all classes of each band group; classes are (id, bands)."""
    entries = classes.select("id", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "id")
    dealt = entries.repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id")
    found = cut(dealt.mapInArrow(_starred, "a long, b long, bucket long"))
    # a group that goes on in the next range has an end in each
    ends = found.filter("bucket is not null").select("bucket", "a")
    over = ends.groupBy("bucket").agg(F.min("a").alias("first"))
    across = ends.join(over, "bucket").filter("a <> first").select(F.col("first").alias("a"), F.col("a").alias("b"))
    return found.filter("bucket is null").select("a", "b").union(across).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(id, component): the least id that each node of the (a, b) links reaches.

    Each round hooks every node to its least neighbour, follows the hooks a few steps, and goes on with the links
    between what is left, which soon are few.
    """
    links, labels = written(links.filter("a <> b")), None
    while True:
        both = links.select(F.col("a").alias("id"), F.col("b").alias("to")).union(links.select("b", "a"))
        hooks = written(both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("to")))
        for _ in range(3):
            hooks = hooks.join(hooks.select(F.col("id").alias("to"), F.col("to").alias("up")), "to").select("id", F.col("up").alias("to"))
            hooks = written(hooks)
        if labels is None:
            labels = hooks.withColumnRenamed("to", "component")
        else:
            up = hooks.select(F.col("id").alias("component"), F.col("to").alias("up"))
            labels = written(labels.join(up, "component", "left").select("id", F.coalesce("up", "component").alias("component")))
        a, b = (hooks.select(F.col("id").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        between = links.join(a, "a").join(b, "b").filter("to_a <> to_b")
        links = written(between.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        if links.isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links between components."""
    up = connected(links).select(F.col("id").alias("component"), F.col("component").alias("top"))
    return cut(labels.join(up, "component", "left").select("id", F.coalesce("top", "component").alias("component")))


# ---- verification inside blocks -------------------------------------------------------------


class Overlaps:
    """An inverted index of some sets: how many items one set has in common with each."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        codes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(codes, kind="stable")
        self.owner = np.repeat(np.arange(self.n), [len(s) for s in sets])[order]
        self.codes, first = np.unique(codes[order], return_index=True)
        self.first = np.r_[first, len(codes)]

    def of(self, items: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(self.n, np.int64)
        at = np.minimum(np.searchsorted(self.codes, items), len(self.codes) - 1)
        at = at[self.codes[at] == items]
        sizes = self.first[at + 1] - self.first[at]
        places = np.repeat(self.first[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return np.bincount(self.owner[places], minlength=self.n)


def similar(common: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    return 100 * common >= PERCENT * (size + sizes - common)


def components(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each set the first of its component, and how many it reached first in the search."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    label, reached, left = np.full(n, -1), np.zeros(n, np.int64), np.ones(n, bool)
    members, n_left = np.arange(n), n
    index = Overlaps(sets)
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed], label[seed], queue = False, seed, [seed]
        n_left -= 1
        while queue and n_left:
            x = queue.pop()
            if 2 * n_left < len(members):
                members = np.flatnonzero(left)
                index = Overlaps([sets[i] for i in members])
            found = members[left[members] & similar(index.of(sets[x]), len(sets[x]), sizes[members])]
            label[found], left[found], reached[x] = seed, False, len(found)
            n_left -= len(found)
            queue += found.tolist()
    return label, reached


def crossing(sets: list[np.ndarray], labels: np.ndarray, asks: list[np.ndarray], asking: np.ndarray) -> np.ndarray:
    """Distinct pairs of labels between which some of ``asks`` is linked with one of ``sets``."""
    index, sizes, out = Overlaps(sets), np.array([len(s) for s in sets], np.int64), set()
    for items, own in zip(asks, asking.tolist(), strict=True):
        found = labels[similar(index.of(items), len(items), sizes)]
        out |= {(min(own, x), max(own, x)) for x in np.unique(found).tolist() if x != own}
    return np.array(sorted(out), np.int64).reshape(-1, 2)


def _blocks(table: pa.Table, *keys: str):
    """Parts of a table with equal keys."""
    table = table.sort_by([(k, "ascending") for k in (*keys, "id")])
    new = np.zeros(len(table), bool)
    new[:1] = True
    for k in keys:
        x = table[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    at = [*np.flatnonzero(new).tolist(), len(table)]
    for a, b in zip(at, at[1:], strict=False):
        yield table.slice(a, b - a)


def _sets_of(part: pa.Table) -> list[np.ndarray]:
    texts = as_bytes(part["text"])
    return [s for a, b in slices(texts) for s in shingle_sets(texts[a:b])]


_FOUND = "cluster long, block int, id long, label long, hub boolean"


def _verify(hubs: int):
    """Of whole blocks: for each member the least id of its component there, and whether it is a hub of a cluster of several blocks."""

    def verify(table):
        out = {"cluster": [], "block": [], "id": [], "label": [], "hub": []}
        for part in _blocks(table, "cluster", "block"):
            ids = part["id"].to_numpy()
            label, reached = components(_sets_of(part))
            blocks, block = part["blocks"][0].as_py(), part["block"][0].as_py()
            hub = np.zeros(len(ids), bool)
            if 1 < blocks and block < hubs:
                hub[np.argsort(-reached, kind="stable")[: -(-hubs // blocks)]] = True
            for c, x in zip(out, (part["cluster"].to_numpy(), part["block"].to_numpy(), ids, ids[label], hub), strict=True):
                out[c].append(x)
        return pa.table({c: np.concatenate(x) for c, x in out.items()})

    return verify


def _compared(table: pa.Table) -> pa.Table:
    """One block and those that ask it: pairs of components with a link between them."""
    asks = table["asks"].to_numpy()
    own, other = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
    found = crossing(_sets_of(own), own["label"].to_numpy(), _sets_of(other), other["label"].to_numpy())
    return pa.table({"a": found[:, 0], "b": found[:, 1]})


def _met(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Links between components of the members and the askers of each (cluster, block, lot)."""
    return cut(texts.join(rows, "id").groupBy("cluster", "block", "lot").applyInArrow(_compared, "a long, b long").distinct())


def verified(docs: DataFrame, clusters: DataFrame, members: int = MEMBERS, hubs: int = HUBS, loose: int = LOOSE) -> DataFrame:
    """(id, component) of the classes in clusters; docs are (code, text), clusters (id, code, n_shingles, cluster)."""
    totals = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("n") / members), F.ceil(F.col("shingles") / SHINGLES)).cast("int")
    totals = cut(totals.select("cluster", blocks.alias("blocks"), "shingles"))
    tasks = -(-(totals.agg(F.sum("shingles")).first()[0] or 0) // TASK_SHINGLES) or 1
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = clusters.join(totals.select("cluster", "blocks"), "cluster").withColumn("block", block)
    placed = placed.select("id", "code", "cluster", "block", "blocks", F.pmod(F.xxhash64("cluster", "block"), F.lit(tasks)).alias("task"))
    # rows with one code are equal
    texts = docs.dropDuplicates(["code"]).join(placed, "code").drop("code")
    large = totals.filter("blocks > 1").select("cluster", "blocks")
    alone = large.isEmpty()
    texts = texts if alone else cut(texts)
    found = cut(texts.groupBy("task").applyInArrow(_verify(hubs), _FOUND))
    labels = found.select("id", F.col("label").alias("component"))
    if alone:
        return labels
    rows = cut(found.join(large, "cluster"))
    texts = texts.filter("blocks > 1").select("id", "text")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    asked = rows.select("id", "label", "cluster", "block", F.lit(0).alias("lot"), F.lit(False).alias("asks"))
    asking = rows.filter("hub").select("id", "label", "cluster", every, F.lit(0).alias("lot"), F.lit(True).alias("asks"))
    own = merged(rows.select("id", F.col("label").alias("component")), _met(texts, asked.union(asking)))
    rows = cut(rows.drop("label").join(own.withColumnRenamed("component", "label"), "id"))
    sizes = rows.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    largest = cut(sizes.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("top")).select("cluster", F.col("top.label").alias("largest")))
    outside = cut(rows.join(largest, "cluster").filter("label <> largest"))
    lots = cut(outside.groupBy("cluster").agg(F.ceil(F.count("*") / loose).cast("int").alias("lots")))
    if not lots.isEmpty():
        each = F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot")
        asked = rows.join(lots, "cluster").select("id", "label", "cluster", "block", each, F.lit(False).alias("asks"))
        lot = F.pmod(F.xxhash64("id", F.lit(1)), F.col("lots")).cast("int").alias("lot")
        asking = outside.join(lots, "cluster").select("id", "label", "cluster", every, lot, F.lit(True).alias("asks"))
        own = merged(own, _met(texts, asked.union(asking)))
    return labels.join(own.select("id"), "id", "left_anti").union(own)


def class_labels(docs: DataFrame, classes: DataFrame, **limits: int) -> DataFrame:
    """(id, component) of the classes that share a band with another; classes are (id, code, n_shingles, bands), one for each set."""
    clusters = connected(candidate_links(classes))
    named = classes.select("id", "code", "n_shingles").join(clusters.withColumnRenamed("component", "cluster"), "id")
    return verified(docs, cut(named), **limits)


# ---- documents ------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, **limits: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (the least id of each component stays). ``limits`` are those of ``verified``."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("code", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))
    signed = cut(docs.mapInArrow(_signed, SETS))
    classes = cut(signed.filter("n_shingles > 0").groupBy(F.col("set_key").alias("id")).agg(F.min("doc_id").alias("doc_id"), F.min("code").alias("code"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))
    labels = class_labels(docs.select("code", "text"), classes.drop("doc_id"), **limits)
    labelled = classes.select("id", "doc_id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # dealt anew, so that the join below has plain shuffles on both sides
    least_id = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id")).repartition("component_id")
    of_set = cut(labelled.join(least_id, "component").select(F.col("id").alias("set_key"), "component_id"))
    found = signed.select("doc_id", "n_shingles", "set_key").join(of_set, "set_key", "left")
    least = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", least.alias("component_id"), F.coalesce(F.col("doc_id") == least, least.isNull()).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, less all but one of each component: the one with the least doc_id, null last.

    Each row has a verdict of its own, by a 64-bit code of its columns: rows that share a doc_id are told apart, a row
    without an id goes or stays like any other, and of equal rows one stays. Rows without words are linked with nothing
    and all stay.
    """
    prepare(docs.sparkSession)
    columns = docs.columns
    code = F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", code.alias("code"))
    signed = cut(texts.mapInArrow(_signed, SETS)).filter("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "code")
    classes = cut(signed.groupBy(F.col("set_key").alias("id")).agg(F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"), F.min(order).alias("best")))
    labels = class_labels(texts.select("code", "text"), classes.select("id", F.col("best.code").alias("code"), "n_shingles", "bands"))
    named = classes.select("id", "best").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    stays = named.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.code").alias("code"), F.lit(True).alias("stays"))
    rows = cut(signed.groupBy("code").agg(F.count("*").alias("n")).join(stays, "code", "left").filter("stays is null or n > 1"))
    coded = docs.withColumn("_row", code)
    verdict = rows.select(F.col("code").alias("_row"), "stays")
    single = coded.join(verdict.select("_row"), "_row", "left_anti").select(*columns)
    equal = coded.join(verdict.filter("stays").select("_row"), "_row", "left_semi").select(*columns).distinct()
    return single.union(equal)
