"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Every text becomes the set of its distinct word shingles, a digest of that set (its class) and 128 MinHash values.
   Equal sets are one class from here on, so exact copies cost nothing more, whatever their number.
2. The forest: 32 orders (trees). In each, a class is sorted by 8 of its MinHash values. The range shuffle spreads the
   orders over tasks by the whole label, so a crowded region is cut where its labels differ.
   Classes that agree in the first 4 values are a region: two sets of similarity 0.75 share one in at least one
   order with probability 1 - 5e-6, of similarity 0.8 with 1 - 5e-8.
3. Depth adapts to the region: each class is first compared only with its neighbours of longest common prefix, as deep as
   the region allows. Confirmed links are contracted to components.
4. The rest, exactly: in regions that hold more than one component, members of different components meet in blocks of
   bounded size, each pair in the first order in which it shares a region. Pairs whose estimate from all 128 values is not more
   than 5 standard errors below the threshold are confirmed on the full sets inside the block, where only links leave:
   at most one per class and component, not the pairs that were looked at.

A link is never taken from an estimate: every one is confirmed on the full shingle sets (64-bit digests of shingles).

Defined cases: null or wordless text has an empty set and no links. Rows that repeat a doc_id are one document (linked). A row
without doc_id has no component (null) and is kept. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.components import components
from veilspan.llm.text import WHITE, group_bounds, mix, runs, windows, word_blocks
from veilspan.session import materialise

VALUES = 128
TREES = 32
PREFIX = 4
DEPTH = 8
NEIGHBOURS = 2
SIDE = 2048

_RNG = np.random.default_rng(11)
_MULTIPLY = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)
_FLIP = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def _sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle digests) of every text."""
    for low, high, hashes, _, _, first in word_blocks(column, WHITE):
        shingles = windows(hashes, words)
        for i in range(high - low):
            a, b = first[i], first[i + 1]
            if b - a >= words:
                yield low + i, np.unique(shingles[a : b - words + 1])
            else:
                yield low + i, windows(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def _class(shingles: np.ndarray) -> int:
    """Digest of a set."""
    total = np.sum(mix(shingles + np.uint64(0x51ED270B)), dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _signature(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 4096):
        values = low[None, k : k + 4096] ^ _FLIP[:, None]
        values *= _MULTIPLY[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, class, signature (128 big-endian unsigned 32-bit values; null for an empty set)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, sig = [], [], []
            for _, shingles in _sets(batch.column("text"), words):
                n.append(len(shingles))
                cls.append(_class(shingles) if len(shingles) else None)
                sig.append(_signature(shingles).astype(">u4").tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sig, pa.binary())],
                ["doc_id", "n_shingles", "class", "signature"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, n_shingles long, class long, signature binary")


def _region_keys(values: np.ndarray) -> np.ndarray:
    """Keys of the regions of signatures (classes by 128 values): one per order."""
    firsts = values.reshape(len(values), TREES, PREFIX).astype(np.uint64)
    region = np.broadcast_to(np.arange(TREES, dtype=np.uint64), firsts.shape[:2])
    for d in range(PREFIX):
        region = mix(region * np.uint64(5) + firsts[:, :, d])
    return region.view(np.int64)


def _labels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per order: its number and first values, the further values, the class."""
    places = (np.arange(TREES)[:, None] * PREFIX + np.arange(PREFIX, DEPTH)[None, :]) % VALUES
    for batch in batches:
        for k in range(0, batch.num_rows, 2048):
            part = batch.slice(k, 2048)
            sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), ">u4").reshape(-1, VALUES).astype(np.uint32)
            deep = np.ascontiguousarray(sig[:, places].astype(">u4")).view(f"S{4 * (DEPTH - PREFIX)}").ravel()
            deep = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(4 * (DEPTH - PREFIX)), len(deep), [None, pa.py_buffer(deep.tobytes())]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_region_keys(sig).ravel()),
                    deep.cast(pa.binary()),
                    pa.array(np.repeat(part.column("class").to_numpy(zero_copy_only=False), TREES)),
                ],
                ["region", "deep", "class"],
            )


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of regions, each with the class before it in the order and how many further values they share.

    A region of one class is left out, unless it is the task's first or last: it may go on in the next one.
    """
    opened, held = True, None
    for table in runs(batches, ["region"]):
        if held is not None:
            yield from _members(held, opened, False)
            opened = False
        held = table
    if held is not None:
        yield from _members(held, opened, True)


def _members(table: pa.Table, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
    bounds = group_bounds(table, ["region"])
    size = np.repeat(np.diff(bounds), np.diff(bounds))
    keep = size > 1
    if first:
        keep[: bounds[1]] = True
    if last:
        keep[bounds[-2] :] = True
    region = table.column("region").to_numpy()
    cls = table.column("class").to_numpy()
    joined = b"".join(table.column("deep").to_pylist())
    deep = np.frombuffer(joined, ">u4").reshape(-1, DEPTH - PREFIX)
    shared = np.zeros(len(cls), np.int32)
    shared[1:] = np.cumprod(deep[1:] == deep[:-1], axis=1).sum(axis=1)
    before = np.zeros(len(cls), np.int64)
    before[1:] = cls[:-1]
    none = np.ones(len(cls), bool)
    none[1:] = region[1:] != region[:-1]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(region[keep]),
            pa.array(cls[keep]),
            pa.array(before[keep], mask=none[keep]),
            pa.array(shared[keep]),
        ],
        ["region", "class", "before", "shared"],
    )


def _shingle_sets(docs: DataFrame, classes: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """class and shingles (sorted 64-bit digests) of the classes that share a region with another."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(_class(s), s.tobytes()) for _, s in _sets(batch.column("text"), words) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["class", "shingles"]
            )

    # Regions at the edge of a task may hold one class only.
    crowded = members.groupBy("region").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a <> z").select("region")
    needed = members.join(crowded, "region", "left_semi").select("class").distinct()
    needed = materialise(needed.join(classes.select("class", F.col("rep").alias("doc_id")), "class"), "needed")
    # The ids grow with the documents: no broadcast, at any size.
    ids = needed.select("doc_id").distinct().hint("merge")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    # A repeated doc_id may bring other texts: only the classes asked for stay, once each.
    sets = texts.select("text").mapInArrow(run, "class long, shingles binary").join(needed.select("class"), "class", "left_semi")
    return materialise(sets.groupBy("class").agg(F.first("shingles").alias("shingles")), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""

    def similar(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda key, name: sets.select(F.col("class").alias(key), F.col("shingles").alias(name))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(similar, "a long, b long")


def _meeting(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the regions with more than one component, dealt so that those outside a region's largest component
    (side 0) meet all its members (side 1) in blocks (region, i, j)."""
    named = members.select("region", "class").join(labels, members["class"] == labels["node"], "left")
    named = named.select("region", "class", F.coalesce("label", "class").alias("label"))
    sizes = named.groupBy("region", "label").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("region").agg(
        F.sum("n").alias("rows"), F.max(F.struct("n", "label")).alias("major"), F.count("*").alias("parts")
    )
    mixed = mixed.where("parts > 1").select(
        "region", F.col("major.label").alias("major"),
        F.ceil(F.col("rows") / SIDE).alias("all_blocks"), F.ceil((F.col("rows") - F.col("major.n")) / SIDE).alias("other_blocks"),
    )
    rows = materialise(named.join(mixed, "region").withColumn("other", F.col("label") != F.col("major")), "mixed")
    place = lambda blocks: F.pmod(F.xxhash64("class", "region"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1))
    own = ["region", "class", "label", "other"]
    left = rows.where("other").select(*own, F.lit(0).alias("side"), place("other_blocks").alias("i"), every("all_blocks").alias("j"))
    right = rows.select(*own, F.lit(1).alias("side"), every("other_blocks").alias("i"), place("all_blocks").alias("j"))
    return left.union(right)


_BLOCK = ["region", "i", "j"]
_DEALT = "region long, class long, label long, other boolean, side int, i int, j int"


def _candidates(table: pa.Table, similarity: int) -> Iterator[tuple[int, np.ndarray]]:
    """For every row of side 0: the rows of side 1 in its block that may be similar and are apart from it."""
    bounds = group_bounds(table, _BLOCK)
    cls, label, region = (table.column(c).to_numpy() for c in ("class", "label", "region"))
    side, n, other = (table.column(c).to_numpy() for c in ("side", "n_shingles", "other"))
    sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), ">u4").reshape(-1, VALUES).astype(np.uint32)
    least = similarity / 100 - 5 * np.sqrt(similarity / 100 * (1 - similarity / 100) / VALUES)
    for low, high in zip(bounds[:-1], bounds[1:]):
        x = low + np.flatnonzero(side[low:high] == 0)
        y = low + np.flatnonzero(side[low:high] == 1)
        tree = int(np.flatnonzero(_region_keys(sig[low : low + 1])[0] == region[low])[0])
        for i in x:
            # Two classes outside the largest component meet once, not from both sides.
            z = y[(label[y] != label[i]) & (~other[y] | (cls[y] > cls[i]))]
            z = z[100 * np.minimum(n[z], n[i]) >= similarity * np.maximum(n[z], n[i])]
            if len(z):
                equal = sig[z] == sig[i]
                z, equal = z[(ok := equal.mean(axis=1) >= least)], equal[ok]
                # In this order for the first time?
                before = equal[:, : tree * PREFIX].reshape(len(z), tree, PREFIX).all(axis=2).any(axis=1)
                z = z[~before]
            yield i, z


def _links_apart(members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) between classes that share a region and lie in different components."""

    def taking_part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, _BLOCK):
            some = np.zeros(table.num_rows, bool)
            for i, z in _candidates(table, similarity):
                some[z] = True
                some[i] |= len(z) > 0
            yield from table.select(["region", "class", "label", "other", "side", "i", "j"]).filter(pa.array(some)).to_batches()

    def confirmed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, _BLOCK):
            cls, label = table.column("class").to_numpy(), table.column("label").to_numpy()
            own = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("shingles")]
            size = np.array([len(s) for s in own])
            out: list[tuple[int, int]] = []
            for i, z in _candidates(table, similarity):
                if not len(z):
                    continue
                x = own[i]
                every = np.concatenate([own[k] for k in z])
                at = np.minimum(np.searchsorted(x, every), len(x) - 1)
                both = np.add.reduceat((x[at] == every).astype(np.int64), np.cumsum(size[z]) - size[z])
                z = z[100 * both >= similarity * (len(x) + size[z] - both)]
                z = z[np.unique(label[z], return_index=True)[1]]
                out += [(int(cls[i]), int(cls[k])) for k in z]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (zip(*out) if out else ((), ()))], ["a", "b"])

    sigs = classes.select("class", "n_shingles", "signature")
    dealt = _meeting(members, labels).join(sigs, "class")
    part = dealt.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK).mapInArrow(taking_part, _DEALT)
    part = materialise(part, "meeting")
    full = part.join(sigs, "class").join(sets, "class")
    return full.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK).mapInArrow(confirmed, "a long, b long").distinct()


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links (a, b) between classes: only components are joined, not their members again."""
    name = lambda key: labels.select(F.col("node").alias(key), F.col("label").alias(f"l{key}"))
    named = links.select("a", "b").join(name("a"), "a", "left").join(name("b"), "b", "left")
    joined = components(named.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    follow = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
    moved = labels.join(follow, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return materialise(moved.union(joined.join(labels, "node", "left_anti")), "labels")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    signed = materialise(signatures(docs, words), "signatures")
    classes = signed.where("class is not null and doc_id is not null").groupBy("class").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
    )
    classes = materialise(classes, "classes")
    order = classes.select("class", "signature").mapInArrow(_labels, "region long, deep binary, class long")
    order = order.repartitionByRange("region", "deep", "class").sortWithinPartitions("region", "deep", "class")
    members = materialise(order.mapInArrow(_neighbours, "region long, class long, before long, shared int"), "regions")

    near = members.where("before is not null").groupBy(F.least("class", "before").alias("a"), F.greatest("class", "before").alias("b"))
    near = near.agg(F.max("shared").alias("shared"), F.first("class").alias("class"))
    best = near.groupBy("class").agg(F.slice(F.sort_array(F.collect_list(F.struct("shared", "a", "b")), False), 1, NEIGHBOURS).alias("best"))
    pairs = materialise(best.select(F.explode("best").alias("p")).select("p.a", "p.b").distinct(), "pairs")
    sets = _shingle_sets(docs, classes, members, words)
    links = _confirm(pairs, sets, similarity)
    # Rows that repeat a doc_id are one document.
    repeated = signed.where("class is not null and doc_id is not null").groupBy("doc_id").agg(
        F.min("class").alias("a"), F.max("class").alias("z")
    ).where("a <> z")
    repeated = signed.join(repeated, "doc_id").select("a", F.col("class").alias("b"))
    labels = components(links.union(repeated))

    labels = _relabel(labels, _links_apart(members, labels, classes, sets, similarity))

    named = classes.select("class", "rep").join(labels.withColumnRenamed("node", "class"), "class", "left")
    named = named.select("class", "rep", F.coalesce("label", "class").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "label").select("class", "component_id")
    out = signed.select("doc_id", "n_shingles", "class").join(named, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"),
    )
