"""A trie of conversations by their turns, built as adaptive radix trees.

1. A turn's id is the 128-bit digest of its role and text, written as a fixed-width big-endian number; a conversation's key is
   its turns' ids side by side. Only ids and word counts leave the table's rows, the texts do not.
2. Equal conversations are counted first. The distinct keys are sorted over the whole corpus (range partitions) and taken in
   runs of ``BLOCK`` turns; every run becomes an adaptive radix tree: nodes of 4, 16, 48 or 256 children that grow as they fill, and
   paths without a branch kept as one edge. A tree's nodes stand at any byte; only depths at a turn's border become trie nodes,
   so an edge over several turns gives one for each of them.
3. A trie node that is no prefix of its run's first or last key has all its conversations in the run, and is final. Those others
   are open: they are summed over the runs by their digest. An open node of one run only is final as well. Of a node that
   several runs share, the sums below it come from what hangs on it closed, from the nodes of one run below a shared one,
   and from the shared ones themselves, each counted once for each of its ancestors. Shared nodes are few: each border
   between runs has as many as its two neighbouring keys have turns in common.
4. The hash of the conversations that end at a node needs their ids in order. They are sorted by key and id over the whole
   corpus, joined to strings of at most ``JOINED`` ids in parallel, and those strings go one by one through the hash, whose state is
   all that is held. A hot key is many short strings' hash in one task, as the hash is one of all ids in order.

Defined cases: rows are ordered by turn (null first), then by the turn's digest; rows that repeat are turns of their own. Null
roles and texts are empty. Rows without conv_id belong to no conversation and take no part. A conversation rebuilt to no turn
ends at the root. Without conversations there is no node, the root included. Other columns are not read. A conversation
is one row of 20 bytes a turn from its gathering on.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.session import materialise, remove_folders

WIDTH = 16
#: Turns of a run.
BLOCK = 1 << 17
#: Ids in one string.
JOINED = 1 << 14
WORD = r"[^\x20\x09-\x0D]+"


# The tree


class Node4:
    """At most ``ROOM`` children: their bytes in order, beside them the children."""

    ROOM = 4
    __slots__ = ("children", "keys")

    def __init__(self, keys: Iterable[int] = (), children: Iterable[Tree] = ()) -> None:
        self.keys, self.children = bytearray(keys), list(children)

    def get(self, byte: int) -> Tree | None:
        at = self.keys.find(byte)
        return self.children[at] if at >= 0 else None

    def put(self, byte: int, child: Tree) -> Node4 | Node48:
        """This layout, or the next larger one if there was no room."""
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.children[at] = child
            return self
        if len(self.keys) == self.ROOM:
            return self.grown().put(byte, child)
        self.keys.insert(at, byte)
        self.children.insert(at, child)
        return self

    def grown(self) -> Node4 | Node48:
        return Node16(self.keys, self.children)

    def items(self) -> Iterator[tuple[int, Tree]]:
        return zip(self.keys, self.children)


class Node16(Node4):
    ROOM = 16
    __slots__ = ()

    def grown(self) -> Node48:
        return Node48(self.items())


class Node48:
    """At most 48 children, found by a table of all bytes."""

    __slots__ = ("children", "slots")

    def __init__(self, items: Iterable[tuple[int, Tree]]) -> None:
        self.slots, self.children = bytearray(256), []
        for byte, child in items:
            self.put(byte, child)

    def get(self, byte: int) -> Tree | None:
        slot = self.slots[byte]
        return self.children[slot - 1] if slot else None

    def put(self, byte: int, child: Tree) -> Node48 | Node256:
        slot = self.slots[byte]
        if slot:
            self.children[slot - 1] = child
            return self
        if len(self.children) == 48:
            return Node256(self.items()).put(byte, child)
        self.children.append(child)
        self.slots[byte] = len(self.children)
        return self

    def items(self) -> Iterator[tuple[int, Tree]]:
        return ((byte, self.children[slot - 1]) for byte, slot in enumerate(self.slots) if slot)


class Node256:
    """A place for every byte."""

    __slots__ = ("children",)

    def __init__(self, items: Iterable[tuple[int, Tree]]) -> None:
        self.children: list[Tree | None] = [None] * 256
        for byte, child in items:
            self.children[byte] = child

    def get(self, byte: int) -> Tree | None:
        return self.children[byte]

    def put(self, byte: int, child: Tree) -> Node256:
        self.children[byte] = child
        return self

    def items(self) -> Iterator[tuple[int, Tree]]:
        return ((byte, child) for byte, child in enumerate(self.children) if child is not None)


class Tree:
    """A place at byte ``end`` of ``key``, which all keys below share up to there; ``row`` is the key's that ends here."""

    __slots__ = ("end", "key", "layout", "row")

    def __init__(self, key: bytes, end: int, row: int | None = None) -> None:
        self.key, self.end, self.row = key, end, row
        self.layout: Node4 | Node48 | Node256 | None = None

    def put(self, child: Tree) -> None:
        self.layout = (self.layout or Node4()).put(child.key[self.end], child)


def first_difference(a: bytes, b: bytes, start: int, end: int) -> int:
    """The first byte from ``start`` on in which the two differ, at most ``end`` or the shorter one's length."""
    end = min(end, len(a), len(b))
    x, y = a[start:end], b[start:end]
    if x == y:
        return end
    gap = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return end - (gap.bit_length() + 7) // 8


def build(keys: list[bytes]) -> Tree:
    """The tree of distinct keys; its root stands at byte 0."""
    root = Tree(b"", 0)
    for row, key in enumerate(keys):
        tree, parent = root, None
        while True:
            same = first_difference(key, tree.key, parent.end if parent else 0, tree.end)
            if same < tree.end:
                # The path parts here: a tree of its own takes the place.
                fork = Tree(key, same)
                fork.put(tree)
                parent.put(fork)
                tree = fork
            if same == len(key):
                tree.row = row
                break
            child = tree.layout.get(key[same]) if tree.layout else None
            if child is None:
                tree.put(Tree(key, len(key), row))
                break
            tree, parent = child, tree
    return root


# One run of keys

_NODE = (
    "node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "words long, open boolean, closed_children long, closed_leaves long, closed_saved long, path array<binary>"
)
_NODE_TYPES = pa.schema(
    [("node", pa.binary()), ("parent", pa.binary()), *((n, pa.int64()) for n in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "words")),
     ("open", pa.bool_()), *((n, pa.int64()) for n in ("closed_children", "closed_leaves", "closed_saved")), ("path", pa.list_(pa.binary()))]
)


def run_nodes(keys: list[bytes], words: list[list[int]], counts: list[int], least: list[int]) -> pa.RecordBatch:
    """The trie nodes of a run of sorted distinct keys: turn-aligned places of its tree, parents before children."""
    first, last = keys[0], keys[-1]
    parent, depth, digest, own_words, own_row = [-1], [0], [hashlib.md5().digest()], [0], [None]
    # Whether a node is a prefix of the first and of the last key.
    edges = [(True, True)]
    words_of = dict(zip(keys, words))
    stack = [(build(keys), 0, 0, hashlib.md5())]
    while stack:
        tree, at, start, state = stack.pop()
        state = state.copy()
        for border in range(start // WIDTH, tree.end // WIDTH):
            turn = slice(border * WIDTH, (border + 1) * WIDTH)
            state.update(tree.key[turn])
            edges.append(tuple(on and edge[turn] == tree.key[turn] for on, edge in zip(edges[at], (first, last))))
            parent.append(at)
            at = len(depth)
            depth.append(border + 1)
            digest.append(state.digest())
            own_words.append(words_of[tree.key][border])
            own_row.append(None)
        if tree.row is not None:
            own_row[at] = tree.row
        if tree.layout:
            stack.extend((child, at, tree.end, state) for _, child in tree.layout.items())
    n = len(depth)
    n_convs, conv_id = [0] * n, [None] * n
    for k, row in enumerate(own_row):
        if row is not None:
            n_convs[k], conv_id[k] = counts[row], least[row]
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    closed_children, closed_leaves, closed_saved = [0] * n, [0] * n, [0] * n
    is_open = [any(on) for on in edges]
    for k in range(n - 1, -1, -1):
        saved[k] += (n_convs[k] - 1) * own_words[k]
        leaves[k] = leaves[k] or 1
        up = parent[k]
        if up >= 0:
            n_convs[up] += n_convs[k]
            conv_id[up] = conv_id[k] if conv_id[up] is None else min(conv_id[up], conv_id[k])
            children[up] += 1
            leaves[up] += leaves[k]
            saved[up] += saved[k]
            if not is_open[k]:
                closed_children[up] += 1
                closed_leaves[up] += leaves[k]
                closed_saved[up] += saved[k]
    paths: list[list[bytes] | None] = []
    for k in range(n):
        paths.append(None if not is_open[k] else [] if parent[k] < 0 else [*paths[parent[k]], digest[parent[k]]])
    columns = [
        # A closed node's parent is looked up only where other runs may have it too.
        digest, [digest[p] if p >= 0 and is_open[p] else None for p in parent], depth, conv_id, [conv_id[p] if p >= 0 else None for p in parent],
        n_convs, children, leaves, saved, own_words, is_open, closed_children, closed_leaves, closed_saved, paths,
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE_TYPES)], schema=_NODE_TYPES)


def _runs(block: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the runs of a sorted partition."""
    held: tuple[list, ...] = ([], [], [], [])
    turns = 0
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ("key", "words", "n", "conv_id"))):
            for column, value in zip(held, row):
                column.append(value)
            turns += 1 + len(row[1])
            if turns >= block:
                yield run_nodes(*held)
                held, turns = ([], [], [], []), 0
    if held[0]:
        yield run_nodes(*held)


# Conversations


def own_turns(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (id and words of each, in order)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        # The role's length ends it: no two pairs read alike.
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("id"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "words"))).alias("turns"))
    return whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def rebuilt(turns: DataFrame, base: Column, shared: Column, most: int) -> DataFrame:
    """``turns`` with the first ``shared`` (at most ``most``) turns taken from conversation ``base``; no turns if it is absent."""
    heads = turns.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_head"))
    joined = turns.withColumns({"_base": base, "_shared": shared}).join(heads, "_base", "left")
    none = F.array().cast(turns.schema["turns"].dataType)
    head = F.slice(F.coalesce("_head", none), F.lit(1), F.col("_shared"))
    return joined.select("conv_id", F.concat(head, F.expr("slice(turns, _shared + 1, greatest(size(turns), 1))")).alias("turns"))


def trie(turns: DataFrame, block: int = BLOCK, joined: int = JOINED) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256."""
    spark = turns.sparkSession
    folders: list[str] = []
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")).alias("key")
    keyed = turns.select("conv_id", key, F.transform("turns", lambda t: t["words"].cast("long")).alias("words"))
    keyed = materialise(keyed.withColumn("node", F.unhex(F.md5("key"))), "conversations", folders=folders)
    distinct = keyed.groupBy("node").agg(F.first(F.struct("key", "words")).alias("c"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    ordered = distinct.select("c.key", "c.words", "n", "conv_id").repartitionByRange("key").sortWithinPartitions("key")
    nodes = materialise(ordered.mapInArrow(partial(_runs, block), _NODE), "nodes", folders=folders)

    sums = ["n_convs", "closed_children", "closed_leaves", "closed_saved"]
    firsts = ["parent", "depth", "words", "path", "parent_conv_id", "n_children", "n_leaves", "saved_tokens"]
    merged = nodes.where("open").groupBy("node").agg(
        F.count("*").alias("runs"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in sums), *(F.first(c).alias(c) for c in firsts)
    )
    merged = materialise(merged, "open", folders=folders)
    single, shared = merged.where("runs = 1"), merged.where("runs > 1")
    shared_ids = shared.select(F.col("node").alias("parent"))
    below = single.join(shared_ids, "parent", "left_semi")
    gains = shared.select(
        F.explode(F.concat("path", F.array("node"))).alias("node"), F.col("closed_leaves").alias("leaves"), (F.col("closed_saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved")
    ).union(below.select(F.explode("path").alias("node"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    gains = gains.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    open_children = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("open_children"))
    several = shared.drop("n_children", "n_leaves", "saved_tokens").join(gains, "node").join(open_children, "node", "left")
    several = several.withColumn("n_children", F.col("closed_children") + F.coalesce("open_children", F.lit(0)))
    columns = ["node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    found = nodes.where("not open").select(*columns).union(single.select(*columns)).union(several.select(*columns))
    # A parent that several runs share may have a smaller member in another one.
    known = materialise(shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("whole_parent")), "shared", folders=folders)
    asked = found.where("parent is not null").join(known, "parent", "left")
    found = asked.select(*columns, F.coalesce("whole_parent", "parent_conv_id").alias("p")).union(
        found.where("parent is null").select(*columns, F.col("parent_conv_id").alias("p"))
    )

    ends = keyed.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    strings = ends.mapInArrow(partial(_joined, joined), "node binary, first long, ids string")
    hashed = strings.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends_sha256 string")
    result = found.join(hashed, "node", "left").select(
        "conv_id", "depth", F.col("p").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    result = materialise(result, "trie")
    remove_folders(spark, folders)
    return result


_STRINGS = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
_HASHES = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _joined(most: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of equal nodes of a sorted partition as strings of at most ``most`` ids."""
    node, ids = None, []
    for batch in batches:
        out = []
        for this, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (this != node or len(ids) == most):
                out.append((node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = this
            ids.append(conv)
        if out:
            yield _batch(out, _STRINGS)
    if ids:
        yield _batch([(node, ids[0], ",".join(map(str, ids)))], _STRINGS)


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of every node's strings, which come in order, with commas between."""
    node, state = None, hashlib.sha256()
    for batch in batches:
        out = []
        for this, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if this == node:
                state.update(b",")
            else:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = this, hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield _batch(out, _HASHES)
    if node is not None:
        yield _batch([(node, state.hexdigest())], _HASHES)
