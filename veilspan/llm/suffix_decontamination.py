"""Benchmark passages in training documents, by suffix arrays over the training text.

A shard is a block of whole documents (about 2 MB). Its suffix array holds the word suffixes that begin as some
benchmark window does, sorted by their first ``window`` words; every benchmark suffix is looked up in it by binary
search. A hit goes on to the next word as long as the item goes on too, and back as far: the match is verbatim and as long as it
gets from there. Shards are made and searched inside the tasks that read the documents: no text is shuffled, and a hot
passage only marks more words.

The benchmark's distinct items are dealt into parts of about ``part_bytes`` of text, copies of one text over all of them, and one part
at a time is sent to the tasks; more parts are more passes over the documents, with the matches so far written in between.

Defined cases: null texts and texts without words have no words and no hits. Items without words take no part; items that
repeat are one item. An item without item_id marks words like any other; its matches have no item_id. An item shorter than the
window is a window of its own length. Other columns are kept; columns named as the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.llm.text import NOT_ALNUM, word_blocks
from veilspan.session import materialise

PART_BYTES = 8 << 20
ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField(
            "matches",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("item_id", T.StringType()),
                        T.StructField("item_word", T.LongType()),
                        T.StructField("doc_word", T.LongType()),
                        T.StructField("n_words", T.LongType()),
                    ]
                )
            ),
        ),
    ]
)
_MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))


class Suffixes:
    """The windows of one part of the benchmark, as keys over its own vocabulary."""

    def __init__(self, ids: list[str], texts: list[str], window: int) -> None:
        self.window = window
        words: list[np.ndarray] = []
        for *_, hashes, _, _, first in word_blocks(pa.array(texts, pa.string()), NOT_ALNUM):
            words += [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]))
        sizes = np.array([len(own) for own in words], np.int64)
        # An item's number of windows; a short one has a window of its own length, filled up with zeros.
        many = np.where(sizes > 0, np.maximum(sizes - window, 0) + 1, 0)
        items = np.repeat(np.arange(len(words)), many)
        places = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        lengths = np.minimum(sizes[items], window)
        row = np.zeros(int(sizes.sum()) + window * (len(words) + 1), np.int64)
        begins = np.cumsum(sizes) - sizes + window * np.arange(len(words))
        for own, at in zip(words, begins):
            row[at : at + len(own)] = np.searchsorted(self.vocabulary, own) + 1
        self.ids = ids
        matrix = np.lib.stride_tricks.sliding_window_view(row, window)[begins[items] + places]
        keys = self.keys(matrix)
        # A window's items: one entry for each item that has it, at its first place there.
        self.unique, which = np.unique(keys, return_inverse=True)
        entry = np.unique(np.stack([which, np.array(items, np.int64), np.array(places, np.int64)], 1).reshape(-1, 3), axis=0)
        entry = entry[np.unique(entry[:, :2], axis=0, return_index=True)[1]] if len(entry) else entry
        self.bounds = np.searchsorted(entry[:, 0], np.arange(len(self.unique) + 1))
        self.items, self.places = entry[:, 1], entry[:, 2]
        # The window at every place of an item.
        self.at, self.begin, self.many = which, np.cumsum(many) - many, many
        self.lengths = np.zeros(len(self.unique), np.int64)
        self.lengths[which] = lengths
        full = np.zeros((len(self.unique), window), np.int64)
        full[which] = matrix
        self.upper = self.keys(np.where(np.arange(window) < self.lengths[:, None], full, 0xFFFFFFFF))
        second = full[:, 1] if window > 1 else np.zeros(len(full), np.int64)
        self.alone = np.unique(full[self.lengths == 1, 0])
        self.begins = np.unique((full[:, 0] << 32 | second)[self.lengths > 1])

    def keys(self, matrix: np.ndarray) -> np.ndarray:
        """Byte strings that sort as the rows of word numbers do."""
        return np.ascontiguousarray(matrix.astype(">u4")).view(f"S{4 * self.window}").ravel()

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers from 1; 0 for words that no item has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def _isin(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def search(part: Suffixes, hashes: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """For each document of a shard: (item, item_word, doc_word, n_words) of its longest matches."""
    docs, w = len(first) - 1, part.window
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in range(docs)]
    doc = np.repeat(np.arange(docs), np.diff(first))
    # Documents are set apart by as many zeros as a window is long.
    row = np.zeros(len(hashes) + w * (docs + 1) + 1, np.int64)
    place = np.arange(len(hashes)) + w * doc
    row[place] = part.numbers(hashes)
    head = np.flatnonzero(row)
    good = _isin(row[head], part.alone) | _isin(row[head] << 32 | row[head + 1], part.begins)
    head = head[good]
    if not len(head) or not len(part.unique):
        return found
    keys = part.keys(np.lib.stride_tricks.sliding_window_view(row, w)[head])
    order = np.argsort(keys, kind="stable")
    array, keys = head[order], keys[order]
    low = np.searchsorted(keys, part.unique, "left")
    high = np.searchsorted(keys, part.upper, "right")
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return found
    # One row per occurrence of a window and item that has it.
    count = high[hit] - low[hit]
    key = np.repeat(hit, count)
    at = array[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[hit], count)]
    many = part.bounds[key + 1] - part.bounds[key]
    entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(part.bounds[key], many)
    at, key = np.repeat(at, many), np.repeat(key, many)
    item, origin, length = part.items[entry], part.places[entry], part.lengths[key]
    in_doc = np.searchsorted(first + w * np.arange(docs + 1), at, "right") - 1
    word = at - w * in_doc - first[in_doc]
    order = np.lexsort((word, item, in_doc))
    rows = [x[order].tolist() for x in (in_doc, item, word, origin, key, length)]
    seen = {(d, i, w): k for d, i, w, k in zip(rows[0], rows[1], rows[2], rows[4])}
    at, begin, many = part.at, part.begin, part.many
    done = (-1, -1, -1)
    for d, i, w, o, k, n in zip(*rows):
        if (d, i) == done[:2] and w <= done[2]:
            continue
        first, last = begin[i], begin[i] + many[i]
        # On and back along the item, window by window.
        low, high, place = w, w, first + o
        while place + high - w + 1 < last and seen.get((d, i, high + 1)) == at[place + high - w + 1]:
            high += 1
        while place - (w - low) - 1 >= first and seen.get((d, i, low - 1)) == at[place - (w - low) - 1]:
            low -= 1
        # Matches that began at the item's first place and stopped short are inside this one.
        while found[d] and found[d][-1][0] == i and found[d][-1][2] >= low:
            found[d].pop()
        found[d].append((i, o - (w - low), low, high - low + n))
        done = (d, i, high)
    return found


def _covered(matches: list[dict]) -> int:
    total, reach = 0, 0
    for start, end in sorted((m["doc_word"], m["doc_word"] + m["n_words"]) for m in matches):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


def _pass(spark, part: Suffixes, names: list[str], again: bool):
    sent = spark.sparkContext.broadcast(part)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = sent.value
        for batch in batches:
            counts, matches = [], []
            for _, _, hashes, _, _, first in word_blocks(batch.column(names.index("text")), NOT_ALNUM):
                counts += np.diff(first).tolist()
                for rows in search(part, hashes, first):
                    matches.append([{"item_id": part.ids[i], "item_word": o, "doc_word": d, "n_words": n} for i, o, d, n in rows])
            if again:
                matches = [old + new for old, new in zip(batch.column("matches").to_pylist(), matches)]
            added = [pa.array(counts, pa.int64()), pa.array([_covered(m) for m in matches], pa.int64()), pa.array(matches, _MATCH)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), *added], [*names, *ADDED.names])

    return run


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` (text, ...) with n_words, n_hit (words inside any occurrence of a window) and matches."""
    spark = docs.sparkSession
    docs = docs.drop(*ADDED.names)
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(size // part_bytes) + 1
    schema = T.StructType(list(docs.schema) + list(ADDED))
    out = docs
    for k in range(parts):
        mine = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(parts)) == k).toArrow() if parts > 1 else items.toArrow()
        part = Suffixes(mine.column("item_id").to_pylist(), mine.column("text").to_pylist(), window)
        out = out.mapInArrow(_pass(spark, part, docs.columns, k > 0), schema)
        if k + 1 < parts:
            out = materialise(out, "matches")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, as they were."""
    return find_matches(docs, benchmark, window).where("n_hit = 0").select(*docs.columns)
