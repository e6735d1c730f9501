"""Removal of passages that repeat, by content-defined chunking with a gear rolling hash.

The gear runs over words: ``g = 2 * g + G(word)``; a cut follows where the low four bits of ``g``, which depend on the
last four words only, fall below 4. Cuts therefore depend on the content around them and an insertion moves only those near it.
Where none falls for ``LONGEST`` words (a short phrase over and over has as few values of ``g`` as its period has words), cuts stand
at the least values within ``AROUND`` words to both sides, equal ones included: these depend on the words around them as well, never on
where the passage stands. Single gear chunks are short (4 words on average), and short chunks repeat by chance in a large
corpus, as licence lines and other stock phrases do by intent; so a digest is taken at every cut, over the following
chunks up to the first cut at least ``min_words`` (20) on. What is removed of a copy reaches from the first cut in it to the last
one that such a chunk ends at; some words at its head and its tail stay.

A digest belongs to the document of least doc_id that has it; there it stays. Everywhere else the words it covers are cut,
with the white space after them; within a document all but the first occurrence (not overlapping it) are cut.
Digests are dealt out once, and sorted there; the marks of a document return to it as one set, which its own text bounds.

Defined cases: a null text stays null; texts below ``min_words`` words have no chunks. Rows that repeat a doc_id are one
document and are not cut against each other. Rows without doc_id are passed on whole and own nothing. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.llm.text import BLOCK, WHITE, mix, utf8, word_blocks

WINDOW = 4
LONGEST = 16
AROUND = 8
_STEP = 0xC2B2AE3D27D4EB4F | 1
MARKS = "_marks"
SPANS = "removed_spans"
COUNTS = ("n_words", "n_removed")
_ADDED = T.StructType(
    [
        T.StructField(SPANS, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        *(T.StructField(name, T.LongType()) for name in COUNTS),
    ]
)


def cuts(words: np.ndarray) -> np.ndarray:
    """Places between words where a chunk begins or ends, from 0 to the number of words."""
    gear = mix(words ^ np.uint64(0x6A09E667F3BCC908)) >> np.uint64(40)
    value = np.zeros(len(words), np.uint64)
    for k in range(min(WINDOW, len(words))):
        value[k:] += gear[: len(gear) - k] << np.uint64(k)
    places = np.concatenate(([0], np.flatnonzero((value & np.uint64(15)) < 4) + 1, [len(words)]))
    places = np.unique(places)
    far = np.flatnonzero(np.diff(places) > LONGEST)
    if len(far):
        # The value at a place is that of the word before it; beyond the text there is none.
        least = np.pad(value & np.uint64(0xFFFFFF), AROUND, constant_values=np.uint64(1 << 62))
        least = np.lib.stride_tricks.sliding_window_view(least, 2 * AROUND + 1)
        more = []
        for i in far:
            inside = slice(places[i], places[i + 1] - 1)
            own = (value[inside] & np.uint64(0xFFFFFF)) == least[inside].min(axis=1)
            more.append(places[i] + 1 + np.flatnonzero(own))
        places = np.unique(np.concatenate((places, *more)))
    return places


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    return _power_tables(size)


@cache
def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    power = np.full(size, _STEP, np.uint64)
    inverse = np.full(size, pow(_STEP, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    return np.multiply.accumulate(power), np.multiply.accumulate(inverse)


def chunks(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest, first word and end word of the chunk that begins at each cut."""
    places = cuts(words)
    ends = np.searchsorted(places, places + min_words)
    begins = places[ends < len(places)]
    stops = places[ends[ends < len(places)]]
    power, inverse = _powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    digest = mix((total[stops] - total[begins]) * inverse[begins] + (stops - begins).astype(np.uint64))
    return digest, begins, stops


def repeats(digest: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which chunks have an earlier, not overlapping occurrence in the same document."""
    _, first, inverse = np.unique(digest, return_index=True, return_inverse=True)
    return begins >= stops[first][inverse]


def digests(docs: DataFrame, min_words: int) -> DataFrame:
    """(digest, doc_id): the distinct digests of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for low, high, hashes, _, _, first in word_blocks(batch.column("text"), WHITE):
                found = [np.unique(chunks(hashes[first[i] : first[i + 1]], min_words)[0]) for i in range(high - low)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(found).view(np.int64)),
                        pa.array(np.repeat(ids[low:high].astype(np.int64), [len(x) for x in found])),
                    ],
                    ["digest", "doc_id"],
                )

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "digest long, doc_id long")


def _cut_text(data: np.ndarray, starts: np.ndarray, out: np.ndarray) -> tuple[bytes, list[dict[str, int]]]:
    """The text without the words marked in ``out`` and the white space after them, and the removed character spans."""
    edge = np.diff(np.concatenate(([0], out.astype(np.int8), [0])))
    places = np.append(starts, len(data))
    begin, end = places[np.flatnonzero(edge == 1)], places[np.flatnonzero(edge == -1)]
    keep = np.ones(len(data), bool)
    for a, b in zip(begin, end):
        keep[a:b] = False
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return data[keep].tobytes(), [{"start": int(chars[a]), "end": int(chars[b])} for a, b in zip(begin, end)]


def _cut(schema: T.StructType, min_words: int):
    names = [f.name for f in schema if f.name != MARKS]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index("text"))
            data, offsets, valid = utf8(column)
            ids, marks = batch.column("_id"), batch.column(MARKS)
            texts, spans, counts, removed = [], [], [], []
            for low, high, hashes, starts, _, first in word_blocks(column, WHITE, BLOCK):
                for i in range(low, high):
                    a, b = first[i - low], first[i - low + 1]
                    own = data[offsets[i] : offsets[i + 1]]
                    digest, begins, stops = chunks(hashes[a:b], min_words)
                    gone = repeats(digest, begins, stops) if ids[i].is_valid else np.zeros(len(digest), bool)
                    if marks[i].is_valid:
                        gone |= np.isin(digest.view(np.int64), marks[i].values.to_numpy())
                    edge = np.zeros(b - a + 1, np.int64)
                    np.add.at(edge, begins[gone], 1)
                    np.add.at(edge, stops[gone], -1)
                    out = np.cumsum(edge)[:-1] > 0
                    text, cut = _cut_text(own, starts[a:b] - (offsets[i] - offsets[low]), out) if gone.any() else (own.tobytes(), [])
                    texts.append(text if valid[i] else None)
                    spans.append(cut), counts.append(b - a), removed.append(int(out.sum()))
            # A cut keeps whole words, so the bytes stay valid text.
            new = {"text": pa.array(texts, pa.binary()).cast(pa.string()), SPANS: pa.array(spans, _SPAN_TYPE)}
            new |= {COUNTS[0]: pa.array(counts, pa.int64()), COUNTS[1]: pa.array(removed, pa.int64())}
            kept = [n for n in names if n != "_id"]
            arrays = [new["text"] if n == "text" else batch.column(names.index(n)) for n in kept]
            yield pa.RecordBatch.from_arrays([*arrays, *(new[f.name] for f in _ADDED)], [*kept, *_ADDED.names])

    return run


_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove_repeats(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """``docs`` (doc_id, text, ...) with repeated passages cut from ``text``; adds removed_spans, n_words and n_removed."""
    docs = docs.drop(*_ADDED.names, MARKS, "_id").withColumn("_id", F.col("doc_id").cast("long"))
    rows = digests(docs.select(F.col("_id").alias("doc_id"), "text"), min_words)
    # One exchange of the digests: a digest's rows meet its owner where they are, and are not dealt out a second time.
    owned = rows.withColumn("owner", F.min("doc_id").over(Window.partitionBy("digest")))
    foreign = owned.where("doc_id > owner")
    marks = foreign.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("digest").alias(MARKS))
    joined = docs.join(marks, "_id", "left").select(*docs.columns, MARKS)
    schema = T.StructType([f for f in docs.schema if f.name != "_id"] + list(_ADDED))
    return joined.mapInArrow(_cut(joined.schema, min_words), schema)
