"""Vector codes by product quantisation with an equal-average search.

Components become integers ``floor(SCALE * x)``, vectors are cut into ``PARTS`` equal consecutive parts, and every part position
has a codebook of at most ``ENTRIES`` entries. It starts as that part of the vectors of smallest ids; each of ``ROUNDS`` rounds
assigns every part to its nearest entry and replaces the entries by their parts' componentwise floor of the mean. All
distances are squared and integer; ties go to the lower entry.

The nearest entry of a part is found by component sums. Entries are sorted by their sum; from the place of the part's sum the
search goes outward on both sides, one entry a step. Since the squared gap of the sums over the number of components is
never above the squared distance, a side ends where it strictly exceeds the best distance so far: an equal one can
still be a tie. Many parts take their steps together; those whose two sides have ended leave.

A round is one pass over the table: a task adds up sums and counts by entry, Spark adds the tasks' up, and the driver gets
``PARTS * ENTRIES`` entries, whatever the table's size. Vectors are not shuffled and not copied.

Defined cases: rows whose vector is null, or holds null or non-finite components, are dropped. So are vectors of another number
of components than the first kept one (by id), and empty ones; a number that ``PARTS`` does not divide is an error, as
are components so large that squared distances leave 63 bits. Ids that repeat are rows of their own, equal ids ordered
by their vectors; null ids come last. Fewer vectors than ``ENTRIES`` make smaller codebooks; entries that no part
chooses stay as they are. Without vectors there are no codebooks, and no rows. Other columns stay; those named code and
error are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
VECTOR = "_vector"


def whole(embedding: str = "embedding", scale: int = SCALE) -> Column:
    """A vector's integers, null for a vector that takes no part."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    good = (F.size(embedding) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(good, F.transform(x, lambda v: F.floor(v * scale)))


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, position]``; there are ``PARTS`` parts and at most ``ENTRIES`` entries."""

    entries: np.ndarray

    @property
    def dimension(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        """Of all components by part, entry and position, as decimal numbers with commas between."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The integer vector that a code stands for."""
        return [x for book, k in zip(self.entries, bytes.fromhex(code)) for x in book[k].tolist()]


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every part the index of its nearest entry and the squared distance; and how many distances were taken in all."""
    n, size = parts.shape
    order = np.argsort(book.sum(axis=1), kind="stable")
    sorted_book = book[order]
    sums, own = sorted_book.sum(axis=1), parts.sum(axis=1)
    best = np.full(n, np.iinfo(np.int64).max if parts.dtype != np.float64 else np.inf, parts.dtype)
    index = np.zeros(n, np.int64)
    place = np.searchsorted(sums, own)
    taken = 0
    sides = [[np.arange(n), place - 1, -1], [np.arange(n), place.copy(), 1]]
    while any(len(rows) for rows, _, _ in sides):
        for side in sides:
            rows, at, step = side
            within = (at >= 0) & (at < len(sums))
            rows, at = rows[within], at[within]
            gap = sums[at] - own[rows]
            # gap**2 / size > best, in whole numbers.
            near = gap * gap <= best[rows] * size if parts.dtype == np.float64 else (gap * gap + size - 1) // size <= best[rows]
            rows, at = rows[near], at[near]
            difference = parts[rows] - sorted_book[at]
            distance = np.einsum("ij,ij->i", difference, difference)
            taken += len(rows)
            entry = order[at]
            better = (distance < best[rows]) | ((distance == best[rows]) & (entry < index[rows]))
            best[rows[better]], index[rows[better]] = distance[better], entry[better]
            side[0], side[1] = rows, at + step
    return index, best, taken


def _fitting(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and codebooks as 64-bit floats where all squared distances are exact in them, else as integers."""
    most = max(int(np.abs(vectors).max(initial=0)), int(np.abs(books).max(initial=0)))
    if most >= 1 << 62 or (2 * most) ** 2 * max(1, books.shape[2]) ** 2 >= 1 << 62:
        raise ValueError(f"components up to {most} are too large for whole squared distances")
    # The bound's sides, a sum's square and a distance times the size, are below size**2 * (2 * most)**2.
    kind = np.float64 if (2 * most) ** 2 * max(1, books.shape[2]) ** 2 < 1 << 53 else np.int64
    return vectors.astype(kind), books.astype(kind)


def _blocks(batches: Iterable[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(VECTOR).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _kept(vectors: DataFrame, dimension: int | None = None) -> DataFrame:
    kept = vectors.withColumn(VECTOR, whole()).where(F.col(VECTOR).isNotNull())
    return kept if dimension is None else kept.where(F.size(VECTOR) == dimension)


def _first(vectors: DataFrame, n: int) -> np.ndarray:
    """The ``n`` vectors of smallest id, of the first one's number of components."""
    order = F.col("vec_id").asc_nulls_last(), F.col(VECTOR)
    rows = _kept(vectors).select("vec_id", VECTOR).orderBy(*order).limit(n).collect()
    if len({len(r[VECTOR]) for r in rows}) > 1:
        rows = _kept(vectors, len(rows[0][VECTOR])).select("vec_id", VECTOR).orderBy(*order).limit(n).collect()
    return np.array([r[VECTOR] for r in rows], np.int64) if rows else np.zeros((0, 0), np.int64)


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``vectors`` (vec_id, embedding)."""
    first = _first(vectors, min(entries, 256))
    if first.shape[1] % parts:
        raise ValueError(f"{first.shape[1]} components cannot be cut into {parts} equal parts")
    size = first.shape[1] // parts
    books = first.reshape(len(first), parts, size).transpose(1, 0, 2).copy()
    spark = vectors.sparkSession
    for _ in range(rounds if len(first) else 0):
        sent = spark.sparkContext.broadcast(books)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            sums, counts = np.zeros(own.shape, np.int64), np.zeros(own.shape[:2], np.int64)
            for _, block in _blocks(batches, parts * size):
                block, book = _fitting(block, own)
                for part in range(parts):
                    piece = block[:, part * size : (part + 1) * size]
                    index, _, _ = nearest(piece, book[part])
                    np.add.at(sums[part], index, piece.astype(np.int64))
                    counts[part] += np.bincount(index, minlength=own.shape[1])
            part, entry = np.nonzero(counts)
            columns = [np.repeat(part, size), np.repeat(entry, size), np.tile(np.arange(size), len(part)), sums[part, entry].ravel(), np.repeat(counts[part, entry], size)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "position", "total", "n"])

        found = _kept(vectors, parts * size).select(VECTOR).mapInArrow(run, "part long, entry long, position long, total long, n long")
        # At most parts * entries * size rows.
        for r in found.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r["part"], r["entry"], r["position"]] = r["total"] // r["n"]
        sent.unpersist()
    return Codebooks(books)


def encode(vectors: DataFrame, codebooks: Codebooks) -> DataFrame:
    """The kept rows of ``vectors`` with code (two hexadecimal digits a part) and error (sum of the parts' squared distances)."""
    books = codebooks.entries
    rows = vectors.drop("code", "error", VECTOR)
    schema = T.StructType([*rows.schema, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not books.size:
        return vectors.sparkSession.createDataFrame([], schema)
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    parts, _, size = books.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in _blocks(batches, parts * size):
            block, book = _fitting(block, sent.value)
            codes, error = np.zeros((len(block), parts), np.uint8), np.zeros(len(block), np.int64)
            for part in range(parts):
                index, distance, _ = nearest(block[:, part * size : (part + 1) * size], book[part])
                codes[:, part] = index
                error += distance.astype(np.int64)
            code = pa.array([row.tobytes().hex() for row in codes])
            kept = [n for n in batch.schema.names if n != VECTOR]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), code, pa.array(error)], [*kept, "code", "error"])

    return _kept(rows, parts * size).mapInArrow(run, schema)
