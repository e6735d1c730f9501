"""Document quality by a factorisation machine.

Features: distinct words (hashed to 2**15 places, weighted by the logarithm of their count), structure statistics of the whole
text (shares of character kinds, word and line lengths, repeated words and lines) and the text's length as metadata, each
statistic as one of 16 steps. Every pair of features interacts through the product of two short vectors; the sum over all
pairs takes linear time by ``((sum v x)**2 - sum (v x)**2) / 2``.

The model is fitted on at most ``train_rows`` labelled rows, those of least hash among all, so it is bounded whatever the
corpus; every document is scored. The fitted tables have a fixed size (about 1.3 MB) and are broadcast.

Defined cases: null texts score as empty ones. Without labelled rows every score is 0.5. Rows that repeat a doc_id are
scored one by one; labels that repeat count as their highest. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.text import WHITE, hash_words, mix, utf8, word_blocks

BUCKETS = 1 << 15
STEPS = 16
STATISTICS = 12
FEATURES = BUCKETS + STATISTICS * STEPS
RANK = 8
_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "line": (10,), "space": (32, 9),
    "far": range(128, 256), "mark": [c for c in range(33, 127) if not chr(c).isalnum()],
}
_KIND = np.zeros(256, np.int64)
for _number, _codes in enumerate(_KINDS.values(), 1):
    _KIND[list(_codes)] = _number
_NOT_LINE = np.zeros(256, bool)
_NOT_LINE[[10, 13]] = True


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, places, values): the features of every text, words first."""
    data, offsets, _ = utf8(column)
    for low, high, hashes, starts, ends, first in word_blocks(column, WHITE):
        base = offsets[low]
        kinds = _KIND[data[base : offsets[high]]]
        fresh = offsets[low:high] - base
        lines, line_starts, _ = hash_words(data[base : offsets[high]], fresh[fresh < offsets[high] - base], _NOT_LINE)
        line_first = np.searchsorted(line_starts, offsets[low : high + 1] - base)
        bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
        length = ends - starts
        for i in range(high - low):
            a, b = first[i], first[i + 1]
            place, count = np.unique(bucket[a:b], return_counts=True)
            value = 1 + np.log(count)
            value /= max(1e-9, np.sqrt((value**2).sum()))
            n_bytes, n_words = int(offsets[low + i + 1] - offsets[low + i]), int(b - a)
            kind = np.bincount(kinds[offsets[low + i] - base : offsets[low + i + 1] - base], minlength=8)[1:8] / max(1, n_bytes)
            own = lines[line_first[i] : line_first[i + 1]]
            shares = [
                *kind,
                length[a:b].mean() / 20 if n_words else 0,
                len(place) / max(1, n_words),
                1 - len(np.unique(own)) / max(1, len(own)),
            ]
            logs = [np.log2(1 + n_bytes) / 24, np.log2(1 + n_words / max(1, len(own))) / 12]
            # Small shares matter: the square root widens their steps.
            steps = np.minimum(STEPS - 1, (np.sqrt(np.array(shares)) * STEPS).astype(np.int64)).tolist()
            steps += np.minimum(STEPS - 1, (np.array(logs) * STEPS).astype(np.int64)).tolist()
            stat = BUCKETS + np.arange(STATISTICS) * STEPS + np.array(steps)
            yield low + i, np.concatenate((place, stat)), np.concatenate((value, np.full(STATISTICS, STATISTICS**-0.5)))


class Machine:
    """Weights of single features and a short vector per feature."""

    def __init__(self) -> None:
        self.bias = 0.0
        self.weight = np.zeros(FEATURES, np.float32)
        # Start values from a rule, equal everywhere.
        unit = mix(np.arange(FEATURES * RANK, dtype=np.uint64) + np.uint64(1)) / float(1 << 64) - 0.5
        self.vector = (0.1 * unit).astype(np.float32).reshape(FEATURES, RANK)

    def logit(self, place: np.ndarray, value: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Of ``rows`` documents whose features are listed one after the other; ``row`` is sorted."""
        single = np.bincount(row, self.weight[place] * value, rows)
        part = self.vector[place] * value[:, None]
        total = np.stack([np.bincount(row, part[:, f], rows) for f in range(RANK)], 1)
        square = np.bincount(row, (part * part).sum(1), rows)
        return self.bias + single + 0.5 * ((total**2).sum(1) - square)

    def fit(self, sets: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, epochs: int = 8, rate: float = 0.05, decay: float = 1e-5) -> None:
        """Adaptive gradient steps over batches of 32 documents, in an order that is equal everywhere."""
        # Both labels weigh the same together, whatever their shares; few rows are gone through more often.
        share = label.mean()
        weight = np.where(label > 0.5, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) if 0 < share < 1 else np.ones(len(label))
        epochs = max(epochs, 20_000 // len(label))
        past_w, past_v, past_b = np.full(FEATURES, 1e-4), np.full((FEATURES, RANK), 1e-4), 1e-4
        rng = np.random.default_rng(3)
        for _ in range(epochs):
            order = rng.permutation(len(sets))
            for k in range(0, len(order), 32):
                batch = order[k : k + 32]
                place = np.concatenate([sets[i][0] for i in batch])
                value = np.concatenate([sets[i][1] for i in batch])
                row = np.repeat(np.arange(len(batch)), [len(sets[i][0]) for i in batch])
                slope = (1 / (1 + np.exp(-self.logit(place, value, row, len(batch)))) - label[batch]) * weight[batch] / len(batch)
                part = self.vector[place] * value[:, None]
                total = np.stack([np.bincount(row, part[:, f], len(batch)) for f in range(RANK)], 1)
                pull = slope[row] * value
                grad_v = pull[:, None] * (total[row] - part)
                used, back = np.unique(place, return_inverse=True)
                sum_w = np.bincount(back, pull) + decay * self.weight[used]
                sum_v = np.stack([np.bincount(back, grad_v[:, f]) for f in range(RANK)], 1) + decay * self.vector[used]
                past_w[used] += sum_w**2
                past_v[used] += sum_v**2
                past_b += slope.sum() ** 2
                self.weight[used] -= rate * sum_w / np.sqrt(past_w[used])
                self.vector[used] -= rate * sum_v / np.sqrt(past_v[used])
                self.bias -= rate * slope.sum() / np.sqrt(past_b)


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = 12_000) -> Machine | None:
    """The machine fitted on rows of ``docs`` with a label (doc_id, label 0 or 1)."""
    labels = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, v) for _, p, v in features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("label"),
                    pa.array([p.astype(np.int32) for p, _ in found], pa.list_(pa.int32())),
                    pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32())),
                ],
                ["doc_id", "label", "place", "value"],
            )

    # Bounded by train_rows.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    found = rows.mapInArrow(run, "doc_id long, label int, place array<int>, value array<float>").toArrow()
    if not found.num_rows:
        return None
    found = found.sort_by("doc_id")
    sets = [(p.values.to_numpy().astype(np.int64), v.values.to_numpy().astype(np.float64)) for p, v in zip(found.column("place"), found.column("value"))]
    machine = Machine()
    machine.fit(sets, found.column("label").to_numpy().astype(np.float64))
    return machine


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id and score (0 to 1; higher: label 1 is likelier) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        for batch in batches:
            scores: list[float] = []
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for row, place, value in features(batch.column("text")) if machine else ():
                held.append((place, value))
                if len(held) == 256 or row + 1 == batch.num_rows:
                    number = np.repeat(np.arange(len(held)), [len(p) for p, _ in held])
                    logit = machine.logit(np.concatenate([p for p, _ in held]), np.concatenate([v for _, v in held]), number, len(held))
                    scores += (1 / (1 + np.exp(-np.clip(logit, -30, 30)))).tolist()
                    held = []
            scores = scores if machine else [0.5] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def fold(folds: int) -> Column:
    """Remainder of the checksum of doc_id's digits; a missing doc_id counts as no digits."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds
