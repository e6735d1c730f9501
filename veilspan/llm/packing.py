"""Packing of token sequences by a configuration linear program.

1. Every document becomes its token ids and an end id; one longer than ``capacity`` is cut into pieces of ``capacity``, the first
   of which may be shorter. The pieces are written once, with their task's number and a rank among that task's pieces
   of the same length.
2. Over the histogram of lengths (at most ``capacity`` entries, whatever the corpus): cover the counts with as few
   sequences as possible, a sequence being a configuration of lengths of at most ``capacity`` together. The fractional program
   is solved by multiplicative weights: lengths still short of their count gain price, and a knapsack dynamic program finds
   the configurations of most price, until the least covered length is within ``GAP`` of the mean. The solution is rounded
   to whole sequences, of which the fullest stay: the share of ``SHARES`` (half at least) with which all pieces need fewest.
   The residue goes into their rooms and into new sequences by best fit. The log says how many pieces the program placed.
3. The plan is a list of slots (length, range of ranks, first sequence, offset), bounded by the number of configurations,
   not of documents. A piece's rank over the whole corpus is its task's first rank plus its own; the slot with this rank is
   its place. Token ids never leave the table they were written to.

Defined cases: null texts are empty and become the end id alone. Rows without doc_id or with a repeated one are packed like any
other. Other columns are not read.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.llm.text import blocks, hash_spans, utf8
from veilspan.session import materialise

log = logging.getLogger(__name__)

CAPACITY = 1024
END = 2
#: A round's share of a length lowers its weight by so much.
STEP = 0.25
#: The program ends when the least covered length is so near the mean.
GAP = 0.05
#: Configurations so near the best of a round are taken in it.
NEAR = 0.02
#: How much of the rounded solution stays.
SHARES = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)
#: Bytes of documents that are encoded together.
ENCODED = 1 << 19
#: Pieces that a worker keeps, and ids of them, at most.
KEPT, KEPT_IDS = 1 << 19, 1 << 22
#: New pieces are kept apart until there are so many.
FRESH = 1 << 16

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[33:127] = ~_ALNUM[33:127]
_ASCII_WHITE = np.zeros(256, bool)
_ASCII_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _white(data: np.ndarray) -> np.ndarray:
    """Where a white space character begins, as the tokenizer's splitting pattern has it."""
    out = _ASCII_WHITE[data]
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        padded = np.append(data, np.zeros(2, np.uint8))
        a, b, c = padded[lead], padded[lead + 1], padded[lead + 2]
        # U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000.
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
        general = (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        out[lead[two | three | general]] = True
    return out


def piece_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Bytes at which a piece begins; ``begins``: those where a document does (none is empty).

    A piece begins at a space before something other than white space, and at a mark between a letter or digit and something
    else: there the splitting pattern always begins a new part, whatever stands around.
    """
    edge = np.zeros(len(data) + 1, bool)
    edge[begins] = edge[-1] = True
    white = np.append(_white(data), True)
    alnum = np.append(_ALNUM[data] | (data >= 0x80), False)
    start = (data == 0x20) & ~white[1:] & ~edge[1:]
    before = np.zeros(len(data), bool)
    before[1:] = _ALNUM[data[:-1]]
    start |= _PUNCTUATION[data] & before & (~alnum[1:] | edge[1:])
    return np.flatnonzero(start | edge[:-1])


class Encoder:
    """Token ids of whole texts. Texts are cut into pieces that no token spans; the ids of pieces seen lately are looked up.

    A piece is known by the 64-bit hash of its bytes. Hashes, places and ids are flat arrays, some 40 bytes a piece; beyond ``KEPT``
    pieces (or ``KEPT_IDS`` ids) those not asked for since the last time are dropped. Texts that hold a special token
    go to the tokenizer whole.
    """

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [t["content"].encode() for t in json.loads(definition).get("added_tokens", [])]
        self._clear()

    def _clear(self) -> None:
        self.keys = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]  # sorted: the bulk, and the fresh ones
        self.numbers = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.count = self.used_ids = 0
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.asked, self.ids = np.zeros(1 << 12, bool), np.zeros(1 << 14, np.uint32)

    def _add(self, hashes: np.ndarray, texts: list[str]) -> np.ndarray:
        """Numbers of new pieces (sorted hashes)."""
        found = [code.ids for k in range(0, len(texts), 4096) for code in self.tokenizer.encode_batch_fast(texts[k : k + 4096], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        low, high = self.count, self.count + len(found)
        ids_high = self.used_ids + int(sizes.sum())
        for name in ("start", "length", "asked"):
            setattr(self, name, _grown(getattr(self, name), high))
        self.ids = _grown(self.ids, ids_high)
        self.ids[self.used_ids : ids_high] = np.fromiter((i for ids in found for i in ids), np.uint32, ids_high - self.used_ids)
        self.start[low:high], self.length[low:high] = self.used_ids + np.cumsum(sizes) - sizes, sizes
        self.count, self.used_ids = high, ids_high
        numbers = np.arange(low, high)
        self._merge(1, hashes, numbers)
        if len(self.keys[1]) >= FRESH:
            self._merge(0, self.keys[1], self.numbers[1])
            self.keys[1], self.numbers[1] = self.keys[1][:0], self.numbers[1][:0]
        return numbers

    def _merge(self, level: int, hashes: np.ndarray, numbers: np.ndarray) -> None:
        at = np.searchsorted(self.keys[level], hashes)
        self.keys[level], self.numbers[level] = np.insert(self.keys[level], at, hashes), np.insert(self.numbers[level], at, numbers)

    def _forget(self) -> None:
        """Keep the pieces that were asked for since the last time; none, if these are more than half."""
        kept = np.flatnonzero(self.asked[: self.count])
        sizes = self.length[kept].astype(np.int64)
        if len(kept) > KEPT // 2 or sizes.sum() > KEPT_IDS // 2:
            self._clear()
            return
        keys, numbers = np.concatenate(self.keys), np.concatenate(self.numbers)
        taken = self.ids[_spans(self.start[kept], sizes)]
        hashes = np.empty(self.count, np.uint64)
        hashes[numbers] = keys
        self._clear()
        order = np.argsort(hashes[kept], kind="stable")
        self.keys[0], self.numbers[0] = hashes[kept][order], order
        self.count, self.used_ids = len(kept), len(taken)
        self.start, self.length = np.cumsum(sizes) - sizes, sizes.astype(np.int32)
        self.asked, self.ids = np.zeros(len(kept), bool), taken

    def _look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of pieces (sorted hashes), -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        for keys, numbers in zip(self.keys, self.numbers):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[at] == hashes
                out[hit] = numbers[at[hit]]
        return out

    def encode_bytes(self, data: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        """Ids of the documents ``data[own[i]:own[i + 1]]``."""
        if self.count > KEPT or self.used_ids > KEPT_IDS:
            self._forget()
        whole = self._whole(data, own)
        if not len(data):
            return [np.zeros(0, np.uint32) for _ in own[1:]]
        begins = own[:-1][own[:-1] < own[1:]]
        first = piece_starts(data, begins)
        last = np.append(first[1:], len(data))
        hashes = hash_spans(data, first, last)
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        number = self._look_up(unique)
        new = np.flatnonzero(number < 0)
        if len(new):
            raw = data.tobytes()
            number[new] = self._add(unique[new], [raw[first[k] : last[k]].decode() for k in where[new]])
        self.asked[number] = True
        number = number[inverse]
        size = self.length[number].astype(np.int64)
        ids = self.ids[_spans(self.start[number], size)]
        cuts = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(first, own)]
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for k, code in zip(whole, self.tokenizer.encode_batch_fast([data[own[k] : own[k + 1]].tobytes().decode() for k in whole], add_special_tokens=False)):
            out[k] = np.array(code.ids, np.uint32)
        return out

    def _whole(self, data: np.ndarray, own: np.ndarray) -> list[int]:
        """Documents that hold a special token."""
        raw, found = data.tobytes(), set()
        for special in self.special:
            at = raw.find(special)
            while at >= 0:
                doc = int(np.searchsorted(own, at, "right")) - 1
                if at + len(special) <= own[doc + 1]:
                    found.add(doc)
                at = raw.find(special, at + 1)
        return sorted(found)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        data, offsets, _ = utf8(pa.array(texts, pa.string()))
        return self.encode_bytes(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def _grown(values: np.ndarray, size: int) -> np.ndarray:
    if size <= len(values):
        return values
    return np.concatenate((values, np.zeros(max(size, 2 * len(values)) - len(values), values.dtype)))


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, … (size[0] of them), start[1], …"""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@lru_cache(maxsize=1)
def _encoder(definition: str) -> Encoder:
    """One per worker process: its pieces serve the next task too."""
    return Encoder(definition)


def tokenise(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids (unsigned little-endian 32-bit), task and rank of its length in the task."""
    with open(tokenizer, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, seen = _encoder(sent.value), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            data, offsets, _ = utf8(batch.column("text"))
            for low, high in blocks(offsets, ENCODED):
                rows: list[tuple] = []
                doc_ids = batch.column("doc_id").slice(low, high - low).to_pylist()
                found = encoder.encode_bytes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                for doc, ids in zip(doc_ids, found):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                    for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                        rows.append((doc, piece, a, b - a, ids[a:b].tobytes(), int(seen[b - a])))
                        seen[b - a] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], _NAMES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary, rank long"
    )
    return rows.withColumn("task", F.spark_partition_id())


_NAMES = ["doc_id", "piece", "start", "length", "ids", "rank"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]


class Knapsack:
    """For every room up to ``capacity`` the lengths of highest price together, by dynamic programming over the rooms.

    Lengths of price 0 are not wanted; of equal prices together, longer lengths are taken.
    """

    def __init__(self, price: np.ndarray, capacity: int) -> None:
        self.value, self.choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
        wanted = np.flatnonzero(price > 0)[::-1]
        own = price[wanted]
        first = np.searchsorted(-wanted, -np.arange(capacity + 1), "left")
        for room in range(1, capacity + 1):
            self.value[room] = self.value[room - 1]
            fits = first[room]
            if fits < len(wanted):
                options = self.value[room - wanted[fits:]] + own[fits:]
                best = int(options.argmax())
                if options[best] > self.value[room] * (1 + 1e-12):
                    self.value[room], self.choice[room] = options[best], wanted[fits + best]

    def lengths(self, room: int) -> dict[int, int]:
        chosen: dict[int, int] = {}
        while room:
            length = int(self.choice[room])
            if length:
                chosen[length] = chosen.get(length, 0) + 1
            room -= length or 1
        return chosen


def best_fit(counts: np.ndarray, capacity: int, started: Iterable[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram, many equal lengths at a time, into the rooms of ``started`` sequences first."""
    rooms: dict[int, list[list]] = {}  # room left: [configuration, how many sequences]
    for config, many in started:
        rooms.setdefault(capacity - sum(n * k for n, k in config.items()), []).append([config, many])
    for length in np.flatnonzero(counts)[::-1]:
        length, left = int(length), int(counts[length])
        while left:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                per = capacity // length
                if left >= per:
                    rooms.setdefault(capacity - per * length, []).append([{length: per}, left // per])
                    left %= per
                else:
                    rooms.setdefault(capacity - left * length, []).append([{length: left}, 1])
                    left = 0
                continue
            config, many = rooms[room].pop()
            per = min(room // length, left)
            times = min(many, left // per)
            if many > times:
                rooms[room].append([config, many - times])
            elif not rooms[room]:
                del rooms[room]
            rooms.setdefault(room - per * length, []).append([{**config, length: config.get(length, 0) + per}, times])
            left -= per * times
    return [(config, many) for group in rooms.values() for config, many in group]


def program(rest: np.ndarray, capacity: int, rounds: int | None = None) -> list[tuple[dict[int, int], int]]:
    """Whole sequences of the fractional program's solution; they hold no length more often than ``rest`` counts it.

    ``rounds`` ends the program before the covered shares are within ``GAP``.
    """
    wanted = np.flatnonzero(rest)
    # covered[l]: the share of length l's count that the solution has so far; a price is a weight by piece, first the length.
    weight, covered = np.zeros(capacity + 1), np.zeros(capacity + 1)
    weight[wanted] = np.log(rest[wanted] * (wanted / capacity))
    used: dict[tuple[tuple[int, int], ...], float] = {}
    done = 0
    while len(wanted) and done != rounds:
        done += 1
        price = np.zeros(capacity + 1)
        price[wanted] = np.exp(weight[wanted] - weight[wanted].max()) / rest[wanted]
        best = Knapsack(price, capacity)
        room = rest.astype(float)
        first = wanted[np.lexsort((-wanted, covered[wanted]))]
        # The best configuration, and for every length the best one with it, if that is hardly worse.
        good = price[first] + best.value[capacity - first] >= (1 - NEAR) * best.value[capacity]
        for length in (0, *first[good].tolist()):
            if length and room[length] <= 0:
                continue
            config = best.lengths(capacity - length)
            if length:
                config[length] = config.get(length, 0) + 1
            # A length over its count is thrown out again.
            config = {n: min(k, int(rest[n])) for n, k in config.items()}
            amount = min(room[n] / k for n, k in config.items())
            if amount > 0:
                key = tuple(sorted(config.items()))
                used[key] = used.get(key, 0.0) + amount
                for n, k in config.items():
                    room[n] -= k * amount
        share = 1 - room[wanted] / rest[wanted]
        covered[wanted] += share
        weight[wanted] -= STEP * share
        if covered[wanted].min() >= (1 - GAP) * covered[wanted].mean():
            break
    # Scaled so that the lengths are covered once on average, then whole sequences; fractions are carried on.
    plan, left, carried = [], rest.copy(), 0.0
    scale = covered[wanted].mean() if len(wanted) else 1.0
    for key, amount in sorted(used.items(), key=lambda x: (-x[1], x[0])):
        carried += amount / scale
        many = min(int(carried + 1e-9), *(int(left[n]) // k for n, k in key))
        if many > 0:
            carried -= many
            plan.append((dict(key), many))
            for n, k in key:
                left[n] -= k * many
    return plan


def tightest(solved: list[tuple[dict[int, int], int]], share: float, capacity: int) -> list[tuple[dict[int, int], int]]:
    """The fullest sequences of a solution, ``share`` of them in all; of a configuration used often at most the share of its use."""
    left, out = int(share * sum(many for _, many in solved)), []
    for config, many in sorted(solved, key=lambda x: capacity - sum(n * k for n, k in x[0].items())):
        many = min(left, many if many == 1 else int(np.ceil(max(share, 0.9) * many)))
        if many > 0:
            out.append((config, many))
            left -= many
    return out


def configurations(counts: np.ndarray, capacity: int = CAPACITY, rounds: int | None = None) -> list[tuple[dict[int, int], int]]:
    """(lengths and how often each, number of such sequences): together every counted piece exactly once."""
    plan = [({capacity: 1}, int(counts[capacity]))] if counts[capacity] else []
    rest = counts.copy()
    rest[capacity] = 0
    solved, best = program(rest, capacity, rounds), None
    for share in SHARES:
        kept, left = tightest(solved, share, capacity), rest.copy()
        for config, many in kept:
            for n, k in config.items():
                left[n] -= k * many
        packed = best_fit(left, capacity, kept)
        size = sum(many for _, many in packed)
        if best is None or size < best[0]:
            best = size, share, packed, int(left.sum())
    size, share, packed, left = best
    log.info("configuration program: %.1f of its sequences kept, %d of %d pieces shorter than a sequence, %d sequences", share, rest.sum() - left, rest.sum(), size)
    return plan + packed


def slots(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset)."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for config, many in plan:
        offset = 0
        for length in sorted(config, reverse=True):
            for _ in range(config[length]):
                rank = taken.get(length, 0)
                out.append((length, rank, rank + many, sequence, offset))
                taken[length] = rank + many
                offset += length
        sequence += many
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (length, task, rank, ...; a written table) with sequence_id and offset for task and rank."""
    spark = pieces.sparkSession
    per_task = materialise(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    schema = "l long, low long, high long, sequence long, offset long"
    plan = spark.createDataFrame(slots(configurations(counts, capacity)), schema)
    # One row per task and length: the tasks bound a window's rows.
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    ranges = per_task.select("length", "task", "n", F.coalesce(before, F.lit(0)).alias("base"))
    # The slots that a task's ranks of a length fall in.
    ranges = ranges.join(F.broadcast(plan), F.expr("l = length and low < base + n and high > base"))
    ranges = ranges.select("length", "task", "base", "low", "high", "sequence", "offset")
    at = F.col("base") + F.col("rank")
    placed = pieces.join(ranges, ["length", "task"]).where((at >= F.col("low")) & (at < F.col("high")))
    kept = [c for c in pieces.columns if c not in ("task", "rank")]
    return placed.select(*kept, (F.col("sequence") + at - F.col("low")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset for every piece of every document."""
    return place(materialise(tokenise(docs, tokenizer, capacity, end), "pieces"), capacity)
