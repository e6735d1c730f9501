"""Patterns from a table of any size: found by joins, none of them in the plan or on the driver.

``many`` keeps its patterns and their automaton on the driver and in every worker, which is for thousands of them. Here a
pattern's literal (``many.literal``) is looked for by one window of it: of the windows of the longest length in ``SIZES`` that the literal
holds, the one that fewest patterns share. A text's windows of these lengths pass a bit map of the patterns' windows, whose
size is bounded by ``MOST``; the few that are left are joined with the patterns by their hash, and the patterns so found run over the text
in its row. A window or a hash that occurs by chance costs one such run and changes nothing. Patterns without a literal run over every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.functions.arrays import let
from veilspan.functions.spans import located
from veilspan.operators.detect import NO_FINDINGS, detect
from veilspan.operators.many import literal, parts
from veilspan.recognizers import RecognizerSet
from veilspan.session import materialise

#: Bytes of a window. A literal has three characters at least (``many.LEAST``).
SIZES = (3, 4, 8, 16, 32)
#: Bits of the map for each window, and in all: 16 megabytes, enough for some eight million patterns. Beyond that more windows are joined.
PER_ENTRY, LEAST, MOST = 16, 1 << 10, 1 << 27
#: Bytes of texts that are hashed at once.
BLOCK = 1 << 22

_WINDOWS = pa.schema([("_row", pa.int64()), ("hash", pa.int64())])
_ANCHORS = pa.schema([("_number", pa.int64()), ("hash", pa.int64()), ("size", pa.int32()), ("at", pa.int32())])
_PATTERN = ("regex", "neg_score", "priority", "entity", "pattern_name")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def hashes(data: np.ndarray, sizes: Sequence[int]) -> dict[int, np.ndarray]:
    """For each size, the hash of the window at every byte where one begins."""
    def joined(left: np.ndarray, right: np.ndarray, apart: int, size: int) -> np.ndarray:
        n = max(0, len(data) - size + 1)
        return _mixed(left[:n] * np.uint64(0x9E3779B97F4A7C15) + right[apart : apart + n] + np.uint64(size))

    at = {1: _mixed(data.astype(np.uint64) + np.uint64(1))}
    at[2] = joined(at[1], at[1], 1, 2)
    at[3] = joined(at[2], at[1], 2, 3)
    half = 2
    while 2 * half <= max(sizes):
        at[2 * half] = joined(at[half], at[half], half, 2 * half)
        half *= 2
    return {size: at[size].view(np.int64) for size in sizes}


def _places(hashed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashed & (bits - 1), (hashed >> 32) & (bits - 1)


def _anchored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each pattern's literal; one row without a hash if it has none."""
    for batch in batches:
        rows: list[tuple] = []
        for number, regex in zip(batch.column("_number").to_pylist(), batch.column("regex").to_pylist()):
            own = literal(regex)
            if own is None:
                rows.append((number, None, None, None))
                continue
            data = np.frombuffer(own.encode("utf-8", "surrogatepass"), np.uint8)
            size = max(s for s in SIZES if s <= len(data))
            rows += [(number, int(h), size, at) for at, h in enumerate(hashes(data, [size])[size])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ANCHORS)], schema=_ANCHORS)


def _occurring(sizes: Sequence[int], sent, bits: int, step: int):
    """(row, hash) of the distinct windows in texts that pass the map."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(sent.value, np.uint8)
        test = lambda p: (held[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        for batch in batches:
            rows = batch.column("_row").to_numpy()
            text = batch.column("_text").cast(pa.large_binary())
            # Null texts have no bytes: filled, so that the offsets say so.
            text = text.fill_null(b"") if text.null_count else text
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            ends = offsets[1:] - offsets[0]
            found = []
            for low in range(0, len(data), step):
                block = data[low : low + step + max(sizes) - 1]
                for size, hashed in hashes(block, sizes).items():
                    first, second = _places(hashed[:step], bits)
                    hits = np.flatnonzero(test(first))
                    hits = hits[test(second[hits])]
                    own = np.searchsorted(ends, low + hits, side="right")
                    inside = low + hits + size <= ends[own]
                    found.append(np.stack((rows[own[inside]], hashed[hits[inside]]), axis=1))
            if found:
                once = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], schema=_WINDOWS)

    return run


def listed_patterns(patterns: DataFrame, recognizers: RecognizerSet, folders: list[str] | None = None) -> tuple[DataFrame, RecognizerSet]:
    """The patterns (entity, pattern_name, regex, score) numbered and checked, written once; and ``recognizers`` with their entities.

    The same patterns are refused as by ``RecognizerSet.with_recognizer``. Entities are kinds of data, each with a rule of its own in a
    policy, so they are few and the driver may know them.
    """
    name = F.coalesce(F.nullif(F.col("pattern_name"), F.lit("")), F.concat(F.lower("entity"), F.lit("_custom")))
    rows = patterns.select("entity", name.alias("pattern_name"), "regex", F.col("score").cast("double").alias("score"))
    wrong = F.when(F.col("entity").isNull(), "pattern without an entity").when(F.col("regex").isNull(), "not a pattern")
    wrong = wrong.when(F.rlike(F.lit(""), F.col("regex")), "pattern matches the empty string")
    wrong = wrong.when(F.col("score").isNull() | ~F.col("score").between(0.0, 1.0), "score out of range")
    try:
        listed = materialise(rows.withColumn("wrong", wrong).withColumn("_number", F.monotonically_increasing_id()), "patterns", folders=folders)
    except (Py4JJavaError, PySparkException) as error:
        if not re.search(r"PatternSyntaxException|INVALID_PARAMETER_VALUE.PATTERN", str(error)):
            raise
        raise ValueError("not a pattern in the table") from error
    for row in listed.where("wrong is not null").limit(1).collect():
        raise ValueError(f"{row['wrong']}: {row['regex']!r}, score {row['score']}")
    kinds = sorted(r["entity"] for r in listed.select("entity").distinct().collect())
    entities = [*recognizers.entities, *(e for e in kinds if e not in recognizers.entities)]
    known = RecognizerSet(recognizers.items, recognizers.flags, entities)
    priority = F.element_at(F.create_map(*[F.lit(x) for e in kinds for x in (e, known.priority(e))]), F.col("entity")) if kinds else F.lit(0)
    ready = listed.select(
        "_number", "entity", "pattern_name", F.concat(F.lit(known.prefix), "regex").alias("regex"), F.col("regex").alias("plain"),
        (-F.col("score")).alias("neg_score"), priority.alias("priority"),
    )
    return ready, known


def _anchors(listed: DataFrame, any_case: bool, folders: list[str] | None) -> DataFrame:
    """_number, hash and size of the window each pattern is looked for by; null for those without a literal."""
    if any_case:
        return listed.select("_number", F.lit(None).cast("long").alias("hash"), F.lit(None).cast("int").alias("size"))
    wide = 4 * listed.sparkSession.sparkContext.defaultParallelism
    plain = listed.select("_number", F.col("plain").alias("regex")).repartition(wide, "_number")
    all_ = materialise(plain.mapInArrow(_anchored, "_number long, hash long, size int, at int"), "windows", folders=folders)
    shared = all_.where("hash is not null").groupBy("hash").agg(F.count("*").alias("n"))
    chosen = all_.join(shared, "hash").groupBy("_number").agg(F.min(F.struct("n", "at", "hash", "size")).alias("a"))
    none = all_.where("hash is null").select("_number", "hash", "size")
    return chosen.select("_number", "a.hash", "a.size").unionByName(none)


def _bit_map(anchors: DataFrame, count: int) -> tuple[int, bytes]:
    """The map's bits, put together from bytes that tasks have set; ``MOST`` bounds it."""
    bits = min(MOST, max(LEAST, 1 << (PER_ENTRY * count - 1).bit_length()))
    mask = F.lit(bits - 1).cast("long")
    places = F.array(F.col("hash").bitwiseAND(mask), F.shiftright("hash", 32).bitwiseAND(mask))
    set_ = anchors.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(p & 7 as int))")).alias("set"))
    found = set_.select(F.col("at").cast("int").alias("at"), F.col("set").cast("short").alias("set")).toArrow()
    held = np.zeros(bits // 8, np.uint8)
    held[found.column("at").to_numpy()] = found.column("set").to_numpy().astype(np.uint8)
    return bits, held.tobytes()


def detect_with_table(
    df: DataFrame, patterns: DataFrame, recognizers: RecognizerSet, text: str = "text", column: str = "raw", folders: list[str] | None = None
) -> DataFrame:
    """``df`` with the findings of ``recognizers`` and of a table of patterns, as ``detect`` gives them for all together.

    Texts are written once and numbered; numbers and hashes meet the patterns, and the patterns found go back to their text.
    """
    listed, known = listed_patterns(patterns, recognizers, folders)
    anchors = materialise(_anchors(listed, "i" in known.flags, folders), "anchors", folders=folders)
    texts = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "texts", folders=folders)
    counted = {r["size"]: r["n"] for r in anchors.groupBy("size").agg(F.count("*").alias("n")).collect()}
    always = counted.pop(None, 0)
    asked = None
    if counted:
        bits, held = _bit_map(anchors.where("hash is not null"), sum(counted.values()))
        sent = df.sparkSession.sparkContext.broadcast(held)
        windows = texts.select("_row", F.col(text).alias("_text")).mapInArrow(_occurring(sorted(counted), sent, bits, BLOCK), "_row long, hash long")
        asked = windows.join(anchors.where("hash is not null").select("hash", "_number"), "hash").select("_row", "_number")
    if always:
        everywhere = texts.select("_row").crossJoin(anchors.where("hash is null").select("_number"))
        asked = everywhere if asked is None else asked.unionByName(everywhere)
    if asked is None:
        return detect(texts, text, known, column=column).drop("_row")
    chosen = asked.join(listed.select("_number", *_PATTERN), "_number").groupBy("_row").agg(F.collect_list(F.struct(*_PATTERN)).alias("_chosen"))

    def of(p):
        return F.transform(
            located(parts(F.col(text), p["regex"])),
            lambda x: F.struct(
                x["start"].alias("start"), (-(x["start"] + F.length(x["value"]))).alias("neg_end"), p["neg_score"].alias("neg_score"),
                p["priority"].alias("priority"), p["entity"].alias("entity"), p["pattern_name"].alias("pattern_name"), x["value"].alias("value"),
            ),
        )

    met = detect(texts.join(chosen, "_row", "left"), text, known, column="_others")
    found = F.coalesce(F.flatten(F.transform("_chosen", lambda p: let(p, of))), F.expr(NO_FINDINGS))
    return met.withColumn(column, F.array_sort(F.concat("_others", found))).drop("_row", "_chosen", "_others")
