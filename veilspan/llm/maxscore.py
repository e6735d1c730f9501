"""Exact top-k by inner product with MaxScore over shards of postings.

Vectors become integer impacts ``floor(256 * x)``. A shard holds at most ``SHARD`` vectors as one posting list per component, a
list's positive and negative impacts bounding what the component can add to a query's score. For each query and shard:

1. The query's components are ordered by their bound. Those of highest bound are essential: without a gain from one of them,
   the others' bounds together stay below the k-th score known so far.
2. Essential lists are traversed for the shard's vectors.
3. The other lists are probed in order, for the vectors that can still reach the k-th score; it rises on the way.

A shard gives its k best per query; shards are merged by score and smaller id. Queries travel in blocks of ``BLOCK`` to every
shard: the stated query set against all rows. Nothing is broadcast.

Defined cases: vectors null, empty, or with a null or non-finite component take no part; a query meets only vectors of its own
number of components; fewer than k candidates give fewer rows; ids that repeat are candidates one by one, but never their own
query's. Rows without id take no part. Other columns are not read. Scores are computed in 64-bit floats, exact while
they stay under 2**53 (components up to some hundred thousand), else in unbounded integers, kept within 64 bits at the end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.session import materialise

SHARD = 4096
BLOCK = 1024
PROBED = 8
_PACKED = "part int, dim int, ids binary, impacts binary"


def impacts(vectors: DataFrame) -> DataFrame:
    """vec_id and impacts (array of doubles with whole values) of the vectors that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    good = F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    )
    # floor() of a double gives a long; the multiplication is by a power of two and so exact.
    return (
        vectors.where("vec_id is not null").where(F.coalesce(good, F.lit(False)))
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * 256).cast("double")).alias("impacts"))
    )


def _packed(rows: DataFrame, per_part: int) -> DataFrame:
    """Parts of about ``per_part`` vectors of one size each: ids and impacts side by side."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, schema=None) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        table = table.sort_by([("dim", "ascending"), ("part", "ascending"), ("vec_id", "ascending")])
        dim, part = table.column("dim").to_numpy(), table.column("part").to_numpy()
        edge = np.flatnonzero((np.diff(dim) != 0) | (np.diff(part) != 0)) + 1
        for a, b in zip(np.concatenate(([0], edge)), np.concatenate((edge, [len(dim)]))):
            values = table.column("impacts").slice(a, b - a).combine_chunks().flatten().to_numpy()
            ids = table.column("vec_id").slice(a, b - a).to_numpy()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part[a]], pa.int32()), "dim": pa.array([dim[a]], pa.int32()), "ids": [ids.tobytes()], "impacts": [values.tobytes()]}
            )

    rows = rows.withColumn("dim", F.size("impacts"))
    parts = int(rows.count() // per_part) + 1
    # A vector's own values take part in the hash: copies of one id spread as well.
    rows = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "impacts"), F.lit(parts)).cast("int"))
    return rows.repartition(parts, "part").mapInArrow(run, _PACKED).withColumn("parts", F.lit(parts))


def search(ids: np.ndarray, columns: np.ndarray, bounds: np.ndarray, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (vec_id, score) of a shard. ``columns``: a posting list per component; ``bounds``: their least and highest impact."""
    gain = np.maximum(query * bounds[0], query * bounds[1])
    order = np.argsort(-gain, kind="stable")
    rest = np.append(np.cumsum(gain[order][::-1])[::-1], 0)  # what the components from here on can add
    other = np.flatnonzero(ids != query_id)
    if len(other) <= k:
        exact = query @ columns[:, other]
        return sorted(zip(ids[other].tolist(), exact.tolist()), key=lambda x: (-x[1], x[0]))
    # A first k-th score, from the vectors whose best component matters most.
    top = columns[order[0], other] * query[order[0]]
    seed = other[np.argpartition(-top, k - 1)[: 4 * k]] if len(other) > 4 * k else other
    known = np.partition(query @ columns[:, seed], len(seed) - k)[len(seed) - k]
    essential = int(np.searchsorted(-rest, -known, "right"))  # the first place whose rest stays below the k-th score
    essential = min(max(essential, 1), len(order))
    score = query[order[:essential]] @ columns[order[:essential]][:, other]
    alive = score + rest[essential] >= known
    other, score, done = other[alive], score[alive], essential
    while done < len(order):
        step = order[done : done + PROBED]
        score = score + query[step] @ columns[step][:, other]
        done += len(step)
        if len(score) > k:
            # Whatever the others add, k vectors reach this.
            low = np.minimum(query * bounds[0], query * bounds[1])[order[done:]].sum()
            known = max(known, np.partition(score, len(score) - k)[len(score) - k] + low)
        alive = score + rest[done] >= known
        other, score = other[alive], score[alive]
    best = np.lexsort((ids[other], -score.astype(np.float64)))[:k] if score.dtype != object else sorted(range(len(score)), key=lambda i: (-score[i], ids[other[i]]))[:k]
    return [(int(ids[other[i]]), int(score[i])) for i in best]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query (rows of ``vectors`` where ``is_query``)."""
    rows = materialise(impacts(vectors), "impacts")
    shards = materialise(_packed(rows, SHARD), "shards")
    queries = _packed(rows.where(is_query), BLOCK).drop("parts")
    # Every block of queries goes to every shard of its number of components.
    places = queries.select("dim", F.col("ids").alias("q_ids"), F.col("impacts").alias("q_impacts")).join(
        shards.groupBy("dim").agg(F.collect_set("part").alias("all")), "dim"
    )
    pairs = shards.join(places.select("dim", "q_ids", "q_impacts", F.explode("all").alias("part")), ["dim", "part"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = 1 << 63
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                ids, query_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                columns = np.frombuffer(row["impacts"], np.float64).reshape(-1, row["dim"]).T.copy()
                queries = np.frombuffer(row["q_impacts"], np.float64).reshape(-1, row["dim"])
                if np.abs(columns).max() * np.abs(queries).max() * row["dim"] >= 2**52:
                    whole = np.vectorize(int, otypes=[object])
                    columns, queries = whole(columns), whole(queries)
                bounds = np.stack([columns.min(axis=1), columns.max(axis=1)])
                for query_id, query in zip(query_ids.tolist(), queries):
                    out += [(query_id, v, max(-limit, min(limit - 1, int(s)))) for v, s in search(ids, columns, bounds, query_id, query, k)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else ((), (), ()))], ["query_id", "vec_id", "score"])

    found = pairs.repartition("part", F.xxhash64("q_ids")).mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
