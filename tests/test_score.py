"""Precision and recall against the largest matching there is."""

import itertools
import random

from pyspark.sql import functions as F

from veilspan.operators.score import merged_spans, pairs, scores


def merge(spans):
    out = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def largest(left, right):
    """The largest one-to-one matching, by augmenting paths."""
    partner = {}

    def place(a, seen):
        for b in range(len(right)):
            if left[a][0] < right[b][1] and right[b][0] < left[a][1] and b not in seen:
                seen.add(b)
                if b not in partner or place(partner[b], seen):
                    partner[b] = a
                    return True
        return False

    return sum(place(a, set()) for a in range(len(left)))


def test_scores_are_those_of_the_largest_matching(spark):
    rng = random.Random(6)
    rows, expected = {"found": [], "true": []}, {}
    for doc, entity in itertools.product([None, *range(60)], ["A", "B", "C"]):
        sides = []
        for side, most in (("found", 12), ("true", 9)):
            spans = [(s, s + rng.randrange(1, 9)) for s in (rng.randrange(60) for _ in range(rng.randrange(most) if (entity, side) != ("C", "found") else 0))]
            rows[side] += [(doc, entity, *span) for span in spans]
            sides.append(merge(spans))
        total = expected.setdefault(entity, [0, 0, 0])
        total[0] += len(sides[1])
        total[1] += len(sides[0])
        total[2] += largest(*sides)
    frames = [spark.createDataFrame(rows[side], "doc_id int, entity string, start int, end int") for side in ("found", "true")]
    got = {r.entity: r for r in scores(*frames, "doc_id").collect()}
    for entity, (n_true, n_found, tp) in expected.items():
        r = got[entity]
        assert (r.n_true, r.n_found, r.tp, r.fp, r.fn) == (n_true, n_found, tp, n_found - tp, n_true - tp)
        assert r.recall == tp / n_true and r.precision == (tp / n_found if n_found else None)
    assert scores(frames[0].limit(0), frames[1].limit(0), "doc_id").count() == 0


def test_touching_spans_stay_apart_and_share_nothing(spark):
    df = spark.createDataFrame([(1, "A", 0, 3), (1, "A", 3, 5), (1, "A", 4, 9), (1, "A", 5, 6)], "doc_id int, entity string, start int, end int")
    assert sorted((r.start, r.end) for r in merged_spans(df, "doc_id").collect()) == [(0, 3), (3, 9)]
    side = lambda *spans: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in spans])
    row = spark.range(1).select(pairs(side((0, 3)), side((3, 5))).alias("a"), pairs(side((0, 9)), side((1, 2), (8, 12))).alias("b"), pairs(side((0, 9), (9, 12)), side((1, 2), (8, 12))).alias("c")).first()
    assert tuple(row) == (0, 1, 2)
