"""The training-data operators against brute force, on the given tables and on small tables of odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import SF
from veilspan.llm import chunk_dedup, gated_lm, language_spans, maxscore, packing, quality_fm, sharding
from veilspan.llm import suffix_decontamination as decon
from veilspan.llm.chat_format import format_chats, parse
from veilspan.llm.components import components
from veilspan.llm.minhash_forest import near_duplicates
from veilspan.llm.queries import QUERIES, TOKENIZER
from veilspan.llm.text import NOT_ALNUM, WHITE, hash_word, word_blocks

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        # Names that the operators use themselves.
        T.StructField("class", T.StringType()), T.StructField("matches", T.StringType()), T.StructField("n_words", T.StringType()),
        T.StructField("removed_spans", T.StringType()), T.StructField("lang_pred", T.StringType()), T.StructField("length", T.LongType()),
    ]
)
PASSAGE = " ".join(f"passage{k} word" for k in range(40))
LONG = " ".join(f"w{k * k % 977}x{k}" for k in range(30_000))
ODD = [
    (1, PASSAGE, "en"), (2, "intro of its own " + PASSAGE + " and an end", "en"), (3, None, "en"), (4, "", None), (5, " \n\t ", None),
    (None, "without an id " + PASSAGE, "en"), (6, "one", "de"), (7, "one", "de"), (7, "one", "de"), (8, LONG, None), (9, "ONE", None),
    (10, "12345 !!! 67", None), (None, None, None), (11, "</s> <|endoftext|>  two  spaces\n\n", "fr"),
    (12, "aé " * 300, "fr"), (13, "aé " * 300 + "b", "fr"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "c", "m", "n", "r", "l", 1) for r in ODD], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def words(text):
    return (text or "").encode().lower().split()


def crc(x):
    return zlib.crc32(str(x).encode())


# Words


def test_words_of_any_length_and_place():
    rng = np.random.default_rng(1)
    texts = ["", None, "a", " a  B\tc\n", "x" * 1_200_000 + " y", LONG]
    texts += ["".join(rng.choice(list("ab \n\x0b\x1cé9-"), rng.integers(0, 60))) for _ in range(300)]
    import pyarrow as pa

    for separators, split in ((WHITE, lambda t: t.split()), (NOT_ALNUM, re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall)):
        got = []
        for *_, hashes, starts, ends, first in word_blocks(pa.array(texts), separators, 1 << 16):
            got += [hashes[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
        expected = [split((t or "").encode().lower()) for t in texts]
        assert [len(g) for g in got] == [len(e) for e in expected]
        known = {}
        for g, e in zip(got, expected):
            for h, w in zip(g, e):
                assert known.setdefault(w, h) == h
        assert len(set(known.values())) == len(known)
        assert all(hash_word(w) == h for w, h in list(known.items())[:20])


def test_components_are_those_of_union_find(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000, k) for k in range(1001, 1300)]
    pairs += [(k, k + 1) for k in range(2000, 2100)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    for a, b in pairs:
        if a != b:
            assert got[a] == got[b]
    assert len(set(got.values())) == len({find(x) for x in got})
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


# 1


def brute_components(rows, n=5, similarity=75):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            linked = both and 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both)
            if linked or (rows[i][0] == rows[j][0]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(sets[i]), least[find(i)], least[find(i)] == doc) for i, (doc, _) in enumerate(rows)]


def test_near_duplicates(spark, docs, none):
    got = QUERIES["op1_minhash_forest"](spark, SF).toPandas()
    expected = brute_components(list(zip(docs.doc_id, docs.text)))
    assert sorted(map(tuple, got.values.tolist())) == sorted(expected)
    assert near_duplicates(none).count() == 0


def test_near_duplicates_of_odd_rows_and_a_large_family(spark, odd):
    rng = np.random.default_rng(4)
    base = [f"b{k}" for k in range(120)]
    family = []
    for k in range(160):
        own = list(base)
        for p in rng.choice(120, rng.integers(0, 9), replace=False):
            own[p] = f"k{rng.integers(0, 9)}"
        family.append((100 + k, " ".join(own)))
    rows = [r for r in ODD if r[0] is not None]
    given = odd.select("doc_id", "text", "class").union(spark.createDataFrame([(*r, "c") for r in family], "doc_id long, text string, class string"))
    got = near_duplicates(given).toPandas()
    named = got[got.doc_id.notna()]
    expected = brute_components([r[:2] for r in rows] + family)
    assert sorted((int(a), b, int(c), d) for a, b, c, d in named.values.tolist()) == sorted(expected)
    unnamed = got[got.doc_id.isna()]
    assert len(unnamed) == 2 and unnamed.kept.all() and unnamed.component_id.isna().all()


# 2


def test_languages(spark, docs, odd, none):
    got = QUERIES["op2_language_spans"](spark, SF).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs)
    assert (got.held_out == (got.doc_id.map(crc) % 4 == 2)).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()
    model = language_spans.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    found = language_spans.identify(odd, model)
    assert found.columns[-3:] == ["lang_pred", "lang_score", "lang_spans"]
    pred = [(r.doc_id, r.lang_pred, r.lang_score, r.text) for r in found.collect()]
    assert len(pred) == len(ODD)
    for _, lang, score, text in pred:
        assert (lang == "und" and score == 0) == (not any(c.isalpha() for c in text or ""))
    assert {r.lang_pred for r in language_spans.identify(odd, language_spans.learn(none)).collect()} == {"und"}
    assert language_spans.identify(none, model).count() == 0


def test_language_spans_and_scripts(spark, docs):
    some = {lang: docs[(docs.lang == lang) & (docs.n_chars > 600)].text.iloc[0][:500].rsplit(" ", 1)[0] for lang in ("en", "de")}
    greek = "αβγ δεζ ηθι κλμ " * 30
    train = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").union(
        spark.createDataFrame([(greek, "el")] * 5, "text string, lang string")
    )
    mixed = some["en"] + " " + some["de"] + " " + greek
    row = language_spans.identify(spark.createDataFrame([(mixed,)], "text string"), language_spans.learn(train)).first()
    assert [s.lang for s in row.lang_spans] == ["en", "de", "el"]
    assert abs(row.lang_spans[0].end - len(some["en"])) < 40
    assert row.lang_spans[2].start == mixed.index("α")


# 3


def test_repeated_passages(spark, odd, none):
    found = chunk_dedup.remove_repeats(odd)
    got = defaultdict(list)
    for r in found.collect():
        got[r.doc_id].append(r)
    assert got[1][0].text == PASSAGE
    cut = got[2][0]
    assert cut.text.startswith("intro of its own ") and cut.text.endswith("and an end") and cut.n_removed > 60
    assert cut.n_words == len(words(ODD[1][1]))
    whole = "".join(ODD[1][1][s.start : s.end] for s in cut.removed_spans)
    assert len(words(whole)) == cut.n_removed
    assert got[3][0].text is None and got[4][0].text == "" and got[8][0].text == LONG
    assert {r.text for r in got[None]} == {"without an id " + PASSAGE, None}
    # Repeats inside one document: the first stays.
    assert 0 < len(words(got[12][0].text)) < 300
    assert got[7][0]["class"] == "c"
    assert chunk_dedup.remove_repeats(none).count() == 0


def test_passages_are_cut_wherever_they_stand(spark):
    rng = np.random.default_rng(6)
    own = lambda n: " ".join(f"o{x}" for x in rng.integers(0, 10**9, n))
    rows, passages = [], []
    for k in range(120):
        passage = own(55)
        passages.append(passage)
        rows += [(3 * k, f"{own(rng.integers(0, 60))} {passage} {own(20)}"), (3 * k + 1, f"{own(30)}\n{passage}"), (3 * k + 2, own(90))]
    got = {r.doc_id: r for r in chunk_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum(got[3 * k + 1].n_removed > 0 for k in range(120))
    assert caught >= 118
    texts = dict(rows)
    for doc, r in got.items():
        if doc % 3 != 1:
            assert r.text == texts[doc]
        else:
            # Nothing but words of the passage goes.
            assert words(texts[doc])[:30] == words(r.text)[:30] and r.n_removed <= 55


# 4


def brute_top(rows, is_query, k=5):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if is_query(q):
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    frame = pd.read_parquet(f"{SF}/embeddings.parquet")
    got = QUERIES["op4_maxscore"](spark, SF).collect()
    rows = [(i, list(map(float, v))) for i, v in zip(frame.vec_id, frame.embedding)]
    assert sorted(map(tuple, got)) == brute_top(rows, lambda i: i % 50 == 0)
    rng = np.random.default_rng(8)
    odd = [(int(i), [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(0, 400)]
    odd += [(1000, None), (1001, []), (1002, [1.0, None, 2.0]), (1003, [1.0, float("nan"), 2.0]), (1004, [float("inf"), 1.0, 2.0]), (None, [1.0, 1.0, 1.0]),
            (1050, [1e30, 1.0, -1.0]), (1100, [1.0, 2.0]), (1101, [2.0, 1.0]), (1150, [5.0])]
    monkeypatch.setattr(maxscore, "SHARD", 64)
    monkeypatch.setattr(maxscore, "BLOCK", 4)
    frame = spark.createDataFrame([(*r, 1) for r in odd if r[0] != 1050], "vec_id long, embedding array<double>, score int")
    got = sorted(map(tuple, maxscore.top_k(frame, F.col("vec_id") % 50 == 0).collect()))
    assert got == brute_top([r for r in odd if r[0] != 1050], lambda i: i % 50 == 0)
    huge = spark.createDataFrame([odd[0], (1050, [1e30, 1.0, -1.0])], "vec_id long, embedding array<double>")
    assert maxscore.top_k(huge, F.col("vec_id") == 0).count() == 1
    assert maxscore.top_k(frame.limit(0), F.col("vec_id") == 0).count() == 0


# 5


def test_quality(spark, docs, odd, none):
    labels = pd.read_parquet(f"{SF}/labels.parquet").groupby("doc_id").quality.max()
    got = QUERIES["op5_quality_fm"](spark, SF).toPandas()
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert (got.held_out == (got.doc_id.map(crc) % 5 == 0)).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out & got.doc_id.isin(labels.index)]
    assert (held.predicted == held.doc_id.map(labels)).mean() > 0.8
    machine = quality_fm.learn(odd, spark.createDataFrame([(1, 1), (2, 0), (2, 1), (99, 0), (None, 1)], "doc_id long, label int"))
    assert quality_fm.score(odd, machine).count() == len(ODD)
    assert {r.score for r in quality_fm.score(odd, quality_fm.learn(none, none.select("doc_id", F.lit(1).alias("label")))).collect()} == {0.5}
    assert quality_fm.score(none, machine).count() == 0


def test_pair_sum_is_that_of_all_pairs():
    machine = quality_fm.Machine()
    rng = np.random.default_rng(3)
    machine.weight[:] = rng.normal(size=len(machine.weight))
    place, value = rng.choice(quality_fm.FEATURES, 12, replace=False), rng.normal(size=12)
    pairs = sum(machine.vector[place[i]] @ machine.vector[place[j]] * value[i] * value[j] for i in range(12) for j in range(i))
    expected = machine.bias + machine.weight[place] @ value + pairs
    assert np.isclose(machine.logit(place, value, np.zeros(12, int), 1)[0], expected, rtol=1e-4)


# 6


def test_language_model(spark, docs):
    got = QUERIES["op6_gated_lm"](spark, SF).toPandas().set_index("doc_id")
    own = {i: [*words(t), 0] for i, t in zip(docs.doc_id, docs.text)}
    count = Counter(w for i, ws in own.items() if crc(i) % 10 for w in ws)
    total = sum(count.values())
    for i, ws in own.items():
        row = got.loc[i]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), total)
        assert np.isclose(row.base_score, sum(np.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in ws))
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_language_model_gradient_state_and_odd_rows(spark, odd, none):
    rng = np.random.default_rng(1)
    net = gated_lm.Network(rng.normal(0, 0.4, gated_lm.SIZE))
    net.flat = net.flat.astype(np.float64)
    net = _double(net)
    inputs, targets = rng.integers(0, 1024, (5, 3)), rng.integers(0, 1025, (5, 3))
    keep = np.ones((5, 3))
    keep[2, 1] = 0
    state = rng.normal(0, 0.5, (3, gated_lm.UNITS))

    def loss(flat):
        states, _ = _double(gated_lm.Network(flat), flat).forward(inputs, keep, state)
        return -_double(gated_lm.Network(flat), flat).outputs(states.reshape(-1, gated_lm.UNITS).astype(float), targets.ravel(), False)[0].mean()

    grad, _ = net.gradient(inputs, keep, targets, state)
    at = np.argsort(-np.abs(grad))[:30]
    for k in at:
        step = np.zeros(gated_lm.SIZE)
        step[k] = 1e-3
        assert np.isclose((loss(net.flat + step) - loss(net.flat - step)) / 2e-3, grad[k], rtol=0.05, atol=1e-4)
    # A document's score does not depend on where windows end or on its neighbours.
    net = gated_lm.Network(rng.normal(0, 0.3, gated_lm.SIZE))
    one, two = rng.integers(0, 1025, 150), rng.integers(0, 1025, 37)
    both = gated_lm.log_probabilities(net, np.concatenate((one, two)), np.array([0, 150]))
    assert np.allclose(both[:150], gated_lm.log_probabilities(net, one, np.array([0])), atol=1e-4)
    assert np.allclose(both[150:], gated_lm.log_probabilities(net, two, np.array([0])), atol=1e-4)
    got = gated_lm.score(odd, quality_fm.fold(10) == 0).collect()
    assert len(got) == len(ODD) and all(np.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert gated_lm.score(none, quality_fm.fold(10) == 0).count() == 0
    unlearned = gated_lm.score(odd, F.lit(True)).collect()
    assert {r.train_tokens for r in unlearned} == {0}


def _double(net, flat=None):
    at = 0
    net.flat = np.array(net.flat if flat is None else flat, np.float64)
    for name, shape in gated_lm._SHAPES.items():
        n = int(np.prod(shape))
        net.part[name] = net.flat[at : at + n].reshape(shape)
        at += n
    return net


# 7


def check_packing(rows, tokenizer_ids, capacity=1024):
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, ids in tokenizer_ids.items():
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.length for r in pieces[1:]] == [capacity] * (len(pieces) - 1)
        at = 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    return len(used)


def ids_of(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_packing(spark, docs):
    rows = QUERIES["op7_packing"](spark, SF).collect()
    ids = dict(zip(docs.doc_id, ids_of(docs.text)))
    sequences = check_packing(rows, ids)
    assert sequences <= 1.02 * -(-sum(map(len, ids.values())) // 1024) + 1


def test_packing_of_odd_rows(spark, odd, none):
    rows = packing.pack(odd, TOKENIZER).withColumn("ids_crc32", F.crc32("ids")).collect()
    once = [r for r in ODD if r[0] not in (None, 7)]
    check_packing(rows, dict(zip([r[0] for r in once], ids_of([r[1] for r in once]))))
    assert sum(r.doc_id == 7 for r in rows) == 2
    assert packing.pack(none, TOKENIZER).count() == 0


def test_ids_are_the_tokenizers_for_any_white_space():
    rng = np.random.default_rng(9)
    with open(TOKENIZER, encoding="utf-8") as file:
        encoder = packing.Encoder(file.read())
    parts = ["a", "the", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "é", "日本", "'s", "12", "--", ", ", ". ", "_", "e\u0301", "\u00b2", "\0", "<|endoftext|>", "it's"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(3000)]
    assert [x.tolist() for x in encoder.encode(texts)] == [i[:-1] for i in ids_of(texts)]


def test_forgotten_pieces_and_long_ones_come_back(docs, monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 500)
    monkeypatch.setattr(packing, "FRESH", 50)
    with open(TOKENIZER, encoding="utf-8") as file:
        encoder = packing.Encoder(file.read())
    for k in range(0, 200, 20):
        texts = docs.text[k : k + 20].tolist() + ["z" * 700_000 + " wörd" * 9, None, ""]
        assert [x.tolist() for x in encoder.encode(texts)] == [i[:-1] for i in ids_of(texts)]


def test_configurations_cover_every_count():
    rng = np.random.default_rng(2)
    for top, n in ((60, 300), (1024, 4000), (1024, 3), (200, 0)):
        counts = np.zeros(1025, np.int64)
        np.add.at(counts, rng.integers(1, top + 1, n), 1)
        plan = packing.configurations(counts, 1024, 60)
        made = np.zeros(1025, np.int64)
        for config, many in plan:
            assert sum(length * k for length, k in config.items()) <= 1024 and many > 0
            for length, k in config.items():
                made[length] += k * many
        assert (made == counts).all()
        # The program decides in every case; best fit is hardly ever ahead of it.
        assert sum(m for _, m in plan) <= 1.005 * sum(m for _, m in packing.best_fit(counts, 1024)) + 2


def least_sequences(lengths, capacity):
    """The fewest sequences there can be, by trying all places for the longest length left."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for at in {room: i for i, room in enumerate(rooms) if room >= lengths[k]}.values():
            place(k + 1, [*rooms[:at], rooms[at] - lengths[k], *rooms[at + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def test_few_pieces_need_at_most_one_sequence_more_than_the_best():
    rng = np.random.default_rng(8)
    over = 0
    for _ in range(25):
        lengths = sorted(rng.choice([2, 3, 5, 7, 8, 9], rng.integers(1, 10)).tolist(), reverse=True)
        counts = np.bincount(lengths, minlength=17).astype(np.int64)
        over += sum(m for _, m in packing.configurations(counts, 16, 40)) - least_sequences(lengths, 16)
    assert 0 <= over <= 3


def test_the_program_places_half_of_the_pieces_of_the_given_table():
    texts = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text
    lengths = np.array([len(ids) for ids in ids_of(texts)])
    counts = np.bincount(lengths % 1024, minlength=1025)
    counts[0], counts[1024] = 0, (lengths // 1024).sum()
    plan = packing.configurations(counts)
    assert sum(m for _, m in plan) <= -(-lengths.sum() // 1024) + 3


def test_the_configuration_program_places_most_pieces():
    counts = np.zeros(1025, np.int64)
    np.add.at(counts, np.random.default_rng(4).integers(300, 480, 20_000), 1)
    left = counts.copy()
    for config, many in packing.program(counts, 1024):
        assert sum(length * k for length, k in config.items()) <= 1024
        for length, k in config.items():
            left[length] -= k * many
    assert (left >= 0).all() and left.sum() < 0.2 * counts.sum()
    # Best fit alone puts two of the long pieces together and three of the short ones.
    assert sum(m for _, m in packing.configurations(counts)) < 0.98 * sum(m for _, m in packing.best_fit(counts, 1024))


# 8


def test_shards(spark, docs, odd, none):
    got = QUERIES["op8_sharding"](spark, SF).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs)
    assert (got["size"] == got.text.map(lambda t: len(t.encode()) + 1)).all()
    assert (got.text_crc32 == got.text.map(lambda t: zlib.crc32(t.encode()))).all()
    sizes = got.groupby("shard")["size"].sum()
    assert set(sizes.index) == set(range(8)) and sizes.max() - sizes.min() <= 2 * got["size"].max()
    for _, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    small = sharding.shards(odd, 3).toPandas()
    assert len(small) == len(ODD) and (small.groupby("shard").slot.apply(sorted).map(lambda s: s == list(range(len(s))))).all()
    assert sharding.shards(none).count() == 0
    same = spark.createDataFrame([(k, "same text") for k in range(100)], "doc_id long, text string")
    assert sorted(sharding.shards(same, 4).groupBy("shard").count().toPandas()["count"]) == [25] * 4


# 9


def test_chats(spark):
    frame = pd.read_parquet(f"{SF}/conversations.parquet")
    said = "</s>[INST] ok [/INST]"
    extra = pd.DataFrame({"conv_id": [-7, -7], "turn": [0, 1], "role": ["user", "assistant"], "text": [said] * 2})
    got = {r.conv_id: r for r in QUERIES["op9_chat_format"](spark, SF).collect()}
    whole = pd.concat([frame, extra])
    assert set(got) == set(whole.conv_id)
    for conv, rows in whole.sort_values("turn").groupby("conv_id"):
        turns = "".join(f"{r}\n{t or ''}\n" for r, t in zip(rows.role, rows.text))
        loss = "".join(t or "" for r, t in zip(rows.role, rows.text) if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(rows), hashlib.sha256(turns.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chats_of_any_text_come_back(spark):
    rng = np.random.default_rng(5)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "<\\\\/s>", "[\\/INST]", "\\", "<", "[", " ", "\n", "ok", "é𝒳", "/s>", "INST] "]
    text = lambda: "".join(rng.choice(parts, rng.integers(0, 7)))
    rows = [(c, t, str(rng.choice(["user", "assistant", "system", "", " [/INST] ", "a [", "\\"])), text(), 1) for c in range(300) for t in range(3)]
    rows += [(900, None, None, None, 1), (900, 1, "assistant", None, 1), (None, 0, "user", "x", 1), (901, 0, "b", "2", 1), (901, 0, "a", "1", 1)]
    out = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int"))
    got = {r.conv_id: r for r in out.withColumn("back", parse(F.col("formatted"))).collect()}
    expected = defaultdict(list)
    for c, t, role, body, _ in rows:
        expected[c].append((-1 if t is None else t, role or "", body or ""))
    for c, turns in expected.items():
        turns = sorted(turns)
        assert [(b.role, b.text) for b in got[c].back] == [x[1:] for x in turns]
        loss = "".join(x[2] for x in turns if x[1] == "assistant")
        held = "".join(got[c].formatted[s.start : s.start + s.length] for s in got[c].loss_spans)
        assert re.sub(r"([<\[])\\(\\*)(/?s>|/?INST\])", r"\1\2\3", held) == loss
    # Nothing is escaped where nothing conflicts.
    assert got[901].formatted == "<s>[INST] a [/INST] 1</s><s>[INST] b [/INST] 2</s>"
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_no_control_string_stays_inside_a_text(spark):
    said = ["a <s> b", "a [INST] b", "a [/INST] b", "a [/INST] b [INST]", "plain"]
    rows = [(c, 0, "user", text) for c, text in enumerate(said)]
    out = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in out.withColumn("back", parse(F.col("formatted"))).collect():
        assert [(b.role, b.text) for b in r.back] == [("user", said[r.conv_id])]
        body = r.formatted.removeprefix("<s>[INST] user [/INST] ").removesuffix("</s>")
        assert not re.search(r"[<\[](/?s>|/?INST\])", body)


# 10

ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(texts, items, window=10):
    runs = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").encode().lower())
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            # An item without id marks words and names no item.
            runs[tuple(w[k : k + n])] |= {str(item)} - {"None"}
    sizes = {len(k) for k in runs}
    out = []
    for text in texts:
        w = ALNUM.findall((text or "").encode().lower())
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (mine := runs.get(tuple(w[k : k + n]))) is not None:
                    found |= mine
                    hit.update(range(k, k + n))
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_decontamination(spark, docs, odd, none):
    got = {r.doc_id: r for r in QUERIES["op10_suffix_decontamination"](spark, SF).collect()}
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    for doc, (n, hit, found) in zip(docs.doc_id, brute_hits(docs.text, list(zip(items.item_id, items.text)))):
        r = got[doc]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


@pytest.mark.parametrize("part_bytes", [decon.PART_BYTES, 200])
def test_decontamination_of_odd_rows(spark, odd, none, part_bytes):
    rng = np.random.default_rng(7)
    few = lambda n: " ".join(rng.choice(list("abcd"), n))
    items = [(1, few(14)), (2, few(9)), (3, "a"), (4, None), (5, ""), (None, "one"), (6, PASSAGE[:150]), (6, PASSAGE[:150]), (7, "aé " * 12), (8, "ONE")]
    texts = [(100 + k, few(200)) for k in range(20)]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, n_hit string")
    given = odd.select("doc_id", "text", "matches").union(spark.createDataFrame([(*r, "m") for r in texts], "doc_id long, text string, matches string"))
    rows = decon.find_matches(given, bench, part_bytes=part_bytes).collect()
    expected = brute_hits([r.text for r in rows], items)
    for r, (n, hit, found) in zip(rows, expected):
        assert (r.n_words, r.n_hit, sorted({m.item_id for m in r.matches} - {None})) == (n, hit, found)
    kept = decon.decontaminate(given, bench)
    assert kept.columns == given.columns and kept.count() == sum(hit == 0 for _, hit, _ in expected)
    assert decon.find_matches(none, bench).count() == 0
    assert decon.decontaminate(given, bench.limit(0)).count() == given.count()
