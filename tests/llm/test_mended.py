"""Cases that earlier versions lost: periodic passages, items without id, matches that are not verbatim, doc_ids that come back."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import words
from veilspan.llm import chunk_dedup
from veilspan.llm import suffix_decontamination as decon
from veilspan.llm.oracles import ORACLES
from veilspan.llm.queries import QUERIES
from veilspan.llm.text import hash_word


@pytest.mark.parametrize("period", [1, 2, 3, 5, 8, 13, 40, 1000])
def test_passages_of_any_period_are_found(period):
    rng = np.random.default_rng(period)
    fresh = lambda n: rng.integers(1, 1 << 63, n, dtype=np.uint64)
    missed, share = 0, []
    for _ in range(120):
        length = int(rng.choice([52, 60, 110, 300]))
        passage = np.resize(fresh(period), length)
        at = int(rng.integers(0, 200))
        one = np.concatenate((fresh(rng.integers(0, 200)), passage, fresh(rng.integers(0, 200))))
        two = np.concatenate((fresh(at), passage, fresh(rng.integers(0, 200))))
        digest, begins, stops = chunk_dedup.chunks(two, 20)
        covered = np.zeros(len(two), bool)
        for k in np.flatnonzero(np.isin(digest, chunk_dedup.chunks(one, 20)[0])):
            covered[begins[k] : stops[k]] = True
        missed += not covered.any()
        share.append(covered[at : at + length].mean())
        assert not covered[:at].any() and not covered[at + length :].any()
    assert missed <= 2 and np.mean(share) > 0.8


def test_removal_is_that_of_the_rules(spark):
    """The whole operator against plain Python, word by word; the chunks are its own."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    passages = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(4)] + ["na " * 55 + "end", "tick tock " * 40]
    rows = []
    for doc in range(40):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(80))) for _ in range(3)]
        rows.append((doc, f"{parts[0]} {rng.choice(passages)} {parts[1]} {rng.choice(passages)} {parts[2]}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in chunk_dedup.remove_repeats(df).collect()}
    found = {}
    for doc, text in rows:
        own = words(text)
        hashes = np.array([hash_word(w) for w in own], np.uint64)
        found[doc] = (own, *chunk_dedup.chunks(hashes, 20)[1:])
    owner = {}
    for doc, (own, begins, stops) in found.items():
        for a, b in zip(begins, stops):
            owner.setdefault(tuple(own[a:b]), doc)
    total = 0
    for doc, (own, begins, stops) in found.items():
        gone, first = set(), {}
        for a, b in zip(begins, stops):
            key = tuple(own[a:b])
            first.setdefault(key, b)
            if owner[key] < doc or a >= first[key]:
                gone |= set(range(a, b))
        assert (got[doc].n_words, got[doc].n_removed) == (len(own), len(gone))
        assert words(got[doc].text) == [w for k, w in enumerate(own) if k not in gone]
        total += len(gone)
    assert total > 2000


BENCHMARK = [("hello", "hello"), ("aaa", "a " * 10), (None, "one two three four five six seven eight nine ten eleven"), (None, "solo"), ("rep", "x y " * 12), ("gap", "p1 p2 p3 p4 p5 p6 p7 p8 p9 p10 q p1 p2 p3 p4 p5 p6 p7 p8 p9 p10 r s")]
TEXTS = [
    (1, "hello hello hello"), (2, "a " * 14), (3, "zero one two three four five six seven eight nine ten eleven twelve"), (4, "so solo here"),
    (5, "y x y x y x y x y x y x y x z"), (6, "p1 p2 p3 p4 p5 p6 p7 p8 p9 p10 r s and p2 p3 p4 p5 p6 p7 p8 p9 p10 q p1"), (7, "nothing"), (8, None),
]


def test_matches_are_verbatim_and_items_without_id_count(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    items = spark.createDataFrame(BENCHMARK + [BENCHMARK[0]], "item_id string, text string")
    own = {item: words(text) for item, text in BENCHMARK if item}
    for part_bytes in (1 << 20, 40):
        got = {r.doc_id: r for r in decon.find_matches(docs, items, part_bytes=part_bytes).collect()}
        assert {i: r.n_hit for i, r in got.items()} == {1: 3, 2: 14, 3: 11, 4: 1, 5: 14, 6: 23, 7: 0, 8: 0}
        for doc, text in TEXTS:
            said = words(text)
            for m in got[doc].matches:
                if m.item_id is not None:
                    assert said[m.doc_word : m.doc_word + m.n_words] == own[m.item_id][m.item_word : m.item_word + m.n_words]
        assert [m.n_words for m in got[1].matches] == [1, 1, 1] and {m.n_words for m in got[2].matches} == {10}
        # The longest ways through the item, also where its first place goes on otherwise.
        assert sorted((m.item_word, m.doc_word, m.n_words) for m in got[6].matches) == [(1, 13, 11), (11, 0, 12)]
        assert [(m.item_id, m.n_words) for m in got[3].matches] == [(None, 11)]
    left = {r.doc_id for r in decon.decontaminate(docs, items).collect()}
    assert left == {7, 8}


def test_sql_of_items_without_id_and_of_control_strings(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = ["<s>", "</s>", "[INST]", "[/INST]", "a [/INST] b", "<\\s>", "[\\\\INST]", "<s", "plain", "", None, "</s><s>[INST]", "\\</s>", "<", "[ INST ]"]
    chats = [(k, t, role, text) for k, text in enumerate(odd) for t, role in enumerate(("user", "assistant"))]
    chats += [(100 + k, 0, role, "x") for k, role in enumerate(odd)]
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("op9_chat_format", "op10_suffix_decontamination"):
        theirs = con.execute(ORACLES[name])
        columns = [c[0] for c in theirs.description]
        mine = QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
        assert sorted(map(tuple, mine)) == sorted(theirs.fetchall())


def test_two_texts_under_one_doc_id_both_stay(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choices([f"w{k}" for k in range(900)], k=60))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (2, b + " more"), (3, c), (3, c), (4, c), (None, a), (None, "short"), (5, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).coalesce(1)
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, a), (1, b), (3, c), (None, "short"), (5, None), (5, "")], key=str)


def test_words_end_where_the_script_changes(spark):
    from veilspan.llm import language_spans as spans

    def cut(text):
        found = spans.Words([text])
        return ["\n".join(["", text, ""])[a:b] for a, b in zip(found.starts, found.ends)]

    assert cut("日本語English русскийtext, plain words") == ["日本語", "English", "русский", "text", "plain", "words"]
    assert cut("e\u0301té αe\u0301β x") == ["e\u0301té", "α", "e\u0301", "β", "x"]
    assert cut("漢" * 10 + "ab") == ["漢" * 4, "漢" * 4, "漢" * 2, "ab"]
    assert cut("東京タワー") == ["東京", "タワ", "ー"] or cut("東京タワー") == ["東京", "タワー"]
    assert cut("") == [] and cut("12 !!") == [] and cut("a") == ["a"]
    latin = "the quick brown fox jumps over the lazy dog "
    cyrillic = "съешь ещё этих мягких французских булок "
    rows = [(k, latin * 5, "en") for k in range(20)] + [(100 + k, cyrillic * 5, "ru") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = spans.learn(docs)
    mixed = spark.createDataFrame([(1, "thequickbrownfox" + "мягкихфранцузских" + "overthelazydog")], "doc_id long, text string")
    row = spans.identify(mixed, model).first()
    text = mixed.first().text
    assert [(text[s.start : s.end], s.lang) for s in row.lang_spans] == [("thequickbrownfox", "en"), ("мягкихфранцузских", "ru"), ("overthelazydog", "en")]
