"""Vector codes, the trie of conversations and token counts against brute force, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.test_operators import DOCS, ODD
from veilspan.llm import prefix_trie, token_counts, vector_codes
from veilspan.llm.queries import COUNTER, QUERIES

# 11


def brute_nearest(part, book):
    return min((sum((int(a) - int(b)) ** 2 for a, b in zip(part, entry)), k) for k, entry in enumerate(book))


@pytest.mark.parametrize("kind", [np.float64, np.int64])
def test_search_by_sums_finds_the_nearest_entry(kind):
    rng = np.random.default_rng(1)
    for spread, n in ((2, 256), (40, 100), (1000, 7), (1000, 1)):
        book = rng.integers(-spread, spread + 1, (n, 4))
        parts = rng.integers(-spread, spread + 1, (200, 4))
        # Ties at every distance: entries that repeat, and parts between two entries of equal gap.
        book[n // 2 :] = book[: n - n // 2]
        index, distance, taken = vector_codes.nearest(parts.astype(kind), book.astype(kind))
        assert [(int(d), int(k)) for d, k in zip(distance, index)] == [brute_nearest(p, book) for p in parts]
        assert taken <= 200 * n
    smooth = np.sort(rng.integers(0, 10**6, (256, 1)), axis=0) + np.zeros((1, 8), int)
    _, _, taken = vector_codes.nearest(smooth.astype(float), smooth.astype(float))
    assert taken < 256 * 4


def brute_codes(rows, parts=4):
    """rows: (vec_id, label, integers), sorted; the contract's codes, errors and codebooks."""
    size = len(rows[0][2]) // parts
    pieces = [[r[2][p * size : (p + 1) * size] for r in rows] for p in range(parts)]
    books = [[list(x) for x in own[:256]] for own in pieces]
    for last in (0, 0, 0, 0, 1):
        found = [[brute_nearest(x, book) for x in own] for own, book in zip(pieces, books)]
        for p in range(0 if last else parts):
            for k in range(len(books[p])):
                own = [x for x, (_, at) in zip(pieces[p], found[p]) if at == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    codes = ["".join(f"{found[p][i][1]:02x}" for p in range(parts)) for i in range(len(rows))]
    return [(r[0], r[1], code, sum(found[p][i][0] for p in range(parts))) for i, (r, code) in enumerate(zip(rows, codes))], digest


def test_vector_codes(spark):
    rng = random.Random(2)
    given_rows = [(k, k % 3 or None, [rng.randrange(-4, 5) / 7 for _ in range(8)]) for k in range(290)]
    given_rows += [(5, 1, given_rows[5][2]), (5, 1, [0.0] * 8), (None, None, [0.5] * 8)]
    odd = [(-9, 1, None), (-8, 1, []), (-7, 1, [1.0] * 7 + [None]), (-6, 1, [1.0] * 7 + [float("nan")]), (-5, None, [float("-inf")] + [1.0] * 7), (900, 1, [1.0] * 4)]
    rng.shuffle(given_rows)
    frame = spark.createDataFrame([(*r, "c", 7) for r in given_rows + odd], "vec_id long, label int, embedding array<double>, code string, _vector int")
    books = vector_codes.learn(frame)
    got = vector_codes.encode(frame, books)
    assert got.columns == ["vec_id", "label", "embedding", "code", "error"]
    whole = sorted(((i, label, [int(np.floor(1024 * x)) for x in v]) for i, label, v in given_rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    expected, digest = brute_codes(whole)
    as_key = lambda r: [str(x) for x in r]
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in got.collect()), key=as_key) == sorted(expected, key=as_key)
    assert books.sha256() == digest
    assert books.dimension == 8 and len(books.decode(expected[0][2])) == 8
    # Large components take the integer way, too large ones are an error.
    large = spark.createDataFrame([(k, [float(rng.randrange(10**6)) for _ in range(4)]) for k in range(300)], "vec_id long, embedding array<double>")
    rows = [(r.vec_id, None, [int(x * 1024) for x in r.embedding]) for r in large.collect()]
    own = vector_codes.learn(large)
    expected, digest = brute_codes(rows)
    assert own.sha256() == digest
    assert sorted((r.vec_id, r.code, r.error) for r in vector_codes.encode(large, own).collect()) == [(i, c, e) for i, _, c, e in expected]
    with pytest.raises(Exception, match="too large for whole squared distances"):
        vector_codes.learn(spark.createDataFrame([(1, [1e12] * 4)], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.learn(spark.createDataFrame([(1, [1.0] * 5)], "vec_id long, embedding array<double>"))
    none = frame.limit(0)
    assert vector_codes.encode(none, vector_codes.learn(none)).count() == 0


def test_label_errors_are_sums_over_equal_labels(spark):
    got = QUERIES["op11_vector_codes"](spark, SF).join(spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label"), "vec_id").collect()
    sums = {}
    for r in got:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert got and all(r.label_error == sums[r.label] for r in got)


# 12


def test_tree_layouts_grow_and_paths_stay_compressed():
    for fan in (1, 4, 5, 16, 17, 48, 49, 256):
        keys = [b"path" + bytes([k]) + b"tail" for k in range(fan)]
        random.Random(fan).shuffle(keys)
        root = prefix_trie.build(keys)
        ((_, below),) = root.layout.items()
        if fan == 1:
            assert below.end == 9 and below.layout is None and below.row == 0
            continue
        # One edge to the fork, one to every leaf.
        assert below.end == 4
        sizes = {4: "Node4", 16: "Node16", 48: "Node48", 256: "Node256"}
        assert type(below.layout).__name__ == next(name for n, name in sizes.items() if fan <= n)
        items = list(below.layout.items())
        assert [b for b, _ in items] == sorted(k[4] for k in keys)
        assert all(below.layout.get(b) is child and child.key == keys[child.row] and child.end == 9 for b, child in items)
        assert below.layout.get(255) is None or fan == 256


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(max_size=6), min_size=1, max_size=60))
def test_tree_holds_every_key_once(found):
    keys = list(found)
    root, seen = prefix_trie.build(keys), []
    stack = [root]
    while stack:
        tree = stack.pop()
        if tree.row is not None:
            seen.append(tree.row)
            assert keys[tree.row] == tree.key[: tree.end]
        for byte, child in tree.layout.items() if tree.layout else ():
            assert child.key[: tree.end] == tree.key[: tree.end] and child.key[tree.end] == byte and child.end > tree.end
            stack.append(child)
    assert sorted(seen) == list(range(len(keys)))


def brute_trie(rows, rebuild=True):
    """rows: (conv_id, turn, role, text); the contract's nodes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    tie = lambda t: (t[0] is not None, t[0] or 0, hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest())
    own = {c: [t[1:] for t in sorted(turns, key=tie)] for c, turns in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        convs[c] = tuple(own.get(base, [])[:h] + turns[h:]) if rebuild else tuple(turns)
    members, ends = {}, {}
    for c, turns in convs.items():
        ends.setdefault(turns, []).append(c)
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        n_words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = (len(members[node]) - 1) * n_words + sum(saved[x] for x in below)
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children.get(node, [])), leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
        for node, m in members.items()
    )


TURNS = "conv_id long, turn long, role string, text string, node string, depth int, key string"


def rows_of(trie):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in trie.collect())


def rebuilt(frame):
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    return prefix_trie.rebuilt(prefix_trie.own_turns(frame), F.col("conv_id") - F.col("conv_id") % 20, shared, 3)


def test_trie_of_few_turns_over_many_runs(spark):
    rng = random.Random(3)
    texts = ["", " ", "one", "two words", "three  more\twords", None]
    rows = []
    for c in itertools.chain(range(-30, 260), [300, 305, 1000]):
        if c in (40, 41):
            continue
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8])):
            # A hot first turn, a hot conversation and chains of prefixes.
            text = "hot" if c % 3 else texts[min(5, int(rng.expovariate(1.2)))]
            rows.append((c, turn, ("user", "assistant")[turn % 2], text))
    rows += [(1, None, None, None), (1, None, "user", "null turn"), (7, 0, "user", "hot"), (7, 0, "user", "hot"), (None, 0, "user", "x"), (6, 1, "1:", "a"), (6, 1, "", "1:a")]
    rows += [(500, t, "user", f"turn {t}") for t in range(120)] + [(501, t, "user", f"turn {t}") for t in range(100)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "n", 1, "k") for r in rows], TURNS)
    expected = brute_trie(rows)
    turns = rebuilt(frame)
    for block, joined in ((1, 1), (6, 3), (100, 2), (prefix_trie.BLOCK, prefix_trie.JOINED)):
        assert rows_of(prefix_trie.trie(turns, block, joined)) == expected
    assert rows_of(prefix_trie.trie(prefix_trie.own_turns(frame), 9)) == brute_trie(rows, False)


def test_trie_of_the_given_table_and_of_none(spark):
    frame = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op12_prefix_trie"](spark, SF)) == brute_trie(rows)
    assert prefix_trie.trie(rebuilt(spark.createDataFrame([], TURNS))).count() == 0
    # Conversations whose base is absent may be left without turns: they end at the root.
    alone = [(c, 0, "user", "x") for c in range(21, 40)]
    got = rows_of(prefix_trie.trie(rebuilt(spark.createDataFrame([(*r, "n", 1, "k") for r in alone], TURNS))))
    assert got == brute_trie(alone) and got[0][1] == 0 and got[0][3] == 19


# 13


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=COUNTER)
    return lambda text: len(model.encode(text or ""))


def test_counts_of_whole_texts(spark, library):
    got = QUERIES["op13_token_counts"](spark, SF).collect()
    texts = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == [
        (int(i), len((t or "").encode()), library(t), library(t) > 4096) for i, t in sorted(texts.items())
    ]


def test_counts_do_not_depend_on_cuts_and_batches(spark, library):
    extra = [
        "<s> a </s><unk>", "▁x ▁ y", " lead", "trail ", "two  spaces   three", "a\r\nb \r c;\r d", "日本語のテキスト 英語 text", "é ́x", "no-space" * 40,
        "tab\tand nbsp   em", "a b c d e f g h i j", "🙂 🙂🙂 👨‍👩‍👧", "\0 null \0",
    ]
    rng = random.Random(5)
    extra += ["".join(rng.choices("ab ▁\n é日.", k=rng.randrange(60))) for _ in range(300)]
    rows = [(i, t, lang, "c", "m", "n", "r", "l", 1) for i, t, lang in ODD + [(None, t, None) for t in extra]]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_tokens", F.lit("x"))
    for longest, size in ((1, 1), (8, 64), (1 << 16, 1 << 20)):
        got = token_counts.count_tokens(docs, COUNTER, limit=20, longest=longest, size=size)
        assert set(got.columns) == {*docs.columns, "n_bytes", "over_limit"}
        for r in got.select("text", "n_bytes", "n_tokens", "over_limit").collect():
            assert r.n_tokens == library(r.text) and r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 20)
    assert token_counts.count_tokens(docs.limit(0), COUNTER).count() == 0


def test_cuts_and_batches_keep_every_text():
    text = "word " * 1000 + "end"
    parts = token_counts.cut(text, 64)
    assert " ".join(parts) == text and max(map(len, parts)) < 80 and len(parts) > 60
    assert token_counts.cut("x" * 500, 64) == ["x" * 500]
    texts = ["é" * 30, "", "b" * 10] * 50 + [text]
    seen = [""] * len(texts)
    for owners, parts in token_counts.batches(texts, 64, 200):
        assert sum(len(p.encode()) for p in parts[:-1]) < 200
        for k, part in zip(owners, parts):
            seen[k] += " " * bool(seen[k]) + part
    assert seen == texts


def test_counts_by_another_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(i, t) for i, t, _ in ODD], "doc_id long, text string")
    got = token_counts.count_tokens(docs, path).select("text", "n_tokens").collect()
    assert all(r.n_tokens == len(own.encode(r.text or "", add_special_tokens=False)) for r in got)
    with pytest.raises(ValueError, match="no library"):
        token_counts._lengths(".txt", b"")
