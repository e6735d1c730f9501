"""Languages of the spans of a text.

A word is a run of letters of one script; where a script puts no spaces between words, a few of its characters.
Learned: counts of character trigrams and of words per language, hashed to 2**16 places each, and of letters per script. A
word's script (by code point ranges) leaves as candidates the languages that use it; each candidate scores the sum of its
log probability ratios against the mean of all. A Viterbi pass over a text's words, with a penalty for every switch,
labels spans; the language with most letters is the text's. Texts are labelled side by side, one word of each at a time.

The model's size is fixed by the hash places and the number of languages; it is summed by Spark from sparse
counts of each task and broadcast.

A text's evidence is the log probability ratio of its words under their languages to an unknown language, per letter; words in a
script that their language does not use give none.

Defined cases: null texts and texts without a letter are ``und`` with score and evidence 0 and no spans; with no labelled text to learn
from, all are ``und``. A language null in training is not learned. Other columns are kept; columns named as the added ones
are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.llm.text import blocks, mix, utf8

PLACES = 1 << 16
SWITCH = 12.0
SHARPNESS = 0.7
FAR = -30.0
UNKNOWN = "und"

# First code points of script ranges (Unicode blocks); 0 stands for Latin and everything not named.
SCRIPTS = (
    (0x0000, 0), (0x0370, 1), (0x0400, 2), (0x0530, 3), (0x0590, 4), (0x0600, 5), (0x0700, 0), (0x0900, 6), (0x0980, 7),
    (0x0A00, 8), (0x0A80, 9), (0x0B00, 10), (0x0B80, 11), (0x0C00, 12), (0x0C80, 13), (0x0D00, 14), (0x0D80, 15), (0x0E00, 16),
    (0x0E80, 17), (0x0F00, 18), (0x1000, 19), (0x10A0, 20), (0x1100, 21), (0x1200, 22), (0x13A0, 0), (0x1780, 23), (0x1800, 24),
    (0x18B0, 0), (0x1C80, 2), (0x1C90, 20), (0x1CC0, 0), (0x1F00, 1), (0x2000, 0), (0x2E80, 25), (0x3040, 26), (0x3100, 25),
    (0x3130, 21), (0x3190, 25), (0x31F0, 26), (0x3200, 25), (0xA000, 0), (0xA640, 2), (0xA6A0, 0), (0xAC00, 21), (0xD7B0, 21),
    (0xD800, 0), (0xF900, 25), (0xFB00, 0), (0xFB1D, 4), (0xFB50, 5), (0xFE00, 0), (0xFE70, 5), (0xFF00, 0), (0xFF66, 26),
    (0xFFA0, 21), (0xFFE0, 0), (0x20000, 25), (0x32000, 0),
)
N_SCRIPTS = 27
# The scripts above that put no spaces between words (Thai, Lao, Tibetan, Myanmar, Khmer, Han, Kana).
_SPACELESS = np.isin(np.arange(N_SCRIPTS), [16, 17, 18, 19, 23, 25, 26])
#: Places of a word in these.
UNSPACED = 4
_FIRST = np.array([a for a, _ in SCRIPTS])
_SCRIPT = np.array([b for _, b in SCRIPTS], np.int8)
ADDED = T.StructType(
    [
        T.StructField("lang_evidence", T.DoubleType()),
        T.StructField("lang_pred", T.StringType()),
        T.StructField("lang_score", T.DoubleType()),
        T.StructField(
            "lang_spans",
            T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])),
        ),
    ]
)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the first 0x30000 code points: lower case, is a letter, belongs to a word (letters and their marks)."""
    n = 0x30000
    kinds = [unicodedata.category(chr(c)) for c in range(n)]
    lower = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(n)], np.uint32)
    letter = np.array([k[0] == "L" for k in kinds])
    return lower, letter, letter | np.array([k[0] == "M" for k in kinds])


def word_bounds(codes: np.ndarray, is_letter: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end places of words: runs of letters and their marks, cut where the script changes and, in scripts that put no
    spaces between words, every ``UNSPACED`` places. The first and the last code are no part of a word."""
    edge = np.diff(is_word.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    if not len(starts):
        return starts, ends
    p = np.flatnonzero(is_letter).astype(np.int32)
    if not len(p):
        return starts, ends
    script = _SCRIPT[np.searchsorted(_FIRST, codes[p], "right") - 1]
    run = np.searchsorted(starts, p, "right").astype(np.int32) - 1
    same = np.append(False, run[1:] == run[:-1])
    # A mark belongs to the letter before it, so only letters are compared.
    changed = same & np.append(False, script[1:] != script[:-1])
    long = _SPACELESS[script] & same & ((p - starts[run]) % UNSPACED == 0)
    more = p[changed | long]
    if len(more):
        starts = np.sort(np.concatenate((starts, more)))
        ends = np.minimum(np.append(starts[1:], len(codes)), ends[np.searchsorted(ends, starts, "right")])
    return starts, ends


class Words:
    """The words of a block of texts."""

    def __init__(self, texts: list[str]) -> None:
        lower, letter, member = _characters()
        codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
        inside = np.minimum(codes, len(lower) - 1)
        code = np.where(codes < len(lower), lower[inside], codes)
        is_letter = letter[inside]
        is_word = member[inside]
        begin = np.append(np.cumsum([1] + [len(t) + 1 for t in texts[:-1]]), len(codes)) if texts else np.array([1, 1])
        starts, ends = word_bounds(codes, is_letter, is_word)
        letters = np.concatenate(([0], np.cumsum(is_letter)))
        some = letters[ends] > letters[starts]
        self.starts, self.ends = starts[some], ends[some]
        self.letters = (letters[ends] - letters[starts])[some]
        self.begin, self.texts = begin, len(texts)
        self.first = np.searchsorted(self.starts, begin)
        x = np.where(is_word, code, 1).astype(np.uint64)
        self.place = np.flatnonzero(is_word)
        p = self.place
        gram = mix((mix(x[p - 1] * np.uint64(3) + np.uint64(1)) + x[p]) * np.uint64(5) + x[p + 1])
        self.gram = (gram % np.uint64(PLACES)).astype(np.int64)
        # Characters of words with a letter; each with its word's number.
        self.of = np.searchsorted(self.starts, p, "right") - 1
        good = (self.of >= 0) & (p < self.ends[self.of]) if len(self.starts) else np.zeros(len(p), bool)
        self.place, self.gram, self.of = p[good], self.gram[good], self.of[good]
        self.head = np.searchsorted(self.of, np.arange(len(self.starts)))
        weight = mix(x[self.place] + (self.place - self.starts[self.of]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        whole = np.add.reduceat(weight, self.head) if len(self.head) else np.zeros(0, np.uint64)
        self.word = PLACES + (mix(whole) % np.uint64(PLACES)).astype(np.int64)
        first_letter = codes[self.starts]
        self.script = _SCRIPT[np.searchsorted(_FIRST, first_letter, "right") - 1]


def _texts(column: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, int, Words]]:
    _, offsets, _ = utf8(column)
    for low, high in blocks(offsets, size):
        yield low, high, Words([t or "" for t in column.slice(low, high - low).to_pylist()])


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        """``counts``: languages by trigram places, word places and scripts."""
        self.languages = languages
        tables, common = [], []
        for low in (0, PLACES):
            part = counts[:, low : low + PLACES] + 0.05
            logs = np.log(part / part.sum(axis=1, keepdims=True))
            tables.append(logs - logs.mean(axis=0))
            common.append(logs.mean(axis=0) + np.log(PLACES))
        self.table = np.concatenate(tables, axis=1).T.astype(np.float32).copy()
        # What the ratios to the mean of all languages lack to the ratio to an unknown language, for which all places are alike.
        self.common = np.concatenate(common).astype(np.float32)
        letters = counts[:, 2 * PLACES :]
        used = letters >= 0.01 * np.maximum(1, letters.sum(axis=1, keepdims=True))
        self.candidates = np.where(used | ~used.any(axis=0), 0.0, FAR).T.astype(np.float32).copy()
        self.used = used.T.copy()

    def scores(self, words: Words) -> np.ndarray:
        total = np.add.reduceat(self.table[words.gram], words.head, axis=0) if len(words.head) else np.zeros((0, len(self.languages)), np.float32)
        return SHARPNESS * (total + self.table[words.word]) + self.candidates[words.script]

    def evidence(self, words: Words, labels: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Log probability ratio of every word under its language to an unknown one; 0 for scripts the language does not use."""
        if not len(labels):
            return np.zeros(0)
        ratio = scores[np.arange(len(labels)), labels] / SHARPNESS + np.add.reduceat(self.common[words.gram], words.head) + self.common[words.word]
        return np.where(self.used[words.script, labels], ratio, 0.0)

    def label(self, words: Words, scores: np.ndarray) -> np.ndarray:
        """The language number of every word, by the best path with switches."""
        counts = np.diff(words.first)
        order = np.argsort(-counts, kind="stable")
        active = np.searchsorted(-counts[order], -np.arange(counts.max(initial=0)), "left")
        first = words.first[:-1][order]
        n = len(self.languages)
        came = np.zeros((len(scores), n), np.int8 if n < 128 else np.int32)
        best = np.zeros((len(order), n), np.float32)
        own = np.arange(n)
        for t, k in enumerate(active):
            at = first[:k] + t
            if t:
                top = best[:k].argmax(axis=1)
                jump = best[np.arange(k), top] - SWITCH
                stay = best[:k] >= jump[:, None]
                came[at] = np.where(stay, own, top[:, None])
                best[:k] = np.where(stay, best[:k], jump[:, None])
            best[:k] += scores[at]
        labels = np.zeros(len(scores), np.int64)
        state = best.argmax(axis=1)
        for t in range(len(active) - 1, -1, -1):
            k = active[t]
            at = first[:k] + t
            labels[at] = state[:k]
            state[:k] = came[at, state[:k]] if t else state[:k]
        return labels


def learn(docs: DataFrame) -> Model | None:
    """A model from all rows of ``docs`` (text, lang) that have both."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for low, high, words in _texts(batch.column("text")):
                own = np.repeat(np.arange(high - low), np.diff(words.first))
                for lang in set(langs[low:high]):
                    mine = (langs[low:high] == lang)[own]
                    counts = total.setdefault(lang, np.zeros(2 * PLACES + N_SCRIPTS, np.int64))
                    counts[:PLACES] += np.bincount(words.gram[mine[words.of]], minlength=PLACES)
                    counts[PLACES : 2 * PLACES] += np.bincount(words.word[mine] - PLACES, minlength=PLACES)
                    counts[2 * PLACES :] += np.bincount(words.script[mine], words.letters[mine], N_SCRIPTS).astype(np.int64)
        for lang, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])], ["lang", "place", "n"]
            )

    known = docs.where("text is not null and lang is not null").select("text", "lang")
    # At most languages x (2 x 2**16 + 27) rows.
    found = known.mapInArrow(run, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    if not languages:
        return None
    counts = np.zeros((len(languages), 2 * PLACES + N_SCRIPTS))
    row = np.searchsorted(np.array(languages), np.array(found.column("lang").to_pylist(), str))
    counts[row, found.column("place").to_numpy()] = found.column("n").to_numpy()
    return Model(languages, counts)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (text, ...) with lang_evidence (log probability ratio to an unknown language, per letter), lang_pred,
    lang_score (share of the letters in its spans) and lang_spans (characters).
    """
    docs = docs.drop(*ADDED.names)
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            evidence, langs, scores, spans = [], [], [], []
            for low, high, words in _texts(batch.column(names.index("text"))):
                if model:
                    by_word = model.scores(words)
                    labels = model.label(words, by_word)
                    ratio = model.evidence(words, labels, by_word)
                for i in range(high - low):
                    a, b = words.first[i], words.first[i + 1]
                    if model is None or a == b:
                        evidence.append(0.0), langs.append(UNKNOWN), scores.append(0.0), spans.append([])
                        continue
                    weight = np.bincount(labels[a:b], words.letters[a:b], len(model.languages))
                    langs.append(model.languages[int(weight.argmax())])
                    scores.append(float(weight.max() / weight.sum()))
                    evidence.append(float(ratio[a:b].sum() / weight.sum()))
                    cut = np.concatenate(([a], a + 1 + np.flatnonzero(np.diff(labels[a:b])), [b]))
                    spans.append([
                        {"start": int(words.starts[x] - words.begin[i]), "end": int(words.ends[y - 1] - words.begin[i]), "lang": model.languages[int(labels[x])]}
                        for x, y in zip(cut[:-1], cut[1:])
                    ])
            added = [pa.array(evidence, pa.float64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, _SPANS)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), *added], [*names, *ADDED.names])

    return docs.mapInArrow(run, T.StructType(list(docs.schema) + list(ADDED)))
