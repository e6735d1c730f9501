"""Token counts of whole texts by a public tokenizer, in batches of equal bytes.

Texts go to the library in Arrow batches that are cut anew by bytes, so that one call has about ``BATCH`` bytes whatever the
rows hold; only lengths come back. A text above ``LONGEST`` characters is cut first. With a sentencepiece model a cut is safe
at a space behind something other than white space, if no piece of the vocabulary holds its space mark behind another character:
then no merge spans the border, and the mark that the library puts before a text stands for the space that was cut out. Both
are tested when the model is loaded; where they do not hold, and in a text without such a space, nothing is cut. Texts for
a ``.json`` tokenizer are never cut: its splitting rules are not known here.

Defined cases: null texts are empty and have 0 tokens and 0 bytes. Rows are independent: null or repeated ids change
nothing. Columns named n_bytes, n_tokens and over_limit are replaced, all others stay.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 1 << 20
LONGEST = 1 << 16
LIMIT = 4096

#: The library's mark for a space.
_MARK = "▁"
_BORDER = re.compile(f"(?<=[^ {_MARK}]) (?=[^ {_MARK}])")


@lru_cache(maxsize=2)
def _lengths(kind: str, definition: bytes) -> tuple[Callable[[list[str]], list[int]], bool]:
    """Counts of a list of texts, and whether texts may be cut; loaded once a worker."""
    if kind == ".model":
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=definition)

        def count(texts: list[str]) -> list[int]:
            return [len(ids) for ids in model.encode(texts, num_threads=1)]

        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        inside = any(_MARK in piece.lstrip(_MARK) for piece in pieces)
        whole = model.encode("a a")
        return count, not inside and whole == model.encode("a") * 2
    if kind == ".json":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(definition.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(code) for code in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], False
    raise ValueError(f"no library for a tokenizer file {kind!r}")


def cut(text: str, longest: int = LONGEST) -> list[str]:
    """``text`` in parts of ``longest`` characters or a little more; the space at every cut is left out."""
    parts, start = [], 0
    while len(text) - start > longest:
        border = _BORDER.search(text, start + longest)
        if border is None:
            break
        parts.append(text[start : border.start()])
        start = border.end()
    parts.append(text[start:])
    return parts


def batches(texts: list[str], longest: int, size: int) -> Iterator[tuple[list[int], list[str]]]:
    """Parts of the texts with their texts' numbers, about ``size`` bytes at a time; empty texts have no part."""
    owners: list[int] = []
    parts: list[str] = []
    held = 0
    for number, text in enumerate(texts):
        for part in cut(text, longest) if len(text) > longest else [text]:
            if part:
                owners.append(number)
                parts.append(part)
                # Bytes of a part: exact for ASCII, which the string knows of itself.
                held += len(part) if part.isascii() else len(part.encode())
                if held >= size:
                    yield owners, parts
                    owners, parts, held = [], [], 0
    if parts:
        yield owners, parts


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, longest: int = LONGEST, size: int = BATCH) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit; ``tokenizer``: a .model or .json file that the driver can read."""
    kind = os.path.splitext(tokenizer)[1]
    with open(tokenizer, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count, may_cut = _lengths(kind, sent.value)
        for column in columns:
            total = np.zeros(len(column), np.int64)
            for owners, parts in batches(column.to_pylist(), longest if may_cut else sys.maxsize, size):
                np.add.at(total, owners, count(parts))
            yield pa.array(total)

    lengths = F.arrow_udf(run, "long")
    counted = docs.withColumn("n_tokens", lengths(F.coalesce("text", F.lit(""))))
    return counted.withColumns(
        {"n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "over_limit": F.col("n_tokens") > limit}
    )
