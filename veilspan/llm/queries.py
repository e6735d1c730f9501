"""The queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import (
    chunk_dedup,
    gated_lm,
    language_spans,
    maxscore,
    packing,
    prefix_trie,
    quality_fm,
    sharding,
    suffix_decontamination,
    token_counts,
    vector_codes,
)
from veilspan.llm.chat_format import format_chats, parse, unescape
from veilspan.llm.minhash_forest import near_duplicates
from veilspan.llm.oracles import ORACLES as ORACLES
from veilspan.session import materialise

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
COUNTER = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = quality_fm.fold(4) == 2
    model = language_spans.learn(docs.where(~held_out))
    found = language_spans.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_dedup.remove_repeats(docs).select("doc_id", "text", "n_words", "n_removed", "removed_spans")


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return maxscore.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality_fm.fold(5) == 0
    labels = _table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").cast("int").alias("label"))
    scored = quality_fm.score(docs, quality_fm.learn(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return gated_lm.score(docs, quality_fm.fold(10) == 0)


def _packed(docs: DataFrame) -> DataFrame:
    pieces = materialise(packing.tokenise(docs, TOKENIZER), "pieces")
    digest = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place(digest).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = [
        spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), said)
        for k, role in enumerate(("user", "assistant"))
    ]
    chats = format_chats(rows.union(extra[0]).union(extra[1]))
    turns = parse(F.col("formatted"))
    source = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["length"]))), "")
    return chats.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(source, 256).alias("turns_sha256"), F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_decontamination.find_matches(docs, _table(spark, sf_dir, "benchmark"))
    items = F.array_compact(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(items), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vector_codes.learn(vectors)
    codes = materialise(vector_codes.encode(vectors, books).drop("embedding"), "codes")
    # One row a label; Spark's size check decides how it meets the codes.
    totals = materialise(codes.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "labels")
    found = codes.join(totals, F.col("label").eqNullSafe(F.col("l")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.own_turns(_table(spark, sf_dir, "conversations"))
    base = F.col("conv_id") - F.col("conv_id") % 20
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    return prefix_trie.trie(prefix_trie.rebuilt(turns, base, shared, 3))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, COUNTER).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_forest, op2_language_spans, op3_chunk_dedup, op4_maxscore, op5_quality_fm, op6_gated_lm, op7_packing,
        op8_sharding, op9_chat_format, op10_suffix_decontamination, op11_vector_codes, op12_prefix_trie, op13_token_counts,
    )
}
