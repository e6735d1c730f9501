"""From raw documents to packed training sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import chunk_dedup, language_spans, packing, suffix_decontamination
from veilspan.llm.minhash_forest import near_duplicates
from veilspan.llm.queries import TOKENIZER
from veilspan.session import materialise, remove_folders

#: A document goes if less than this share of its letters is in spans of its main language.
LEAST_SHARE = 0.5
#: A document goes if its letters speak less than this for its languages against an unknown one. Held-out rows of the given
#: tables have 1.86 at least; letters at random are below -2, scripts that no language uses at 0.
LEAST_EVIDENCE = 1.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without letters, without a language of half their letters, or in a language not learned, go.

    Learns from the rows' own text and lang. Null texts have no letters and go; a null lang is no reason to go.
    """
    found = language_spans.identify(docs, language_spans.learn(docs))
    keep = (F.col("lang_pred") != language_spans.UNKNOWN) & (F.col("lang_score") >= LEAST_SHARE) & (F.col("lang_evidence") >= LEAST_EVIDENCE)
    return found.where(keep).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    Rows are told apart by a number of their own and linked by their texts alone: two texts under one doc_id are two documents.
    Of a group, the row of least doc_id stays (null last), of several with that doc_id the one read first. Rows without
    words are linked with nothing, so each of them stays.
    """
    numbered = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(numbered.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    # Ids and groups only; the texts meet the rows that stay.
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    kept = numbered.select("_row", "doc_id").join(groups, "_row").groupBy("component_id").agg(F.min(order).getField("_row").alias("_row"))
    return numbered.join(kept, "_row", "left_semi").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; a document of which nothing is left goes."""
    cut = chunk_dedup.remove_repeats(docs).where("n_removed = 0 or n_removed < n_words")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return suffix_decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1,024 tokens; ids as a checksum."""
    pieces = materialise(packing.tokenise(docs, TOKENIZER), "pieces")
    placed = packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", keep_one_of_each_group),
    ("repeated_passages", cut_repeated_passages),
    ("benchmark", remove_benchmark),
    ("packing", pack_sequences),
]

#: SQL has no form of the language model, the rolling hash or the packing; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's texts are removed from the shared folder when the next one's are written."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        folders: list[str] = []
        docs = materialise(stage(spark, docs, sf_dir), name, folders=folders)
        remove_folders(spark, written)
        written = folders
    # The last stage writes its pieces before it returns.
    packed = STAGES[-1][1](spark, docs, sf_dir)
    remove_folders(spark, written)
    return packed
