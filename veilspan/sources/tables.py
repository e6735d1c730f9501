"""Text columns of several tables as one table of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_documents(df: DataFrame, source: str, key: Column, text: Column) -> DataFrame:
    return df.select(F.lit(source).alias("source"), key.cast("string").alias("doc_key"), text.alias("text"))


def union_documents(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def only_language(df: DataFrame, language: str = "en", column: str = "lang") -> DataFrame:
    """Optional row filter; by default every row is scanned as the recognizers' language."""
    return df.where(F.col(column) == language)
