"""Verdicts kept from run to run, so that only new values are asked.

The store is a table in the shared folder, bucketed by (entity, value). What a run found is counted down to distinct values; an
anti-join leaves those that the store does not know, the classifier is asked for them, and its answers are appended. Both
joins and the reduction of the store to one verdict a value use its buckets: the store itself is never shuffled,
however large it has grown.

A value without an answer is not stored: it is asked again the next time. Two runs that ask the same value leave two answers,
which count as any others that differ (false wins). Findings are the only rows that move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.operators.verify import MIN_SCORE, VALUE_KEY, classify, confirm, distinct_values
from veilspan.session import materialise

BUCKETS = 64


class VerdictStore:
    """The store under ``root``; ``buckets`` belongs to its place, another number is another store."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark = spark
        self.path = f"{root.rstrip('/')}/verdicts-{buckets}"
        self.name = f"verdicts_{hashlib.md5(self.path.encode()).hexdigest()}"
        # The files carry their bucket's number: a session that does not know the table yet only has to name it.
        place = self.path.replace("'", "\\'")
        spark.sql(
            f"create table if not exists {self.name} (entity string, value string, response string) using parquet "
            f"clustered by (entity, value) into {buckets} buckets location '{place}'"
        )

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def unknown(self, values: DataFrame) -> DataFrame:
        """The distinct values that have no verdict yet."""
        return values.select(*VALUE_KEY).join(self.table(), VALUE_KEY, "left_anti")

    def add(self, answers: DataFrame) -> None:
        """Append answers (entity, value, response); rows without a response are none."""
        answers.where("response is not null").select(*VALUE_KEY, "response").write.insertInto(self.name)

    def ask(self, findings: DataFrame, classifier: Callable[[pd.DataFrame], pd.Series], folders: list[str] | None = None) -> DataFrame:
        """Ask ``classifier`` for the values of ``findings`` that are new, keep its answers, and return them."""
        answers = materialise(classify(self.unknown(distinct_values(findings)), classifier), "answers", folders=folders)
        self.add(answers)
        return answers

    def confirm(self, findings: DataFrame, on_missing: str = "drop", min_score: float = MIN_SCORE) -> DataFrame:
        """Findings that the store confirms."""
        return confirm(findings, self.table(), on_missing, min_score)
