"""Keep findings that a table of verdicts (or a classifier) confirms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan import schemas
from veilspan.functions.text import strip

# ---------------------------------------------------------------------------
# The score gate and the labelled examples.
# ---------------------------------------------------------------------------
MIN_SCORE = 0.8
ATTEMPTS = 3
SEED_VERDICTS = (
    ("EMAIL_ADDRESS", "john.doe@example.com", "True"),
    ("PHONE_NUMBER", "123-abc-456", "False"),
    ("PASSWORD", "password123", "True"),
    ("PASSWORD", 'leftFreq":20.0', "False"),
    ("PERSON", "at", "False"),
    ("PHONE_NUMBER", 'frequency":117.11509134647333', "False"),
    ("PERSON", 'colorId":4', "False"),
    ("SSH_KEY", "ssh-rsa AAAAB3NzaC...", "True"),
    ("AADHAAR_NUMBER", "1234 5678 9012", "True"),
    ("PAN_NUMBER", "ABCDE1234F", "True"),
    ("API_KEY", "sk-xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx", "True"),
    ("API_KEY", "my_variable_key", "False"),
)
# ---------------------------------------------------------------------------

VALUE_KEY = ["entity", "value"]


def seed_verdicts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEED_VERDICTS), schemas.VERDICT)


def is_true(response: Column) -> Column:
    """Exactly 'true' after stripping and lower-casing; everything else, null too, is false."""
    return F.coalesce(F.lower(strip(response)) == "true", F.lit(False))


def distinct_values(findings: DataFrame) -> DataFrame:
    """Each value to verify once, however often it occurs (counted map-side first)."""
    return findings.groupBy(*VALUE_KEY).agg(F.count(F.lit(1)).alias("n_findings"))


def verdict_table(verdicts: DataFrame) -> DataFrame:
    """One verdict per (entity, value); conflicting responses count as false, a null response is none."""
    return verdicts.where("response is not null").groupBy(*VALUE_KEY).agg(F.bool_and(is_true(F.col("response"))).alias("verdict"))


def join_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Add ``verdict`` (null when there is none) to each finding.

    Values are mostly distinct, so verdicts are not copied for salts; where a value is hot, the adaptive skew join divides its
    findings. There is no broadcast hint: Spark broadcasts verdicts only when its own size check allows it.
    """
    return findings.join(verdict_table(verdicts), VALUE_KEY, "left")


def confirm(
    findings: DataFrame,
    verdicts: DataFrame,
    on_missing: str = "drop",
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """Findings with a true verdict and a sufficient score.

    ``on_missing='drop'`` treats an unverified finding as not sensitive, so its value
    stays in the text; 'keep' is the safer choice when verdicts may be incomplete.
    """
    if on_missing not in ("drop", "keep"):
        raise ValueError(f"on_missing must be 'drop' or 'keep', not {on_missing!r}")
    joined = join_verdicts(findings, verdicts)
    accepted = F.coalesce(F.col("verdict"), F.lit(on_missing == "keep"))
    return joined.where(accepted & (F.col("score") >= min_score)).drop("verdict")


def classify(
    values: DataFrame,
    classifier: Callable[[pd.DataFrame], pd.Series],
    attempts: int = ATTEMPTS,
) -> DataFrame:
    """Verdict rows from a user's classifier over distinct values, in Arrow batches.

    ``classifier`` gets a frame with ``entity`` and ``value`` and returns one response per row. If a batch fails, its values
    are asked one by one, each up to ``attempts`` times; a value that still fails has a null response, which is no verdict.
    """

    def alone(row: pd.DataFrame) -> object:
        for _ in range(attempts):
            try:
                return list(classifier(row))[0]
            except Exception:
                continue
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                response = list(classifier(batch))
                if len(response) != len(batch):
                    raise ValueError("one response per row is needed")
            except Exception:
                response = [alone(batch.iloc[k : k + 1].reset_index(drop=True)) for k in range(len(batch))]
            yield batch.assign(response=pd.Series(response, dtype=object, index=batch.index))

    return values.select(*VALUE_KEY).mapInPandas(run, schemas.VERDICT)
