"""The scoring pipeline: transcripts to error rates to summaries; shared by batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow.functions.distance import char_rate, word_rate
from glossaflow.functions.rewrite import scoring_form
from glossaflow.functions.text import orthographic


def with_hypotheses(jobs: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Jobs with their hypothesis and ``status``: scored, missing (no transcript) or empty."""
    joined = jobs.join(transcripts.select(F.col("path").alias("transcript_path"), "hypothesis"), "transcript_path", "left")
    blank = F.trim(F.regexp_replace("hypothesis", r"[\s\x1c-\x1f\p{Z}]+", " ")) == ""
    return joined.withColumn("status", F.when(F.col("hypothesis").isNull(), "missing").when(blank, "empty").otherwise("scored"))


def orthographic_rates(df: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Adds ``wer_orthographic, cer_orthographic``; a null hypothesis counts as an empty text."""
    normal = df.withColumns({"_r": orthographic(F.coalesce(reference, F.lit(""))), "_h": orthographic(F.coalesce(hypothesis, F.lit("")))})
    return normal.withColumns({"wer_orthographic": word_rate(F.col("_r"), F.col("_h")), "cer_orthographic": char_rate(F.col("_r"), F.col("_h"))}).drop("_r", "_h")


def policy_rates(df: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis", language: str | None = "language") -> DataFrame:
    """Adds ``wer, cer`` of the scoring forms of both sides."""
    lang = F.col(language) if language else None
    formed = df.withColumns({"_r": scoring_form(F.coalesce(reference, F.lit("")), lang), "_h": scoring_form(F.coalesce(hypothesis, F.lit("")), lang)})
    return formed.withColumns({"wer": word_rate(F.col("_r"), F.col("_h")), "cer": char_rate(F.col("_r"), F.col("_h"))}).drop("_r", "_h")


def error_rates(df: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis", language: str | None = "language") -> DataFrame:
    """All four rates."""
    return orthographic_rates(policy_rates(df, reference, hypothesis, language), reference, hypothesis)
