"""Text variants of sentences (raw, regex, llm) and the hooks by which models come in."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glossaflow.functions.answers import checked_answer
from glossaflow.functions.rewrite import verbalised
from glossaflow.functions.text import is_greek

METHODS = ("raw", "regex", "llm")


def with_model(df: DataFrame, column: str, result: str, kind: str, load: Callable[[], Callable[[list], list]]) -> DataFrame:
    """Adds ``result`` of type ``kind``: what a model says to ``column``, batch by batch.

    ``load`` runs once per task and gives a function from a list of values to a list of results; it is the hook for
    rewriting models, judges, naturalness predictors and speaker encoders alike. Only ``column`` travels to Python.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for values in batches:
            rows = values.to_dict("records") if isinstance(values, pd.DataFrame) else values.tolist()
            yield pd.Series(model(rows), index=values.index, dtype=object)

    structured = isinstance(df.schema[column].dataType, StructType)
    run.__annotations__ = {"batches": Iterator[pd.DataFrame] if structured else Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(result, F.pandas_udf(run, kind)(F.col(column)))


def variant(sentences: DataFrame, method: str, *, off: Sequence[str] = (), load: Callable[[], Callable[[list], list]] | None = None) -> DataFrame:
    """Adds ``method, original_text, normalized_text, normalization_warnings, normalizer``.

    Texts that are not Greek pass through unchanged, whatever the method; no model sees them. An answer of a model is
    cleaned and checked, and any warning brings the original back. An unknown method is refused.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    named = {"raw": "identity", "regex": "regex", "llm": "llm"}[method]
    greek = is_greek(F.col("language")) if method != "raw" else F.lit(True)
    base = sentences.withColumns({"method": F.lit(method), "original_text": F.col("text"), "normalizer": F.when(greek, named).otherwise("identity_non_greek")})
    none = F.lit(None).cast("array<string>")
    if method == "raw":
        return base.withColumns({"normalized_text": F.col("text"), "normalization_warnings": none})
    if method == "regex":
        return base.withColumns({"normalized_text": F.when(greek, verbalised(F.col("text"), tuple(off))).otherwise(F.col("text")), "normalization_warnings": none})
    if load is None:
        raise ValueError("the llm method needs a model")
    asked = with_model(base.withColumn("_ask", F.when(greek, F.col("text"))), "_ask", "_said", "string", _skipping_nulls(load))
    checked = checked_answer(F.col("text"), F.col("_said"))
    done = asked.withColumn("_c", F.when(F.col("_ask").isNotNull(), checked))
    return done.withColumns({"normalized_text": F.coalesce("_c.text", "text"), "normalization_warnings": F.when(F.size("_c.warnings") > 0, F.col("_c.warnings"))}).drop("_ask", "_said", "_c")


def _skipping_nulls(load: Callable[[], Callable[[list], list]]) -> Callable[[], Callable[[list], list]]:
    def loaded() -> Callable[[list], list]:
        model = load()

        def run(values: list) -> list:
            asked = [v for v in values if v is not None]
            said = iter(model(asked) if asked else [])
            return [None if v is None else next(said) for v in values]

        return run

    return loaded


def variant_report(variants: DataFrame) -> DataFrame:
    """Sentences and sentences with warnings by data set, method and normaliser."""
    return variants.groupBy("dataset_id", "method", "normalizer").agg(F.count("*").alias("sentences"), F.count_if(F.size("normalization_warnings") > 0).alias("sentences_with_warnings"))
