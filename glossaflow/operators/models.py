"""What models say of clips: judges, naturalness predictors and speaker encoders, each behind a hook.

A ``load`` function runs once per task and gives a function over a batch, so that a model is loaded once and fed in batches.
Prompts, parsing, clamping and similarities are expressions of the engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow.functions import answers
from glossaflow.functions.text import audio_type
from glossaflow.functions.vectors import cosine
from glossaflow.operators.ranking import bounded
from glossaflow.operators.variants import with_model

Load = Callable[[], Callable[[list], list]]


def judged_clips(clips: DataFrame, load: Load, dimensions: dict[str, str | tuple[str, str]], *, style: str = "standard", with_reference: bool = True) -> DataFrame:
    """Adds ``mos, mos_overall, comment, flaws, parse_ok`` to clips (``audio_path, source_text``) by a judge that listens.

    The judge is given ``audio_path, instructions, prompt`` of every clip and answers in free text; a null or unreadable answer
    is one without scores.
    """
    asked = F.struct("audio_path", F.lit(answers.system_prompt(dimensions, style, with_reference)).alias("instructions"), answers.user_prompt(F.col("source_text"), with_reference).alias("prompt"))
    said = with_model(clips.withColumn("_asked", asked), "_asked", "_said", "string", load)
    return said.withColumn("_j", answers.judged(F.col("_said"), dimensions)).select(*clips.columns, "_j.*")


def judge_batch(clips: DataFrame, dimensions: dict[str, str | tuple[str, str]], *, style: str = "standard", with_reference: bool = True, config: dict | None = None) -> DataFrame:
    """``line``: the requests of a hosted judge, one JSON object per clip (``utterance_id, source_text, audio_path``)."""
    prompt, mime = answers.user_prompt(F.col("source_text"), with_reference), audio_type(F.col("audio_path"))
    return clips.select(answers.batch_request(F.col("utterance_id"), prompt, mime, uri=F.col("audio_path"), instructions=answers.system_prompt(dimensions, style, with_reference), config=config).alias("line"))


def judge_replies(replies: DataFrame, dimensions: dict[str, str | tuple[str, str]]) -> DataFrame:
    """``utterance_id, mos, mos_overall, comment, flaws, parse_ok, usage`` of a hosted judge's replies (``line``: key and response)."""
    response = F.get_json_object("line", "$.response")
    read = replies.select(F.get_json_object("line", "$.key").alias("utterance_id"), answers.judged(answers.response_text(response), dimensions).alias("j"), answers.usage_metadata(response).alias("usage"))
    return read.select("utterance_id", "j.*", "usage")


def naturalness(clips: DataFrame, load: Load, score: str = "utmos") -> DataFrame:
    """Adds the score of a predictor that is given audio paths; null where it gives none or no number."""
    said = with_model(clips, "audio_path", score, "double", load)
    return said.withColumn(score, F.nanvl(F.col(score), F.lit(None).cast("double")))


def speaker_scores(clips: DataFrame, load: Load) -> DataFrame:
    """Adds ``speaker_similarity``: cosine of the clip's and its reference's embedding (``audio_path, reference_path``).

    Every reference is embedded once. The score is null without a reference or where the encoder gives no vector.
    """
    references = clips.select(F.col("reference_path").alias("_path")).filter("_path is not null").distinct()
    known = bounded(with_model(references, "_path", "_reference", "array<double>", load), derived=True)
    heard = with_model(clips, "audio_path", "_clip", "array<double>", load)
    joined = heard.join(known, heard["reference_path"] == known["_path"], "left")
    return joined.select(*clips.columns, cosine(F.col("_clip"), F.col("_reference")).alias("speaker_similarity"))
