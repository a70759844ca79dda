"""Grouped summaries: every grouping in one pass over the rows (Expand, partial and final aggregation, one shuffle)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decimal places carried through a mean, so that it does not depend on the order of its rows.
PLACES = 12

ERROR_GROUPINGS = (
    ("overall", ()), ("by_system", ("tts_system_id",)), ("by_method", ("preprocessing_method",)),
    ("by_system_method", ("tts_system_id", "preprocessing_method")), ("by_scenario", ("scenario",)),
    ("by_scenario_method", ("scenario", "preprocessing_method")),
)
SCORE_GROUPINGS = (
    ("overall", ()), ("by_system", ("tts_system_id",)), ("by_system_method", ("tts_system_id", "preprocessing_method")), ("by_scenario", ("scenario",)),
)


def exact_mean(value: Column) -> Column:
    """Mean over the non-null values, summed as decimals: the same in any order and partitioning."""
    total = F.sum(value.cast(f"decimal(28,{PLACES})"))
    return total.cast("double") / F.count(value)


def grouped(df: DataFrame, groupings: Sequence[tuple[str, Sequence[str]]], measures: Iterable[Column]) -> DataFrame:
    """``grouping, key`` and the measures, for every grouping in one GROUPING SETS pass.

    A null key counts as the group 'None'; keys of several columns are joined by '::'; the overall key is 'all'.
    """
    keys = list(dict.fromkeys(c for _, cs in groupings for c in cs))
    named = df.withColumns({f"_k{i}": F.coalesce(F.col(k).cast("string"), F.lit("None")) for i, k in enumerate(keys)})
    at = {k: F.col(f"_k{i}") for i, k in enumerate(keys)}
    sets = [[at[c] for c in cs] for _, cs in groupings]
    out = named.groupingSets(sets, *at.values()).agg(F.grouping_id().alias("_gid"), *measures)
    ids = {sum(0 if k in cs else 1 << (len(keys) - 1 - i) for i, k in enumerate(keys)): (name, cs) for name, cs in groupings}
    name, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for gid, (label, cs) in ids.items():
        name = F.when(F.col("_gid") == gid, F.lit(label)).otherwise(name)
        key = F.when(F.col("_gid") == gid, F.concat_ws("::", *[at[c] for c in cs]) if cs else F.lit("all")).otherwise(key)
    measured = [c for c in out.columns if not c.startswith("_k") and c != "_gid"]
    return out.select(name.alias("grouping"), key.alias("key"), *measured)


def error_summary(scores: DataFrame) -> DataFrame:
    """Counts and macro means of the four error rates over the six groupings."""
    rates = ("wer", "cer", "wer_orthographic", "cer_orthographic")
    return grouped(scores, ERROR_GROUPINGS, [F.count("*").alias("count"), *[exact_mean(F.col(r)).alias(f"mean_{r}") for r in rates]])


def mos_summary(scores: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Counts, scored rows, mean overall and per-dimension means over the rows that have an overall score."""
    has = F.col("mos_overall").isNotNull()
    dims = [exact_mean(F.when(has, F.col("mos")[d])).alias(f"mean_{d}") for d in dimensions]
    return grouped(scores, SCORE_GROUPINGS, [F.count("*").alias("count"), F.count("mos_overall").alias("scored"), exact_mean(F.col("mos_overall")).alias("mean_overall"), *dims])


def score_summary(scores: DataFrame, score: str) -> DataFrame:
    """Count, scored rows, mean, least and greatest of a nullable score (predicted MOS, speaker similarity)."""
    s = F.col(score)
    return grouped(scores, SCORE_GROUPINGS, [F.count("*").alias("count"), F.count(s).alias("scored"), exact_mean(s).alias("mean"), F.min(s).alias("min"), F.max(s).alias("max")])


def qc_summary(records: DataFrame) -> DataFrame:
    """Clips, missing clips, clips with issues, sample rates and durations, overall and by system."""
    measures = [
        F.count("*").alias("count"),
        F.count_if(F.col("issues") == F.array(F.lit("missing"))).alias("missing"),
        F.count_if(F.size("issues") > 0).alias("with_issues"),
        F.array_join(F.array_sort(F.collect_set("sample_rate")), ",").alias("sample_rates"),
        exact_mean(F.col("duration_s")).alias("mean_duration_s"), F.min("duration_s").alias("min_duration_s"), F.max("duration_s").alias("max_duration_s"),
    ]
    return grouped(records, (("overall", ()), ("by_system", ("tts_system_id",))), measures)


def presence_counts(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of the manifest, those whose clip exists and those it lacks, overall, by system and by family.

    Counters that stay at zero are null, as a counter without events has no entry.
    """
    there = existing.select("audio_path").distinct().withColumn("_there", F.lit(True))
    joined = manifest.join(there, "audio_path", "left")
    measures = [F.count("*").alias("rows"), F.nullif(F.count("_there"), F.lit(0)).alias("existing"), F.nullif(F.count("*") - F.count("_there"), F.lit(0)).alias("missing")]
    return grouped(joined, (("overall", ()), ("by_system", ("tts_system_id",)), ("by_family", ("tts_family",))), measures)


def python_rounded(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """Columns of a (small) summary rounded as Python rounds: correctly on the binary value."""
    from collections.abc import Iterator

    import pandas as pd

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for c, n in places.items():
                frame[c] = [None if v is None or v != v else round(v, n) for v in frame[c]]
            yield frame

    return df.mapInPandas(apply, df.schema)


def latest(df: DataFrame, keys: Sequence[str], at: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``keys`` and ``columns`` (all by default) of the row of each key with the latest ``at``, nulls first.

    One shuffle, map-side combined, no window. Name the columns that are needed: only they are read and shuffled. Of rows
    with the same ``at`` any may stay.
    """
    kept = [c for c in (df.columns if columns is None else columns) if c not in keys]
    if not kept:
        return df.select(*keys).distinct()
    when = F.coalesce(F.col(at), F.lit("0001-01-01").cast(df.schema[at].dataType))
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*kept), when).alias("_row"))
    return packed.select(*keys, "_row.*") if columns is not None else packed.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])
