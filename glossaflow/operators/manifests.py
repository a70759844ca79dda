"""Job manifests: sentence x method x system expansion, transcription jobs, selection, handoff, reference resolution."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossaflow.functions.text import collapse_spaces, fallback, path_of, safe_id, word_count
from glossaflow.operators.checks import missing_variants
from glossaflow.operators.ranking import bounded, running_index

def enabled_systems(systems: DataFrame) -> DataFrame:
    """Systems that are not switched off; a missing switch is on."""
    return systems.filter(F.coalesce("enabled", F.lit(True)))


def in_scenarios(df: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> DataFrame:
    out = df.filter(F.col("scenario").isin(*include)) if include else df
    return out.filter(~F.col("scenario").isin(*exclude)) if exclude else out


def within_words(df: DataFrame, most: int) -> DataFrame:
    return df.filter(word_count(F.col("text")) <= most)


def first_of_dataset(sentences: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` sentences of every data set in file order."""
    return first_of_groups(sentences, "dataset_id", ["sentence_index", "id"], limit)


def hash_selected(sentences: DataFrame, limit: int, seed: str) -> DataFrame:
    """``limit`` sentences of every data set in the order of a seeded digest: the native, distributed selection."""
    key = F.sha2(F.concat(F.lit(seed), F.lit(":"), "dataset_id", F.lit(":"), "id"), 256)
    return first_of_groups(sentences.withColumn("_digest", key), "dataset_id", ["_digest", "id"], limit).drop("_digest")


#: Limits up to which Spark cuts a group in every task before the shuffle.
SMALL_LIMIT = 1000


def first_of_groups(rows: DataFrame, key: str, order: Sequence[str], limit: int | str) -> DataFrame:
    """The first ``limit`` rows (a number or a column) of every group in ``order``.

    Small limits cut every task's share of a group before the shuffle; a large one numbers the rows over range partitions,
    so that no task sorts a whole group.
    """
    if isinstance(limit, int) and limit <= SMALL_LIMIT:
        rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
        return rows.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")
    most = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    return running_index(rows, [key], order, "_rank").filter(F.col("_rank") <= most).drop("_rank")


def shuffled_selection(sentences: DataFrame, limit: int | str, seed: int | str) -> DataFrame:
    """``dataset_id, id``: the exact selection of a Mersenne-Twister shuffle seeded with '<seed>:<dataset_id>'.

    limit: a number, or the column that holds the data set's own. For parity with existing manifests only: the shuffle needs
    all ids of a data set in one task. Data sets are files of a few dozen sentences; use ``hash_selected`` for corpora.
    """

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame.sort_values(["sentence_index", "id"])["id"].tolist()
        chosen = list(ids)
        random.Random(f"{seed}:{frame['dataset_id'].iloc[0]}").shuffle(chosen)
        keep = set(chosen[: int(frame["_most"].iloc[0])])
        return pd.DataFrame({"dataset_id": frame["dataset_id"].iloc[0], "id": [i for i in ids if i in keep]})

    most = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    return sentences.select("dataset_id", "sentence_index", "id", most.alias("_most")).groupBy("dataset_id").applyInPandas(pick, "dataset_id string, id string")


def sampled_by_hash(rows: DataFrame, limit: int, seed: int | str) -> DataFrame:
    """The ``limit`` rows with the least seeded digests of their ids: a distributed top-k, the same in every layout."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return rows.withColumn("_digest", key).orderBy("_digest", "id").limit(limit).drop("_digest")


def sampled_exactly(rows: DataFrame, limit: int, seed: int) -> DataFrame:
    """``limit`` rows drawn as ``random.Random(seed).sample`` draws from the rows in id order.

    For parity with published selections only; ``sampled_by_hash`` is the distributed draw. The draw picks positions, so the
    ids are numbered in order over range partitions and meet the drawn positions; no task sees all of them.
    """
    numbered = running_index(rows.select(F.lit(1).alias("_all"), "id"), ["_all"], ["id"], "_at")
    n = numbered.count()
    if n <= limit:
        return rows
    drawn = rows.sparkSession.createDataFrame([(i + 1,) for i in random.Random(seed).sample(range(n), limit)], "_at bigint")
    return rows.join(numbered.join(F.broadcast(drawn), "_at").select("id"), "id", "left_semi")


def tier(experiment: dict, name: str | None, *, methods: Sequence[str] | None = None, seed: str | None = None) -> dict:
    """Methods, scenarios, sentences per scenario and seed of a run: the whole experiment, or one of its tiers.

    Given methods and a given seed take precedence over the tier's; the seed 'none' means file order.
    """
    part = experiment[name] if name else {}
    own = part.get("selection_seed") if seed is None else (None if seed.lower() == "none" else seed)
    return {
        "methods": list(methods or part.get("preprocessing_methods") or experiment["preprocessing_methods"]), "scenarios": sorted(set(part["scenarios"])) if name else None,
        "per_scenario": int(part["sentences_per_scenario"]) if name else None, "seed": None if own is None else str(own),
    }


def without_systems(rows: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Rows of all but the excluded systems; a row without a system stays."""
    return rows.filter(~F.coalesce(F.col("tts_system_id").isin(*excluded), F.lit(False))) if excluded else rows


def selected_ids(rows: DataFrame) -> DataFrame:
    """``dataset_file, n_ids, ids``: the distinct sentences that a manifest takes from every file, in order."""
    return rows.groupBy("dataset_file").agg(F.array_sort(F.collect_set("sentence_id")).alias("ids")).select("dataset_file", F.size("ids").alias("n_ids"), "ids")


def reference_assets(paths: DataFrame, shared: Sequence[tuple[str, str, str, str]], folders: Sequence[tuple[str, str, str, str]] = ()) -> DataFrame:
    """Adds ``asset_id, asset_path, asset_kind`` to reference audio paths (``path``); all null where no rule maps a path.

    shared: (ending, id, path, kind) of assets that many systems use. folders: (folder, ending, prefix of the id, kind) of
    assets that keep their path and are known by their file name. The first rule that fits counts.
    """
    p, kind = F.col("path"), "struct<id:string,path:string,kind:string>"
    made = lambda i, at, k: F.struct(i.alias("id"), at.alias("path"), F.lit(k).alias("kind"))
    rules = [F.when(p.endswith(e), made(F.lit(i), F.lit(at), k)) for e, i, at, k in shared]
    rules += [F.when(p.startswith(folder) & p.endswith(e), made(F.concat(F.lit(prefix), F.regexp_extract(p, r"([^/]*?)\.[^./]*$", 1)), p, k)) for folder, e, prefix, k in folders]
    found = F.coalesce(*rules, F.lit(None).cast(kind))
    return paths.withColumn("_a", found).withColumns({"asset_id": F.col("_a.id"), "asset_path": F.col("_a.path"), "asset_kind": F.col("_a.kind")}).drop("_a")


def resolve_audio_paths(rows: DataFrame, listing: DataFrame, root: str, config_dir: str | None = None) -> DataFrame:
    """Adds ``resolved_path``: absolute paths as they are, others below ``root`` if they exist there, else below ``config_dir``."""
    there = listing.select(F.col("path").alias("_at_root")).distinct().withColumn("_there", F.lit(True))
    p = F.col("audio_path")
    placed = rows.withColumn("_at_root", F.concat(F.lit(root.rstrip("/") + "/"), p)).join(there, "_at_root", "left")
    below = F.concat(F.lit((config_dir or root).rstrip("/") + "/"), p)
    return placed.withColumn("resolved_path", F.when(p.startswith("/"), p).when(F.coalesce("_there", F.lit(False)), F.col("_at_root")).otherwise(below)).drop("_at_root", "_there")


def scenario_caps(per_file: DataFrame, most: int) -> DataFrame:
    """``taken`` of every file of ``scenario, dataset_file, eligible``: files in name order share a cap per scenario."""
    before = F.sum("eligible").over(Window.partitionBy("scenario").orderBy("dataset_file").rowsBetween(Window.unboundedPreceding, -1))
    room = F.lit(most) - F.coalesce(before, F.lit(0))
    return per_file.withColumn("taken", F.greatest(F.lit(0), F.least("eligible", room)).cast("bigint"))


def variant_sources(files: DataFrame, variants: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Which file serves each data set and method: the variant, or for 'raw' the base file; null where neither exists."""
    wanted = files.select("dataset_file").distinct().select("dataset_file", F.explode(F.array(*map(F.lit, methods))).alias("method"))
    have = variants.select("dataset_file", "method").distinct().withColumn("_have", F.lit(True))
    joined = wanted.join(have, ["dataset_file", "method"], "left")
    served = F.when(F.col("_have"), F.concat_ws("/", "method", "dataset_file")).when(F.col("method") == "raw", F.col("dataset_file"))
    return joined.select("dataset_file", "method", served.alias("served_by"))


def missing_sentences(selected: DataFrame, variants: DataFrame, methods: Sequence[str]) -> DataFrame:
    """``dataset_id, id, method``: selected sentences that a variant lacks."""
    return missing_variants(selected, variants, methods)


def synthesis_manifest(variants: DataFrame, systems: DataFrame, audio_dir: str) -> DataFrame:
    """One row per variant sentence and enabled system; a registry of proven size is broadcast."""
    registry = bounded(enabled_systems(systems).select(
        F.col("id").alias("tts_system_id"), F.col("family").alias("tts_family"), F.col("display_name").alias("tts_display_name"),
        F.struct("model_ref", "voice", "sample_rate_hz").alias("metadata"),
    ))
    source = fallback(F.col("original_text"), F.col("text"))
    spoken = fallback(F.col("normalized_text"), F.col("text"))
    clips = variants.select(
        "dataset_id", "dataset_file", "scenario", F.col("id").alias("sentence_id"), "language", F.col("method").alias("preprocessing_method"),
        source.alias("source_text"), spoken.alias("synthesis_text"), word_count(source).cast("int").alias("source_token_count"),
        word_count(spoken).cast("int").alias("synthesis_token_count"), "source_url",
    )
    rows = clips.crossJoin(registry)
    parts = [F.col(c) for c in ("tts_system_id", "preprocessing_method", "dataset_id", "sentence_id")]
    utterance = safe_id(F.concat_ws("_", "dataset_id", "sentence_id", "preprocessing_method", "tts_system_id"))
    return rows.select(utterance.alias("utterance_id"), *clips.columns, "tts_system_id", "tts_family", "tts_display_name", F.concat(path_of(audio_dir, *parts), F.lit(".wav")).alias("audio_path"), "metadata")


def asr_command(audio: Column, transcript_dir: Column, language: Column, asr: dict) -> Column:
    """The command line of one transcription job."""
    base = ["--model", str(asr["model"]), "--language", None, "--task", str(asr.get("task", "transcribe")), "--output_format", str(asr.get("output_format", "json")), "--output_dir", None, "--device", str(asr.get("device", "cuda")), "--compute_type", str(asr.get("compute_type", "float16")), "--batch_size", str(asr.get("batch_size", 16))]
    filled = {3: language, 9: transcript_dir}
    words = [F.lit("whisperx"), audio, *[filled.get(i, F.lit(w)) for i, w in enumerate(base)]]
    if not asr.get("align", True):
        words.append(F.lit("--no_align"))
    elif asr.get("alignment_model"):
        words += [F.lit("--align_model"), F.lit(str(asr["alignment_model"]))]
    if asr.get("diarize"):
        words.append(F.lit("--diarize"))
    return F.array(*words)


def transcription_manifest(synthesis: DataFrame, asr: dict, transcript_dir: str) -> DataFrame:
    """One job per clip; the clip's own language, else the recogniser's."""
    folder = path_of(transcript_dir, asr["id"], F.col("tts_system_id"), F.col("preprocessing_method"), F.col("dataset_id"))
    language = fallback(F.col("language"), F.lit(str(asr["language"])))
    return synthesis.select(
        "utterance_id", F.lit(asr["id"]).alias("asr_id"), F.lit(asr.get("backend")).cast("string").alias("asr_backend"), F.lit(asr.get("model")).cast("string").alias("asr_model"),
        language.alias("language"), "audio_path", F.concat(folder, F.lit("/"), "sentence_id", F.lit(".json")).alias("transcript_path"),
        F.col("synthesis_text").alias("expected_text"), "source_text", "dataset_id", "scenario", "sentence_id", "preprocessing_method", "tts_system_id",
        asr_command(F.col("audio_path"), folder, language, asr).alias("command"),
    )


def handoff_index(manifest: DataFrame, order: Sequence[str] = ("utterance_id",), variant: str = "ft") -> DataFrame:
    """Clips of every system numbered from 1, with the one-line text and the name of the wave file that comes back."""
    needed = list(dict.fromkeys(["tts_system_id", "utterance_id", "synthesis_text", "audio_path", *order]))
    numbered = running_index(manifest.select(*needed), ["tts_system_id"], order, "handoff_index")
    line = collapse_spaces(F.col("synthesis_text"))
    return numbered.select("tts_system_id", "handoff_index", "utterance_id", line.alias("handoff_text"), (line != F.col("synthesis_text")).alias("text_changed"), returned_wav(F.col("handoff_index"), variant).alias("returned_wav"), "audio_path")


def returned_wav(index: Column, variant: str) -> Column:
    """File name of a returned clip: fine-tuned '_ft', 'base' or plain."""
    return F.format_string({"ft": "%03d_ft.wav", "base": "%03d_base.wav", "plain": "%03d.wav"}[variant], index)


def copy_summary(plan: DataFrame) -> DataFrame:
    """``tts_system_id, copied, missing`` of a copy plan."""
    return plan.groupBy("tts_system_id").agg(F.count_if("exists").alias("copied"), F.count_if(~F.col("exists")).alias("missing"))


def handoff_summary(index: DataFrame) -> DataFrame:
    return index.groupBy("tts_system_id").agg(F.count("*").alias("rows"), F.count_if("text_changed").alias("changed"))


def copy_plan(index: DataFrame, listing: DataFrame, source_dir: str) -> DataFrame:
    """Source and target of every returned clip and whether the source exists."""
    planned = index.withColumn("source", path_of(source_dir, F.col("tts_system_id"), F.col("returned_wav")))
    there = listing.select(F.col("path").alias("source")).distinct().withColumn("_there", F.lit(True))
    return planned.join(there, "source", "left").select("tts_system_id", "utterance_id", "source", F.col("audio_path").alias("target"), F.coalesce("_there", F.lit(False)).alias("exists"))


def resolve_references(rows: DataFrame, by_system: dict[str, str], by_family_voice: dict[str, str], by_voice: dict[str, str], row_path: str | None = None) -> DataFrame:
    """Adds ``reference_path, reference_selector``: the row's own path, else by system, family::voice, voice."""

    def found(table: dict[str, str], key: Column) -> Column:
        kept = {k: v for k, v in table.items() if v}
        return F.try_element_at(F.create_map(*[F.lit(x) for kv in kept.items() for x in kv]), key) if kept else F.lit(None).cast("string")

    system, voice, family = F.coalesce("tts_system_id", F.lit("")), F.coalesce("metadata.voice", F.lit("")), F.coalesce("tts_family", F.lit(""))
    pair = F.when((family != "") & (voice != ""), F.concat(family, F.lit("::"), voice))
    own = F.nullif(F.col(row_path), F.lit("")) if row_path else F.lit(None).cast("string")
    options = [
        (own, F.lit(f"row:{row_path}")),
        (found(by_system, F.nullif(system, F.lit(""))), F.concat(F.lit("system:"), system)),
        (found(by_family_voice, pair), F.concat(F.lit("family_voice:"), pair)),
        (found(by_voice, F.nullif(voice, F.lit(""))), F.concat(F.lit("voice:"), voice)),
    ]
    return rows.withColumns({"reference_path": F.coalesce(*[p for p, _ in options]), "reference_selector": F.coalesce(*[F.when(p.isNotNull(), s) for p, s in options])})
