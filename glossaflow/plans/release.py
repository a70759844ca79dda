"""Integrity of a release: every rule is a query, all of them run, and what breaks is one table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaflow.functions.text import collapse_spaces, portable_path, word_count
from glossaflow.operators import checks, manifests
from glossaflow.sources import readers, sinks


def _broken(rows: DataFrame, rule: str, key: Sequence[str]) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.concat_ws("::", *[F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in key]).alias("key"))


def manifest_violations(clips: DataFrame, sentences: DataFrame, variants: DataFrame, systems: DataFrame, *, per_system: int | None = None) -> DataFrame:
    """``rule, key``: what breaks the rules of a core manifest.

    Clips are unique, their paths portable, their systems known, their sentences and variants there with the same texts;
    every sentence comes in every method and system; a sentence has one source text; each system has its number of clips.
    """
    sid, vid = ["dataset_id", "sentence_id"], ["dataset_id", "sentence_id", "preprocessing_method"]
    source = sentences.select("dataset_id", F.col("id").alias("sentence_id"), F.col("scenario").alias("source_text_scenario"), F.col("text").alias("source_of"))
    spoken = variants.select("dataset_id", F.col("id").alias("sentence_id"), F.col("method").alias("preprocessing_method"), F.col("normalized_text").alias("spoken_of"))
    with_source = clips.join(source, sid, "left")
    with_spoken = clips.join(spoken, vid, "left")
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    rules = [
        _broken(checks.doubled_keys(clips, ["utterance_id"]), "utterance_twice", ["utterance_id"]),
        _broken(checks.doubled_keys(clips, ["audio_path"]), "audio_path_twice", ["audio_path"]),
        _broken(clips.filter(~portable_path(F.col("audio_path"))), "path_not_portable", ["utterance_id"]),
        _broken(checks.orphans(clips, ["tts_system_id"], systems, ["id"]), "unknown_system", ["tts_system_id"]),
        _broken(with_source.filter("source_of is null"), "sentence_missing", ["utterance_id"]),
        _broken(with_source.filter(F.col("source_of").isNotNull() & (differs("source_of", "source_text") | differs("source_text_scenario", "scenario"))), "sentence_differs", ["utterance_id"]),
        _broken(with_spoken.filter("spoken_of is null"), "variant_missing", ["utterance_id"]),
        _broken(with_spoken.filter(F.col("spoken_of").isNotNull() & differs("spoken_of", "synthesis_text")), "variant_differs", ["utterance_id"]),
        _broken(checks.cartesian_gaps(clips, [sid, ["preprocessing_method"], ["tts_system_id"]]), "combination_missing", [*vid, "tts_system_id"]),
        _broken(checks.broken_dependencies(clips, sid, "source_text"), "source_text_varies", sid),
    ]
    if per_system is not None:
        rules.append(_broken(checks.unbalanced(clips, ["tts_system_id"], per_system), "clips_per_system", ["tts_system_id"]))
    return reduce(DataFrame.unionByName, rules)


def track_violations(clips: DataFrame, jobs: DataFrame, speakers: DataFrame) -> DataFrame:
    """``rule, key`` of a three-way manifest join: the same clips everywhere, and shared columns equal."""
    rules = [
        _broken(checks.uncovered(clips, jobs, ["utterance_id"]), "transcription_coverage", ["utterance_id", "side"]),
        _broken(checks.uncovered(clips, speakers, ["utterance_id"]), "speaker_coverage", ["utterance_id", "side"]),
    ]
    for name, other in (("transcription", jobs), ("speaker", speakers)):
        shared = [c for c in other.columns if c in clips.columns and c != "utterance_id"]
        if shared:
            rules.append(_broken(checks.differing_columns(clips, other, ["utterance_id"], shared), f"{name}_differs", ["utterance_id", "column"]))
    return reduce(DataFrame.unionByName, rules)


def handoff_violations(clips: DataFrame, handoff: DataFrame) -> DataFrame:
    """Handoff lines that are not the collapsed text of their clip, and clips without a line."""
    joined = clips.join(handoff.select("utterance_id", "handoff_text"), "utterance_id", "left")
    wrong: Column = F.col("handoff_text").isNotNull() & (F.col("handoff_text") != collapse_spaces(F.col("synthesis_text")))
    return _broken(joined.filter("handoff_text is null"), "handoff_missing", ["utterance_id"]).unionByName(_broken(joined.filter(wrong), "handoff_differs", ["utterance_id"]))


def speaker_violations(clips: DataFrame, expected_share: dict[str, int]) -> DataFrame:
    """Sentences with more than one speaker, and speakers whose number of sentences is not as expected."""
    sentences = clips.select("dataset_id", "sentence_id", "speaker").distinct()
    wanted = clips.sparkSession.createDataFrame(list(expected_share.items()), "speaker string, wanted bigint")
    counts = sentences.groupBy("speaker").agg(F.count("*").alias("n")).join(F.broadcast(wanted), "speaker", "full_outer")
    return _broken(checks.broken_dependencies(sentences, ["dataset_id", "sentence_id"], "speaker"), "speaker_varies", ["dataset_id", "sentence_id"]).unionByName(
        _broken(counts.filter(~F.col("n").eqNullSafe(F.col("wanted"))), "speaker_balance", ["speaker"])
    )


def count_violations(expected: dict[str, int], counted: dict[str, DataFrame]) -> DataFrame:
    """Numbers that a protocol fixes and the tables do not have; the key names the number and what was found."""
    spark = next(iter(counted.values())).sparkSession
    found = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in counted.items()])
    wanted = F.broadcast(spark.createDataFrame([(k, int(v)) for k, v in expected.items()], "name string, wanted bigint"))
    both = found.join(wanted, "name", "full_outer").filter(~F.col("n").eqNullSafe(F.col("wanted")))
    return _broken(both, "count_differs", ["name", "n", "wanted"])


def roster_violations(systems: DataFrame, pinned: Sequence[str], excluded: Sequence[str], tracks: dict[str, DataFrame]) -> DataFrame:
    """Registered systems that are not the pinned ones, excluded ones that are there, and tracks with another roster."""
    spark = systems.sparkSession
    known = systems.select(F.col("id").cast("string").alias("tts_system_id"))
    wanted = spark.createDataFrame([(s,) for s in pinned], "tts_system_id string")
    rules = [_broken(checks.unequal_sets(known, wanted), "roster_differs", ["tts_system_id", "side"]), _broken(known.filter(F.col("tts_system_id").isin(*excluded)), "excluded_system", ["tts_system_id"])]
    rules += [_broken(checks.unequal_sets(t.select("tts_system_id").distinct(), known.distinct()), f"{name}_roster_differs", ["tts_system_id", "side"]) for name, t in tracks.items()]
    return reduce(DataFrame.unionByName, rules)


def pinned_violations(sentences: DataFrame, pinned: DataFrame) -> DataFrame:
    """Sentences (``dataset_id, sentence_id``) that are not pinned, and pinned ones that are not there."""
    key = ["dataset_id", "sentence_id"]
    return _broken(checks.unequal_sets(sentences.select(*key).distinct(), pinned.select(*key).distinct()), "pinned_sentences_differ", [*key, "side"])


def variant_violations(sentences: DataFrame, variants: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Variants that stand twice, of unknown sentences or methods, or whose original is not the sentence."""
    key = ["dataset_id", "id"]
    joined = variants.join(sentences.select(*key, F.col("text").alias("source_of")), key, "left")
    rules = [
        _broken(checks.doubled_keys(sentences, key), "sentence_twice", key), _broken(checks.doubled_keys(variants, [*key, "method"]), "variant_twice", [*key, "method"]),
        _broken(variants.filter(~F.coalesce(F.col("method").isin(*methods), F.lit(False))), "unknown_method", [*key, "method"]), _broken(joined.filter("source_of is null"), "variant_of_nothing", [*key, "method"]),
        _broken(joined.filter("source_of is not null and not (source_of <=> original_text)"), "original_differs", [*key, "method"]), _broken(checks.missing_variants(sentences, variants, methods), "variant_lacking", [*key, "method"]),
    ]
    return reduce(DataFrame.unionByName, rules)


def asset_violations(clips: DataFrame, systems: DataFrame, references: DataFrame, models: DataFrame) -> DataFrame:
    """Clips whose reference is not registered or stands elsewhere, and whose model or rate is not that of their system."""
    own = systems.select(F.col("id").alias("tts_system_id"), F.col("model_ref").alias("_model"), F.col("sample_rate_hz").alias("_rate"))
    refs = references.select(F.col("id").alias("reference_asset_id"), F.col("path").alias("_path"))
    held = clips.join(refs, "reference_asset_id", "left").join(own, "tts_system_id", "left")
    rules = [
        _broken(checks.orphans(systems, ["model_asset_id"], models, ["id"]), "unknown_model", ["model_asset_id"]), _broken(references.filter(~portable_path(F.col("path"))), "path_not_portable", ["id"]),
        _broken(held.filter("_path is null"), "unknown_reference", ["utterance_id"]), _broken(held.filter("_path is not null and not (_path <=> reference_audio_path)"), "reference_path_differs", ["utterance_id"]),
        _broken(held.filter("_model is not null and not (_model <=> metadata.model_ref)"), "model_differs", ["utterance_id"]), _broken(held.filter("_rate is not null and not (_rate <=> metadata.sample_rate_hz)"), "rate_differs", ["utterance_id"]),
        _broken(clips.filter(~F.col("handoff_text").eqNullSafe(collapse_spaces(F.col("synthesis_text")))), "handoff_differs", ["utterance_id"]),
    ]
    return reduce(DataFrame.unionByName, rules)


def heldout_violations(clips: DataFrame, own_reference: dict[str, str] | None = None, prefix: str = "natural_") -> DataFrame:
    """Held-out clips that are not the raw text, differ by system, or have another reference than their natural recording.

    own_reference: systems that are compared with a recording of their own speaker, and its asset.
    """
    expected = F.coalesce(*[F.when(F.col("tts_system_id") == s, F.lit(r)) for s, r in (own_reference or {}).items()], F.concat(F.lit(prefix), "sentence_id"))
    rules = [
        _broken(clips.filter("not (preprocessing_method <=> 'raw')"), "heldout_method", ["utterance_id"]), _broken(clips.filter("not (source_text <=> synthesis_text)"), "heldout_text_changed", ["utterance_id"]),
        _broken(checks.broken_dependencies(clips, ["sentence_id"], "source_text"), "heldout_text_varies", ["sentence_id"]), _broken(clips.filter(~F.col("reference_asset_id").eqNullSafe(expected)), "heldout_reference", ["utterance_id"]),
    ]
    return reduce(DataFrame.unionByName, rules)


def split_violations(clips: DataFrame, within: Sequence[str], speakers: int = 2) -> DataFrame:
    """Groups in which the speakers do not have the same number of sentences, or are not so many."""
    counts = clips.select(*within, "dataset_id", "sentence_id", "speaker").distinct().groupBy(*within, "speaker").agg(F.count("*").alias("n"))
    uneven = counts.groupBy(*within).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("k")).filter((F.col("least") != F.col("most")) | (F.col("k") != speakers))
    return _broken(uneven, "speakers_uneven", within)


def job_violations(clips: DataFrame, jobs: DataFrame, asr_id: str, aligned: bool) -> DataFrame:
    """Transcription jobs with another text, audio file or setting than their clip and the recogniser have."""
    both = jobs.alias("j").join(clips.select("utterance_id", F.col("synthesis_text").alias("_text"), F.col("audio_path").alias("_audio")), "utterance_id")
    rules = [
        _broken(both.filter("not (expected_text <=> _text)"), "job_text_differs", ["utterance_id"]), _broken(both.filter("not (audio_path <=> _audio)"), "job_audio_differs", ["utterance_id"]),
        _broken(jobs.filter((F.col("asr_id") != asr_id) | (F.array_contains("command", "--no_align") == F.lit(aligned))), "job_settings", ["utterance_id"]), _broken(jobs.filter(~portable_path(F.col("transcript_path"))), "path_not_portable", ["utterance_id"]),
    ]
    return reduce(DataFrame.unionByName, rules)


CLIPS = readers.SYNTHESIS + ", handoff_text string, reference_asset_id string, reference_audio_path string, speaker int, paper_label string"
JOBS = "utterance_id string, asr_id string, language string, audio_path string, transcript_path string, expected_text string, command array<string>"
SYSTEMS = "systems array<struct<id:string,family:string,display_name:string,enabled:boolean,model_ref:string,model_asset_id:string,voice:string,sample_rate_hz:int,core_clips:bigint,heldout_clips:bigint>>"


def release_violations(spark: SparkSession, root: str, preset: str, *, hashes: bool = True) -> DataFrame:
    """``rule, key``: everything that is wrong with a release folder; empty if it is sound.

    The folder holds ``configs/<preset>`` (protocol, systems, assets), ``datasets/<preset>/source`` and ``normalized/<method>``,
    ``manifests/<preset>`` with two tracks of clips, jobs and references, and ``releases/<preset>/inputs.sha256``. What is
    expected stands in the protocol; no number is fixed here.
    """
    at = lambda *parts: "/".join([root.rstrip("/"), *parts])
    protocol = readers.document(spark, at("configs", preset, "paper_protocol.json"))
    systems = spark.read.schema(SYSTEMS).option("multiLine", True).json(at("configs", preset, "systems.json")).select(F.explode("systems").alias("s")).select("s.*")
    assets = lambda name: spark.read.schema("assets array<struct<id:string,path:string>>").option("multiLine", True).json(at("configs", preset, name)).select(F.explode("assets").alias("a")).select("a.*")
    references, models, methods = assets("reference_assets.json"), assets("model_assets.json"), protocol["methods"]
    source = readers.dataset_sentences(spark, at("datasets", preset, "source"))
    variants = reduce(DataFrame.unionByName, [readers.dataset_sentences(spark, at("datasets", preset, "normalized", m)).withColumn("method", F.lit(m)) for m in methods])
    tracks = {t: readers.json_lines(spark, at("manifests", preset, f"synthesis_{t}.jsonl"), CLIPS) for t in ("core", "heldout")}
    pinned = spark.createDataFrame([(s["dataset_id"], s["sentence_id"]) for s in protocol["sentences"]], "dataset_id string, sentence_id string")
    per_scenario = checks.unbalanced(source, ["scenario"], protocol["counts"]["sentences_per_scenario"])
    counted = {
        "sentences": source, "scenarios": source.select("scenario").distinct(), "normalized_inputs": variants, "systems": systems, "core_clips": tracks["core"], "heldout_clips": tracks["heldout"],
        "heldout_sentences": tracks["heldout"].select("sentence_id").distinct(),
    }
    asr = readers.document(spark, at("configs", preset, "asr.json"))
    issues = checks.dataset_issues(readers.json_files(spark, at("datasets", preset, "source"))).filter("severity = 'error'")
    rules = [
        count_violations({k: v for k, v in protocol["counts"].items() if k in counted}, counted), _broken(per_scenario, "scenario_size", ["scenario"]), roster_violations(systems, protocol["system_ids"], protocol.get("excluded_systems", []), tracks),
        pinned_violations(source.withColumnRenamed("id", "sentence_id"), pinned), variant_violations(source, variants, methods), _broken(issues, "data_set_error", ["path", "code", "sentence_id"]),
        manifest_violations(tracks["core"], source, variants, systems), heldout_violations(tracks["heldout"], protocol.get("own_references")),
    ]
    for name, clips in tracks.items():
        jobs = readers.json_lines(spark, at("manifests", preset, f"transcription_{name}.jsonl"), JOBS)
        spoken = readers.json_lines(spark, at("manifests", preset, f"speaker_references_{name}.jsonl"), "utterance_id string, dataset_id string, sentence_id string, scenario string, preprocessing_method string, tts_system_id string, audio_path string, reference_asset_id string, reference_audio_path string")
        expected = systems.select(F.col("id").alias("tts_system_id"), F.col(f"{name}_clips").alias("wanted"))
        sizes = clips.groupBy("tts_system_id").agg(F.count("*").alias("n")).join(expected, "tts_system_id", "full_outer").filter("wanted is not null and not (n <=> wanted)")
        rules += [asset_violations(clips, systems, references, models), track_violations(clips, jobs.select("utterance_id", "audio_path"), spoken), job_violations(clips, jobs, asr.get("id"), bool(asr.get("align", True))), _broken(sizes, f"{name}_clips_of_system", ["tts_system_id", "n"])]
        voiced = clips.filter("speaker is not null")
        if name == "core":
            rules += [_broken(checks.broken_dependencies(voiced, ["dataset_id", "sentence_id", "tts_system_id"], "speaker"), "speaker_varies", ["dataset_id", "sentence_id"]), split_violations(voiced, ["tts_system_id", "scenario"])]
    if hashes:
        listed = readers.inventory(spark, at("releases", preset, "inputs.sha256"))
        base = readers.plain_path(F.lit(at(""))).alias("b")
        folders = [at(f, preset) for f in ("configs", "datasets", "manifests")]
        files = reduce(DataFrame.unionByName, [readers.hashed_files(spark, f, "*.json*") for f in folders])
        files = files.select(readers.plain_path(F.col("path")).alias("p"), "sha256", base).select(F.expr("substring(p, length(b) + 1)").alias("path"), "sha256")
        rules.append(_broken(checks.hash_mismatches(listed, files), "inventory", ["path", "problem"]))
        rules.append(_broken(listed.filter(~portable_path(F.col("path"))), "path_not_portable", ["path"]))
    return reduce(DataFrame.unionByName, rules)


def export_violations(clips: DataFrame, sentences: DataFrame, variants: DataFrame) -> DataFrame:
    """What keeps clips from being exported: doubled ids, texts that depend on the system, lost or differing sources and variants."""
    key = ["dataset_id", "sentence_id", "preprocessing_method"]
    sources = clips.join(sentences.select("dataset_id", F.col("id").alias("sentence_id"), F.col("text").alias("_source")), ["dataset_id", "sentence_id"], "left")
    spoken = clips.join(variants.select("dataset_id", F.col("id").alias("sentence_id"), F.col("method").alias("preprocessing_method"), F.col("normalized_text").alias("_spoken")), key, "left")
    rules = [
        _broken(checks.doubled_keys(clips, ["utterance_id"]), "utterance_twice", ["utterance_id"]), _broken(checks.broken_dependencies(clips, key, "synthesis_text"), "text_by_system", key), _broken(checks.broken_dependencies(clips, key, "source_text"), "source_by_system", key),
        _broken(sources.filter("not (_source <=> source_text)"), "source_differs", ["utterance_id"]), _broken(spoken.filter("not (_spoken <=> synthesis_text)"), "variant_differs", ["utterance_id"]),
    ]
    return reduce(DataFrame.unionByName, rules)


def export_release(clips: DataFrame, sentences: DataFrame, variants: DataFrame, target: str, *, excluded: Sequence[str] = ()) -> dict:
    """Writes the clips, the sentences and variants that they take, an audit and an inventory below a new folder.

    Gives the census of the audit: rows, sentences whose recorded word count is off, warnings of variants, texts that a handoff
    changes. Refuses to write anything if ``export_violations`` finds something (ValueError).
    """
    spark, clips = clips.sparkSession, manifests.without_systems(clips, excluded).persist()
    if bad := export_violations(clips, sentences, variants).limit(20).collect():
        raise ValueError("; ".join(f"{r.rule} {r.key}" for r in bad))
    taken = clips.select("dataset_id", F.col("sentence_id").alias("id"), F.col("preprocessing_method").alias("method")).distinct().persist()
    own_sentences = sentences.join(taken.select("dataset_id", "id").distinct(), ["dataset_id", "id"], "left_semi")
    own_variants = variants.join(taken, ["dataset_id", "id", "method"], "left_semi")
    line = collapse_spaces(F.col("synthesis_text"))
    written = clips.withColumn("handoff_text", line)
    parts = {"clips": written, "sentences": own_sentences, "variants": own_variants}
    counted = own_sentences.withColumn("rough", word_count(F.col("text"))).filter("not (rough <=> word_count)").select("dataset_id", "id", F.col("word_count").alias("recorded"), "rough")
    warned = own_variants.filter(F.size("normalization_warnings") > 0).select("dataset_id", "id", "method", "normalization_warnings")
    changed = written.filter("handoff_text <> synthesis_text").select("utterance_id")
    parts |= {"audit/word_counts": counted, "audit/warnings": warned, "audit/handoff_changes": changed}
    for name, df in parts.items():
        sinks.write_json_lines(df, f"{target.rstrip('/')}/{name}", "errorifexists")
    schemas = {n: spark.read.json(f"{target.rstrip('/')}/{n}", schema=df.schema) for n, df in parts.items()}
    census = {n.rpartition("/")[2]: df.count() for n, df in schemas.items()}
    base = readers.plain_path(F.lit(target.rstrip("/") + "/"))
    files = readers.hashed_files(spark, target, "*.json").select(readers.plain_path(F.col("path")).alias("p"), "sha256", base.alias("b")).select(F.expr("substring(p, length(b) + 1)").alias("path"), "sha256")
    sinks.write_inventory(files, f"{target.rstrip('/')}/inventory")
    return census
