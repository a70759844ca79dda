"""``python -m glossaflow.cli COMMAND ...``: the jobs of the toolkit over files and folders."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaflow.functions.text import BOUNDARY
from glossaflow.operators import audio, checks, collect, manifests, summaries, variants
from glossaflow.plans import release, scoring
from glossaflow.session import local_session
from glossaflow.sources import pages, readers, sinks


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    found = checks.dataset_issues(readers.json_files(spark, a.datasets), strict=a.strict, tolerance=a.tolerance).persist()
    for r in found.orderBy("path", "code", "sentence_id").limit(a.show).collect():
        print(f"{r.severity} {r.code} {r.path} {r.sentence_id or ''} {r.message}")
    counts = {r.severity: r.n for r in found.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    print(f"errors={counts.get('error', 0)} warnings={counts.get('warning', 0)}")
    return 1 if counts.get("error") else 0


def normalise(spark: SparkSession, a: argparse.Namespace) -> int:
    sentences = readers.dataset_sentences(spark, a.datasets).drop("original_text", "normalized_text", "normalization_warnings")
    made = [variants.variant(sentences, m) for m in a.method]
    out = made[0]
    for v in made[1:]:
        out = out.unionByName(v)
    sinks.write_variants(out, a.output)
    return 0


def synthesis(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = spark.read.parquet(a.variants)
    systems = spark.read.option("multiLine", True).json(a.systems)
    systems = systems.select(F.explode("systems").alias("s")).select("s.*") if "systems" in systems.columns else systems
    for name, kind in (("enabled", "boolean"), ("voice", "string"), ("sample_rate_hz", "int")):
        if name not in systems.columns:
            systems = systems.withColumn(name, F.lit(None).cast(kind))
    if a.tier and not a.experiment:
        print("a tier needs --experiment")
        return 2
    run = {"methods": a.method or ["raw", "regex"], "scenarios": a.scenario, "per_scenario": a.per_scenario, "seed": a.seed}
    if a.experiment:
        plan = manifests.tier(readers.document(spark, a.experiment), a.tier, methods=a.method, seed=a.seed)
        run = {k: v if v is not None else run[k] for k, v in plan.items()} | {"seed": plan["seed"]}
    rows = manifests.in_scenarios(rows, run["scenarios"], a.exclude_scenario)
    systems = systems.filter(~F.col("id").isin(*a.exclude_system)) if a.exclude_system else systems
    base = rows.select("dataset_id", "dataset_file", "scenario", "id", "text", "sentence_index").dropDuplicates(["dataset_id", "id"])
    base = manifests.within_words(base, a.max_tokens) if a.max_tokens else base
    chosen = selected(base, run["per_scenario"], run["seed"], a.exact_shuffle)
    rows = rows.join(chosen, ["dataset_id", "id"], "left_semi")
    missing = manifests.missing_sentences(chosen, rows, run["methods"]).limit(20).collect()
    for m in missing:
        print(f"WARNING sentence {m.id} of {m.dataset_id} missing in {m.method}")
    if missing and a.fail_on_missing:
        return 1
    sinks.write_json_lines(manifests.synthesis_manifest(rows.filter(F.col("method").isin(*run["methods"])), systems, a.audio), a.output)
    return 0


def selected(base: DataFrame, per_scenario: int | None, seed: str | None, exact: bool = False) -> DataFrame:
    """``dataset_id, id`` chosen once from the base texts, so that every method has the same sentences.

    Without a seed in file order, else by seeded digest; ``exact`` repeats the shuffle of published selections, which needs
    every data set in one task.
    """
    if not per_scenario:
        return base.select("dataset_id", "id")
    per_file = base.groupBy("scenario", "dataset_file", "dataset_id").agg(F.count("*").alias("eligible"))
    caps = manifests.scenario_caps(per_file, per_scenario).select("dataset_id", F.col("taken").alias("_taken"))
    capped = base.join(caps, "dataset_id")  # one row per file
    if seed is not None and exact:
        return manifests.shuffled_selection(capped, "_taken", seed)
    order = ["sentence_index", "id"] if seed is None else [F.sha2(F.concat(F.lit(f"{seed}:"), "dataset_id", F.lit(":"), "id"), 256), "id"]
    keyed = capped.select("dataset_id", "id", "_taken", *[(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)])
    return manifests.first_of_groups(keyed, "dataset_id", ["_o0", "_o1"], "_taken").select("dataset_id", "id")


def transcription(spark: SparkSession, a: argparse.Namespace) -> int:
    asr = readers.document(spark, a.asr)
    jobs = manifests.transcription_manifest(readers.json_lines(spark, a.manifest, readers.SYNTHESIS), asr, a.transcripts)
    sinks.write_json_lines(jobs, a.output)
    return 0


def score(spark: SparkSession, a: argparse.Namespace) -> int:
    jobs = spark.read.json(a.manifest).drop("command")
    found = readers.transcripts(spark, a.transcripts).withColumn("path", readers.plain_path(F.col("path")))
    rows = scoring.with_hypotheses(jobs, found).persist()
    counts = {r.status: r.n for r in rows.groupBy("status").agg(F.count("*").alias("n")).collect()}
    kept = rows.filter("status = 'scored'" if a.exclude_empty else "status <> 'missing'")
    scores = scoring.error_rates(kept.withColumn("reference", F.col("expected_text"))).drop("status").persist()
    sinks.write_json_lines(scores, a.output)
    missing = counts.get("missing", 0)
    print(f"scored={scores.count()} missing={missing} excluded_empty={counts.get('empty', 0) if a.exclude_empty else 0}")
    if missing and not a.allow_missing:
        return 1
    summary = summaries.error_summary(scores)
    rounded = summaries.python_rounded(summary, {c: 4 for c in summary.columns if c.startswith("mean_")})
    sinks.write_document(sinks.summary_document(rounded, missing=missing), a.output.rstrip("/") + ".summary.json")
    return 0


def check_audio(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = readers.json_lines(spark, a.manifest, readers.SYNTHESIS)
    measured = audio.waves(readers.binary_files(spark, a.audio, "*.wav")).withColumn("path", readers.plain_path(F.col("path")))
    listed = readers.listing(spark, a.audio, "*.wav").select(readers.plain_path(F.col("path")).alias("path"))
    rows = manifests.resolve_audio_paths(rows, listed, a.root, a.config_dir).withColumn("audio_path", F.col("resolved_path")).drop("resolved_path")
    done = audio.quality(rows, measured, shortest=a.min_duration, longest=a.max_duration, silence=a.silence_peak).persist()
    sinks.write_json_lines(done.select("utterance_id", "tts_system_id", "audio_path", "duration_s", "sample_rate", "peak", "issues"), a.output)
    sinks.write_document(sinks.summary_document(summaries.qc_summary(done)), a.output.rstrip("/") + ".summary.json")
    return 0


def fetch(spark: SparkSession, a: argparse.Namespace) -> int:
    """Saves a snapshot of pages; the only command that needs a network."""
    try:
        found = pages.snapshot(pages.wiki(a.edition, a.agent, delay=a.delay), a.edition, a.title, a.category, a.max_pages)
        sinks.write_document(found, a.output, overwrite=False)
    except (ValueError, RuntimeError, FileExistsError) as e:
        print(e)
        return 1
    print(f"pages={len(found['pages'])} skipped={len(found['skipped'])}")
    return 0


def candidates(spark: SparkSession, a: argparse.Namespace) -> int:
    options = {"boundary": a.boundary or BOUNDARY, "min_chars": a.min_chars, "max_chars": a.max_chars, "min_words": a.min_words, "max_words": a.max_words, "include": a.include, "exclude": a.exclude}
    try:
        collect.checked_options(**options, max_sentences=a.max_sentences, dataset_id=a.dataset_id, scenario=a.scenario)
    except ValueError as e:
        print(e)
        return 2
    saved = readers.snapshot_pages(spark, a.snapshot)
    if bad := collect.tampered(saved).limit(20).collect():
        print("digest differs:", *[r.page_id for r in bad])
        return 1
    read = collect.paragraphs(saved).persist()
    kept = read.filter("kept").join(saved.drop("html"), "page_id")
    split = collect.chunks(kept, by_sentence=a.split == "punctuation", boundary=options.pop("boundary"))
    judged = collect.judged_candidates(split.drop("text"), ["page_pos", "paragraph_index", "chunk_index"], **options).persist()
    rows = collect.candidates(collect.kept_candidates(judged), a.edition).withColumns({"dataset_id": F.lit(a.dataset_id), "scenario": F.lit(a.scenario)})
    draw = manifests.sampled_exactly if a.exact_sample else manifests.sampled_by_hash
    drawn = draw(rows, a.max_sentences, a.seed).persist()
    sinks.write_once(drawn, a.output)
    for r in collect.collection_counts(judged, read, drawn.count()).orderBy("counter").collect():
        print(f"{r.counter}={r.n}")
    return 0


def validate_release(spark: SparkSession, a: argparse.Namespace) -> int:
    found = release.release_violations(spark, a.root, a.preset, hashes=not a.no_hashes).persist()
    for r in found.orderBy("rule", "key").limit(a.show).collect():
        print(f"{r.rule} {r.key}")
    n = found.count()
    print(f"violations={n}")
    return 1 if n else 0


def export_release(spark: SparkSession, a: argparse.Namespace) -> int:
    clips = readers.json_lines(spark, a.manifest, readers.SYNTHESIS)
    sentences = readers.dataset_sentences(spark, a.datasets).drop("original_text", "normalized_text", "normalization_warnings")
    try:
        census = release.export_release(clips, sentences, spark.read.parquet(a.variants), a.output, excluded=a.exclude_system)
    except ValueError as e:
        print(e)
        return 1
    print(*[f"{k}={v}" for k, v in census.items()])
    return 0


def example(spark: SparkSession, a: argparse.Namespace) -> int:
    """A written example from sentences to rates; needs neither files nor models."""
    said = "Το δύο χιλιάδες είκοσι τέσσερα ήταν σπουδαίο έτος."
    rows = spark.createDataFrame([("s1", "el", "Το 2024 ήταν σπουδαίο έτος."), ("s2", "el", "Καλημέρα σας."), ("s3", "en", "At 5 o'clock.")], "id string, language string, text string")
    made = {(r.id, r.method): r.normalized_text for m in ("raw", "regex") for r in variants.variant(rows, m).collect()}
    rates = scoring.error_rates(rows.filter("id = 's1'").select("language", F.col("text").alias("reference"), F.lit(said).alias("hypothesis"))).first()
    for (sentence, method), text in sorted(made.items()):
        print(f"{sentence} {method}: {text}")
    print(*[f"{k}={rates[k]:.4f}" for k in ("wer", "cer", "wer_orthographic", "cer_orthographic")])
    return 0 if made["s1", "regex"] == said and rates.wer == rates.cer == 0.0 < rates.wer_orthographic else 1


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="glossaflow")
    sub = top.add_subparsers(required=True)

    def command(run, *needed: str) -> argparse.ArgumentParser:
        p = sub.add_parser(run.__name__.replace("_", "-"))
        p.set_defaults(run=run)
        for n in needed:
            p.add_argument(n)
        return p

    p = command(validate, "datasets")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--tolerance", type=int, default=2)
    p.add_argument("--show", type=int, default=100)
    p = command(normalise, "datasets", "output")
    p.add_argument("--method", nargs="+", choices=("raw", "regex"), default=["raw", "regex"])
    p = command(synthesis, "variants", "systems", "output")
    p.add_argument("--audio", default="audio")
    p.add_argument("--method", nargs="+")
    p.add_argument("--experiment")
    p.add_argument("--tier", choices=("pilot", "core"))
    p.add_argument("--exclude-system", nargs="*")
    p.add_argument("--exact-shuffle", action="store_true")
    p.add_argument("--scenario", nargs="*")
    p.add_argument("--exclude-scenario", nargs="*")
    p.add_argument("--max-tokens", type=int)
    p.add_argument("--per-scenario", type=int)
    p.add_argument("--seed", "--selection-seed")
    p.add_argument("--fail-on-missing", action="store_true")
    command(transcription, "manifest", "asr", "transcripts", "output")
    p = command(score, "manifest", "transcripts", "output")
    p.add_argument("--allow-missing", action="store_true")
    p.add_argument("--exclude-empty", action="store_true")
    p = command(check_audio, "manifest", "audio", "output")
    p.add_argument("--root", default=".")
    p.add_argument("--config-dir")
    p.add_argument("--min-duration", type=float, default=audio.SHORTEST)
    p.add_argument("--max-duration", type=float, default=audio.LONGEST)
    p.add_argument("--silence-peak", type=float, default=audio.SILENCE)
    p = command(validate_release, "root")
    p.add_argument("--preset", required=True)
    p.add_argument("--no-hashes", action="store_true")
    p.add_argument("--show", type=int, default=100)
    p = command(export_release, "manifest", "datasets", "variants", "output")
    p.add_argument("--exclude-system", nargs="*", default=[])
    command(example)
    p = command(fetch, "output")
    p.add_argument("--edition", default="el")
    p.add_argument("--agent", required=True)
    p.add_argument("--delay", type=float, default=pages.LEAST_DELAY)
    p.add_argument("--title", nargs="*", default=[])
    p.add_argument("--category", nargs="*", default=[])
    p.add_argument("--max-pages", type=int, default=20)
    p = command(candidates, "snapshot", "output")
    p.add_argument("--edition", default="el")
    p.add_argument("--min-chars", type=int, default=25)
    p.add_argument("--max-chars", type=int, default=300)
    p.add_argument("--include")
    p.add_argument("--exclude")
    p.add_argument("--min-words", type=int, default=0)
    p.add_argument("--max-words", type=int, default=0)
    p.add_argument("--boundary")
    p.add_argument("--split", choices=("punctuation", "paragraph"), default="punctuation")
    p.add_argument("--dataset-id", default="candidates")
    p.add_argument("--scenario", default="unreviewed")
    p.add_argument("--exact-sample", action="store_true")
    p.add_argument("--max-sentences", type=int, default=200)
    p.add_argument("--seed", type=int, default=20260610)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or local_session()
    try:
        return args.run(spark, args)
    finally:
        spark.catalog.clearCache()


if __name__ == "__main__":
    sys.exit(main())
