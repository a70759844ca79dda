import hashlib
import json
import shutil

import pytest

from glossaflow.cli import main
from glossaflow.operators import manifests
from glossaflow.plans import release
from glossaflow.sources import readers, sinks


@pytest.fixture(scope="module")
def core(spark):
    sentences = spark.createDataFrame([("d", "plain", str(i), f"πρόταση {i}") for i in range(3)], "dataset_id string, scenario string, id string, text string")
    rows = [("d", "d.json", "plain", str(i), "el", m, f"πρόταση {i}", f"πρόταση {i}", f"πρόταση  {i}" if m == "regex" else f"πρόταση {i}", None) for i in range(3) for m in ("raw", "regex")]
    variants = spark.createDataFrame(rows, "dataset_id string, dataset_file string, scenario string, id string, language string, method string, text string, original_text string, normalized_text string, source_url string")
    systems = spark.createDataFrame([(s, "f", s, True, "m", None, 1) for s in "ab"], "id string, family string, display_name string, enabled boolean, model_ref string, voice string, sample_rate_hz int")
    clips = manifests.synthesis_manifest(variants, systems, "audio").collect()
    return sentences, variants, systems, spark.createDataFrame(clips, manifests.synthesis_manifest(variants, systems, "audio").schema)


def broken(df):
    return {r.rule for r in df.collect()}


def test_sound_release(core):
    sentences, variants, systems, clips = core
    assert broken(release.manifest_violations(clips, sentences, variants, systems, per_system=6)) == set()
    index = manifests.handoff_index(clips)
    assert broken(release.handoff_violations(clips, index)) == set()
    jobs = manifests.transcription_manifest(clips, {"id": "w", "model": "m", "language": "el"}, "t").drop("command")
    assert broken(release.track_violations(clips, jobs, clips.select("utterance_id", "scenario"))) == set()


@pytest.mark.parametrize(
    ("change", "rules"),
    [
        (lambda c: c.filter("utterance_id <> 'd_0_raw_a'"), {"combination_missing", "clips_per_system"}),
        (lambda c: c.unionByName(c.limit(1)), {"utterance_twice", "audio_path_twice", "clips_per_system"}),
        (lambda c: c.replace("πρόταση 1", "άλλη", ["source_text"]), {"sentence_differs"}),
        (lambda c: c.replace("πρόταση  1", "άλλη", ["synthesis_text"]), {"variant_differs"}),
        (lambda c: c.replace("b", "x", ["tts_system_id"]), {"unknown_system"}),
        (lambda c: c.replace("audio/a/raw/d/0.wav", "/abs.wav", ["audio_path"]), {"path_not_portable"}),
    ],
)
def test_mutations(core, change, rules):
    sentences, variants, systems, clips = core
    assert broken(release.manifest_violations(change(clips), sentences, variants, systems, per_system=6)) == rules


def test_other_mutations(spark, core):
    sentences, variants, systems, clips = core
    assert "sentence_missing" in broken(release.manifest_violations(clips, sentences.limit(1), variants, systems))
    assert broken(release.handoff_violations(clips, manifests.handoff_index(clips).limit(3))) == {"handoff_missing"}
    assert broken(release.track_violations(clips, clips.limit(2), clips.withColumn("scenario", clips.dataset_id))) == {"transcription_coverage", "speaker_differs"}
    voiced = spark.createDataFrame([("d", "1", "x"), ("d", "1", "y"), ("d", "2", "x")], "dataset_id string, sentence_id string, speaker string")
    assert broken(release.speaker_violations(voiced, {"x": 2, "y": 2, "z": 1})) == {"speaker_varies", "speaker_balance"}


def release_folder(spark, root, core):
    """A small release in which everything fits: three sentences, two methods, two systems, two tracks."""
    sentences, variants, systems, clips = core
    put = lambda path, doc: sinks.write_document(doc, str(root / path))
    lines = lambda path, rows: ((root / path).parent.mkdir(parents=True, exist_ok=True), (root / path).write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8"))
    base = {"dataset_id": "d", "scenario": "plain", "language": "el", "total_sentences": 3, "source": "x"}
    texts = {r.id: r.text for r in sentences.collect()}
    put("datasets/p/source/d.json", base | {"sentences": [{"id": i, "text": t, "source_url": None, "word_count": 2, "characteristics": {}} for i, t in texts.items()]})
    for m in ("raw", "regex"):
        put(f"datasets/p/normalized/{m}/d.json", base | {"sentences": [{"id": r.id, "text": r.text, "original_text": r.original_text, "normalized_text": r.normalized_text} for r in variants.filter(f"method = '{m}'").collect()]})
    own = [{"id": s, "family": "f", "display_name": s, "model_ref": "m", "model_asset_id": "ma", "sample_rate_hz": 1, "core_clips": 6, "heldout_clips": 2} for s in "ab"]
    put("configs/p/systems.json", {"systems": own})
    put("configs/p/model_assets.json", {"assets": [{"id": "ma"}]})
    put("configs/p/reference_assets.json", {"assets": [{"id": "ref", "path": "refs/r.wav"}, *[{"id": f"natural_h{i}", "path": f"refs/h{i}.wav"} for i in range(2)]]})
    put("configs/p/asr.json", {"id": "w", "align": False})
    counts = {"sentences": 3, "scenarios": 1, "sentences_per_scenario": 3, "normalized_inputs": 6, "systems": 2, "core_clips": 12, "heldout_clips": 4, "heldout_sentences": 2}
    put("configs/p/paper_protocol.json", {"counts": counts, "methods": ["raw", "regex"], "system_ids": ["a", "b"], "excluded_systems": ["z"], "sentences": [{"dataset_id": "d", "sentence_id": i} for i in texts]})
    tracks = {"core": [r.asDict(True) | {"reference_asset_id": "ref", "reference_audio_path": "refs/r.wav"} for r in clips.collect()]}
    first = tracks["core"][0]
    tracks["heldout"] = [
        first | {"utterance_id": f"h{i}{s}", "dataset_id": "h", "sentence_id": f"h{i}", "preprocessing_method": "raw", "source_text": f"λόγια {i}", "synthesis_text": f"λόγια {i}", "tts_system_id": s, "audio_path": f"audio/h/{i}{s}.wav", "reference_asset_id": f"natural_h{i}", "reference_audio_path": f"refs/h{i}.wav"}
        for i in range(2) for s in "ab"
    ]
    for t, rows in tracks.items():
        rows = [r | {"handoff_text": " ".join(r["synthesis_text"].split())} for r in rows]
        lines(f"manifests/p/synthesis_{t}.jsonl", rows)
        jobs = manifests.transcription_manifest(spark.createDataFrame(rows, release.CLIPS), {"id": "w", "model": "m", "language": "el", "align": False}, "tr")
        lines(f"manifests/p/transcription_{t}.jsonl", [r.asDict(True) for r in jobs.collect()])
        keys = ("utterance_id", "dataset_id", "sentence_id", "scenario", "preprocessing_method", "tts_system_id", "audio_path", "reference_asset_id", "reference_audio_path")
        lines(f"manifests/p/speaker_references_{t}.jsonl", [{k: r[k] for k in keys} for r in rows])
    files = sorted(f for d in ("configs", "datasets", "manifests") for f in (root / d).rglob("*.json*"))
    (root / "releases/p").mkdir(parents=True)
    (root / "releases/p/inputs.sha256").write_text("".join(f"{hashlib.sha256(f.read_bytes()).hexdigest()}  {f.relative_to(root)}\n" for f in files))


@pytest.fixture(scope="module")
def folder(spark, core, tmp_path_factory):
    root = tmp_path_factory.mktemp("release")
    release_folder(spark, root, core)
    return root


def changed(folder, tmp_path, path, change):
    root = tmp_path / "r"
    shutil.copytree(folder, root)
    change(root / path)
    return root


def test_release_folder(spark, folder, capsys):
    assert main(["validate-release", str(folder), "--preset", "p"], spark) == 0 and "violations=0" in capsys.readouterr().out


def rewritten(old, new, n=1):
    return lambda f: f.write_text(f.read_text(encoding="utf-8").replace(old, new, n), encoding="utf-8")


@pytest.mark.parametrize(
    ("path", "change", "rules"),
    [
        ("manifests/p/synthesis_core.jsonl", lambda f: f.write_text("\n".join(f.read_text(encoding="utf-8").splitlines()[:-1]), encoding="utf-8"), {"count_differs", "core_clips_of_system", "combination_missing", "transcription_coverage", "speaker_coverage"}),
        ("manifests/p/synthesis_core.jsonl", rewritten('"synthesis_text": "πρόταση 0"', '"synthesis_text": "άλλη"'), {"variant_differs", "handoff_differs", "job_text_differs"}),
        ("manifests/p/synthesis_core.jsonl", rewritten('"reference_asset_id": "ref"', '"reference_asset_id": "other"'), {"unknown_reference", "speaker_differs"}),
        ("manifests/p/synthesis_heldout.jsonl", rewritten('"source_text": "λόγια 0"', '"source_text": "άλλα"'), {"heldout_text_changed", "heldout_text_varies"}), ("manifests/p/synthesis_heldout.jsonl", rewritten('"sample_rate_hz": 1', '"sample_rate_hz": 2'), {"rate_differs"}),
        ("configs/p/paper_protocol.json", rewritten('"core_clips": 12', '"core_clips": 13'), {"count_differs"}), ("configs/p/paper_protocol.json", rewritten('"sentence_id": "2"', '"sentence_id": "9"'), {"pinned_sentences_differ"}), ("configs/p/paper_protocol.json", rewritten('"z"', '"b"'), {"excluded_system"}),
        ("configs/p/systems.json", rewritten('"id": "b"', '"id": "x"'), {"roster_differs", "core_roster_differs", "heldout_roster_differs", "unknown_system", "core_clips_of_system", "heldout_clips_of_system"}), ("configs/p/model_assets.json", rewritten('"ma"', '"mb"'), {"unknown_model"}),
        ("datasets/p/source/d.json", rewritten('"text": "πρόταση 1"', '"text": ""'), {"data_set_error", "original_differs", "sentence_differs"}), ("datasets/p/normalized/raw/d.json", rewritten('"id": "1"', '"id": "0"'), {"variant_twice", "variant_lacking", "original_differs", "utterance_twice"}),
        ("manifests/p/transcription_core.jsonl", rewritten('"--no_align"', '"--align_model"'), {"job_settings"}),
    ],
)
def test_changed_release_folders(spark, folder, tmp_path, path, change, rules):
    found = broken(release.release_violations(spark, str(changed(folder, tmp_path, path, change)), "p", hashes=False))
    assert rules - {"utterance_twice"} <= found and (rules & {"utterance_twice"} or found <= rules | {"variant_missing", "variant_differs", "sentence_differs"})


def test_changed_bytes(spark, folder, tmp_path, capsys):
    root = changed(folder, tmp_path, "configs/p/asr.json", lambda f: f.write_text('{"id": "w", "align": false}'))
    (root / "datasets/p/source/e.json").write_text("{}")
    assert main(["validate-release", str(root), "--preset", "p"], spark) == 1
    said = capsys.readouterr().out
    assert "inventory configs/p/asr.json::changed" in said and "inventory datasets/p/source/e.json::unlisted" in said


def test_speaker_split(spark):
    rows = [("s", "d", str(i), i % 2) for i in range(4)] + [("t", "d", "9", 0), ("u", "d", "7", 0), ("u", "d", "8", 1), ("u", "d", "6", 1)]
    clips = spark.createDataFrame(rows, "scenario string, dataset_id string, sentence_id string, speaker int")
    assert {r.key for r in release.split_violations(clips, ["scenario"]).collect()} == {"t", "u"}


def test_export(spark, core, tmp_path, capsys):
    sentences, variants, systems, clips = core
    sentences = sentences.selectExpr("*", "cast(5 as bigint) word_count")
    variants = variants.selectExpr("*", "if(method = 'regex', array('x'), null) normalization_warnings")
    census = release.export_release(clips, sentences, variants, str(tmp_path / "e"), excluded=["b"])
    assert census == {"clips": 6, "sentences": 3, "variants": 6, "word_counts": 3, "warnings": 3, "handoff_changes": 3}
    listed = {r.path.split("/")[0] for r in readers.inventory(spark, str(tmp_path / "e" / "inventory")).collect()}
    assert listed == {"clips", "sentences", "variants", "audit"}
    with pytest.raises(Exception, match="(?i)already exists"):
        release.export_release(clips, sentences, variants, str(tmp_path / "e"))
    with pytest.raises(ValueError, match="variant_differs"):
        release.export_release(clips.replace("πρόταση  1", "άλλη", ["synthesis_text"]), sentences, variants, str(tmp_path / "f"))
    assert main(["example"], spark) == 0 and "wer=0.0000" in capsys.readouterr().out
