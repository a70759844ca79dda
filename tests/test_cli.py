import json

import pytest

from glossaflow.cli import main
from glossaflow.functions.text import digest  # noqa: F401
from glossaflow.operators import variants


def dataset(folder, name="d", n=4, language="el", **changes):
    folder.mkdir(exist_ok=True)
    rows = [{"id": f"s{i}", "text": f"Πρόταση {i} με λέξεις.", "source_url": None, "word_count": 4, "characteristics": {}} for i in range(n)]
    doc = {"dataset_id": name, "scenario": "plain", "language": language, "total_sentences": n, "source": "x", "sentences": rows} | changes
    (folder / f"{name}.json").write_text(json.dumps(doc), encoding="utf-8")


def test_end_to_end(spark, tmp_path, capsys):
    dataset(tmp_path / "data")
    dataset(tmp_path / "data", "e", 3)
    run = lambda *a: main([str(x) for x in a], spark)
    assert run("validate", tmp_path / "data") == 0 and "errors=0 warnings=0" in capsys.readouterr().out
    assert run("normalise", tmp_path / "data", tmp_path / "variants") == 0
    (tmp_path / "systems.json").write_text(json.dumps({"systems": [{"id": "a", "family": "f", "display_name": "A", "model_ref": "m"}, {"id": "b", "family": "f", "display_name": "B", "model_ref": "m", "enabled": False}]}))
    chosen = []
    for k in range(2):
        assert run("synthesis", tmp_path / "variants", tmp_path / "systems.json", tmp_path / f"m{k}", "--per-scenario", 5, "--seed", "7") == 0
        chosen.append({r.utterance_id for r in spark.read.json(str(tmp_path / f"m{k}")).collect()})
    assert chosen[0] == chosen[1] and len(chosen[0]) == 10
    (tmp_path / "asr.json").write_text(json.dumps({"id": "w", "model": "m", "language": "el"}))
    assert run("transcription", tmp_path / "m0", tmp_path / "asr.json", tmp_path / "tr", tmp_path / "jobs") == 0
    for r in spark.read.json(str(tmp_path / "jobs")).collect():
        path = tmp_path / r.transcript_path if not r.transcript_path.startswith("/") else __import__("pathlib").Path(r.transcript_path)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps({"text": r.source_text}), encoding="utf-8")
    assert run("score", tmp_path / "jobs", tmp_path / "tr", tmp_path / "scores") == 0
    summary = json.loads((tmp_path / "scores.summary.json").read_text())
    assert summary["overall"]["count"] == 10 and summary["overall"]["mean_wer"] == 0.0 and summary["overall"]["mean_wer_orthographic"] > 0
    assert run("check-audio", tmp_path / "m0", tmp_path / "data", tmp_path / "qc") == 0
    assert json.loads((tmp_path / "qc.summary.json").read_text())["overall"]["missing"] == 10
    path.unlink()
    assert run("score", tmp_path / "jobs", tmp_path / "tr", tmp_path / "scores2") == 1


def test_bad_data_fails(spark, tmp_path):
    dataset(tmp_path / "data", total_sentences=9)
    assert main(["validate", str(tmp_path / "data")], spark) == 1


def test_candidates(spark, tmp_path, capsys):
    import hashlib

    html = "<p>Πρώτη πρόταση με αρκετές λέξεις εδώ. Δεύτερη πρόταση με αρκετές λέξεις εδώ.</p>"
    page = {"page_id": 1, "revision_id": 2, "title": "t", "html": html, "html_sha256": hashlib.sha256(html.encode()).hexdigest()}
    (tmp_path / "s.json").write_text(json.dumps({"edition": "el", "language": "el", "pages": [page, page | {"page_id": 3}]}))
    assert main(["candidates", str(tmp_path / "s.json"), str(tmp_path / "c")], spark) == 0
    assert "duplicate_text=2" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "c")).count() == 2
    (tmp_path / "bad.json").write_text(json.dumps({"edition": "el", "language": "el", "pages": [page | {"html": "x"}]}))
    assert main(["candidates", str(tmp_path / "bad.json"), str(tmp_path / "c2")], spark) == 1
    for wrong in (["--boundary", "(x)"], ["--min-chars", "0"], ["--dataset-id", "a b"]):
        assert main(["candidates", str(tmp_path / "s.json"), str(tmp_path / "c3"), *wrong], spark) == 2
    assert main(["candidates", str(tmp_path / "s.json"), str(tmp_path / "c4"), "--exact-sample", "--max-sentences", "1", "--split", "paragraph"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "c4")).first().provenance.title == "t" and "selected=1" in capsys.readouterr().out


def test_tiers(spark, tmp_path):
    dataset(tmp_path / "data", n=9)
    assert main(["normalise", str(tmp_path / "data"), str(tmp_path / "v")], spark) == 0
    (tmp_path / "systems.json").write_text(json.dumps({"systems": [{"id": i, "family": "f", "display_name": "A", "model_ref": "m"} for i in ("a", "b")]}))
    (tmp_path / "x.json").write_text(json.dumps({"preprocessing_methods": ["raw"], "pilot": {"scenarios": ["plain"], "sentences_per_scenario": 2, "preprocessing_methods": ["regex"], "selection_seed": 5}}))
    go = lambda out, *a: main(["synthesis", str(tmp_path / "v"), str(tmp_path / "systems.json"), str(tmp_path / out), *a], spark)
    assert go("m", "--experiment", str(tmp_path / "x.json"), "--tier", "pilot", "--exclude-system", "b") == 0
    rows = spark.read.json(str(tmp_path / "m")).collect()
    assert len(rows) == 2 and {(r.preprocessing_method, r.tts_system_id) for r in rows} == {("regex", "a")}
    assert go("n", "--experiment", str(tmp_path / "x.json")) == 0 and spark.read.json(str(tmp_path / "n")).count() == 18
    assert go("o", "--experiment", str(tmp_path / "x.json"), "--tier", "pilot", "--selection-seed", "none") == 0
    assert {r.sentence_id for r in spark.read.json(str(tmp_path / "o")).collect()} == {"s0", "s1"}
    assert go("p", "--per-scenario", "3", "--seed", "4", "--exact-shuffle") == 0 and spark.read.json(str(tmp_path / "p")).count() == 12
    assert go("q", "--tier", "core") == 2


def test_variants(spark):
    rows = spark.createDataFrame([("d", "el", "το 5"), ("e", "en", "at 5"), ("f", None, "το 6")], "dataset_id string, language string, text string")

    def load():
        return lambda texts: ["Λυπάμαι, δεν μπορώ" if "6" in t else f"«{t} δύο»" for t in texts]

    got = {r.dataset_id: r for r in variants.variant(rows, "llm", load=load).collect()}
    assert got["d"].normalized_text == "το 5 δύο" and got["e"].normalized_text == "at 5" and got["e"].normalizer == "identity_non_greek"
    assert got["f"].normalized_text == "το 6" and got["f"].normalization_warnings
    assert [r.normalized_text for r in variants.variant(rows, "regex").orderBy("dataset_id").collect()] == ["το πέντε", "at 5", "το έξι"]
    assert variants.variant_report(variants.variant(rows, "llm", load=load)).filter("sentences_with_warnings = 1").count() == 1
    for method in ("other", "llm"):
        with pytest.raises(ValueError, match="unknown|needs"):
            variants.variant(rows, method)
