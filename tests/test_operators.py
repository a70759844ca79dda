import json
import struct

import pytest
from pyspark.sql import functions as F

from glossaflow.functions import answers, vectors
from glossaflow.operators import audio, checks, collect, manifests, ranking, summaries


def test_error_summary(spark):
    rows = spark.createDataFrame([("a", "raw", "s", 0.5, 0.1, 0.2, 0.3), ("a", "raw", None, None, 0.3, 0.2, 0.3)], "tts_system_id string, preprocessing_method string, scenario string, wer double, cer double, wer_orthographic double, cer_orthographic double")
    got = {(r.grouping, r.key): r for r in summaries.error_summary(rows).collect()}
    assert len(got) == 8 and got["overall", "all"]["count"] == 2 and got["overall", "all"].mean_wer == 0.5
    assert got["by_scenario", "None"].mean_wer is None and got["by_system_method", "a::raw"].mean_cer == 0.2


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "tts_system_id string, preprocessing_method string, scenario string, utmos double")
    assert summaries.score_summary(empty, "utmos").filter("`count` > 0").count() == 0


def test_mos_ignores_rows_without_overall(spark):
    rows = spark.createDataFrame([("a", "raw", "s", 4.0, {"clarity": 4.0}), ("a", "raw", "s", None, {"clarity": 1.0})], "tts_system_id string, preprocessing_method string, scenario string, mos_overall double, mos map<string,double>")
    overall = summaries.mos_summary(rows, ["clarity"]).filter("grouping = 'overall'").first()
    assert (overall["count"], overall.scored, overall.mean_clarity) == (2, 1, 4.0)


def test_python_rounding(spark):
    rows = spark.createDataFrame([(2.00005,), (0.00015,), (None,)], "x double")
    assert [r.x for r in summaries.python_rounded(rows, {"x": 4}).collect()] == [2.0, 0.0001, None]


def test_running_index_and_first_rows(spark):
    rows = spark.createDataFrame([("h", i) for i in range(500)] + [(None, i) for i in range(3)], "k string, i int").repartition(7)
    got = ranking.running_index(rows, ["k"], ["i"]).collect()
    assert all(r["index"] == r.i + 1 for r in got) and len(got) == 503
    assert {(r.k, r.i) for r in ranking.first_rows(rows, ["k"], ["i"]).collect()} == {("h", 0), (None, 0)}


def test_manifests(spark):
    variants = spark.createDataFrame([("d", "d.json", "s", "1", "el", "raw", "ένα", "", None, None), ("d", "d.json", "s", "1", "el", "regex", "ένα", "ένα δύο", "τρία  τέσσερα", None)], "dataset_id string, dataset_file string, scenario string, id string, language string, method string, text string, original_text string, normalized_text string, source_url string")
    systems = spark.createDataFrame([("a b", "f", "A", None, "m", "v", 1), ("c", "f", "C", False, "m", None, 1)], "id string, family string, display_name string, enabled boolean, model_ref string, voice string, sample_rate_hz int")
    rows = {r.preprocessing_method: r for r in manifests.synthesis_manifest(variants, systems, "audio").collect()}
    assert rows["raw"].source_text == "ένα" and rows["raw"].audio_path == "audio/a b/raw/d/1.wav" and rows["raw"].utterance_id == "d_1_raw_a_b" and len(rows) == 2
    jobs = manifests.transcription_manifest(manifests.synthesis_manifest(variants, systems, "audio"), {"id": "x", "model": "m", "language": "en", "align": False}, "tr").collect()
    assert jobs[0].command[-1] == "--no_align" and jobs[0].transcript_path.startswith("tr/x/a b/")
    assert jobs[0].command[jobs[0].command.index("--language") + 1] == "el"
    assert jobs[0].command[jobs[0].command.index("--output_dir") + 1].startswith("tr/x/")
    index = manifests.handoff_index(manifests.synthesis_manifest(variants, systems, "audio")).orderBy("handoff_index").collect()
    plan = manifests.copy_plan(manifests.handoff_index(manifests.synthesis_manifest(variants, systems, "audio")), spark.createDataFrame([("in/a b/001_ft.wav",)], "path string"), "in")
    assert [tuple(r) for r in manifests.copy_summary(plan).collect()] == [("a b", 1, 1)]
    assert [r.returned_wav for r in index] == ["001_ft.wav", "002_ft.wav"] and index[1].text_changed


def test_selection(spark):
    rows = spark.createDataFrame([("d", i, f"s_{i:03d}") for i in range(20)], "dataset_id string, sentence_index int, id string")
    assert [r.id for r in manifests.first_of_dataset(rows, 3).orderBy("id").collect()] == ["s_000", "s_001", "s_002"]
    a, b = ({r.id for r in manifests.shuffled_selection(rows.repartition(n), 5, 7).collect()} for n in (1, 5))
    assert a == b and len(a) == 5
    assert manifests.hash_selected(rows, 5, "x").count() == 5
    import random

    picked = {r.id for r in manifests.sampled_exactly(rows.repartition(7), 4, 1).collect()}
    assert picked == set(random.Random(1).sample(sorted(f"s_{i:03d}" for i in range(20)), 4)) and manifests.sampled_exactly(rows, 40, 1).count() == 20
    assert {r.id for r in manifests.sampled_by_hash(rows, 4, 1).collect()} == {r.id for r in manifests.sampled_by_hash(rows.repartition(6), 4, 1).collect()}
    big = spark.range(3000).selectExpr("if(id < 2800, 'd', 'e') dataset_id", "cast(id as int) sentence_index", "cast(id as string) id")
    assert {r.n for r in manifests.first_of_dataset(big, 1500).groupBy("dataset_id").agg(F.count("*").alias("n")).collect()} == {1500, 200}
    assert manifests.first_of_dataset(big, 1500).filter("dataset_id = 'd'").agg(F.max("sentence_index")).first()[0] == 1499
    caps = spark.createDataFrame([("s", "a", 3), ("s", "b", 4), ("s", "c", 2)], "scenario string, dataset_file string, eligible int")
    assert [r.taken for r in manifests.scenario_caps(caps, 5).orderBy("dataset_file").collect()] == [3, 2, 0]


def test_reference_resolution(spark):
    rows = spark.createDataFrame([("s1", "f", ("v",), None), ("s2", "f", ("v",), None), ("s2", "g", ("v",), None), ("s2", "g", (None,), None), ("s1", "f", ("v",), "own.wav")], "tts_system_id string, tts_family string, metadata struct<voice:string>, ref string")
    got = manifests.resolve_references(rows, {"s1": "1", "x": ""}, {"f::v": "2"}, {"v": "3"}, "ref").collect()
    assert [(r.reference_path, r.reference_selector) for r in got] == [("1", "system:s1"), ("2", "family_voice:f::v"), ("3", "voice:v"), (None, None), ("own.wav", "row:ref")]


def test_paths_tiers_and_assets(spark):
    listing = spark.createDataFrame([("/root/a/1.wav",)], "path string")
    rows = spark.createDataFrame([("a/1.wav",), ("b/2.wav",), ("/x/3.wav",), (None,)], "audio_path string")
    got = {r.audio_path: r.resolved_path for r in manifests.resolve_audio_paths(rows, listing, "/root/", "/conf").collect()}
    assert got == {"a/1.wav": "/root/a/1.wav", "b/2.wav": "/conf/b/2.wav", "/x/3.wav": "/x/3.wav", None: None}
    paths = spark.createDataFrame([("/any/refs/f.wav",), ("natural/s_1.wav",), ("natural/s_1.mp3",), (None,)], "path string")
    assets = {r.path: (r.asset_id, r.asset_path, r.asset_kind) for r in manifests.reference_assets(paths, [("refs/f.wav", "shared_f", "refs/shared_f.wav", "voice")], [("natural/", ".wav", "natural_", "anchor")]).collect()}
    assert assets["/any/refs/f.wav"] == ("shared_f", "refs/shared_f.wav", "voice") and assets["natural/s_1.wav"] == ("natural_s_1", "natural/s_1.wav", "anchor") and assets["natural/s_1.mp3"] == assets[None] == (None, None, None)
    experiment = {"preprocessing_methods": ["raw"], "core": {"scenarios": ["b", "a"], "sentences_per_scenario": "20", "preprocessing_methods": ["raw", "llm"], "selection_seed": 7}}
    assert manifests.tier(experiment, None) == {"methods": ["raw"], "scenarios": None, "per_scenario": None, "seed": None}
    assert manifests.tier(experiment, "core") == {"methods": ["raw", "llm"], "scenarios": ["a", "b"], "per_scenario": 20, "seed": "7"}
    assert manifests.tier(experiment, "core", methods=["x"], seed="None")["seed"] is None and manifests.tier(experiment, "core", methods=["x"])["methods"] == ["x"]
    clips = spark.createDataFrame([("f", "1", "a"), ("f", "2", "b"), ("f", "1", "b"), ("g", "1", None)], "dataset_file string, sentence_id string, tts_system_id string")
    assert manifests.without_systems(clips, ["b"]).count() == 2 and {(r.dataset_file, r.n_ids, tuple(r.ids)) for r in manifests.selected_ids(clips).collect()} == {("f", 2, ("1", "2")), ("g", 1, ("1",))}


def document(**changes):
    sentence = {"id": "1", "text": "δύο λέξεις", "source_url": None, "word_count": 2, "characteristics": {}}
    return {"dataset_id": "d", "scenario": "s", "language": "el", "total_sentences": 1, "source": "x", "sentences": [sentence]} | changes


@pytest.mark.parametrize(
    ("value", "codes"),
    [
        (document(), []), ([], ["json_error"]), (document(sentences={}), ["sentences_not_list"]), (document(total_sentences=3), ["sentence_count_mismatch"]),
        (document(sentences=[1]), ["sentence_not_object"]), (document(sentences=[{"id": "1", "text": "", "source_url": None, "word_count": "2", "characteristics": []}]), ["characteristics_not_object", "empty_text", "word_count_not_int"]),
        (document(sentences=[{"id": "1", "text": "α", "word_count": 9, "characteristics": {}}]), ["missing_sentence_field", "word_count_mismatch"]),
        (document(sentences=document()["sentences"] * 2, total_sentences=2), ["duplicate_sentence_id"]),
        ({k: v for k, v in document().items() if k != "source"}, ["missing_top_level_field"]),
        (document(total_sentences="1"), ["sentence_count_mismatch"]), (document(total_sentences=1.5), ["sentence_count_mismatch"]), (document(total_sentences=1.0), []), (document(total_sentences=True), []), (document(total_sentences=None), ["sentence_count_mismatch"]),
        (document(sentences=[document()["sentences"][0] | {"text": "", "word_count": 9}]), ["empty_text", "word_count_mismatch"]), (document(sentences=[document()["sentences"][0] | {"text": 5, "word_count": "x"}]), ["empty_text"]),
        (document(sentences=[document()["sentences"][0] | {"id": None}] * 2, total_sentences=2), ["duplicate_sentence_id"]), (document(sentences=[{k: v for k, v in document()["sentences"][0].items() if k != "id"}] * 2, total_sentences=2), ["missing_sentence_field"] * 2),
        (document(sentences=[document()["sentences"][0] | {"id": 1}, document()["sentences"][0]], total_sentences=2), ["duplicate_sentence_id"]),
    ],
)
def test_dataset_rules(spark, value, codes):
    files = spark.createDataFrame([("f", json.dumps(value))], "path string, value string")
    assert sorted(r.code for r in checks.dataset_issues(files).collect()) == codes


def test_unreadable_json_and_nothing(spark):
    files = spark.createDataFrame([("f", "{"), ("g", "")], "path string, value string")
    assert [r.code for r in checks.dataset_issues(files).collect()] == ["json_error", "json_error"]
    assert checks.dataset_issues(files.limit(0)).count() == 0


def test_mutations_fire(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y"), ("2", "z")], "id string, v string")
    b = spark.createDataFrame([("1", "x"), ("3", None)], "id string, v string")
    assert [r.id for r in checks.doubled_keys(a, ["id"]).collect()] == ["2"]
    assert [r.id for r in checks.broken_dependencies(a, ["id"], "v").collect()] == ["2"]
    assert [r.id for r in checks.orphans(a, ["id"], b, ["id"]).collect()] == ["2"]
    assert {(r.id, r.side) for r in checks.uncovered(a, b, ["id"]).collect()} == {("2", "left"), ("3", "right")}
    assert checks.cartesian_gaps(a, [["id"], ["v"]]).count() == 3
    sides = checks.cartesian_differences(a, [b.select("id"), b.select("v")]).collect()
    assert {(r.id, r.v, r.side) for r in sides} == {("1", None, "missing"), ("3", "x", "missing"), ("3", None, "missing"), ("2", "y", "extra"), ("2", "z", "extra")}
    assert checks.unbalanced(a, ["id"], 1).count() == 1
    assert checks.differing_columns(a, b, ["id"], ["v"]).count() == 0
    assert checks.unequal_sets(a, b).count() == 3
    listed = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", "3")], "path string, sha256 string")
    found = spark.createDataFrame([("p", "1"), ("q", "9"), ("s", "4")], "path string, sha256 string")
    assert {(r.path, r.problem) for r in checks.hash_mismatches(listed, found).collect()} == {("q", "changed"), ("r", "missing"), ("s", "unlisted")}


PAGE = "<p>Ένα <b>δύο</b><sup class='reference'>[1]</sup> τρία.</p><p>x<sup>2</sup></p><table><p>όχι</p></table><p>χαμένο<p>Τέσσερα<br>πέντε.</p><p></p>"


def test_paragraphs(spark):
    assert collect.page_paragraphs(PAGE) == [("Ένα δύο τρία.", True), ("x2", False), ("Τέσσερα πέντε.", True)]
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>αθώο & καλό")], "page_id bigint, html string")
    assert collect.paragraphs(pages).filter("kept").count() == 2
    signed = pages.withColumn("html_sha256", F.sha2("html", 256)).withColumn("html", F.when(F.col("page_id") == 3, "other").otherwise(F.col("html")))
    assert [r.page_id for r in collect.tampered(signed.filter("html is not null")).collect()] == [3]


def test_candidates(spark):
    docs = spark.createDataFrame([(1, "Πρώτη πρόταση με λέξεις. Δεύτερη πρόταση με 12 λέξεις!"), (2, "Πρώτη πρόταση με λέξεις. Μικρή."), (3, None)], "doc_id int, text string")
    judged = collect.judged_candidates(collect.chunks(docs).drop("text"), ["doc_id", "chunk_index"], min_chars=10, exclude="[0-9]")
    kept = collect.kept_candidates(judged)
    assert [(r.doc_id, r.chunk_index, r.words) for r in kept.collect()] == [(1, 0, 4)]
    counts = {r.counter: r.n for r in collect.collection_counts(judged).collect()}
    assert counts == {"candidates": 4, "eligible_unique": 1, "exclude_pattern": 1, "duplicate_text": 1, "character_length": 1}
    included = collect.judged_candidates(collect.chunks(docs).drop("text"), ["doc_id", "chunk_index"], min_chars=10, include="Πρώτη")
    assert {r.counter: r.n for r in collect.collection_counts(included).collect()} == {"candidates": 4, "eligible_unique": 1, "include_pattern": 1, "duplicate_text": 1, "character_length": 1}
    read = spark.createDataFrame([(True,), (False,), (True,)], "kept boolean")
    nothing = {r.counter: r.n for r in collect.collection_counts(judged.limit(0), read, 0).collect()}
    assert nothing == {"candidates": 0, "eligible_unique": 0, "selected": 0, "paragraphs": 2, "markup_paragraphs_rejected": 1}
    row = collect.candidates(kept.withColumns({"page_id": F.lit(7), "revision_id": F.lit(8), "title": F.lit("Τ"), "revision_url": F.lit("u"), "paragraph_index": F.lit(3)}), "el").first()
    assert (row.source_url, row.provenance.title, row.provenance.paragraph_index, row.provenance.text_sha256, row.provenance.article_url) == ("u", "Τ", 3, row.text_sha256, None)
    hot = spark.createDataFrame([(i, 1 if i % 3 else None, 0, None) for i in range(6000)] + [(7000 + i, 100 + i % 50, 0, None) for i in range(200)], "pos int, page_id bigint, namespace int, disambiguation boolean").repartition(5)
    reasons = {r.pos: r.reason for r in collect.page_reasons(hot).collect()}
    assert len(reasons) == 6200 and reasons[0] == "missing_or_invalid" and reasons[1] is None and reasons[2] == "duplicate_page" and reasons[7000] is None and reasons[7050] == "duplicate_page"
    assert collect.page_reasons(hot.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, 7, 0, None), (2, 7, 0, None), (3, None, 0, None), (4, 8, 1, None), (5, 9, 0, True)], "pos int, page_id bigint, namespace int, disambiguation boolean")
    assert [r.reason for r in collect.page_reasons(pages).orderBy("pos").collect()] == [None, "duplicate_page", "missing_or_invalid", "not_an_article", "disambiguation"]


@pytest.mark.parametrize("bad", [{"min_chars": 0}, {"max_chars": 5}, {"min_words": -1}, {"min_words": 5, "max_words": 4}, {"max_sentences": 0}, {"dataset_id": "a b"}, {"scenario": " "}, {"boundary": "(x)"}, {"boundary": "x*"}, {"boundary": "("}, {"include": "["}])
def test_options_of_a_candidate_build(bad):
    collect.checked_options()
    with pytest.raises(ValueError):
        collect.checked_options(**bad)


def judged(spark, text, dims=("clarity",)):
    return spark.createDataFrame([(text,)], "t string").select(answers.judged(F.col("t"), dims).alias("j")).first().j


@pytest.mark.parametrize(
    ("said", "overall", "clarity"),
    [
        ('{"clarity": 4, "overall": 9}', 5.0, 4.0), ('Sure! {"scores": {"clarity": "3.5/5"}} bye', 3.5, 3.5), ('{"clarity": true, "overall_mos": 2}', 2.0, None), ("nonsense", None, None),
        ("", None, None), (None, None, None), ('{"clarity": -3}', 1.0, 1.0), ("[1]", None, None),
    ],
)
def test_judge(spark, said, overall, clarity):
    j = judged(spark, said)
    assert (j.mos_overall, j.mos["clarity"], j.parse_ok) == (overall, clarity, overall is not None)


@pytest.mark.parametrize(
    ("original", "answer", "text", "n"),
    [
        ("το ΔΝΤ", "```\nΈξοδος: «Το Διεθνές Νομισματικό Ταμείο (ΔΝΤ) .»\n```", "Το Διεθνές Νομισματικό Ταμείο.", 0), ("ένα δύο", '"ένα δύο"', "ένα δύο", 0), ("ένα δύο", "", "ένα δύο", 1), ("ένα δύο", None, "ένα δύο", 1),
        ("ένα δύο τρία", "Λυπάμαι, δεν μπορώ", "ένα δύο τρία", 1), ("λυπάμαι πολύ", "λυπάμαι πολύ", "λυπάμαι πολύ", 0), ("αβγδεζηθικ", "αβ", "αβγδεζηθικ", 1),
        ("Μέλος του ΔΝΤ εδώ.", "Μέλος του Διεθνούς Ταμείου (ΔΝΤ) εδώ .", "Μέλος του Διεθνούς Ταμείου εδώ.", 0),
    ],
)
def test_answers(spark, original, answer, text, n):
    got = spark.createDataFrame([(original, answer)], "o string, a string").select(answers.checked_answer(F.col("o"), F.col("a")).alias("c")).first().c
    assert len(got.warnings) == n and got.text == (original if text is None else text)


def test_responses(spark):
    reply = json.dumps({"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "b"}]}}], "usage_metadata": {"n": 1}})
    row = spark.createDataFrame([(reply,), ("{}",)], "r string").select(answers.response_text(F.col("r")).alias("t"), answers.usage_metadata(F.col("r")).alias("u")).collect()
    assert (row[0].t, json.loads(row[0].u), row[1].t, row[1].u) == ("a\nb", {"n": 1}, None, None)
    line = spark.range(1).select(answers.batch_request(F.lit('k"1'), F.lit("προς"), F.lit("audio/wav"), audio=F.lit(b"xy"), instructions="i", config={"temperature": 0}).alias("l")).first().l
    assert json.loads(line)["request"]["contents"][0]["parts"][1]["inline_data"]["data"] == "eHk=" and json.loads(line)["key"] == 'k"1'


def test_prompts_and_settings(spark):
    from glossaflow.session import first_env

    meant = {"clarity": ("words as in the text", "words that can be understood"), "pace": "speed"}
    made = {(style, ref): answers.system_prompt(meant, style, ref) for style in answers.STYLES for ref in (True, False)}
    assert len(set(made.values())) == 4 and "words as in the text" in made["strict", True] and "words that can be understood" in made["standard", False]
    assert '"pace_anomalies"' in made["strict", False] and '"overall_mos"' in made["strict", True] and '"overall": 1-5' in made["standard", True]
    with pytest.raises(ValueError):
        answers.system_prompt(meant, "mild")
    rows = spark.createDataFrame([("λόγια",), ("",), (None,)], "t string")
    said = [r.p for r in rows.select(answers.user_prompt(F.col("t")).alias("p")).collect()]
    assert said == ["Rate the attached clip. It should say: λόγια", "Rate the attached clip.", "Rate the attached clip."] and rows.select(answers.user_prompt(F.col("t"), False).alias("p")).first().p == said[1]
    assert first_env(["A", "B"], {"A": "", "B": "x"}) == "x" and first_env(["A"], {}) is None


def test_model_hooks(spark):
    from glossaflow.operators import models

    clips = spark.createDataFrame([("u1", "α", "a.wav", "r.wav", 1), ("u2", "", "b.wav", None, 2), ("u3", "γ", "c.wav", "r.wav", 3)], "utterance_id string, source_text string, audio_path string, reference_path string, mos_rank int").repartition(2)

    def judge():
        return lambda rows: [None if r["audio_path"] == "c.wav" else '{"clarity": 4, "overall": %d}' % (len(r["prompt"]) > 30) for r in rows]

    got = {r.utterance_id: r for r in models.judged_clips(clips, judge, {"clarity": "c"}, style="strict").collect()}
    assert got["u1"].mos == {"clarity": 4.0} and got["u1"].mos_overall == 1.0 and got["u3"].parse_ok is False and got["u2"].mos_rank == 2
    lines = models.judge_batch(clips, {"clarity": "c"}, config={"temperature": 0})
    assert json.loads(lines.filter("line like '%u1%'").first().line)["request"]["contents"][0]["parts"][1]["file_data"] == {"file_uri": "a.wav", "mime_type": "audio/wav"}
    reply = {"key": "u1", "response": {"candidates": [{"content": {"parts": [{"text": '{"clarity": 9}'}]}}], "usageMetadata": {"n": 1}}}
    read = models.judge_replies(spark.createDataFrame([(json.dumps(reply),), ("{}",)], "line string"), {"clarity": "c"}).collect()
    assert (read[0].utterance_id, read[0].mos_overall, read[1].parse_ok) == ("u1", 5.0, False) and json.loads(read[0].usage) == {"n": 1}
    scores = {r.utterance_id: r.utmos for r in models.naturalness(clips, lambda: lambda paths: [{"a.wav": 4.2, "b.wav": None}.get(p, float("nan")) for p in paths]).collect()}
    assert scores == {"u1": 4.2, "u2": None, "u3": None}
    vectors_of = {"a.wav": [1.0, 0.0], "b.wav": [1.0, 0.0], "c.wav": None, "r.wav": [1.0, 1.0]}
    near = {r.utterance_id: r.speaker_similarity for r in models.speaker_scores(clips, lambda: lambda paths: [vectors_of[p] for p in paths]).collect()}
    assert abs(near["u1"] - 0.5**0.5) < 1e-12 and near["u2"] is None and near["u3"] is None and models.speaker_scores(clips.limit(0), lambda: lambda paths: []).count() == 0


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    got = row.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.unit(F.col("a")).alias("u"), vectors.cosine(F.col("a"), F.col("z")).alias("zc"), vectors.unit(F.col("z")).alias("n")).first()
    assert abs(got.c - 1) < 1e-12 and [round(x, 6) for x in got.u] == [0.6, 0.8] and got.zc is None and got.n is None


def wav(samples, rate=16000, bits=16, kind=1):
    data = struct.pack(f"<{len(samples)}{'h' if bits == 16 else 'f'}", *samples) if bits in (16, 32) else bytes(samples)
    width = bits // 8
    form = struct.pack("<HHIIHH", kind, 1, rate, rate * width, width, bits)
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    body = b"WAVEfmt " + struct.pack("<I", 16) + form + odd + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_waves(spark):
    files = [("f", wav([-0.5, 0.0, 0.25, 0.75], bits=32, kind=3)), ("n", wav([0.1, float("nan")], bits=32, kind=3)), ("p", wav([0, 16384] * 8000)), ("c", wav([32767] * 8000)), ("e", wav([100] * 100, bits=8)), ("x", b"RIFFnope"), ("z", None)]
    rows = {r.path: r for r in audio.waves(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert rows["f"].peak == 0.75 and rows["f"].sample_rate == 16000 and rows["p"].duration_s == 1.0 and rows["p"].peak == 0.5
    assert rows["n"].finite is False and rows["e"].peak is None and rows["x"].error and rows["z"].error
    odd = [("empty", wav([])), ("cut float", wav([0.5] * 100, bits=32, kind=3)[:-8]), ("cut pcm", wav([3000] * 16000)[:-16000])]
    odd = {r.path: r for r in audio.waves(spark.createDataFrame(odd, "path string, content binary")).collect()}
    assert odd["empty"].peak is None and odd["empty"].error is None and odd["cut float"].error == "truncated data chunk" and odd["cut pcm"].duration_s == 1.0
    manifest = spark.createDataFrame([(p, (22050 if p == "p" else 16000,)) for p in ("f", "p", "c", "gone", "x")], "audio_path string, metadata struct<sample_rate_hz:int>")
    got = {r.audio_path: r.issues for r in audio.quality(manifest, audio.waves(spark.createDataFrame(files, "path string, content binary"))).collect()}
    assert got == {"f": ["too short (0.00s)"], "p": ["sample rate 16000 != configured 22050"], "c": ["possible clipping (peak at full scale)"], "gone": ["missing"], "x": ["unreadable: no RIFF/WAVE file"]}
