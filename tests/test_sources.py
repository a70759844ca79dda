import json

import pytest

from glossaflow.sources import readers, sinks
from glossaflow.streaming.scorer import score_stream


def test_datasets_and_files(spark, tmp_path):
    sentence = {"id": "1", "text": "α", "source_url": None, "word_count": 1, "characteristics": {"has_numbers": True}}
    (tmp_path / "b.json").write_text(json.dumps({"dataset_id": "d", "scenario": "s", "language": "el", "total_sentences": 1, "source": ["a"], "sentences": [sentence, None]}), encoding="utf-8")
    rows = readers.dataset_sentences(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].characteristics == {"has_numbers": "true"} and rows[0].dataset_file == "b.json"
    (tmp_path / "b.json").write_text(json.dumps({"a": [1, 2]}, indent=2))
    assert [json.loads(r.value) for r in readers.json_files(spark, str(tmp_path)).collect()] == [{"a": [1, 2]}]
    assert readers.hashed_files(spark, str(tmp_path), "*.json").first().length > 10


def test_transcripts(spark, tmp_path):
    for name, value in (("a", {"text": " x "}), ("b", {"segments": [{"text": " y "}, {}]}), ("c", {})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    assert sorted(r.hypothesis for r in readers.transcripts(spark, str(tmp_path)).collect()) == ["", " x ", "y"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", None, 1)], "b string, a string, c int")
    sinks.write_json_lines(rows.coalesce(1), str(tmp_path / "o"))
    sinks.append_json_lines(rows.coalesce(1), str(tmp_path / "o"))
    lines = [line for f in (tmp_path / "o").glob("part*") for line in f.read_text().splitlines()]
    assert lines == ['{"a":null,"b":"b","c":1}'] * 2
    sinks.write_once(rows, str(tmp_path / "once"))
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_once(rows, str(tmp_path / "once"))
    sinks.write_document({"α": 1}, str(tmp_path / "x" / "d.json"))
    assert (tmp_path / "x" / "d.json").read_text(encoding="utf-8") == '{\n  "α": 1\n}\n'
    files = spark.createDataFrame([("f", "0" * 64)], "path string, sha256 string")
    sinks.write_inventory(files, str(tmp_path / "inv"))
    assert readers.inventory(spark, str(tmp_path / "inv")).collect() == [("0" * 64, "f")]


def test_paged_source(spark):
    pages = {None: ([{"n": 1}, {"n": 2}], "t"), "t": ([{"n": 3}], None)}
    readers.register_paged(spark, lambda token: pages[token])
    assert spark.read.format("paged").load().count() == 3
    assert spark.read.format("paged").option("limit", "2").load().count() == 2


def test_politeness():
    replies = [(429, {"Retry-After": "5"}, {}), (200, {}, {"error": {"code": "maxlag"}}), (200, {}, {"ok": 1})]
    waits = []
    assert readers.polite(lambda: replies.pop(0), sleep=waits.append) == {"ok": 1} and waits == [5.0, 5.0]
    assert readers.retry_after("Thu, 26 Nov 2026 15:00:10 GMT", 1795705200.0) == 10.0 and readers.retry_after("soon", 0) == readers.retry_after(None, 0) == readers.retry_after("Thu, 26 Nov 2020 15:00:10 GMT", 1795705200.0) == 0.0
    lost = [OSError("reset"), (200, {}, {"ok": 2})]

    def call():
        got = lost.pop(0)
        if isinstance(got, OSError):
            raise got
        return got

    assert readers.polite(call, sleep=waits.append) == {"ok": 2}
    for answer in ((501, {}, {}), (200, {}, {"warnings": "x"}), (200, {}, [])):
        with pytest.raises(RuntimeError):
            readers.polite(lambda answer=answer: answer, sleep=waits.append)
    with pytest.raises(RuntimeError, match="busy"):
        readers.polite(lambda: (503, {"Retry-After": "60"}, {}), sleep=waits.append)
    with pytest.raises(RuntimeError, match="failed"):
        readers.polite(lambda: (404, {}, {}), sleep=waits.append)


def fake_wiki(**q):
    """Two categories, pages of two members, redirects, and pages that are skipped."""
    if q.get("meta"):
        return {"query": {"general": {"lang": "el"}, "rightsinfo": {"text": "cc"}}}
    if q.get("list"):
        all_of = {"C": ["A", "B", "D", "E"], "D": ["F"]}[q["cmtitle"]]
        at = int(q.get("cmcontinue", 0))
        stop = at + min(2, q["cmlimit"])
        return {"query": {"categorymembers": [{"title": t} for t in all_of[at:stop]]}} | ({"continue": {"cmcontinue": str(stop)}} if stop < len(all_of) else {})
    if q["action"] == "parse":
        return {"parse": {"revid": q["oldid"], "pageid": q["oldid"] - 100, "text": f"<p>Σελίδα {q['oldid']}.</p>"}}
    page = {"A": {"pageid": 1}, "B": {"missing": True}, "D": {"pageid": 1}, "E": {"pageid": 5, "ns": 4}, "F": {"pageid": 6, "pageprops": {"disambiguation": ""}}, "bad": {"pageid": 7, "revisions": []}}[q["titles"]]
    own = {"title": q["titles"] + " *", "ns": 0, "revisions": [{"revid": 100 + page.get("pageid", 0), "timestamp": "t"}]} | page
    return {"query": {"pages": [own]}}


def test_snapshot_of_pages(spark, tmp_path):
    from glossaflow.sources import pages

    assert list(pages.members(fake_wiki, "C", 3)) == ["A", "B", "D"] and pages.wanted_titles(fake_wiki, ["D", "D"], ["C", "D"], 4) == ["D", "A", "B", "E"]
    got = pages.snapshot(fake_wiki, "el", ["A"], ["C", "D"], 10)
    assert [p["page_id"] for p in got["pages"]] == [1] and [s["reason"] for s in got["skipped"]] == ["missing_or_invalid", "duplicate_resolved_page", "non_article_namespace", "disambiguation"]
    assert got["pages"][0]["article_url"].endswith("/wiki/A_%2A") and got["pages"][0]["history_url"].endswith("?title=A+%2A&action=history") and got["pages"][0]["revision_url"].endswith("?oldid=101")
    sinks.write_document(got, str(tmp_path / "s.json"))
    assert readers.snapshot_pages(spark, str(tmp_path / "s.json")).first().revision_id == 101
    for titles, most in (([], 5), (["a|b"], 5), ([" "], 5), (["A"], 0)):
        with pytest.raises(ValueError):
            pages.snapshot(fake_wiki, "el", titles, (), most)
    with pytest.raises(RuntimeError):
        pages.snapshot(fake_wiki, "el", ["bad"])
    for bad in ({"edition": "EL"}, {"agent": " "}, {"agent": "a\nb"}, {"delay": 0.1}):
        with pytest.raises(ValueError):
            pages.wiki(**({"edition": "el", "agent": "test (mail@example.org)"} | bad))


def test_documents(spark, tmp_path):
    assert readers.document(spark, str(tmp_path / "absent.json")) == {}
    (tmp_path / "c.json").write_text("{\n  \"a\": [1]\n}\n")
    (tmp_path / "l.json").write_text("[1]")
    assert readers.document(spark, str(tmp_path / "c.json")) == {"a": [1]}
    with pytest.raises(ValueError):
        readers.document(spark, str(tmp_path / "l.json"))


def test_stream_scores_what_arrives(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    row = {"utterance_id": "u1", "tts_system_id": "a", "preprocessing_method": "raw", "scenario": "s", "language": "el", "reference": "5 γάτες", "hypothesis": "πέντε γάτες"}
    for n in (1, 2):
        (source / f"{n}.json").write_text(json.dumps(row | {"utterance_id": f"u{n}"}) + "\n", encoding="utf-8")
        score_stream(spark, str(source), str(target), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(target)).collect()
    assert sorted(r.utterance_id for r in got) == ["u1", "u2"] and all(r.wer == 0.0 and r.wer_orthographic == 0.5 for r in got)


def test_copies(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"x")
    plan = spark.createDataFrame([(str(tmp_path / "a.wav"), str(tmp_path / "out" / "1.wav"), True), ("gone", "x", False)], "source string, target string, exists boolean")
    assert sinks.copy_returned(plan) == {"copied": 1, "missing": 1} and (tmp_path / "out" / "1.wav").read_bytes() == b"x"


def test_merged_titles(spark):
    from glossaflow.operators.collect import merged_titles

    given = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "pos int, title string")
    listed = spark.createDataFrame([(0, "c"), (1, "a"), (2, "d")], "pos int, title string")
    assert [r.title for r in merged_titles(given, listed, 3).collect()] == ["b", "a", "c"]


def test_handoff_folders(spark, tmp_path):
    index = spark.createDataFrame([(s, i, f"{s}{i}", "κείμενο") for s in "ab" for i in range(1, 6)], "tts_system_id string, handoff_index int, utterance_id string, handoff_text string")
    sinks.write_handoff(index, str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h" / "tts_system_id=a")).count() == 5
