"""Queries over written examples: what the test tables do not hold (files, mark-up, waves, replies), with answers worked out by hand.

Every entry is a list of inputs with the rows that must come out. The rows are also the SQL counterpart, as a VALUES table.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaflow.functions import answers, rewrite, text
from glossaflow.operators import audio, checks, collect, summaries
from glossaflow.plans import scoring

Query = Callable[[SparkSession, str], DataFrame]


def values_sql(columns: dict[str, str], rows: list[tuple]) -> str:
    """A VALUES table with typed columns."""

    def lit(v) -> str:
        if v is None or isinstance(v, (int, float)):
            return "NULL" if v is None else str(v)
        return "'" + v.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    cast = ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in columns.items())
    return f"SELECT {cast} FROM (VALUES {body}) t({', '.join(f'"{c}"' for c in columns)})"


# --- the verbaliser ---------------------------------------------------------------------------------------------------
SPOKEN = [
    ("στους -5°C", "στους μείον πέντε°C"), ("3/4 και 25/03", "τρία τέταρτα και είκοσι πέντε/τρία"), ("+30 2101234567", "συν τριάντα δύο ένα μηδέν ένα δύο τρία τέσσερα πέντε έξι επτά"),
    ("5,03 ή 5,3", "πέντε κόμμα μηδέν τρία ή πέντε κόμμα τρία"), ("3,5 €", "τρία ευρώ και πέντε λεπτά"), ("467,590 δισ. €", "τετρακόσια εξήντα επτά δισεκατομμύρια πεντακόσια ενενήντα εκατομμύρια ευρώ"),
    ("$350.000", "τριακόσιες πενήντα χιλιάδες δολάρια"), ("12,5% 3,05% 1.2,3%", "δώδεκα και πέντε τοις εκατό τρία και πέντε τοις εκατό 1.2,3%"),
    ("14:30, 09:00, 25:99", "δεκατέσσερις και μισή, εννέα ακριβώς, είκοσι πέντε και ενενήντα εννέα"), ("1 Μαρτίου", "πρώτη Μαρτίου"), ("1/2/2020", "μία Φεβρουαρίου δύο χιλιάδες είκοσι"),
    ("Ο ΟΗΕ κ.λπ.", "Ο Οργανισμός Ηνωμένων Εθνών και λοιπά"), ("10.482.487", "δέκα εκατομμύρια τετρακόσιες ογδόντα δύο χιλιάδες τετρακόσια ογδόντα επτά"), ("95η 2ος", "ενενηκοστή πέμπτη δεύτερος"), ("45-67", "σαράντα πέντε-εξήντα επτά"),
    ("Ο κ. Α, π.χ. ο Δρ. Β", "Ο κύριος Α, παραδείγματος χάριν ο Διδάκτωρ Β"), ("το 2024", "το δύο χιλιάδες είκοσι τέσσερα"), ("1.500 τ.μ.", "χίλια πεντακόσια τετραγωνικά μέτρα"), ("£1,50", "ένα λίρες και πενήντα λεπτά"), ("12/5/24", "δώδεκα/πέντε/είκοσι τέσσερα"),
    ("2 εκ. €", "δύο εκατομμύρια ευρώ"), ("31-12-1999", "τριάντα μία Δεκεμβρίου χίλια εννιακόσια ενενήντα εννέα"), ("5 Μαΐου 2020", "πέντε Μαΐου δύο χιλιάδες είκοσι"), ("Νο5", "Νο5"), ("", ""), ("χωρίς τίποτα", "χωρίς τίποτα"),
]


def verbaliser_examples(spark: SparkSession, sf: str) -> DataFrame:
    return rewrite.verbalise(spark.createDataFrame([(t,) for t, _ in SPOKEN], "written string"), "written", "spoken")


# Reference, hypothesis, language; word and character error rates of the scoring forms, then of the written forms.
SCORED = [
    ("Στις 14:30 πλήρωσε 5 €.", "στις δεκατέσσερις και μιση πληρωσε πέντε ευρώ", "el", 0.0, 0.0), ("Κατά 12,5%", "κατά δώδεκα και πέντε τοις εκατό", None, 0.0, 0.0), ("5 cats", "five cats", "en", 0.5, 0.8), ("", "", "el", 0.0, 0.0),
    ("α", None, "el", 1.0, 1.0), ("", "α", "el", 1.0, 1.0), ("Ο ΟΗΕ ήρθε", "ο οηε ηρθε", "el", 0.0, 0.0), ("ένα δύο τρία τέσσερα", "ένα τρία τέσσερα πέντε", "EL", 0.5, 8 / 17),
]


def scoring_examples(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(n, *r[:3]) for n, r in enumerate(SCORED)], "n int, reference string, hypothesis string, language string")
    return scoring.policy_rates(rows).select("n", F.round("wer", 9).alias("wer"), F.round("cer", 9).alias("cer"))


# --- rules of data set files -----------------------------------------------------------------------------------------------
_SENTENCE = {"id": "1", "text": "δύο λέξεις", "source_url": None, "word_count": 2, "characteristics": {}}
_FILE = {"dataset_id": "d", "scenario": "s", "language": "el", "total_sentences": 1, "source": "x", "sentences": [_SENTENCE]}


def _file(sentences=None, **changes) -> str:
    out = _FILE | ({"sentences": sentences, "total_sentences": len(sentences)} if sentences is not None else {}) | changes
    return json.dumps({k: v for k, v in out.items() if v != "absent"}, ensure_ascii=False)


# What a file holds, and (severity, code, sentence) of everything that is wrong with it.
FILES = [
    (_file(), []), ("[]", [("error", "json_error", None)]), ("{", [("error", "json_error", None)]), ("", [("error", "json_error", None)]), (_file(sentences=[], source="absent"), [("error", "missing_top_level_field", None)]),
    (_file(total_sentences=3), [("error", "sentence_count_mismatch", None)]), (_file(total_sentences="1"), [("error", "sentence_count_mismatch", None)]), (_file(total_sentences=1.5), [("error", "sentence_count_mismatch", None)]), (_file(total_sentences=1.0), []),
    (json.dumps(_FILE | {"sentences": {}}), [("error", "sentences_not_list", None)]), (_file([1, "x"]), [("error", "sentence_not_object", "index_0"), ("error", "sentence_not_object", "index_1")]),
    (_file([{"id": "1", "text": "α", "word_count": 9, "characteristics": {}}]), [("error", "missing_sentence_field", "1"), ("warning", "word_count_mismatch", "1")]),
    (_file([_SENTENCE | {"text": "", "word_count": 9}]), [("error", "empty_text", "1"), ("warning", "word_count_mismatch", "1")]), (_file([_SENTENCE | {"text": 5, "word_count": "x"}]), [("error", "empty_text", "1")]),
    (_file([_SENTENCE | {"word_count": "2"}]), [("error", "word_count_not_int", "1")]), (_file([_SENTENCE | {"word_count": 2.0}]), [("error", "word_count_not_int", "1")]), (_file([_SENTENCE | {"word_count": None}]), [("error", "word_count_not_int", "1")]),
    (_file([_SENTENCE | {"characteristics": []}]), [("error", "characteristics_not_object", "1")]), (_file([_SENTENCE] * 3), [("error", "duplicate_sentence_id", "1")]), (_file([_SENTENCE | {"id": None}] * 2), [("error", "duplicate_sentence_id", "None")]),
    (_file([_SENTENCE | {"id": 1}, _SENTENCE]), [("error", "duplicate_sentence_id", "1")]), (_file([_SENTENCE | {"word_count": 4}]), []), (_file([_SENTENCE | {"word_count": 5}]), [("warning", "word_count_mismatch", "1")]),
]


def file_rule_examples(spark: SparkSession, sf: str) -> DataFrame:
    files = spark.createDataFrame([(f"{n:02d}.json", value) for n, (value, _) in enumerate(FILES)], "path string, value string")
    return checks.dataset_issues(files).select("path", "severity", "code", "sentence_id")


# --- pages -------------------------------------------------------------------------------------------------------------------
# A page, and (text, kept) of its paragraphs.
PAGES = [
    ("<p>Ένα <b>δύο</b><sup class='reference'>[1]</sup> τρία.</p><p>x<sup>2</sup></p><table><p>όχι</p></table><p>χαμένο<p>Τέσσερα<br>πέντε.</p><p></p>", [("Ένα δύο τρία.", True), ("x2", False), ("Τέσσερα πέντε.", True)]),
    ("<div class='navbox x'><p>όχι</p></div><p>ναι &amp; όχι</p><ul><li><p>ούτε</p></li></ul><p>  δύο\n γραμμές </p>", [("ναι & όχι", True), ("δύο γραμμές", True)]),
    ("<p>με <code>κώδικα</code></p><p>και <img src='a'>εικόνα</p><p>μόνο κείμενο", [("με κώδικα", False), ("και εικόνα", False)]), ("", []), ("<p>αλλιώς</p></div><script>p</script><p class='hatnote'>όχι</p>", [("αλλιώς", True)]),
]


def paragraph_examples(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.createDataFrame(list(enumerate(p for p, _ in PAGES)), "page_id bigint, html string")
    return collect.paragraphs(pages)


def _paragraph_rows() -> list[tuple]:
    out = []
    for page, (_, found) in enumerate(PAGES):
        index = 0
        for t, kept in found:
            out.append((page, index if kept else -1, t, "true" if kept else "false"))
            index += kept
    return out


# --- waves -------------------------------------------------------------------------------------------------------------------
def wave(samples: str, data: bytes, rate: int = 16000, channels: int = 1, declared: int | None = None, odd: bool = False) -> bytes:
    """A WAV file of samples 'h' (16 bit), 'B' (8 bit), 'f' or 'd' (float), with a chunk of odd length before them if wanted."""
    width = struct.calcsize(samples)
    form = struct.pack("<HHIIHH", 3 if samples in "fd" else 1, channels, rate, rate * width * channels, width * channels, width * 8)
    between = b"LIST" + struct.pack("<I", 3) + b"abc\0" if odd else b""
    body = b"WAVEfmt " + struct.pack("<I", 16) + form + between + b"data" + struct.pack("<I", len(data) if declared is None else declared) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _pack(kind: str, *values) -> bytes:
    return struct.pack(f"<{len(values)}{kind}", *values)


# A file, its rate in the manifest, and (seconds, peak, issues) of its clip.
WAVES = [
    ("sound", wave("h", _pack("h", *[0, 16384] * 4000)), 16000, (0.5, 0.5, "")), ("odd", wave("h", _pack("h", *[0, 16384] * 4000), odd=True), 22050, (0.5, 0.5, "sample rate 16000 != configured 22050")),
    ("clipped", wave("h", _pack("h", *[-32768] * 8000)), 16000, (0.5, 1.0, "possible clipping (peak at full scale)")), ("silent", wave("h", _pack("h", *[100] * 8000)), None, (0.5, 100 / 32768, "near-silent (peak 0.0031)")),
    ("short", wave("h", _pack("h", *[9000] * 1600), rate=8000, channels=2), 8000, (0.1, 9000 / 32768, "too short (0.10s)")), ("empty", wave("h", b""), 16000, (0.0, None, "too short (0.00s)")), ("8 bit", wave("B", bytes([200] * 8000)), 16000, (0.5, None, "")),
    ("cut", wave("h", _pack("h", *[9000] * 4000), declared=16000), 16000, (0.5, 9000 / 32768, "")), ("float", wave("f", _pack("f", *[0.25, -0.75] * 4000)), 16000, (0.5, 0.75, "")), ("double", wave("d", _pack("d", *[1.5] * 400000)), 16000, (25.0, 1.5, "too long (25.00s), possible clipping (peak at full scale)")),
    ("odd float", wave("f", _pack("f", *[0.5, float("nan")] * 4000)), 16000, (0.5, 0.5, "contains non-finite samples")), ("cut float", wave("f", _pack("f", *[0.5] * 8000), declared=40000), 16000, (None, None, "unreadable: truncated data chunk")),
    ("no wave", b"RIFFnope", 16000, (None, None, "unreadable: no RIFF/WAVE file")), ("gone", None, 16000, (None, None, "missing")),
]


def wave_examples(spark: SparkSession, sf: str) -> DataFrame:
    files = spark.createDataFrame([(n, c) for n, c, _, _ in WAVES if c is not None], "path string, content binary")
    clips = spark.createDataFrame([(n, (r,)) for n, _, r, _ in WAVES], "audio_path string, metadata struct<sample_rate_hz:int>")
    return audio.quality(clips, audio.waves(files)).select("audio_path", "duration_s", F.round("peak", 9).alias("peak"), F.array_join("issues", ", ").alias("issues"))


# --- replies, requests, addresses --------------------------------------------------------------------------------------------
# A reply, its text and the number of tokens it reports.
REPLIES = [
    ('{"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "b"}]}}], "usage_metadata": {"n": 1}}', "a\nb", 1), ('{"candidates": [{"content": {"parts": [{"text": "γ"}, {}]}}, {"content": {"parts": [{"text": "δ"}]}}], "usageMetadata": {"n": 2}}', "γ", 2),
    ("{}", None, None), ('{"candidates": []}', None, None), ("no json", None, None), ('{"usageMetadata": {"n": 3}, "usage_metadata": {"n": 4}}', None, 3),
]


def reply_examples(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(n, r) for n, (r, _, _) in enumerate(REPLIES)], "n int, r string")
    return rows.select("n", answers.response_text(F.col("r")).alias("said"), F.get_json_object(answers.usage_metadata(F.col("r")), "$.n").cast("int").alias("tokens"))


def request_examples(spark: SparkSession, sf: str) -> DataFrame:
    """A batch line with its clip inline."""
    rows = spark.createDataFrame([('k"1', "προς", b"xy"), ("k2", "α\nβ", b"")], "k string, prompt string, clip binary")
    line = answers.batch_request(F.col("k"), F.col("prompt"), F.lit("audio/wav"), audio=F.col("clip"), instructions='say "it"', config={"temperature": 0, "seed": 5})
    part = lambda p: F.get_json_object("l", f"$.request.{p}")
    clip = "contents[0].parts[1].inline_data"
    return rows.select(line.alias("l")).select(F.get_json_object("l", "$.key").alias("key"), part("contents[0].parts[0].text").alias("prompt"), part(f"{clip}.data").alias("data"), part(f"{clip}.mime_type").alias("mime"), part("system_instruction.parts[0].text").alias("instructions"), part("generation_config.seed").alias("seed"))


# A title, as part of a path and as part of a query.
TITLES = [("Ωμέγα *~ x", "%CE%A9%CE%BC%CE%AD%CE%B3%CE%B1%20%2A~%20x", "%CE%A9%CE%BC%CE%AD%CE%B3%CE%B1+%2A~+x"), ("a/b?c=d&e", "a%2Fb%3Fc%3Dd%26e", "a%2Fb%3Fc%3Dd%26e"), ("A-B_c.d", "A-B_c.d", "A-B_c.d"), ("100% + 1", "100%25%20%2B%201", "100%25+%2B+1"), ("", "", "")]


def address_examples(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t, _, _ in TITLES], "title string")
    return rows.select("title", text.quoted_title(F.col("title")).alias("in_path"), text.query_value(F.col("title")).alias("in_query"))


# Numbers and what they are rounded to four places: by their binary value, ties to even.
ROUNDED = [(2.00005, 2.0), (0.00015, 0.0001), (0.12345, 0.1235), (1.00005, 1.0001), (0.5, 0.5), (None, None), (-0.00025, -0.0003), (0.00025, 0.0003)]


def rounding_examples(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.python_rounded(spark.createDataFrame([(n, x) for n, (x, _) in enumerate(ROUNDED)], "n int, x double"), {"x": 4})


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (verbaliser_examples, scoring_examples, file_rule_examples, paragraph_examples, wave_examples, reply_examples, request_examples, address_examples, rounding_examples)}


def oracle_sql() -> dict[str, str]:
    text_ = lambda *names: dict.fromkeys(names, "VARCHAR")
    return {
        "verbaliser_examples": values_sql(text_("written", "spoken"), SPOKEN), "scoring_examples": values_sql({"n": "INTEGER", "wer": "DOUBLE", "cer": "DOUBLE"}, [(n, r[3], round(r[4], 9)) for n, r in enumerate(SCORED)]),
        "file_rule_examples": values_sql(text_("path", "severity", "code", "sentence_id"), [(f"{n:02d}.json", *i) for n, (_, found) in enumerate(FILES) for i in found]),
        "paragraph_examples": values_sql({"page_id": "BIGINT", "paragraph_index": "INTEGER", "text": "VARCHAR", "kept": "BOOLEAN"}, _paragraph_rows()),
        "wave_examples": values_sql({"audio_path": "VARCHAR", "duration_s": "DOUBLE", "peak": "DOUBLE", "issues": "VARCHAR"}, [(n, d, None if p is None else round(p, 9), i) for n, _, _, (d, p, i) in WAVES]),
        "reply_examples": values_sql({"n": "INTEGER", "said": "VARCHAR", "tokens": "INTEGER"}, [(n, t, k) for n, (_, t, k) in enumerate(REPLIES)]),
        "request_examples": values_sql(text_("key", "prompt", "data", "mime", "instructions", "seed"), [('k"1', "προς", "eHk=", "audio/wav", 'say "it"', "5"), ("k2", "α\nβ", "", "audio/wav", 'say "it"', "5")]),
        "address_examples": values_sql(text_("title", "in_path", "in_query"), TITLES), "rounding_examples": values_sql({"n": "INTEGER", "x": "DOUBLE"}, [(n, y) for n, (_, y) in enumerate(ROUNDED)]),
    }
