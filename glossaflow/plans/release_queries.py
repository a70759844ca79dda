"""Release, handoff and selection rules over the test tables, each next to its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaflow.functions import numbers_el, text
from glossaflow.functions.text import collapse_spaces
from glossaflow.operators import checks, collect, manifests, summaries
from glossaflow.plans import release

Query = Callable[[SparkSession, str], DataFrame]
_CLIPS = "clips AS (SELECT * FROM synthesis QUALIFY row_number() OVER (PARTITION BY utterance_id ORDER BY created_at) = 1)"
_VARIANTS = "v AS (SELECT * FROM dataset_05_punctuation QUALIFY row_number() OVER (PARTITION BY dataset_id, id, method ORDER BY ingested_at DESC NULLS LAST) = 1)"
_LINE = lambda c: f"trim(regexp_replace({c}, '[\\s\\p{{Z}}]+', ' ', 'g'))"
_KEY = lambda *cs: " || '::' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'None')" for c in cs)


def _t(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _clips(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return _t(spark, sf, "synthesis").select("utterance_id", *columns).dropDuplicates(["utterance_id"])


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.latest(_t(spark, sf, "dataset_05_punctuation"), ["dataset_id", "id", "method"], "ingested_at", ["text", "original_text", "normalized_text", "normalization_warnings", "word_count"])


HANDOFF_SQL = f"WITH {_CLIPS} SELECT 'handoff_differs' AS rule, utterance_id AS key FROM clips WHERE {_LINE('source_text')} <> {_LINE('synthesis_text')}"


def handoff_rules(spark, sf):
    """Handoff lines made of the source texts, held against the texts to be spoken."""
    clips = _clips(spark, sf, "source_text", "synthesis_text")
    return release.handoff_violations(clips.drop("source_text"), clips.select("utterance_id", collapse_spaces(F.col("source_text")).alias("handoff_text")))


VARIANT_SQL = f"""WITH {_VARIANTS}, s AS (SELECT DISTINCT dataset_id, id, original_text AS text FROM v WHERE method = 'regex'), w AS (SELECT dataset_id, id, m AS method FROM s CROSS JOIN (VALUES ('raw'), ('spoken')) t(m))
SELECT 'unknown_method' AS rule, {_KEY('dataset_id', 'id', 'method')} AS key FROM v WHERE method NOT IN ('raw', 'spoken')
UNION ALL SELECT 'original_differs', {_KEY('v.dataset_id', 'v.id', 'v.method')} FROM v JOIN s USING (dataset_id, id) WHERE v.normalized_text IS DISTINCT FROM s.text
UNION ALL SELECT 'variant_of_nothing', {_KEY('v.dataset_id', 'v.id', 'v.method')} FROM v ANTI JOIN s USING (dataset_id, id)
UNION ALL SELECT 'variant_lacking', {_KEY('w.dataset_id', 'w.id', 'w.method')} FROM w ANTI JOIN v USING (dataset_id, id, method)"""


def variant_rules(spark, sf):
    """The originals of the rule-made variants as sentences, and what every variant says as its original."""
    v = _variants(spark, sf)
    sentences = v.filter("method = 'regex'").select("dataset_id", "id", F.col("original_text").alias("text")).distinct()
    return release.variant_violations(sentences, v.select("dataset_id", "id", "method", F.col("normalized_text").alias("original_text")), ["raw", "spoken"])


HELDOUT_SQL = f"""WITH {_CLIPS} SELECT 'heldout_method' AS rule, utterance_id AS key FROM clips WHERE preprocessing_method IS DISTINCT FROM 'raw'
UNION ALL SELECT 'heldout_text_changed', utterance_id FROM clips WHERE source_text IS DISTINCT FROM synthesis_text
UNION ALL SELECT 'heldout_text_varies', sentence_id FROM clips GROUP BY sentence_id HAVING count(DISTINCT synthesis_text) > 1
UNION ALL SELECT 'heldout_reference', utterance_id FROM clips WHERE CASE WHEN metadata.voice IS NULL THEN NULL ELSE 'natural_' || sentence_id END IS DISTINCT FROM CASE tts_system_id WHEN 'lyra_v1' THEN 'own_voice' ELSE 'natural_' || sentence_id END"""


def heldout_rules(spark, sf):
    """All clips under the rules of a held-out track; those without a voice have no reference."""
    clips = _clips(spark, sf, "preprocessing_method", "source_text", "synthesis_text", "sentence_id", "tts_system_id", "metadata")
    clips = clips.withColumn("reference_asset_id", F.when(F.col("metadata.voice").isNotNull(), F.concat(F.lit("natural_"), "sentence_id")))
    found = release.heldout_violations(clips, {"lyra_v1": "own_voice"}).filter("rule <> 'heldout_text_varies'")
    varied = checks.broken_dependencies(clips, ["sentence_id"], "synthesis_text").select(F.lit("heldout_text_varies").alias("rule"), F.col("sentence_id").alias("key"))
    return found.unionByName(varied)


SPLIT_SQL = f"WITH {_CLIPS}, s AS (SELECT DISTINCT scenario, preprocessing_method, dataset_id, sentence_id, tts_family AS speaker FROM clips), c AS (SELECT scenario, preprocessing_method, speaker, count(*) AS n FROM s GROUP BY ALL) SELECT 'speakers_uneven' AS rule, {_KEY('scenario', 'preprocessing_method')} AS key FROM c GROUP BY scenario, preprocessing_method HAVING min(n) <> max(n) OR count(*) <> 4"


def speaker_rules(spark, sf):
    """Families as speakers: groups of a scenario and method in which they do not have the same number of sentences."""
    clips = _clips(spark, sf, "scenario", "preprocessing_method", "dataset_id", "sentence_id", F.col("tts_family").alias("speaker"))
    return release.split_violations(clips, ["scenario", "preprocessing_method"], 4)


INVENTORY_SQL = f"""WITH {_VARIANTS}, a AS (SELECT id AS path, sha256(normalized_text) AS sha256 FROM v WHERE method = 'raw'), b AS (SELECT id AS path, sha256(normalized_text) AS sha256 FROM v WHERE method = 'llm' AND len(coalesce(normalization_warnings, [])) = 0)
SELECT path, CASE WHEN b.sha256 IS NULL THEN 'missing' WHEN a.sha256 IS NULL THEN 'unlisted' ELSE 'changed' END AS problem FROM a FULL JOIN b USING (path) WHERE a.sha256 IS DISTINCT FROM b.sha256"""


def inventory_rules(spark, sf):
    """Digests of the raw texts as an inventory, held against the model's texts that came without a warning."""
    v = _variants(spark, sf).withColumn("sha256", F.sha2("normalized_text", 256))
    listed, found = v.filter("method = 'raw'"), v.filter("method = 'llm' and coalesce(size(normalization_warnings), 0) <= 0")
    return checks.hash_mismatches(listed.select(F.col("id").alias("path"), "sha256"), found.select(F.col("id").alias("path"), "sha256")).select("path", "problem")


_W = r"\p{L}\p{N}_"
AUDIT_SQL = f"""WITH {_VARIANTS} SELECT method, count(*) AS n, count(*) FILTER (WHERE word_count IS DISTINCT FROM CAST(len(regexp_extract_all(text, '[{_W}]+(?:[./-][{_W}]+)*')) AS BIGINT)) AS word_counts_off, count(*) FILTER (WHERE len(normalization_warnings) > 0) AS with_warnings,
count(*) FILTER (WHERE {_LINE('normalized_text')} <> normalized_text) AS changed_by_handoff FROM v GROUP BY 1"""


def audit_census(spark, sf):
    """What an export reports of its variants: word counts that are off, warnings, texts that a handoff changes."""
    v = _variants(spark, sf)
    off = ~F.col("word_count").eqNullSafe(text.word_count(F.col("text")))
    line = collapse_spaces(F.col("normalized_text")) != F.col("normalized_text")
    return v.groupBy("method").agg(F.count("*").alias("n"), F.count_if(off).alias("word_counts_off"), F.count_if(F.size("normalization_warnings") > 0).alias("with_warnings"), F.count_if(line).alias("changed_by_handoff"))


TITLES_SQL = "WITH b AS (SELECT 0 AS s, doc_id AS pos, source AS title FROM documents UNION ALL SELECT 1, doc_id, lang FROM documents), f AS (SELECT title, min((s, pos)) AS first_seen FROM b GROUP BY title) SELECT title FROM f ORDER BY first_seen LIMIT 12"


def merged_titles(spark, sf):
    """Sources in their order as given titles, then languages as listed ones, twelve of them (a bound of the operator)."""
    d = _t(spark, sf, "documents")
    return collect.merged_titles(d.select(F.col("doc_id").alias("pos"), F.col("source").alias("title")), d.select(F.col("doc_id").alias("pos"), F.col("lang").alias("title")), 12)


_PLAIN_ASR = {"id": "w", "model": "small", "language": "en", "task": "translate", "device": "cpu", "compute_type": "int8", "batch_size": 4}
_RECOGNISERS = ((_PLAIN_ASR | {"align": False}, " --no_align"), (_PLAIN_ASR | {"diarize": True}, " --diarize"), (_PLAIN_ASR | {"alignment_model": "a/b"}, " --align_model a/b"))
COMMANDS_SQL = f"WITH {_CLIPS} SELECT utterance_id, 'whisperx ' || audio_path || ' --model small --language ' || coalesce(nullif(language, ''), 'en') || ' --task translate --output_format json --output_dir t/w/' || tts_system_id || '/' || preprocessing_method || '/' || dataset_id || ' --device cpu --compute_type int8 --batch_size 4' || e AS command FROM clips CROSS JOIN (VALUES " + ", ".join(f"('{e}')" for _, e in _RECOGNISERS) + ") t(e)"


def recogniser_commands(spark, sf):
    """Command lines without alignment, with a plain one and speakers, and with an alignment model."""
    clips = _clips(spark, sf, "tts_system_id", "preprocessing_method", "dataset_id", "language", "audio_path")
    folder = text.path_of("t", "w", F.col("tts_system_id"), F.col("preprocessing_method"), F.col("dataset_id"))
    language = text.fallback(F.col("language"), F.lit("en"))
    lines = F.array(*[F.array_join(manifests.asr_command(F.col("audio_path"), folder, language, asr), " ") for asr, _ in _RECOGNISERS])
    return clips.select("utterance_id", F.explode(lines).alias("command"))


NAMES_SQL = f"WITH {_CLIPS}, i AS (SELECT utterance_id, row_number() OVER (PARTITION BY tts_system_id ORDER BY utterance_id) AS k FROM clips) SELECT utterance_id, printf('%03d_ft.wav', k) AS ft, printf('%03d_base.wav', k) AS base, printf('%03d.wav', k) AS plain FROM i"


def returned_names(spark, sf):
    """Names of the wave files that come back, for the three kinds of systems."""
    index = manifests.handoff_index(_clips(spark, sf, "tts_system_id", "synthesis_text", "audio_path"))
    return index.select("utterance_id", *[manifests.returned_wav(F.col("handoff_index"), v).alias(v) for v in ("ft", "base", "plain")])


def _gender_sql() -> str:
    said = lambda i, g: numbers_el.below_thousand(i, numbers_el.GENDERS.index(g))
    lists = ", ".join(f"[{', '.join(f"'{said(i, g)}'" for i in range(1000))}] AS {g[0]}" for g in numbers_el.GENDERS)
    one = {"masculine": "χίλιοι", "feminine": "χίλιες", "neuter": "χίλια"}
    words = lambda g: f"array_to_string(list_filter([CASE WHEN v // 1000 = 1 THEN '{one[g]}' WHEN v // 1000 > 1 THEN f[CAST(v // 1000 + 1 AS INTEGER)] || ' χιλιάδες' END, CASE WHEN v % 1000 > 0 THEN {g[0]}[CAST(v % 1000 + 1 AS INTEGER)] END], lambda x: x IS NOT NULL), ' ')"
    return f"WITH w AS (SELECT {lists}), k AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) * 1000 + l_linenumber * 100 + l_suppkey % 100 AS v FROM lineitem UNION SELECT DISTINCT 1000 + l_suppkey % 1000 FROM lineitem) SELECT v AS number, {', '.join(f'{words(g)} AS {g}' for g in numbers_el.GENDERS)} FROM k, w"


def number_words_by_gender(spark, sf):
    lines = _t(spark, sf, "lineitem")
    numbers = lines.select((F.col("l_quantity").cast("bigint") * 1000 + F.col("l_linenumber") * 100 + F.col("l_suppkey") % 100).alias("number")).union(lines.select((F.lit(1000) + F.col("l_suppkey") % 1000).cast("bigint"))).distinct()
    return numbers.select("number", *[numbers_el.number_words_col(F.col("number"), g).alias(g) for g in numbers_el.GENDERS])


_ALL: tuple[tuple[Query, str], ...] = (
    (handoff_rules, HANDOFF_SQL), (variant_rules, VARIANT_SQL), (heldout_rules, HELDOUT_SQL), (speaker_rules, SPLIT_SQL), (inventory_rules, INVENTORY_SQL), (audit_census, AUDIT_SQL), (merged_titles, TITLES_SQL),
    (recogniser_commands, COMMANDS_SQL), (returned_names, NAMES_SQL), (number_words_by_gender, _gender_sql()),
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f, _ in _ALL}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in _ALL}
