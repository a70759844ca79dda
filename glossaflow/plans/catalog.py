"""The registered core queries over the test tables, each next to its SQL counterpart where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaflow.functions import answers, distance, numbers_el, rewrite, text, vectors
from glossaflow.operators import audio, checks, collect, manifests, ranking, summaries
from glossaflow.plans import examples, release_queries, scoring

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return _QUERIES | release_queries.queries() | examples.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | release_queries.oracle_sql() | examples.oracle_sql()


def _t(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _scores(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Key and wanted columns of the latest row of every score; nothing else is read."""
    return summaries.latest(_t(spark, sf, "asr_scores"), ["utterance_id", "asr_id"], "ingested_at", columns)


def _clips(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Wanted columns of the synthesis rows without their exact duplicates."""
    return _t(spark, sf, "synthesis").select("utterance_id", *columns).dropDuplicates(["utterance_id"])


def _sentences(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Wanted columns of every sentence of four data sets: re-delivered rows and the methods of a sentence are one."""
    tables = ("dataset_01_normal_text", "dataset_05_punctuation", "dataset_12_morphological", "llm_variants")
    frames = [summaries.latest(_t(spark, sf, t), ["dataset_id", "id"], "ingested_at", columns) for t in tables]
    return reduce(DataFrame.unionByName, frames)


# Pieces of SQL shared by the counterparts.
_W = r"\p{L}\p{N}_"
_WORDS = lambda c: f"CAST(len(regexp_extract_all({c}, '[{_W}]+(?:[./-][{_W}]+)*')) AS BIGINT)"
#: DuckDB lowers a final capital sigma to σ, so it is given its final form first; .:'’· beside it are passed over.
_LOW = lambda c: f"regexp_replace(lower(regexp_replace({c}, '(\\p{{L}}[.:''’·]*)Σ([.:''’·]*)([^\\p{{L}}.:''’·]|$)', '\\1ς\\2\\3', 'g')), '[^{_W}]+', ' ', 'g')"
_ORTHO = lambda c: f"trim({_LOW(c)})"
_MEAN = lambda c: f"CAST(sum(CAST({c} AS DECIMAL(28, 12))) AS DOUBLE) / count({c})"
_SAFE = lambda c: f"trim(regexp_replace({c}, '[^A-Za-z0-9_.-]+', '_', 'g'), '_')"
_LATEST = "latest AS (SELECT * FROM asr_scores QUALIFY row_number() OVER (PARTITION BY utterance_id, asr_id ORDER BY ingested_at DESC NULLS LAST) = 1)"
_CLIPS = "clips AS (SELECT * FROM synthesis QUALIFY row_number() OVER (PARTITION BY utterance_id ORDER BY created_at) = 1)"
_ALL = "sentences AS (" + " UNION ALL ".join(
    f"(SELECT dataset_file, dataset_id, scenario, id, text, sentence_index, word_count, characteristics FROM {t} QUALIFY row_number() OVER (PARTITION BY dataset_id, id ORDER BY ingested_at DESC NULLS LAST) = 1)"
    for t in ("dataset_01_normal_text", "dataset_05_punctuation", "dataset_12_morphological", "llm_variants")
) + ")"


def _grouped_sql(source: str, groupings, measures: str) -> str:
    keys = list(dict.fromkeys(c for _, cs in groupings for c in cs))
    named = ", ".join(f"coalesce({k}, 'None') AS {k}" for k in keys)
    sets = ", ".join("(" + ", ".join(cs) + ")" for _, cs in groupings)
    bits = "grouping_id(" + ", ".join(keys) + ")"
    cases, labels = [], []
    for name, cs in groupings:
        gid = sum(0 if k in cs else 1 << (len(keys) - 1 - i) for i, k in enumerate(keys))
        labels.append(f"WHEN {gid} THEN '{name}'")
        cases.append(f"WHEN {gid} THEN " + (" || '::' || ".join(cs) if cs else "'all'"))
    body = source.replace("__KEYS__", named)
    return f"{body} SELECT CASE {bits} {' '.join(labels)} END AS \"grouping\", CASE {bits} {' '.join(cases)} END AS \"key\", {measures} FROM base GROUP BY GROUPING SETS ({sets})"


_RATES = ("wer", "cer", "wer_orthographic", "cer_orthographic")


# --- scores and summaries -----------------------------------------------------------------------------------------------
@register(_grouped_sql(f"WITH {_LATEST}, base AS (SELECT __KEYS__, {', '.join(_RATES)} FROM latest)", summaries.ERROR_GROUPINGS, "count(*) AS \"count\", " + ", ".join(f"{_MEAN(r)} AS mean_{r}" for r in _RATES)))
def error_rate_summary(spark, sf):
    return summaries.error_summary(_scores(spark, sf, "tts_system_id", "preprocessing_method", "scenario", *_RATES))


_DISTANCE = """encoded AS (
  SELECT utterance_id, asr_id, r, h, list_filter(string_split(r, ' '), lambda w: w <> '') AS rw, list_filter(string_split(h, ' '), lambda w: w <> '') AS hw,
         list_filter(string_split(replace(r, ' ', ''), ''), lambda w: w <> '') AS rc, list_filter(string_split(replace(h, ' ', ''), ''), lambda w: w <> '') AS hc FROM normal),
numbered AS (SELECT *, list_distinct(list_concat(rw, hw)) AS dw, list_distinct(list_concat(rc, hc)) AS dc FROM encoded),
distances AS (SELECT *,
  levenshtein(coalesce(array_to_string(list_transform(rw, lambda w: chr(CAST(33 + list_position(dw, w) AS INTEGER))), ''), ''), coalesce(array_to_string(list_transform(hw, lambda w: chr(CAST(33 + list_position(dw, w) AS INTEGER))), ''), '')) AS word_edits,
  levenshtein(coalesce(array_to_string(list_transform(rc, lambda w: chr(CAST(33 + list_position(dc, w) AS INTEGER))), ''), ''), coalesce(array_to_string(list_transform(hc, lambda w: chr(CAST(33 + list_position(dc, w) AS INTEGER))), ''), '')) AS char_edits FROM numbered)"""


@register(f"WITH {_LATEST}, normal AS (SELECT utterance_id, asr_id, {_ORTHO("coalesce(reference, '')")} AS r, {_ORTHO("coalesce(hypothesis, '')")} AS h FROM latest), {_DISTANCE} "
          "SELECT utterance_id, asr_id, CASE WHEN len(rw) = 0 THEN CASE WHEN len(hw) = 0 THEN 0.0 ELSE 1.0 END ELSE CAST(word_edits AS DOUBLE) / len(rw) END AS wer_orthographic, "
          "CASE WHEN len(rc) = 0 THEN CASE WHEN len(hc) = 0 THEN 0.0 ELSE 1.0 END ELSE CAST(char_edits AS DOUBLE) / len(rc) END AS cer_orthographic FROM distances")  # fmt: skip
def orthographic_error_rates(spark, sf):
    return scoring.orthographic_rates(_scores(spark, sf, "reference", "hypothesis")).select("utterance_id", "asr_id", "wer_orthographic", "cer_orthographic")


@register()
def scored_transcripts(spark, sf):
    """All four rates from the texts; the policy needs the Greek verbaliser, which SQL lacks."""
    rates = scoring.error_rates(_scores(spark, sf, "reference", "hypothesis", "language"))
    return rates.select("utterance_id", "asr_id", *_RATES)


@register(f"WITH {_LATEST} SELECT CASE WHEN hypothesis IS NULL THEN 'missing' WHEN trim(regexp_replace(hypothesis, '[\\s\\p{{Z}}]+', ' ', 'g')) = '' THEN 'empty' ELSE 'scored' END AS status, tts_system_id, count(*) AS n FROM latest GROUP BY 1, 2")
def transcript_status(spark, sf):
    jobs = _scores(spark, sf, "tts_system_id", "hypothesis")
    found = jobs.select(F.concat_ws("/", "asr_id", "utterance_id").alias("path"), "hypothesis").filter("hypothesis is not null")
    joined = scoring.with_hypotheses(jobs.select("tts_system_id", F.concat_ws("/", "asr_id", "utterance_id").alias("transcript_path")), found)
    return joined.groupBy("status", "tts_system_id").agg(F.count("*").alias("n"))


_MOS = f"WITH {_LATEST}, base AS (SELECT __KEYS__, CASE WHEN wer IS NOT NULL THEN 5 - 4 * least(wer, 1.0) END AS mos_overall, CASE WHEN cer IS NOT NULL THEN 5 - 4 * least(cer, 1.0) END AS clarity FROM latest)"


@register(_grouped_sql(_MOS, summaries.SCORE_GROUPINGS, f"count(*) AS \"count\", count(mos_overall) AS scored, {_MEAN('mos_overall')} AS mean_overall, CAST(sum(CAST(CASE WHEN mos_overall IS NOT NULL THEN clarity END AS DECIMAL(28, 12))) AS DOUBLE) / count(CASE WHEN mos_overall IS NOT NULL THEN clarity END) AS mean_clarity"))
def mos_summary(spark, sf):
    grade = lambda c: F.lit(5) - F.lit(4) * F.when(F.col(c).isNotNull(), F.least(F.col(c), F.lit(1.0)))
    rows = _scores(spark, sf, "tts_system_id", "preprocessing_method", "scenario", "wer", "cer").withColumns({"mos_overall": grade("wer"), "mos": F.create_map(F.lit("clarity"), grade("cer"))})
    return summaries.mos_summary(rows, ["clarity"])


@register(_grouped_sql(f"WITH {_LATEST}, base AS (SELECT __KEYS__, wer FROM latest)", summaries.SCORE_GROUPINGS, f"count(*) AS \"count\", count(wer) AS scored, {_MEAN('wer')} AS mean, min(wer) AS min, max(wer) AS max"))
def score_summary(spark, sf):
    return summaries.score_summary(_scores(spark, sf, "tts_system_id", "preprocessing_method", "scenario", "wer"), "wer")


# --- texts ------------------------------------------------------------------------------------------------------------
@register(f"SELECT doc_id, {_WORDS('text')} AS n_words FROM documents")
def word_counts(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.word_count(F.col("text")).alias("n_words"))


@register(f"SELECT doc_id, {_ORTHO('text')} AS normal FROM documents")
def orthographic_texts(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.orthographic(F.col("text")).alias("normal"))


@register("SELECT item_id, translate(strip_accents(text), 'ς', 'σ') AS folded FROM heldout_items")
def folded_texts(spark, sf):
    return _t(spark, sf, "heldout_items").select("item_id", text.fold_accents(F.col("text")).alias("folded"))


@register(f"SELECT DISTINCT id FROM dataset_01_normal_text WHERE {_WORDS('text')} <= 15")
def short_sentences(spark, sf):
    return manifests.within_words(_t(spark, sf, "dataset_01_normal_text"), 15).select("id").distinct()


@register()
def verbalised_texts(spark, sf):
    rows = summaries.latest(_t(spark, sf, "dataset_05_punctuation").select("id", "method", "original_text", "ingested_at"), ["id", "method"], "ingested_at")
    return rewrite.verbalise(rows, "original_text", "spoken_text").select("id", "method", "spoken_text")


_LIST = lambda g: "[" + ", ".join(f"'{numbers_el.below_thousand(i, numbers_el.GENDERS.index(g))}'" for i in range(1000)) + "]"


@register(f"WITH w AS (SELECT {_LIST('neuter')} AS n, {_LIST('feminine')} AS f), k AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) * 1000 + l_partkey AS v FROM lineitem) "
          "SELECT DISTINCT v AS number, array_to_string(list_filter([CASE WHEN v >= 1000000 THEN CASE WHEN v // 1000000 = 1 THEN 'ένα εκατομμύριο' ELSE n[CAST(v // 1000000 + 1 AS INTEGER)] || ' εκατομμύρια' END END, "
          "CASE WHEN v // 1000 % 1000 = 1 THEN 'χίλια' WHEN v // 1000 % 1000 > 1 THEN f[CAST(v // 1000 % 1000 + 1 AS INTEGER)] || ' χιλιάδες' END, CASE WHEN v % 1000 > 0 THEN n[CAST(v % 1000 + 1 AS INTEGER)] END], lambda x: x IS NOT NULL), ' ') AS words FROM k, w")  # fmt: skip
def number_words(spark, sf):
    v = (F.col("l_quantity").cast("bigint") * 1000 + F.col("l_partkey")).alias("number")
    return _t(spark, sf, "lineitem").select(v).distinct().select("number", numbers_el.number_words_col(F.col("number")).alias("words"))


@register("SELECT DISTINCT p_size AS number, (" + "[" + ", ".join(f"'{numbers_el.ordinal_words(i, 'feminine')}'" for i in range(1, 100)) + "])[p_size] AS words FROM part")
def ordinal_words(spark, sf):
    return _t(spark, sf, "part").select(F.col("p_size").alias("number")).distinct().select("number", numbers_el.ordinal_words_col(F.col("number"), "feminine").alias("words"))


@register("SELECT DISTINCT audio_path, lower(regexp_extract(audio_path, '(\\.[^./]+)$', 1)) AS extension, CASE lower(regexp_extract(audio_path, '(\\.[^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.AUDIO_TYPES.items()) + " END AS mime, NOT regexp_matches(audio_path, '^/|^~|(^|/)\\.\\.(/|$)') AS portable FROM synthesis")
def audio_paths(spark, sf):
    p = F.col("audio_path")
    return _t(spark, sf, "synthesis").select(p).distinct().select(p, text.extension(p).alias("extension"), text.audio_type(p).alias("mime"), text.portable_path(p).alias("portable"))


# --- manifests ----------------------------------------------------------------------------------------------------------
_MANIFEST = f"""WITH v AS (SELECT *, coalesce(nullif(original_text, ''), text) AS source_text, coalesce(nullif(normalized_text, ''), text) AS synthesis_text FROM dataset_05_punctuation QUALIFY row_number() OVER (PARTITION BY id, method ORDER BY ingested_at DESC NULLS LAST) = 1)
SELECT {_SAFE("v.dataset_id || '_' || v.id || '_' || v.method || '_' || s.id")} AS utterance_id, v.source_text, v.synthesis_text, CAST({_WORDS('source_text')} AS INTEGER) AS source_token_count, CAST({_WORDS('synthesis_text')} AS INTEGER) AS synthesis_token_count,
  s.id AS tts_system_id, s.voice, 'audio/' || s.id || '/' || v.method || '/' || v.dataset_id || '/' || v.id || '.wav' AS audio_path
FROM v CROSS JOIN systems s WHERE coalesce(s.enabled, true)"""


@register(_MANIFEST)
def synthesis_manifest(spark, sf):
    variants = summaries.latest(_t(spark, sf, "dataset_05_punctuation"), ["id", "method"], "ingested_at", ["dataset_id", "dataset_file", "scenario", "language", "text", "original_text", "normalized_text", "source_url"])
    rows = manifests.synthesis_manifest(variants, _t(spark, sf, "systems"), "audio")
    return rows.select("utterance_id", "source_text", "synthesis_text", "source_token_count", "synthesis_token_count", "tts_system_id", F.col("metadata.voice").alias("voice"), "audio_path")


_JOB = ("tts_system_id", "preprocessing_method", "dataset_id", "scenario", "sentence_id", "language", "audio_path", "source_text", "synthesis_text")
_ASR = {"id": "fono_large", "backend": "local", "model": "large-v3", "language": "el", "align": True, "alignment_model": "align-el", "diarize": True}


@register(f"WITH {_CLIPS} SELECT utterance_id, coalesce(nullif(language, ''), 'el') AS language, 'transcripts/fono_large/' || tts_system_id || '/' || preprocessing_method || '/' || dataset_id || '/' || sentence_id || '.json' AS transcript_path, synthesis_text AS expected_text, "
          "'whisperx ' || audio_path || ' --model large-v3 --language ' || coalesce(nullif(language, ''), 'el') || ' --task transcribe --output_format json --output_dir transcripts/fono_large/' || tts_system_id || '/' || preprocessing_method || '/' || dataset_id || ' --device cuda --compute_type float16 --batch_size 16 --align_model align-el --diarize' AS command FROM clips")  # fmt: skip
def transcription_manifest(spark, sf):
    rows = manifests.transcription_manifest(_clips(spark, sf, *_JOB), _ASR, "transcripts")
    return rows.select("utterance_id", "language", "transcript_path", "expected_text", F.array_join("command", " ").alias("command"))


@register("WITH w AS (SELECT DISTINCT dataset_id, id, m AS method FROM dataset_05_punctuation CROSS JOIN (VALUES ('raw'), ('regex'), ('llm'), ('spoken')) t(m)) SELECT w.* FROM w ANTI JOIN dataset_05_punctuation v USING (dataset_id, id, method)")
def missing_variant_sentences(spark, sf):
    v = _t(spark, sf, "dataset_05_punctuation")
    return manifests.missing_sentences(v, v, ["raw", "regex", "llm", "spoken"])


@register("WITH f AS (SELECT DISTINCT dataset_file FROM dataset_01_normal_text UNION SELECT DISTINCT dataset_file FROM dataset_05_punctuation), w AS (SELECT dataset_file, m AS method FROM f CROSS JOIN (VALUES ('raw'), ('regex'), ('llm')) t(m)), h AS (SELECT DISTINCT dataset_file, method FROM dataset_05_punctuation) "
          "SELECT w.dataset_file, w.method, CASE WHEN h.method IS NOT NULL THEN w.method || '/' || w.dataset_file WHEN w.method = 'raw' THEN w.dataset_file END AS served_by FROM w LEFT JOIN h USING (dataset_file, method)")  # fmt: skip
def variant_sources(spark, sf):
    v = _t(spark, sf, "dataset_05_punctuation")
    files = _t(spark, sf, "dataset_01_normal_text").select("dataset_file").union(v.select("dataset_file"))
    return manifests.variant_sources(files, v, ["raw", "regex", "llm"])


_BY_SYSTEM, _BY_PAIR, _BY_VOICE = {"lyra_v1": "refs/by_system.wav"}, {"harmonic::refs/harmonic_f.wav": "refs/by_pair.wav"}, {"refs/harmonic_m.wav": "refs/by_voice.wav"}


@register(f"WITH {_CLIPS} SELECT utterance_id, CASE WHEN tts_system_id = 'lyra_v1' THEN 'refs/by_system.wav' WHEN tts_family = 'harmonic' AND metadata.voice = 'refs/harmonic_f.wav' THEN 'refs/by_pair.wav' WHEN metadata.voice = 'refs/harmonic_m.wav' THEN 'refs/by_voice.wav' END AS reference_path, "
          "CASE WHEN tts_system_id = 'lyra_v1' THEN 'system:lyra_v1' WHEN tts_family = 'harmonic' AND metadata.voice = 'refs/harmonic_f.wav' THEN 'family_voice:harmonic::refs/harmonic_f.wav' WHEN metadata.voice = 'refs/harmonic_m.wav' THEN 'voice:refs/harmonic_m.wav' END AS reference_selector FROM clips")  # fmt: skip
def reference_resolution(spark, sf):
    rows = manifests.resolve_references(_clips(spark, sf, "tts_system_id", "tts_family", "metadata"), _BY_SYSTEM, _BY_PAIR, _BY_VOICE)
    return rows.select("utterance_id", "reference_path", "reference_selector")


@register(f"WITH {_CLIPS} SELECT tts_system_id, row_number() OVER (PARTITION BY tts_system_id ORDER BY utterance_id) AS handoff_index, utterance_id, trim(regexp_replace(synthesis_text, '[\\s\\p{{Z}}]+', ' ', 'g')) AS handoff_text, trim(regexp_replace(synthesis_text, '[\\s\\p{{Z}}]+', ' ', 'g')) <> synthesis_text AS text_changed, "
          "printf('%03d_ft.wav', row_number() OVER (PARTITION BY tts_system_id ORDER BY utterance_id)) AS returned_wav FROM clips")  # fmt: skip
def handoff_index(spark, sf):
    return manifests.handoff_index(_clips(spark, sf, "tts_system_id", "synthesis_text", "audio_path")).select("tts_system_id", "handoff_index", "utterance_id", "handoff_text", "text_changed", "returned_wav")


@register(f"WITH {_CLIPS} SELECT tts_system_id, count(*) AS rows, count(*) FILTER (WHERE trim(regexp_replace(synthesis_text, '[\\s\\p{{Z}}]+', ' ', 'g')) <> synthesis_text) AS changed FROM clips GROUP BY 1")
def handoff_summary(spark, sf):
    line = text.collapse_spaces(F.col("synthesis_text"))
    clips = _clips(spark, sf, "tts_system_id", "synthesis_text")
    return manifests.handoff_summary(clips.select("tts_system_id", (line != F.col("synthesis_text")).alias("text_changed")))


@register(f"WITH {_ALL}, e AS (SELECT scenario, dataset_file, count(*) AS eligible FROM sentences GROUP BY 1, 2) SELECT scenario, dataset_file, eligible, CAST(greatest(0, least(eligible, 1000 - coalesce(sum(eligible) OVER (PARTITION BY scenario ORDER BY dataset_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken FROM e")
def scenario_caps(spark, sf):
    eligible = _sentences(spark, sf, "scenario", "dataset_file").groupBy("scenario", "dataset_file").agg(F.count("*").alias("eligible"))
    return manifests.scenario_caps(eligible, 1000)


@register("SELECT dataset_id, id FROM (SELECT DISTINCT dataset_id, id FROM llm_variants) QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY sha256('20260610:' || dataset_id || ':' || id), id) <= 50")
def hash_selection(spark, sf):
    return manifests.hash_selected(_t(spark, sf, "llm_variants").select("dataset_id", "id").distinct(), 50, "20260610")


@register("SELECT dataset_id, id FROM (SELECT dataset_id, id, min(sentence_index) AS sentence_index FROM llm_variants GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY sentence_index, id) <= 50")
def first_sentences(spark, sf):
    rows = _t(spark, sf, "llm_variants").groupBy("dataset_id", "id").agg(F.min("sentence_index").alias("sentence_index"))
    return manifests.first_of_dataset(rows, 50).select("dataset_id", "id")


@register()
def seeded_shuffle(spark, sf):
    rows = _t(spark, sf, "llm_variants").groupBy("dataset_id", "id").agg(F.min("sentence_index").alias("sentence_index"))
    return manifests.shuffled_selection(rows, 50, 20260610)


# --- rules --------------------------------------------------------------------------------------------------------------
#: Every sentence once more, broken in a way that goes round by its place, under its own id or that of its neighbour.
_BROKEN_SQL = """broken AS (SELECT dataset_file, CASE WHEN sentence_index % 5 = 4 THEN id ELSE id || '_x' END AS id, CASE WHEN sentence_index % 5 = 0 THEN '' ELSE text END AS text,
  CASE sentence_index % 5 WHEN 1 THEN NULL WHEN 2 THEN word_count + 9 ELSE word_count END AS word_count, CASE WHEN sentence_index % 5 = 3 THEN NULL ELSE characteristics END AS characteristics FROM sentences),
every AS (SELECT dataset_file, id, text, word_count, characteristics FROM sentences UNION ALL SELECT * FROM broken)"""
_ISSUES_SQL = f"""{_BROKEN_SQL}, i AS (
  SELECT dataset_file AS path, 'error' AS severity, 'empty_text' AS code, id AS sentence_id FROM every WHERE coalesce(text, '') = ''
  UNION ALL SELECT dataset_file, 'error', 'word_count_not_int', id FROM every WHERE word_count IS NULL
  UNION ALL SELECT dataset_file, 'warning', 'word_count_mismatch', id FROM every WHERE abs(word_count - {_WORDS('text')}) > 2
  UNION ALL SELECT dataset_file, 'error', 'characteristics_not_object', id FROM every WHERE characteristics IS NULL
  UNION ALL SELECT dataset_file, 'error', 'duplicate_sentence_id', id FROM every GROUP BY dataset_file, id HAVING count(*) > 1)"""


def _sentences_and_broken(spark, sf) -> DataFrame:
    rows = _sentences(spark, sf, "dataset_file", "text", "sentence_index", "word_count", "characteristics")
    kind = F.col("sentence_index") % 5
    row = lambda i, t, n, c: F.struct(i.alias("id"), t.alias("text"), n.alias("word_count"), c.alias("characteristics"))
    broken = row(
        F.when(kind == 4, F.col("id")).otherwise(F.concat("id", F.lit("_x"))), F.when(kind == 0, "").otherwise(F.col("text")),
        F.when(kind == 1, None).when(kind == 2, F.col("word_count") + 9).otherwise(F.col("word_count")), F.when(kind != 3, F.col("characteristics")),
    )
    return rows.select("dataset_file", F.explode(F.array(row(F.col("id"), F.col("text"), F.col("word_count"), F.col("characteristics")), broken)).alias("r")).select("dataset_file", "r.*")


@register(f"WITH {_ALL}, {_ISSUES_SQL} SELECT * FROM i")
def sentence_rule_issues(spark, sf):
    return checks.sentence_issues(_sentences_and_broken(spark, sf)).select("path", "severity", "code", "sentence_id")


@register(f"WITH {_ALL}, {_ISSUES_SQL} SELECT severity, code, count(*) AS n FROM i GROUP BY 1, 2")
def issue_counts(spark, sf):
    return checks.issue_counts(checks.sentence_issues(_sentences_and_broken(spark, sf)))


@register("SELECT id, count(*) AS n_rows FROM dataset_01_normal_text GROUP BY id HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return checks.doubled_keys(_t(spark, sf, "dataset_01_normal_text"), ["id"])


_PARENTS = (("dataset_01_normal_text", "id"), ("dataset_05_punctuation", "id"), ("dataset_12_morphological", "id"), ("heldout_items", "sentence_id"))


@register("WITH p AS (" + " UNION ".join(f"SELECT dataset_id, {k} AS sentence_id FROM {t}" for t, k in _PARENTS) + "), c AS (SELECT DISTINCT dataset_id, sentence_id FROM asr_scores) "
          "SELECT c.dataset_id, count(*) AS n_keys, count(*) FILTER (WHERE p.sentence_id IS NULL) AS n_orphans FROM c LEFT JOIN p USING (dataset_id, sentence_id) GROUP BY 1")  # fmt: skip
def foreign_key_orphans(spark, sf):
    """Keys of the scores by data set, and those that none of the four tables they refer to holds."""
    parents = reduce(DataFrame.unionByName, [_t(spark, sf, t).select("dataset_id", F.col(k).alias("sentence_id")) for t, k in _PARENTS])
    scores = _t(spark, sf, "asr_scores").select("dataset_id", "sentence_id").distinct()
    lost = checks.orphans(scores, ["dataset_id", "sentence_id"], parents, ["dataset_id", "sentence_id"]).groupBy("dataset_id").agg(F.count("*").alias("n_orphans"))
    return scores.groupBy("dataset_id").agg(F.count("*").alias("n_keys")).join(lost, "dataset_id", "left").fillna(0, ["n_orphans"])


@register("SELECT DISTINCT a.sentence_id FROM (SELECT sentence_id FROM asr_scores) a ANTI JOIN (SELECT id AS sentence_id FROM dataset_05_punctuation) d USING (sentence_id)")
def sentences_outside(spark, sf):
    """Scored sentences that are not of the punctuation set."""
    return checks.orphans(_t(spark, sf, "asr_scores"), ["sentence_id"], _t(spark, sf, "dataset_05_punctuation"), ["id"])


@register("SELECT coalesce(s.utterance_id, a.utterance_id) AS utterance_id, CASE WHEN a.utterance_id IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT utterance_id FROM synthesis) s FULL JOIN (SELECT DISTINCT utterance_id FROM asr_scores WHERE wer IS NOT NULL) a ON s.utterance_id = a.utterance_id WHERE s.utterance_id IS NULL OR a.utterance_id IS NULL")
def manifest_coverage(spark, sf):
    """Clips without any rate, and rates without a clip."""
    return checks.uncovered(_t(spark, sf, "synthesis"), _t(spark, sf, "asr_scores").filter("wer is not null"), ["utterance_id"])


@register("WITH a AS (SELECT DISTINCT tts_system_id FROM synthesis), b AS (SELECT DISTINCT preprocessing_method FROM synthesis), c AS (SELECT DISTINCT dataset_id, sentence_id FROM synthesis) SELECT tts_system_id, preprocessing_method, dataset_id, sentence_id FROM a, b, c EXCEPT SELECT tts_system_id, preprocessing_method, dataset_id, sentence_id FROM synthesis")
def cartesian_gaps(spark, sf):
    return checks.cartesian_gaps(_t(spark, sf, "synthesis"), [["dataset_id", "sentence_id"], ["tts_system_id"], ["preprocessing_method"]])


@register("WITH h AS (SELECT DISTINCT tts_system_id, preprocessing_method, scenario FROM synthesis), w AS (SELECT s.id AS tts_system_id, m AS preprocessing_method, c.scenario FROM systems s CROSS JOIN (VALUES ('raw'), ('regex'), ('spoken')) t(m) CROSS JOIN (SELECT DISTINCT scenario FROM synthesis) c WHERE coalesce(s.enabled, true)) "
          "SELECT *, 'missing' AS side FROM (SELECT * FROM w EXCEPT SELECT * FROM h) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM h EXCEPT SELECT * FROM w)")  # fmt: skip
def cartesian_differences(spark, sf):
    """Combinations of enabled systems, planned methods and scenarios that the manifest lacks or has beyond them."""
    s = _t(spark, sf, "synthesis")
    systems = manifests.enabled_systems(_t(spark, sf, "systems")).select(F.col("id").alias("tts_system_id"))
    methods = spark.createDataFrame([("raw",), ("regex",), ("spoken",)], "preprocessing_method string")
    return checks.cartesian_differences(s, [s.select("scenario"), systems, methods])


@register("SELECT dataset_id, sentence_id, count(DISTINCT source_url) + max(CAST(source_url IS NULL AS INTEGER)) AS n_values FROM synthesis GROUP BY 1, 2 HAVING count(DISTINCT source_url) + max(CAST(source_url IS NULL AS INTEGER)) > 1")
def functional_dependencies(spark, sf):
    return checks.broken_dependencies(_t(spark, sf, "synthesis"), ["dataset_id", "sentence_id"], "source_url")


@register("SELECT tts_system_id, preprocessing_method, count(*) AS n_rows FROM synthesis GROUP BY 1, 2 HAVING count(*) <> 100")
def balance_check(spark, sf):
    return checks.unbalanced(_t(spark, sf, "synthesis"), ["tts_system_id", "preprocessing_method"], 100)


@register(f"WITH {_CLIPS} SELECT DISTINCT utterance_id, c.\"column\" FROM (SELECT s.utterance_id, unnest([CASE WHEN s.language IS DISTINCT FROM a.language THEN 'language' END, CASE WHEN s.synthesis_text IS DISTINCT FROM a.reference THEN 'reference' END]) AS \"column\" FROM clips s JOIN asr_scores a USING (utterance_id)) c WHERE c.\"column\" IS NOT NULL")
def row_differences(spark, sf):
    clips = _clips(spark, sf, "language", "synthesis_text").withColumn("reference", F.col("synthesis_text"))
    return checks.differing_columns(clips, _t(spark, sf, "asr_scores"), ["utterance_id"], ["language", "reference"])


@register("SELECT tts_system_id, side FROM (SELECT DISTINCT tts_system_id FROM synthesis EXCEPT SELECT id FROM systems WHERE coalesce(enabled, true)) CROSS JOIN (SELECT 'left' AS side) UNION ALL SELECT id, 'right' FROM (SELECT id FROM systems WHERE coalesce(enabled, true) EXCEPT SELECT tts_system_id FROM synthesis)")
def roster_differences(spark, sf):
    """Systems in use that are not enabled, and enabled ones that are not in use."""
    return checks.unequal_sets(_t(spark, sf, "synthesis").select("tts_system_id").distinct(), manifests.enabled_systems(_t(spark, sf, "systems")).select(F.col("id").alias("tts_system_id")).distinct())


@register("SELECT dataset_id, count(*) AS sentences, count(*) FILTER (WHERE len(normalization_warnings) > 0) AS with_warnings FROM (SELECT * FROM llm_variants QUALIFY row_number() OVER (PARTITION BY dataset_id, id ORDER BY ingested_at DESC NULLS LAST) = 1) GROUP BY 1")
def warnings_census(spark, sf):
    rows = summaries.latest(_t(spark, sf, "llm_variants"), ["dataset_id", "id"], "ingested_at", ["normalization_warnings"])
    return rows.groupBy("dataset_id").agg(F.count("*").alias("sentences"), F.count_if(F.size("normalization_warnings") > 0).alias("with_warnings"))


@register(f"WITH {_ALL} SELECT scenario, count(*) AS sentences, count(DISTINCT dataset_file) AS files FROM sentences GROUP BY 1")
def scenario_counts(spark, sf):
    return _sentences(spark, sf, "scenario", "dataset_file").groupBy("scenario").agg(F.count("*").alias("sentences"), F.countDistinct("dataset_file").alias("files"))


# --- answers and judges ---------------------------------------------------------------------------------------------------
#: Answers of a judge in eight shapes, taken in turn: k is the score, a whole number of up to two digits.
_SAID = (
    ('{"clarity": #, "overall": #}', "k", "k"), ('Here: {"scores": {"clarity": "#/5", "overall_mos": #.5}} Done.', "k", "k + 0.5"), ('```json\n{"clarity": #.25, "pace": 3}\n```', "k + 0.25", None),
    ('{"clarity": true, "overall": "about #"}', None, "k"), ('{"clarity": null, "pace": -#}', None, None), ('{"clarity": #', None, None), ('{"overall": {"x": #}, "clarity": "none"}', None, None), ('no score', None, None),
)


def _judge_sql() -> str:
    clamp = lambda v: f"greatest(1.0, least(5.0, {v}))" if v else "NULL"
    pace = {2: "3.0", 4: "1.0"}
    cases = lambda f: "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {f(i, c, o)}" for i, (_, c, o) in enumerate(_SAID)) + " END"
    clarity, overall = cases(lambda i, c, o: clamp(c)), cases(lambda i, c, o: clamp(o))
    pace_of = cases(lambda i, c, o: pace.get(i, "NULL"))
    return f"""WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events), s AS (SELECT event_id, CAST({clarity} AS DOUBLE) AS clarity, CAST({pace_of} AS DOUBLE) AS pace, CAST({overall} AS DOUBLE) AS o FROM e)
SELECT event_id, clarity, pace, coalesce(o, list_avg(list_filter([clarity, pace], lambda x: x IS NOT NULL))) AS mos_overall, coalesce(o, clarity, pace) IS NOT NULL AS parse_ok FROM s"""


@register(_judge_sql())
def judge_scores(spark, sf):
    k = F.get_json_object("props", "$.k")
    shapes = F.array(*[F.lit(s) for s, _, _ in _SAID])
    said = F.replace(F.element_at(shapes, (F.col("event_id") % 8 + 1).cast("int")), F.lit("#"), k)
    rows = _t(spark, sf, "events").select("event_id", answers.judged(said, ["clarity", "pace"]).alias("j"))
    return rows.select("event_id", F.col("j.mos")["clarity"].alias("clarity"), F.col("j.mos")["pace"].alias("pace"), F.col("j.mos_overall").alias("mos_overall"), F.col("j.parse_ok").alias("parse_ok"))


@register(f"WITH {_LATEST} SELECT utterance_id, asr_id, coalesce(hypothesis, regexp_replace(reference, '^[\\s\\x{{85}}\\p{{Z}}]+|[\\s\\x{{85}}\\p{{Z}}]+$', '', 'g'), '') AS transcript FROM latest")
def transcript_texts(spark, sf):
    segments = F.array(F.struct(F.col("reference").alias("text")))
    return _scores(spark, sf, "hypothesis", "reference").select("utterance_id", "asr_id", answers.transcript_text(F.col("hypothesis"), segments).alias("transcript"))


_S = r"\s\x{85}\p{Z}"
_LABELS = "|".join(x.replace("\\s+", f"[{_S}]+") for x in answers.LABELS)
_STRIP = lambda c: f"regexp_replace({c}, '^[{_S}]+|[{_S}]+$', '', 'g')"


def _cleaned_sql() -> str:
    out = f"a0 AS (SELECT *, {_STRIP('normalized_text')} AS x FROM rows), a1 AS (SELECT * REPLACE (CASE WHEN regexp_matches(x, '(?s)^```[{_W}-]*\\n(.*?)\\n?```[{_S}]*$') THEN {_STRIP(f"regexp_extract(x, '(?s)^```[{_W}-]*\\n(.*?)\\n?```[{_S}]*$', 1)")} ELSE x END AS x) FROM a0), a2 AS (SELECT * REPLACE (regexp_replace(x, '(?i)^[{_S}]*(?:{_LABELS})[{_S}]*[:\uff1a][{_S}]*', '') AS x) FROM a1)"
    for i, (o, c) in enumerate(answers.QUOTES, 3):
        o, c = o.replace("'", "''"), c.replace("'", "''")
        n = 2 if o == c else 1
        out += f", a{i} AS (SELECT * REPLACE (CASE WHEN length(x) >= 2 AND starts_with(x, '{o}') AND ends_with(x, '{c}') AND length(x) - length(replace(x, '{o}', '')) = {n} THEN {_STRIP('substr(x, 2, length(x) - 2)')} ELSE x END AS x) FROM a{i - 1})"
    last = 2 + len(answers.QUOTES)
    return out + f", cleaned AS (SELECT * REPLACE ({_STRIP(f"regexp_replace(regexp_replace(regexp_replace(x, '[{_S}]*\\([{_S}]*[Α-ΩΪΫ](?:[.{_S}]*[Α-ΩΪΫ])+[{_S}]*\\.?[{_S}]*\\)', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '[{_S}]+([,.;:!»)])', '\\1', 'g')")} AS x) FROM a{last})"


_MARKERS = " OR ".join(f"(contains(lower(x), '{m.replace("'", "''")}') AND NOT contains(lower(original_text), '{m.replace("'", "''")}'))" for m in answers.REFUSALS)


@register(f"WITH rows AS (SELECT dataset_id, id, original_text, normalized_text FROM llm_variants QUALIFY row_number() OVER (PARTITION BY dataset_id, id ORDER BY ingested_at DESC NULLS LAST) = 1), {_cleaned_sql()}, "
          f"w AS (SELECT *, CASE WHEN coalesce(x, '') = '' THEN 'empty output' ELSE array_to_string(list_filter([CASE WHEN {_MARKERS} THEN 'possible refusal/meta text' END, CASE WHEN CAST(length(x) AS DOUBLE) / greatest(length(original_text), 1) < 0.5 THEN 'output too short' WHEN CAST(length(x) AS DOUBLE) / greatest(length(original_text), 1) > 5 THEN 'output too long' END, "
          "CASE WHEN length(x) - length(replace(x, chr(10), '')) > length(original_text) - length(replace(original_text, chr(10), '')) + 2 THEN 'output has unexpected extra lines' END], lambda v: v IS NOT NULL), '|') END AS kinds FROM cleaned) "
          "SELECT dataset_id, id, CASE WHEN kinds <> '' THEN original_text ELSE x END AS text, kinds FROM w")  # fmt: skip
def answer_checks(spark, sf):
    rows = summaries.latest(_t(spark, sf, "llm_variants").select("dataset_id", "id", "original_text", "normalized_text", "ingested_at"), ["dataset_id", "id"], "ingested_at")
    checked = rows.select("dataset_id", "id", answers.checked_answer(F.col("original_text"), F.col("normalized_text")).alias("c"))
    kinds = F.array_join(F.transform("c.warnings", lambda w: F.regexp_replace(w, r"( \(ratio .*|: .*)$", "")), "|")
    return checked.select("dataset_id", "id", F.col("c.text").alias("text"), kinds.alias("kinds"))


@register(f"WITH {_CLIPS} SELECT utterance_id AS key, 'Rate the attached clip. It should say: ' || source_text AS prompt, audio_path AS uri, 'audio/wav' AS mime FROM clips")
def judge_batch(spark, sf):
    clips = _clips(spark, sf, "source_text", "audio_path")
    line = answers.batch_request(F.col("utterance_id"), answers.user_prompt(F.col("source_text")), text.audio_type(F.col("audio_path")), uri=F.col("audio_path"), instructions=answers.system_prompt({"clarity": "every word can be understood"}), config={"temperature": 0})
    part = lambda p: F.get_json_object("line", f"$.request.contents[0].parts{p}")
    return clips.select(line.alias("line")).select(F.get_json_object("line", "$.key").alias("key"), part("[0].text").alias("prompt"), part("[1].file_data.file_uri").alias("uri"), part("[1].file_data.mime_type").alias("mime"))


# --- vectors and audio ------------------------------------------------------------------------------------------------------
@register("WITH r AS (SELECT label, min_by(CAST(embedding AS DOUBLE[]), vec_id) AS ref FROM embeddings GROUP BY 1) SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), r.ref), 9) AS similarity FROM embeddings e JOIN r USING (label)")
def speaker_similarity(spark, sf):
    e = _t(spark, sf, "embeddings")
    references = ranking.bounded(e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref")), derived=True)
    return e.join(references, "label").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("ref")), 9).alias("similarity"))


@register("WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), l AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS len FROM n) SELECT vec_id, round(len, 9) AS length, round(e[1] / len, 9) AS first, round(list_sum(list_transform(e, lambda x: x / len)), 8) AS total FROM l")
def unit_vectors(spark, sf):
    """Length of every vector, and the first place and sum of the vector brought to length 1."""
    rows = _t(spark, sf, "embeddings").select("vec_id", vectors.norm(F.col("embedding")).alias("l"), vectors.unit(F.col("embedding")).alias("u"))
    return rows.select("vec_id", F.round("l", 9).alias("length"), F.round(F.element_at("u", 1), 9).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 8).alias("total"))


_CLIP_SQL = "CAST(source_token_count AS DOUBLE) / 2 AS duration_s, CASE WHEN synthesis_token_count <> source_token_count THEN 0.5 ELSE 1.0 END AS peak, CASE WHEN metadata.voice IS NULL THEN 16000 ELSE metadata.sample_rate_hz END AS sample_rate"
_ISSUES = "list_filter([CASE WHEN duration_s < 0.3 THEN printf('too short (%.2fs)', duration_s) END, CASE WHEN duration_s > 12.0 THEN printf('too long (%.2fs)', duration_s) END, CASE WHEN peak < 0.01 THEN printf('near-silent (peak %.4f)', peak) WHEN peak >= 0.999 THEN 'possible clipping (peak at full scale)' END, CASE WHEN sample_rate <> metadata.sample_rate_hz THEN 'sample rate ' || sample_rate || ' != configured ' || metadata.sample_rate_hz END], lambda v: v IS NOT NULL)"


def _measured(spark, sf) -> DataFrame:
    """Stand-ins for measured clips, computed from the manifest, as the tables hold no audio."""
    rows = _clips(spark, sf, "tts_system_id", "source_token_count", "synthesis_token_count", "metadata").withColumns({
        "duration_s": F.col("source_token_count").cast("double") / 2, "peak": F.when(F.col("synthesis_token_count") != F.col("source_token_count"), 0.5).otherwise(1.0),
        "sample_rate": F.when(F.col("metadata.voice").isNull(), 16000).otherwise(F.col("metadata.sample_rate_hz")),
    })
    return rows.withColumn("issues", audio.issues(F.col("duration_s"), F.col("peak"), F.col("sample_rate"), F.col("metadata.sample_rate_hz"), longest=12.0))


@register(f"WITH {_CLIPS}, m AS (SELECT *, {_CLIP_SQL} FROM clips) SELECT utterance_id, array_to_string({_ISSUES}, ',') AS issues FROM m")
def qc_flags(spark, sf):
    return _measured(spark, sf).select("utterance_id", F.array_join("issues", ",").alias("issues"))


@register(_grouped_sql(f"WITH {_CLIPS}, m AS (SELECT *, {_CLIP_SQL} FROM clips), base AS (SELECT __KEYS__, duration_s, sample_rate, {_ISSUES} AS issues FROM m)", (("overall", ()), ("by_system", ("tts_system_id",))),
          f"count(*) AS \"count\", count(*) FILTER (WHERE issues = ['missing']) AS missing, count(*) FILTER (WHERE len(issues) > 0) AS with_issues, array_to_string(list_sort(list(DISTINCT sample_rate) FILTER (WHERE sample_rate IS NOT NULL)), ',') AS sample_rates, {_MEAN('duration_s')} AS mean_duration_s, min(duration_s) AS min_duration_s, max(duration_s) AS max_duration_s"))
def qc_summary(spark, sf):
    return summaries.qc_summary(_measured(spark, sf))


@register(_grouped_sql(f"WITH {_CLIPS}, e AS (SELECT DISTINCT c.audio_path FROM clips c SEMI JOIN asr_scores a ON a.utterance_id = c.utterance_id), base AS (SELECT __KEYS__, e.audio_path IS NOT NULL AS there FROM clips LEFT JOIN e USING (audio_path))", (("overall", ()), ("by_system", ("tts_system_id",)), ("by_family", ("tts_family",))),
          "count(*) AS rows, nullif(count(*) FILTER (WHERE there), 0) AS existing, nullif(count(*) FILTER (WHERE NOT there), 0) AS missing"))
def presence_counts(spark, sf):
    clips = _clips(spark, sf, "tts_system_id", "tts_family", "audio_path")
    existing = clips.join(_t(spark, sf, "asr_scores").select("utterance_id").distinct(), "utterance_id", "left_semi")
    return summaries.presence_counts(clips, existing)


# --- candidate corpora --------------------------------------------------------------------------------------------------------
_CHUNKS = f"""WITH pieces AS (SELECT doc_id, page_id, revision_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?。\uff01\uff1f।॥])[{_S}]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_STRIP('s')}), lambda s: s <> '') AS cs FROM documents WHERE text IS NOT NULL),
chunks AS (SELECT doc_id, page_id, revision_id, unnest(range(len(cs))) AS chunk_index, unnest(cs) AS chunk FROM pieces),
early AS (SELECT *, {_WORDS('chunk')} AS words, CASE WHEN length(chunk) < 25 OR length(chunk) > 300 THEN 'character_length' WHEN {_WORDS('chunk')} < 4 OR {_WORDS('chunk')} > 20 THEN 'rough_word_length' WHEN regexp_matches(chunk, '[0-9]{{4}}') THEN 'exclude_pattern' END AS e FROM chunks),
judged AS (SELECT *, coalesce(e, CASE WHEN row_number() OVER (PARTITION BY e, chunk ORDER BY doc_id, chunk_index) > 1 THEN 'duplicate_text' END) AS reason FROM early)"""


def _judged(spark, sf) -> DataFrame:
    docs = _t(spark, sf, "documents").select("doc_id", "page_id", "revision_id", "text")
    return collect.judged_candidates(collect.chunks(docs).drop("text"), ["doc_id", "chunk_index"], min_words=4, max_words=20, exclude="[0-9]{4}")


@register(_CHUNKS + " SELECT coalesce(reason, 'eligible_unique') AS counter, count(*) AS n FROM judged GROUP BY 1 UNION ALL SELECT 'candidates', count(*) FROM judged")
def candidate_counts(spark, sf):
    return collect.collection_counts(_judged(spark, sf))


@register(_CHUNKS + " SELECT 'wiki_' || substr(sha256('el:' || coalesce(page_id, 0) || ':' || coalesce(revision_id, 0) || ':' || chunk), 1, 24) AS id, chunk AS text, words AS word_count, regexp_matches(chunk, '\\p{Nd}') AS has_digit, sha256(chunk) AS text_sha256, page_id FROM judged WHERE reason IS NULL")
def candidate_rows(spark, sf):
    """The kept chunks; a missing page or revision counts as 0 in their ids."""
    kept = collect.kept_candidates(_judged(spark, sf)).withColumns({"_page": F.col("page_id"), "page_id": F.coalesce("page_id", F.lit(0)), "revision_id": F.coalesce("revision_id", F.lit(0))})
    rows = collect.candidates(kept.drop("_page"), "el")
    return rows.select("id", "text", "word_count", "has_digit", "text_sha256", F.nullif("page_id", F.lit(0)).alias("page_id"))


@register(_CHUNKS.replace("WHEN regexp_matches(chunk, '[0-9]{4}') THEN 'exclude_pattern'", "WHEN NOT regexp_matches(chunk, '[0-9]') THEN 'include_pattern'") + " SELECT coalesce(reason, 'eligible_unique') AS counter, count(*) AS n FROM judged GROUP BY 1 UNION ALL SELECT 'candidates', count(*) FROM judged")
def included_counts(spark, sf):
    """Counters where only chunks with a digit are wanted."""
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    return collect.collection_counts(collect.judged_candidates(collect.chunks(docs).drop("text"), ["doc_id", "chunk_index"], min_words=4, max_words=20, include="[0-9]"))


@register("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_seen_texts(spark, sf):
    return ranking.first_rows(_t(spark, sf, "documents").select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id")


@register("WITH d AS (SELECT doc_id, page_id, CASE WHEN source IS NULL THEN 1 ELSE 0 END AS ns, contains(text, '(') AS dis FROM documents), e AS (SELECT *, CASE WHEN page_id IS NULL THEN 'missing_or_invalid' WHEN ns <> 0 THEN 'not_an_article' WHEN dis THEN 'disambiguation' END AS early FROM d) "
          "SELECT doc_id, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY early, page_id ORDER BY doc_id) > 1 THEN 'duplicate_page' END) AS reason FROM e")  # fmt: skip
def page_reasons(spark, sf):
    """Documents as requested pages: those without a source stand for other namespaces, those with a bracket for lists."""
    pages = _t(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "page_id", F.col("source").isNull().cast("int").alias("namespace"), F.col("text").contains("(").alias("disambiguation"))
    return collect.page_reasons(pages).select(F.col("pos").alias("doc_id"), "reason")


@register("SELECT dataset_file, count(DISTINCT sentence_id) AS n_ids, sha256(array_to_string(list_sort(list(DISTINCT sentence_id)), ',')) AS ids_sha256 FROM synthesis GROUP BY 1")
def selected_ids(spark, sf):
    """Sentences that the manifest takes from every file, their lists by digest."""
    return manifests.selected_ids(_t(spark, sf, "synthesis").select("dataset_file", "sentence_id")).select("dataset_file", F.col("n_ids").cast("bigint").alias("n_ids"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"))


@register(f"WITH {_CLIPS} SELECT tts_system_id, count(*) AS n FROM clips WHERE tts_system_id NOT IN ('lyra_v1', 'harmonic_v2') GROUP BY 1")
def included_systems(spark, sf):
    rows = manifests.without_systems(_clips(spark, sf, "tts_system_id"), ["lyra_v1", "harmonic_v2"])
    return rows.groupBy("tts_system_id").agg(F.count("*").alias("n"))


@register("SELECT audio_path, CASE WHEN ends_with(audio_path, '1.wav') THEN 'first' WHEN ends_with(audio_path, '2.wav') THEN 'second' WHEN starts_with(audio_path, 'audio/') AND ends_with(audio_path, '.wav') THEN 'clip_' || regexp_extract(audio_path, '([^/]*?)\\.[^./]*$', 1) END AS asset_id, "
          "CASE WHEN ends_with(audio_path, '1.wav') OR ends_with(audio_path, '2.wav') THEN 'shared' WHEN starts_with(audio_path, 'audio/') AND ends_with(audio_path, '.wav') THEN 'clip' END AS asset_kind FROM (SELECT DISTINCT audio_path FROM synthesis)")  # fmt: skip
def reference_assets(spark, sf):
    paths = _t(spark, sf, "synthesis").select(F.col("audio_path").alias("path")).distinct()
    found = manifests.reference_assets(paths, [("1.wav", "first", "refs/1.wav", "shared"), ("2.wav", "second", "refs/2.wav", "shared")], [("audio/", ".wav", "clip_", "clip")])
    return found.select(F.col("path").alias("audio_path"), "asset_id", "asset_kind")


@register("WITH p AS (SELECT DISTINCT audio_path FROM synthesis), there AS (SELECT DISTINCT s.audio_path FROM synthesis s SEMI JOIN asr_scores a ON a.utterance_id = s.utterance_id AND a.wer > 0.2) "
          "SELECT audio_path, CASE WHEN starts_with(audio_path, '/') THEN audio_path WHEN t.audio_path IS NOT NULL THEN '/work/' || audio_path ELSE '/conf/' || audio_path END AS resolved_path FROM p LEFT JOIN there t USING (audio_path)")  # fmt: skip
def resolved_audio_paths(spark, sf):
    """Clips with a high rate stand for those that exist below the working folder."""
    s = _t(spark, sf, "synthesis").select("utterance_id", "audio_path")
    there = s.join(_t(spark, sf, "asr_scores").filter("wer > 0.2").select("utterance_id"), "utterance_id", "left_semi").select(F.concat(F.lit("/work/"), "audio_path").alias("path"))
    return manifests.resolve_audio_paths(s.select("audio_path").distinct(), there, "/work", "/conf")


# --- numbers in context -------------------------------------------------------------------------------------------------
def _words_sql(v: str, gender: str = "neuter") -> str:
    """Number words of a whole number under 10^9, from the lists n (neuter) and f (feminine) of the words of 1-999."""
    own = {"neuter": "n", "feminine": "f"}[gender]
    thousand = {"neuter": "χίλια", "feminine": "χίλιες"}[gender]
    return (
        f"CASE WHEN {v} = 0 THEN 'μηδέν' ELSE array_to_string(list_filter([CASE WHEN {v} >= 1000000 THEN CASE WHEN {v} // 1000000 = 1 THEN 'ένα εκατομμύριο' ELSE n[CAST({v} // 1000000 + 1 AS INTEGER)] || ' εκατομμύρια' END END, "
        f"CASE WHEN {v} // 1000 % 1000 = 1 THEN '{thousand}' WHEN {v} // 1000 % 1000 > 1 THEN f[CAST({v} // 1000 % 1000 + 1 AS INTEGER)] || ' χιλιάδες' END, CASE WHEN {v} % 1000 > 0 THEN {own}[CAST({v} % 1000 + 1 AS INTEGER)] END], lambda x: x IS NOT NULL), ' ') END"
    )


_WORD_LISTS = f"w AS (SELECT {_LIST('neuter')} AS n, {_LIST('feminine')} AS f)"
_MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in rewrite.MONTHS) + "]"


@register(f"WITH {_WORD_LISTS}, o AS (SELECT o_orderkey, day(o_orderdate) AS d, month(o_orderdate) AS m, year(o_orderdate) AS y, CAST(floor(o_totalprice) AS BIGINT) AS e, CAST(round(o_totalprice * 100) AS BIGINT) - CAST(floor(o_totalprice) AS BIGINT) * 100 AS c FROM orders) "
          f"SELECT o_orderkey, 'Στις ' || {_words_sql('d', 'feminine')} || ' ' || {_MONTH_LIST}[m] || ' ' || {_words_sql('y')} || ', δηλαδή ' || CASE WHEN d = 1 THEN 'πρώτη' ELSE {_words_sql('d', 'feminine')} END || ' ' || {_MONTH_LIST}[m] || ', πλήρωσε ' || {_words_sql('e')} || ' ευρώ' || CASE WHEN c > 0 THEN ' και ' || {_words_sql('c')} || ' λεπτά' ELSE '' END || '.' AS spoken FROM o, w")  # fmt: skip
def spoken_orders(spark, sf):
    """Dates in two forms, an amount and an abbreviation, of every order."""
    date, cents = F.col("o_orderdate"), F.round(F.col("o_totalprice") * 100).cast("bigint")
    months = F.array(*[F.lit(m) for m in rewrite.MONTHS])
    amount = F.concat(F.floor("o_totalprice").cast("string"), F.lit(","), F.lpad((cents - F.floor("o_totalprice") * 100).cast("string"), 2, "0"))
    written = F.concat(F.lit("Στις "), F.date_format(date, "dd/MM/yyyy"), F.lit(", δηλ. "), F.dayofmonth(date).cast("string"), F.lit(" "), F.element_at(months, F.month(date)), F.lit(", πλήρωσε "), amount, F.lit(" €."))
    return rewrite.verbalise(_t(spark, sf, "orders").select("o_orderkey", written.alias("t")), "t", "spoken").select("o_orderkey", "spoken")


@register(f"WITH {_WORD_LISTS}, l AS (SELECT DISTINCT l_orderkey % 24 AS h, l_partkey % 60 AS m, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS s FROM lineitem) "
          f"SELECT h AS hours, m AS minutes, q AS quantity, s AS share, {_words_sql('h', 'feminine')} || CASE m WHEN 0 THEN ' ακριβώς' WHEN 30 THEN ' και μισή' ELSE ' και ' || {_words_sql('m')} END || ': μείον ' || {_words_sql('q')} || ' κόμμα ' || CASE WHEN s < 10 THEN 'μηδέν ' || {_words_sql('s')} ELSE {_words_sql('s')} END || ', ' || {_words_sql('s')} || ' και ' || {_words_sql('q')} || ' τοις εκατό' AS spoken FROM l, w")  # fmt: skip
def spoken_measures(spark, sf):
    """A time, a negative decimal and a share with a decimal mark, of every kind of line."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    rows = _t(spark, sf, "lineitem").select((F.col("l_orderkey") % 24).alias("hours"), (F.col("l_partkey") % 60).alias("minutes"), F.col("l_quantity").cast("bigint").alias("quantity"), F.round(F.col("l_discount") * 100).cast("bigint").alias("share")).distinct()
    share, quantity = F.col("share").cast("string"), F.col("quantity").cast("string")
    written = F.concat(F.col("hours").cast("string"), F.lit(":"), two(F.col("minutes")), F.lit(": -"), quantity, F.lit(","), two(F.col("share")), F.lit(", "), share, F.lit(","), quantity, F.lit("%"))
    return rewrite.verbalise(rows.withColumn("t", written), "t", "spoken").drop("t")


@register("WITH v AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{rewrite.ordinal_words(i, 'feminine')}', '{rewrite.ordinal_words(i, 'masculine')}', '{rewrite.ordinal_words(i, 'neuter')}')" for i in range(1, 51)) + ") t(p_size, f, m, n)) "
          "SELECT p_partkey, 'η ' || f || ', ο ' || m || ' και το ' || n || CASE p_size WHEN 2 THEN ', ένα δεύτερο' WHEN 3 THEN ', δύο τρίτα' WHEN 10 THEN ', εννέα δέκατα' ELSE '' END AS spoken FROM part JOIN v USING (p_size)")  # fmt: skip
def spoken_ordinals(spark, sf):
    """Ordinals in three genders, and fractions, of every part."""
    n = F.col("p_size").cast("string")
    fraction = F.when(F.col("p_size").isin(2, 3, 10), F.concat(F.lit(", "), (F.col("p_size") - 1).cast("string"), F.lit("/"), n)).otherwise("")
    written = F.concat(F.lit("η "), n, F.lit("η, ο "), n, F.lit("ος και το "), n, F.lit("ο"), fraction)
    return rewrite.verbalise(_t(spark, sf, "part").select("p_partkey", written.alias("t")), "t", "spoken").select("p_partkey", "spoken")
