"""The registered queries of the training-data problems and, where SQL expresses them, their counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaflow.llm import copies, languages, leakage, lookalikes, mixture, pairs, quota, sampling
from glossaflow.operators import summaries

#: Production parameters.
SAMPLE_RATE, SAMPLE_SALT = 0.1, "stable-sample-1"
QUOTA_SALT = "quota-1"


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _quota(spark: SparkSession, sf: str) -> quota.QuotaPlan:
    targets = _read(spark, sf, "category_targets")
    rows = quota.category_rows(_read(spark, sf, "dataset_01_normal_text"), _read(spark, sf, "dataset_12_morphological"), targets)
    return quota.QuotaPlan(rows, targets, QUOTA_SALT)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.defective_pairs(_read(spark, sf, "llm_variants"))


def p1_by_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs and defects by data set and kind."""
    judged = pairs.judged_pairs(_read(spark, sf, "llm_variants"))
    return judged.groupBy("dataset_id", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("n_pairs"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return copies.copy_links(_read(spark, sf, "dataset_01_normal_text"), "id", "text", "ingested_at")


def p2_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return copies.collapsed_records(_read(spark, sf, "dataset_01_normal_text"), "id", "text", "ingested_at")


def p3_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sampled_keys(_read(spark, sf, "dataset_01_normal_text"), "id", SAMPLE_RATE, SAMPLE_SALT)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.changed_fields(_read(spark, sf, "dataset_05_punctuation"), ["original_text", "normalized_text"], ["id", "method"])


def p4_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of the latest row of every key in their consistent form."""
    rows = summaries.latest(_read(spark, sf, "dataset_05_punctuation"), ["id", "method"], "ingested_at", ["original_text", "normalized_text"])
    done = lookalikes.consistent_form(rows, ["original_text", "normalized_text"], ["id", "method"])
    return done.select("id", "method", F.col("original_text_clean").alias("original_text"), F.col("normalized_text_clean").alias("normalized_text"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Targets that the repaired draw falls short of because too few ids have the category."""
    return _quota(spark, sf).report().filter("short_by > 0 and not can_be_met").select("table_name", "category")


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return _quota(spark, sf).report()


def p5_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _quota(spark, sf).sample().withColumnRenamed("sig", "category")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(_read(spark, sf, "documents"), _read(spark, sf, "heldout_items")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(leakage.leaks(_read(spark, sf, "documents"), _read(spark, sf, "heldout_items")))


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.Mixture(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets")).rows()


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.Mixture(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets")).shares()


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return languages.mislabelled(_read(spark, sf, "documents"))


def p8_documents(spark: SparkSession, sf: str) -> DataFrame:
    return languages.document_languages(_read(spark, sf, "documents"))


def p8_segments(spark: SparkSession, sf: str) -> DataFrame:
    return languages.language_segments(_read(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_by_dataset, p2_found, p2_collapsed, p3_sample, p4_found, p4_forms, p5_found, p5_report, p5_sample, p6_found, p6_items, p7_mixture, p7_shares, p8_found, p8_documents, p8_segments)
    return {f.__name__: f for f in found}


_UNIT = f"CAST(('0x' || substr(sha256('{SAMPLE_SALT}:' || id), 1, {sampling.UNIT_HEX})) AS BIGINT) / {float(16**sampling.UNIT_HEX)!r}"

_CATEGORIES = """
WITH flags AS (
  SELECT id, CASE WHEN lower(trim(characteristics['has_numbers'])) IN ('true','1','yes') THEN 'true' WHEN lower(trim(characteristics['has_numbers'])) IN ('false','0','no') THEN 'false' END AS n,
         CASE WHEN lower(trim(characteristics['has_acronyms'])) IN ('true','1','yes') THEN 'true' WHEN lower(trim(characteristics['has_acronyms'])) IN ('false','0','no') THEN 'false' END AS a
  FROM dataset_01_normal_text WHERE id IS NOT NULL),
tagged AS (
  SELECT 'dataset_01_normal_text' AS table_name, id, 'numbers=' || n || ',acronyms=' || a AS category FROM flags
  UNION ALL
  SELECT 'dataset_12_morphological', m.id, t.category FROM dataset_12_morphological m LEFT JOIN category_targets t
    ON t.table_name = 'dataset_12_morphological'
    AND lower(regexp_replace(m.characteristics['subcategory'], '[\\s_-]+', '', 'g')) = lower(regexp_replace(t.category, '[\\s_-]+', '', 'g'))
  WHERE m.id IS NOT NULL),
sizes AS (SELECT table_name, count(DISTINCT id) AS n FROM tagged GROUP BY 1),
held AS (SELECT table_name, category, count(DISTINCT id) AS held FROM tagged WHERE category IS NOT NULL GROUP BY 1, 2),
needs AS (
  SELECT t.table_name, t.category, coalesce(h.held, 0) AS held, t.min_rows,
         ceil(CAST(t.target_share AS DECIMAL(12, 6)) * floor(CAST(t.sample_share AS DECIMAL(12, 6)) * coalesce(s.n, 0))) AS share_rows
  FROM category_targets t LEFT JOIN sizes s USING (table_name) LEFT JOIN held h USING (table_name, category))
"""


# p2 without look-around: marks between digits and separators in front of a label are told by private-use characters first.
_KEEP, _KEPT, _CUT, _SPACE = "\ue000", "\ue001", "\ue002", r"\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}"
_MARKS = rf"[^\p{{L}}\p{{M}}\p{{N}}{_SPACE}\x{{e000}}-\x{{e002}}]+"
_LABEL_SQL = rf"[^\p{{L}}\p{{M}}\p{{N}}]*\p{{L}}[\p{{L}}\p{{M}}\p{{N}}_.\-]*(?: [\p{{L}}\p{{M}}\p{{N}}_.\-]+){{0,7}}[{_SPACE}]*:"


def _bare_sql(text: str) -> str:
    held = text
    for _ in range(2):  # once more for marks on both sides of one digit
        held = rf"regexp_replace({held}, '(\p{{Nd}})({_MARKS})(\p{{Nd}})', '\1{_KEEP}\2{_KEPT}\3', 'g')"
    strip = lambda t: rf"regexp_replace({t}, '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g')"
    part = f"CASE WHEN contains(p, '{_KEPT}') THEN split_part(p, '{_KEPT}', 1) || {strip(f"split_part(p, '{_KEPT}', 2)")} ELSE {strip('p')} END"
    return f"replace(lower(array_to_string(list_transform(string_split({held}, '{_KEEP}'), lambda p: {part}), '')), 'ς', 'σ')"


_RECORDS = rf"""
WITH latest AS (SELECT id, text FROM dataset_01_normal_text WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, text DESC NULLS LAST) = 1),
parted AS (SELECT id, text, list_filter(string_split(regexp_replace(text, '[|;\x{{37e}}\x{{ff1b}}/•·\n,]+({_LABEL_SQL})', '{_CUT}\1', 'g'), '{_CUT}'), lambda f: {_bare_sql('f')} <> '') AS fields FROM latest),
keyed AS (SELECT id, CASE WHEN len(fields) >= 2 AND len(list_filter(fields, lambda f: NOT regexp_matches(trim(f), '(?s)^{_LABEL_SQL}[{_SPACE}]*[^{_SPACE}:].*$'))) = 0
  THEN 'fields ' || array_to_string(list_sort(list_transform(fields, lambda f: {_bare_sql("split_part(f, ':', 1)")} || chr(1) || {_bare_sql("substr(f, instr(f, ':') + 1)")})), chr(2)) ELSE {_bare_sql('text')} END AS key FROM parted),
records AS (SELECT id, CASE WHEN coalesce(key, '') = '' THEN 'single ' || id ELSE 'record ' || key END AS key FROM keyed)
"""
_FORMS = "WITH latest AS (SELECT * FROM dataset_05_punctuation {where}), once AS (SELECT id, method, original_text, normalized_text, " + ", ".join(f"{lookalikes.cleaning_sql(c)} AS s_{c}" for c in ("original_text", "normalized_text")) + " FROM latest), forms AS (SELECT id, method, original_text, normalized_text, " + ", ".join(f"{lookalikes.words_sql(f's_{c}')} AS f_{c}" for c in ("original_text", "normalized_text")) + " FROM once)"
_CHANGED = " UNION ".join(f"SELECT id, method, '{c}' AS field FROM forms WHERE f_{c} <> {c}" for c in ("original_text", "normalized_text"))


def oracle_sql() -> dict[str, str]:
    """p1, p6, p7 and p8 have no SQL: their tests hold them against brute force and held-out accuracy.

    p4 runs SQL in every partition by the method named; its counterpart is that SQL over the whole table.
    """
    return {
        "p2_found": _RECORDS + "SELECT * FROM (SELECT min(id) OVER (PARTITION BY key) AS kept_id, id AS copy_id FROM records) WHERE kept_id <> copy_id",
        "p2_collapsed": _RECORDS + "SELECT min(id) AS kept_id, count(*) AS n_copies FROM records GROUP BY key",
        "p3_sample": f"SELECT id, count(*) AS n_rows, {_UNIT} AS unit FROM dataset_01_normal_text WHERE {_UNIT} < {SAMPLE_RATE} GROUP BY id",
        "p4_found": _FORMS.replace("{where}", "") + " " + _CHANGED,
        "p4_forms": _FORMS.replace("{where}", "QUALIFY row_number() OVER (PARTITION BY id, method ORDER BY ingested_at DESC NULLS LAST) = 1") + " SELECT id, method, f_original_text AS original_text, f_normalized_text AS normalized_text FROM forms",
        "p5_found": _CATEGORIES + "SELECT DISTINCT table_name, category FROM needs WHERE held < greatest(share_rows, min_rows)",
    }
