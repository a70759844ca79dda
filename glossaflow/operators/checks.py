"""Validation rules as queries: each gives its violations as rows, never as exceptions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow.functions.text import word_count
from glossaflow.operators.ranking import bounded

ISSUE = "path string, severity string, code string, message string, sentence_id string"
TOP_FIELDS = ("dataset_id", "language", "scenario", "sentences", "source", "total_sentences")
SENTENCE_FIELDS = ("characteristics", "id", "source_url", "text", "word_count")


def _issue(path: Column, severity: Column | str, code: str, message: Column | str, sentence: Column | None = None) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(path.alias("path"), lit(severity).alias("severity"), F.lit(code).alias("code"), lit(message).alias("message"), (F.lit(None) if sentence is None else sentence).cast("string").alias("sentence_id"))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("ABSENT"))


def dataset_issues(files: DataFrame, *, strict: bool = False, tolerance: int = 2) -> DataFrame:
    """Issues of JSON data sets given as ``path, value`` (whole texts).

    Variants keep an absent field apart from a null one; a null id is an id. Word counts are judged where the text is a
    string, be it empty. Unreadable files and files whose sentences are no list end with
    that issue; duplicates of a sentence id give one issue per id. Order is not part of the result.
    """
    parsed = files.select("path", F.try_parse_json("value").alias("doc"))
    is_object = _kind(F.col("doc")).startswith("OBJECT")
    path = F.col("path")
    bad = parsed.filter(~is_object).select(_issue(path, "error", "json_error", "not a JSON object").alias("i"))
    docs = parsed.filter(is_object)
    keys = F.json_object_keys(F.to_json("doc", {"ignoreNullFields": "false"}))
    missing = docs.select("path", F.explode(F.array_except(F.array(*map(F.lit, TOP_FIELDS)), keys)).alias("f")).select(_issue(path, "error", "missing_top_level_field", F.concat(F.lit("missing field "), "f")).alias("i"))
    listed = docs.withColumn("sentences", F.try_variant_get("doc", "$.sentences", "variant"))
    has_list = _kind(F.col("sentences")).startswith("ARRAY")
    no_list = listed.filter(~has_list).select(_issue(path, "error", "sentences_not_list", "sentences is no list").alias("i"))
    whole = listed.filter(has_list).select("path", "doc", F.try_variant_get("sentences", "$", "array<variant>").alias("items"))
    # Compared by value and kind, as 1, 1.0 and true are one number here, and "1" is none.
    total = F.try_variant_get("doc", "$.total_sentences", "variant")
    number = F.when(_kind(total).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("doc", "$.total_sentences", "double")).when(_kind(total) == "BOOLEAN", F.try_variant_get("doc", "$.total_sentences", "boolean").cast("double"))
    count = whole.filter(~number.eqNullSafe(F.size("items").cast("double"))).select(_issue(path, "error", "sentence_count_mismatch", F.concat(F.lit("total_sentences differs from "), F.size("items").cast("string"))).alias("i"))
    each = whole.select("path", F.posexplode("items").alias("pos", "s"))
    own_id = F.try_variant_get("s", "$.id", "variant")
    sid = F.when(_kind(own_id) == "ABSENT", F.concat(F.lit("index_"), F.col("pos").cast("string"))).when(_kind(own_id) == "VOID", "None").otherwise(F.try_variant_get("s", "$.id", "string"))
    each = each.withColumns({"sid": sid, "object": _kind(F.col("s")).startswith("OBJECT")})
    not_object = each.filter("not object").select(_issue(path, "error", "sentence_not_object", "sentence is no object", F.concat(F.lit("index_"), F.col("pos").cast("string"))).alias("i"))
    rows = each.filter("object")
    text, words = F.try_variant_get("s", "$.text", "variant"), F.try_variant_get("s", "$.word_count", "variant")
    own_keys = F.json_object_keys(F.to_json("s", {"ignoreNullFields": "false"}))
    absent = rows.select("path", "sid", F.explode(F.array_except(F.array(*map(F.lit, SENTENCE_FIELDS)), own_keys)).alias("f")).select(_issue(path, "error", "missing_sentence_field", F.concat(F.lit("missing field "), "f"), F.col("sid")).alias("i"))
    plain = F.when(_kind(text) == "STRING", F.try_variant_get("s", "$.text", "string"))
    empty = F.coalesce(plain, F.lit("")) == ""
    whole_number = _kind(words).isin("BIGINT", "BOOLEAN")
    counted = F.when(_kind(words) == "BOOLEAN", F.try_variant_get("s", "$.word_count", "boolean").cast("bigint")).otherwise(F.try_variant_get("s", "$.word_count", "bigint"))
    off = F.abs(counted - word_count(plain)) > tolerance
    found = F.array_compact(
        F.array(
            F.when(empty, _issue(path, "error", "empty_text", "text is empty or no string", F.col("sid"))),
            F.when(plain.isNotNull() & (_kind(words) != "ABSENT") & ~whole_number, _issue(path, "error", "word_count_not_int", "word_count is no integer", F.col("sid"))),
            F.when(plain.isNotNull() & whole_number & off, _issue(path, "error" if strict else "warning", "word_count_mismatch", "word_count differs from the text", F.col("sid"))),
            F.when((_kind(F.try_variant_get("s", "$.characteristics", "variant")) != "ABSENT") & ~_kind(F.try_variant_get("s", "$.characteristics", "variant")).startswith("OBJECT"), _issue(path, "error", "characteristics_not_object", "characteristics is no object", F.col("sid"))),
        )
    )
    per_sentence = rows.select(F.explode(found).alias("i"))
    doubled = rows.groupBy("path", "sid").count().filter("count > 1").select(_issue(path, "error", "duplicate_sentence_id", "id occurs more than once", F.col("sid")).alias("i"))
    return reduce(DataFrame.unionByName, [bad, missing, no_list, count, not_object, absent, per_sentence, doubled]).select("i.*")


def sentence_issues(sentences: DataFrame, *, strict: bool = False, tolerance: int = 2) -> DataFrame:
    """The row rules over a table of sentences: empty text, word count off, doubled id. Pass one row of re-delivered ones."""
    path, sid = F.col("dataset_file"), F.col("id")
    off = F.abs(F.col("word_count") - word_count(F.col("text"))) > tolerance
    empty = F.coalesce("text", F.lit("")) == ""
    found = F.array_compact(F.array(
        F.when(empty, _issue(path, "error", "empty_text", "text is empty", sid)),
        F.when(F.col("word_count").isNull(), _issue(path, "error", "word_count_not_int", "word_count is no integer", sid)),
        F.when(off, _issue(path, "error" if strict else "warning", "word_count_mismatch", "word_count differs from the text", sid)),
        F.when(F.col("characteristics").isNull(), _issue(path, "error", "characteristics_not_object", "characteristics is no object", sid)),
    ))
    rows = sentences.select(F.explode(found).alias("i"))
    doubled = sentences.groupBy("dataset_file", "id").count().filter("count > 1").select(_issue(path, "error", "duplicate_sentence_id", "id occurs more than once", sid).alias("i"))
    return rows.unionByName(doubled).select("i.*")


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "code").agg(F.count("*").alias("n"))


def doubled_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def orphans(df: DataFrame, keys: Sequence[str], registry: DataFrame, registry_keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``df`` that the registry lacks."""
    known = registry.select(*[F.col(r).alias(k) for k, r in zip(keys, registry_keys)]).distinct()
    return df.select(*keys).distinct().join(known, list(keys), "left_anti")


def uncovered(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, side``: keys on one side only ('left' or 'right'), by one full outer join of the distinct keys."""
    left = a.select(*keys).distinct().withColumn("_l", F.lit(True))
    right = b.select(*keys).distinct().withColumn("_r", F.lit(True))
    both = left.join(right, list(keys), "full_outer")
    return both.filter("_l is null or _r is null").select(*keys, F.when(F.col("_r").isNull(), "left").otherwise("right").alias("side"))


def cartesian_gaps(df: DataFrame, dimensions: Sequence[Sequence[str]]) -> DataFrame:
    """Combinations of the dimensions' distinct values that ``df`` lacks.

    The combinations are the result's own yardstick, so they are made; dimensions of proven size are broadcast to it.
    """
    wanted = _combinations([df.select(*d).distinct() for d in dimensions])
    columns = [c for d in dimensions for c in d]
    return wanted.join(df.select(*columns).distinct(), columns, "left_anti")


def _combinations(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.crossJoin(bounded(y, derived=True)), parts)


def cartesian_differences(df: DataFrame, dimensions: Sequence[DataFrame]) -> DataFrame:
    """``columns, side``: combinations of given dimensions that ``df`` lacks ('missing') or has beyond them ('extra')."""
    wanted = _combinations([d.distinct() for d in dimensions])
    have = df.select(*wanted.columns).distinct()
    missing = wanted.join(have, wanted.columns, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(have.join(wanted, wanted.columns, "left_anti").withColumn("side", F.lit("extra")))


def broken_dependencies(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Keys within which ``value`` is not constant (null counts as a value), with the number of its values."""
    return df.groupBy(*key).agg((F.countDistinct(value) + F.max(F.col(value).isNull().cast("int"))).alias("n_values")).filter("n_values > 1")


def unbalanced(df: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    """Groups whose number of rows differs from ``expected``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") != expected)


def differing_columns(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``keys, column``: shared columns in which the joined rows differ, nulls being equal to nulls."""
    joined = a.alias("a").join(b.alias("b"), list(keys))
    off = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]))
    return joined.select(*keys, F.explode(off).alias("column")).distinct()


def missing_variants(sentences: DataFrame, variants: DataFrame, methods: Sequence[str]) -> DataFrame:
    """``dataset_id, id, method`` of the methods that a sentence lacks: a few rows per sentence, made where it stands."""
    wanted = sentences.select("dataset_id", "id", F.explode(F.array(*map(F.lit, methods))).alias("method")).distinct()
    return wanted.join(variants.select("dataset_id", "id", "method"), ["dataset_id", "id", "method"], "left_anti")


def unequal_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one of two sets only, by EXCEPT both ways."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def hash_mismatches(inventory: DataFrame, files: DataFrame) -> DataFrame:
    """``path, problem`` of an inventory (``path, sha256``) against files (``path, sha256``)."""
    joined = inventory.alias("i").join(files.alias("f"), "path", "full_outer")
    problem = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("i.sha256").isNull(), "unlisted").when(F.col("i.sha256") != F.col("f.sha256"), "changed")
    return joined.select("path", problem.alias("problem")).filter("problem is not null").unionByName(doubled_keys(inventory, ["path"]).select("path", F.lit("listed twice").alias("problem")))
