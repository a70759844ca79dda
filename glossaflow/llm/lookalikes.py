"""p4: visually identical text in one consistent form.

Every Arrow batch goes through an embedded DuckDB: ``nfc_normalize``, ``translate`` and regular expressions in SQL map
compatibility forms, invisible characters, spaces and look-alike letters. The stage is map-only; each worker keeps one
in-memory connection for its partition and sees one batch at a time.

Rules, in this order:
1. full-width forms become ordinary ones, mathematical letters and digits, the micro sign and the Greek symbol letters plain;
2. invisible characters vanish and any other space becomes the ordinary one;
3. a free-standing accent before or after a bare Greek vowel joins it; then canonical composition;
4. in a word that mixes scripts, letters of the minority become their look-alike of the majority (Greek wins a tie).
Whole Latin words, quotes, dashes and signs such as … № ° ½ ² stay as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters that look alike, each row as (other script, imitated script).
_LATIN_AS_GREEK = ("ABEZHIKMNOPTYXaeiknoptuvwxycáéíóúïüı", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαεικηορτυνωχγςάέίόύϊϋι")
_CYRILLIC_AS_GREEK = ("АВЕНІКМОРТУХГПФЛаеікортухвнпфлсѵи", "ΑΒΕΗΙΚΜΟΡΤΥΧΓΠΦΛαεικορτυχβηπφλςνι")
_GREEK_AS_LATIN = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαειηκορτυνωχγάέίόύ", "ABEZHIKMNOPTYXaeinkoptuvwxyáéíóú")
_CYRILLIC_AS_LATIN = ("АВЕНІКМОРСТУХЅЈаеіорсухѕјһԁԛԝѵк", "ABEHIKMOPCTYXSJaeiopcyxsjhdqwvk")


def _table(to: str) -> tuple[str, str]:
    rows = (_LATIN_AS_GREEK, _CYRILLIC_AS_GREEK) if to == "greek" else (_GREEK_AS_LATIN, _CYRILLIC_AS_LATIN)
    return rows[0][0] + rows[1][0], rows[0][1] + rows[1][1]


# Compatibility twins of Greek letters.
_TWINS = ("µϐϑϒϕϖϰϱϲϴϵϹ", "μβθΥφπκρςΘεΣ")
# Full-width signs.
_SIGNS = ("\uffe0\uffe1\uffe2\uffe3\uffe4\uffe5\uffe6", "¢£¬¯¦¥₩")
_FULL = ("".join(chr(c) for c in range(0xFF01, 0xFF5F)) + _SIGNS[0], "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + _SIGNS[1])
_MATHEMATICAL = "".join(chr(c) for c in range(0x1D400, 0x1D800) if len(unicodedata.normalize("NFKC", chr(c))) == 1 and unicodedata.normalize("NFKC", chr(c)) != chr(c))
#: Cf characters, fillers and variation selectors, as RE2 classes.
_INVISIBLE = r"[\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{e0100}-\x{e01ef}]"
_SPACES = r"[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{2028}\x{2029}]"
_WORD = r"[\p{Greek}\p{Latin}\p{Cyrillic}\p{M}]+"
#: Letters of Greek and of Latin words only; signs such as № or ª are no letters of a word.
_BARE, _TONOS = "αεηιουωΑΕΗΙΟΥΩ", "άέήίόύώΆΈΉΊΌΎΏ"
#: Free-standing accents that stand for the tonos.
_ACCENTS = r"[\x{384}\x{b4}\x{2ca}\x{1fef}\x{1ffd}\x{1fbd}\x{1fbf}]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cleaning_sql(column: str) -> str:
    """SQL expression that brings ``column`` to the consistent form."""
    # A translation builds its table for every text, so it runs on those that need it only, the large one on very few.
    narrow, wide = (_FULL[0] + _TWINS[0], _FULL[1] + _TWINS[1]), (_MATHEMATICAL, unicodedata.normalize("NFKC", _MATHEMATICAL))
    full = f"translate({column}, {_quoted(narrow[0])}, {_quoted(narrow[1])})"
    both = f"translate({column}, {_quoted(narrow[0] + wide[0])}, {_quoted(narrow[1] + wide[1])})"
    step = f"CASE WHEN regexp_matches({column}, '[\\x{{1d400}}-\\x{{1d7ff}}]') THEN {both} WHEN regexp_matches({column}, '[\\x{{ff01}}-\\x{{ff5e}}\\x{{ffe0}}-\\x{{ffe6}}{_TWINS[0]}]') THEN {full} ELSE {column} END"
    step = f"regexp_replace(regexp_replace({step}, '{_INVISIBLE}', '', 'g'), '{_SPACES}', ' ', 'g')"
    for bare, accented in zip(_BARE, _TONOS):
        # Capitals carry a free-standing accent in front, small letters behind or in front.
        if bare.isupper():
            step = f"regexp_replace({step}, '{_ACCENTS}{bare}', '{accented}', 'g')"
        else:
            step = f"regexp_replace({step}, '{bare}{_ACCENTS}', '{accented}', 'g')"
    for bare, accented in zip(_BARE, _TONOS):
        if bare.islower():
            step = f"regexp_replace({step}, '{_ACCENTS}{bare}', '{accented}', 'g')"
    return f"nfc_normalize({step})"


def words_sql(column: str) -> str:
    """SQL expression that gives the words of ``column`` that mix scripts the letters of their majority."""
    greek, latin = _table("greek"), _table("latin")
    count = lambda script: f"len(regexp_extract_all(w, '\\p{{{script}}}'))"
    fixed = (
        f"CASE WHEN {count('Greek')} > 0 AND {count('Greek')} >= {count('Latin')} AND regexp_matches(w, '[\\p{{Latin}}\\p{{Cyrillic}}]') THEN translate(w, {_quoted(greek[0])}, {_quoted(greek[1])}) "
        f"WHEN {count('Latin')} > 0 AND regexp_matches(w, '[\\p{{Greek}}\\p{{Cyrillic}}]') THEN translate(w, {_quoted(latin[0])}, {_quoted(latin[1])}) "
        f"WHEN {count('Cyrillic')} > 0 AND translate(w, {_quoted(greek[0])}, {_quoted('')}) = '' THEN translate(w, {_quoted(greek[0])}, {_quoted(greek[1])}) ELSE w END"
    )
    mixed = f"regexp_matches({column}, '\\p{{Cyrillic}}|\\p{{Greek}}\\p{{M}}*\\p{{Latin}}|\\p{{Latin}}\\p{{M}}*\\p{{Greek}}')"
    gaps, words = f"regexp_split_to_array({column}, '{_WORD}')", f"regexp_extract_all({column}, '{_WORD}')"
    joined = f"array_to_string(list_transform(list_zip({gaps}, list_transform({words}, lambda w: {fixed})), lambda p: p[1] || coalesce(p[2], '')), '')"
    return f"CASE WHEN {mixed} THEN nfc_normalize({joined}) ELSE {column} END"


def consistent_form(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """``keys``, and of each of ``columns`` its consistent form ``<c>_clean`` and whether it had to change ``<c>_changed``.

    Null texts stay null and count as unchanged, empty ones stay empty; every row of the input gives one row. Other
    columns are left behind, whatever their names.
    """
    picked = df.select(*[F.col(f"`{k}`").cast("string").alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    ks = "".join(f"k{i}, " for i in range(len(keys)))
    inner = ", ".join(f"c{i}, {cleaning_sql(f'c{i}')} AS s{i}" for i in range(len(columns)))
    outer = ", ".join(f"{words_sql(f's{i}')} AS f{i}, c{i}" for i in range(len(columns)))
    last = ", ".join(f"f{i}, coalesce(f{i} <> c{i}, false) AS b{i}" for i in range(len(columns)))
    sql = f"SELECT {ks}{last} FROM (SELECT {ks}{outer} FROM (SELECT {ks}{inner} FROM batch))"

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB"})
        for b in batches:
            con.register("batch", pa.Table.from_batches([b]))
            yield from con.sql(sql).to_arrow_table().combine_chunks().to_batches()
            con.unregister("batch")

    schema = ", ".join([f"k{i} string" for i in range(len(keys))] + [f"f{i} string, b{i} boolean" for i in range(len(columns))])
    done = picked.mapInArrow(clean, schema)
    named = [F.col(f"k{i}").alias(k) for i, k in enumerate(keys)]
    return done.select(*named, *[x for i, c in enumerate(columns) for x in (F.col(f"f{i}").alias(f"{c}_clean"), F.col(f"b{i}").alias(f"{c}_changed"))])


def changed_fields(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """``keys, field``: one distinct row for every field that had to change."""
    done = consistent_form(df, columns, keys)
    names = F.array_compact(F.array(*[F.when(F.col(f"{c}_changed"), F.lit(c)) for c in columns]))
    return done.select(*keys, F.explode(names).alias("field")).distinct()
