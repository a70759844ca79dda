import random

import pytest
from pyspark.sql import functions as F

from glossaflow.functions import distance, numbers_el, rewrite, text
from glossaflow.plans import examples


def one(spark, value, use):
    return spark.createDataFrame([(value,)], "t string").select(use(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "expected"),
    [("", 0), (None, None), ("ένα δύο", 2), ("12/2011 και e-mail", 3), ("a.b.c d", 2), ("¼ m²", 2), ("...", 0)],
)
def test_word_count(spark, value, expected):
    assert one(spark, value, text.word_count) == expected


def test_orthographic_and_folding(spark):
    assert one(spark, " ΚΌΣΜΟΣ, «ναι»!\x1fόχι ", text.orthographic) == "κόσμος ναι όχι"
    assert one(spark, "Άνθρωπος ΐ é ñ", text.fold_accents) == "Ανθρωποσ ι e n"


def test_identifiers(spark):
    assert one(spark, "__α β/ρ x.y__", text.safe_id) == "x.y"
    assert one(spark, "Ωμέγα *~ x", text.quoted_title) == "%CE%A9%CE%BC%CE%AD%CE%B3%CE%B1%20%2A~%20x"
    assert one(spark, "a/../b", text.portable_path) is False
    assert one(spark, "a/b.WAV", text.audio_type) == "audio/wav"
    assert one(spark, "a/b.txt", text.audio_type) is None


def test_sentence_split(spark):
    assert one(spark, "Α. Β! Γ; δ。ε。 ζ\uff01η", text.sentence_split) == ["Α.", "Β!", "Γ; δ。", "ε。", "ζ\uff01", "η"]


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_rates_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [(" ".join(rng.choices("αβγδ", k=rng.randint(0, 9))), " ".join(rng.choices("αβγδ", k=rng.randint(0, 9)))) for _ in range(80)]
    df = spark.createDataFrame(pairs, "r string, h string").select(
        "r", "h", distance.word_rate(F.col("r"), F.col("h")).alias("w"), distance.char_rate(F.col("r"), F.col("h")).alias("c"),
        distance.token_distance_dp(distance.tokens(F.col("r")), distance.tokens(F.col("h"))).alias("dp"),
    )
    for r in df.collect():
        a, b = r.r.split(), r.h.split()
        expected = (0.0 if not b else 1.0) if not a else brute(a, b) / len(a)
        assert r.w == expected and r.c == expected
        if a and b:
            assert r.dp == brute(a, b)


def test_long_vocabulary(spark):
    words = [f"w{i}" for i in range(400)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:-3]))], "r string, h string")
    assert df.select(distance.word_rate(F.col("r"), F.col("h")).alias("x")).first().x == 3 / 400


def test_very_large_numbers(spark):
    values = ["1" + "0" * 27, "123456789012345678901234567890", "-" + "9" * 36, "1" * 60, "", None, "x1"]
    got = [r.w for r in spark.createDataFrame([(v,) for v in values], "n string").select(numbers_el.number_words_col(F.col("n"), "feminine").alias("w")).collect()]
    assert got == [numbers_el.number_words(int(v), "feminine") for v in values[:4]] + [None] * 3


@pytest.mark.parametrize("n", [0, 1, 3, 14, 21, 100, 101, 200, 999, 1000, 1001, 2003, 21_000, 1_000_000, 2_341_005, 10**9, 3 * 10**12 + 5, -7, 10**9 + 1, 10**17, 10**18, 9 * 10**18 + 12, 2 * 10**15 + 10**9, 1_001_000_000])
def test_number_columns_agree(spark, n):
    for gender in numbers_el.GENDERS:
        got = spark.range(1).select(numbers_el.number_words_col(F.lit(n), gender).alias("x")).first().x
        assert got == numbers_el.number_words(n, gender)


def test_number_words():
    assert numbers_el.number_words(1821) == "χίλια οκτακόσια είκοσι ένα"
    assert numbers_el.number_words(482_000, "feminine") == "τετρακόσιες ογδόντα δύο χιλιάδες"
    assert numbers_el.number_words(101) == "εκατόν ένα"
    assert numbers_el.ordinal_words(95, "feminine") == "ενενηκοστή πέμπτη"
    assert numbers_el.ordinal_words(11, "masculine") == "δέκατος πρώτος"
    assert numbers_el.ordinal_words(100) == "εκατό"


@pytest.mark.parametrize(("value", "expected"), examples.SPOKEN)
def test_verbaliser(value, expected):
    assert rewrite.speak(value) == expected


def test_verbaliser_toggles_and_nulls(spark):
    assert rewrite.speak("Ο ΟΗΕ το 5", ("acronyms", "numbers")) == "Ο ΟΗΕ το 5"
    rows = spark.createDataFrame([(None,), ("",), ("5",)], "t string")
    assert [r.s for r in rewrite.verbalise(rows, "t", "s").collect()] == [None, "", "πέντε"]
    assert rewrite.verbalise(rows.limit(0), "t", "s").count() == 0


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("5%2 και 5%-1", "πέντε τοις εκατό2 και πέντε τοις εκατό-ένα"), ("12,5η", "δώδεκα κόμμα πέντεη"), ("12:30%", "δώδεκα και μισή%"), (".5%", "μηδέν και πέντε τοις εκατό"), ("12.$", "δώδεκα δολάρια"),
        ("1/2-3/4", "ένα δεύτερο-τρία τέταρτα"), ("-1/2 και +1/2", "-ένα δεύτερο και συν ένα δεύτερο"), ("+5% -5% -5,5", "+πέντε τοις εκατό -πέντε τοις εκατό μείον πέντε κόμμα πέντε"), ("1,234,567", "1,234,567"),
        ("5 Μαΐου 2020 €", "πέντε Μαΐου δύο χιλιάδες είκοσι ευρώ"), ("12 Μαΐου και 3-4-2021", "δώδεκα Μαΐου και τρεις Απριλίου δύο χιλιάδες είκοσι ένα"), ("ΜέΡΑ25 και ΑΠΕ-ΜΠΕ", "Μέτωπο Ευρωπαϊκής Ρεαλιστικής Ανυπακοής και Αθηναϊκό Πρακτορείο Ειδήσεων - Μακεδονικό Πρακτορείο Ειδήσεων"),
        ("5,5,5€ 3:4 x7", "πέντε,πέντε ευρώ και πέντε λεπτά τρία:τέσσερα x7"), ("1234567 12345678901η", "ένα δύο τρία τέσσερα πέντε έξι επτά ένα δύο τρία τέσσερα πέντε έξι επτά οκτώ εννέα μηδέν έναη"), ("", ""),
    ],
)
def test_clusters(value, expected):
    assert rewrite.speak(value) == expected


def test_policy_equivalences(spark):
    from glossaflow.plans.scoring import error_rates

    rows = spark.createDataFrame(
        [("Στις 14:30 πλήρωσε 5 €.", "στις δεκατέσσερις και μιση πληρωσε πέντε ευρώ", "el"), ("Κατά 12,5%", "κατά δώδεκα και πέντε τοις εκατό", None), ("5 cats", "five cats", "en"), ("", "", "el"), ("α", None, "el")],
        "reference string, hypothesis string, language string",
    )
    got = error_rates(rows).collect()
    assert [r.wer for r in got] == [0.0, 0.0, 0.5, 0.0, 1.0]
    assert got[0].wer_orthographic > 0 and got[1].wer_orthographic > 0
