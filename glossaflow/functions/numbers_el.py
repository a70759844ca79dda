"""Greek number words, built from short tables by rule.

``number_words`` gives the words of one value; the Column builders say the same of a column, three digits at a time.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossaflow.functions.text import let

GENDERS = ("masculine", "feminine", "neuter")
# Greek number words, and stems of those that take an ending; a tuple holds the masculine, feminine and neuter forms.
UNITS = ("", ("ένας", "μία", "ένα"), "δύο", ("τρεις", "τρεις", "τρία"), ("τέσσερις", "τέσσερις", "τέσσερα"), "πέντε", "έξι", "επτά", "οκτώ", "εννέα")
TEENS = ("δέκα", "έντεκα", "δώδεκα", ("δεκατρείς", "δεκατρείς", "δεκατρία"), ("δεκατέσσερις", "δεκατέσσερις", "δεκατέσσερα"), "δεκαπέντε", "δεκαέξι", "δεκαεπτά", "δεκαοκτώ", "δεκαεννέα")
TENS = ("", "", "είκοσι", "τριάντα", "σαράντα", "πενήντα", "εξήντα", "εβδομήντα", "ογδόντα", "ενενήντα")
HUNDRED_STEMS = ("", "", "διακόσι", "τριακόσι", "τετρακόσι", "πεντακόσι", "εξακόσι", "επτακόσι", "οκτακόσι", "εννιακόσι")
HUNDRED_ENDS = ("οι", "ες", "α")
THOUSAND = ("χίλιοι", "χίλιες", "χίλια")
SCALES = (("δισεκατομμύριο", "δισεκατομμύρια"), ("εκατομμύριο", "εκατομμύρια"))
ORDINAL_UNITS = ("", "πρώτ", "δεύτερ", "τρίτ", "τέταρτ", "πέμπτ", "έκτ", "έβδομ", "όγδο", "ένατ")
ORDINAL_TENS = ("", "δέκατ", "εικοστ", "τριακοστ", "τεσσαρακοστ", "πεντηκοστ", "εξηκοστ", "εβδομηκοστ", "ογδοηκοστ", "ενενηκοστ")
ORDINAL_ENDS = {"plain": ("ος", "η", "ο"), "stressed": ("ός", "ή", "ό")}


def _form(word, gender: int) -> str:
    return word if isinstance(word, str) else word[gender]


@lru_cache(maxsize=4096)
def below_thousand(n: int, gender: int) -> str:
    """Words of 1-999; '' for 0."""
    hundreds, rest = divmod(n, 100)
    out = []
    if hundreds == 1:
        out.append("εκατόν" if rest else "εκατό")
    elif hundreds:
        out.append(HUNDRED_STEMS[hundreds] + HUNDRED_ENDS[gender])
    if 10 <= rest < 20:
        out.append(_form(TEENS[rest - 10], gender))
    else:
        out.append(TENS[rest // 10])
        out.append(_form(UNITS[rest % 10], gender))
    return " ".join(w for w in out if w)


def number_words(n: int, gender: str = "neuter") -> str:
    """Words of any whole number; thousands are feminine, a lone thousand takes the gender."""
    g = GENDERS.index(gender)
    if n == 0:
        return "μηδέν"
    if n < 0:
        return "μείον " + number_words(-n, gender)
    out: list[str] = []
    billions, rest = divmod(n, 10**9)
    millions, rest = divmod(rest, 10**6)
    thousands, units = divmod(rest, 1000)
    for count, (one, many) in zip((billions, millions), SCALES):
        if count:
            out.append(f"{number_words(count)} {one if count == 1 else many}")
    if thousands == 1:
        out.append(THOUSAND[g])
    elif thousands:
        out.append(f"{below_thousand(thousands, 1)} χιλιάδες")
    out.append(below_thousand(units, g))
    return " ".join(w for w in out if w)


def ordinal_words(n: int, gender: str = "neuter") -> str:
    """Ordinal of 1-99; anything else falls back to the cardinal."""
    g = GENDERS.index(gender)
    if not 1 <= n <= 99:
        return number_words(n, gender)
    plain, stressed = ORDINAL_ENDS["plain"][g], ORDINAL_ENDS["stressed"][g]
    unit = lambda u: ORDINAL_UNITS[u] + plain if u else ""
    if n < 10:
        return unit(n)
    tens, rest = divmod(n, 10)
    head = ORDINAL_TENS[tens] + (plain if tens == 1 else stressed)
    return f"{head} {unit(rest)}".strip()


def _array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _below_thousand_col(n: Column, gender: str) -> Column:
    """Column form of ``below_thousand`` from three short arrays; null for 0."""
    g = GENDERS.index(gender)
    low = _array(["", *[_form(w, g) for w in (*UNITS[1:], *TEENS)]])
    tens, hundreds = _array(TENS), _array(["", "", *[stem + HUNDRED_ENDS[g] for stem in HUNDRED_STEMS[2:]]])
    at = lambda words, i: F.nullif(F.element_at(words, i.cast("int") + 1), F.lit(""))

    def say(x: Column) -> Column:
        h, r = F.floor(x / 100), x % 100
        head = F.when(h == 1, F.when(r == 0, "εκατό").otherwise("εκατόν")).otherwise(at(hundreds, h))
        return F.concat_ws(" ", head, F.when(r >= 20, at(tens, F.floor(r / 10))), F.when(r < 20, at(low, r)).otherwise(at(low, r % 10)))

    return F.when(n > 0, let(n, say))


def number_words_col(n: Column, gender: str = "neuter") -> Column:
    """Column form of ``number_words`` for whole numbers of any size, or their digits as text.

    Nine places at a time are read, each by the same expression, and joined from the left: what stands before nine places counts
    thousands of millions and is said by the same words again.
    """
    one, many = SCALES[0]

    def say(written: Column) -> Column:
        size = F.ceil(F.char_length(written) / 9).cast("int")
        padded = F.lpad(written, size * 9, F.lit("0"))
        groups = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(padded, i * 9 + 1, F.lit(9)).cast("int"))

        def spoken(v: Column, i: Column) -> Column:
            own = _below_billion_col(v, "neuter")
            return F.struct(v.alias("v"), (own if gender == "neuter" else F.when(i == size - 1, _below_billion_col(v, gender)).otherwise(own)).alias("w"))

        def join(acc: Column, x: Column) -> Column:
            before = F.when(~acc["zero"], F.concat(acc["w"], F.when(acc["one"], " " + one).otherwise(" " + many)))
            return F.struct(F.concat_ws(" ", before, F.nullif(x["w"], F.lit(""))).alias("w"), (acc["zero"] & (x["v"] == 1)).alias("one"), (acc["zero"] & (x["v"] == 0)).alias("zero"))

        start = F.struct(F.lit("").alias("w"), F.lit(False).alias("one"), F.lit(True).alias("zero"))
        return F.aggregate(F.transform(groups, spoken), start, join, lambda acc: F.when(acc["zero"], "μηδέν").otherwise(acc["w"]))

    text = n.cast("string")
    digits = F.when(F.regexp_like(text, F.lit("^-?[0-9]+$")), F.regexp_replace(text, "^-", ""))
    words = F.when(digits.isNotNull(), let(digits, say))
    return let(words, lambda w: F.when(text.startswith("-") & (w != "μηδέν"), F.concat(F.lit("μείον "), w)).otherwise(w))


def _below_billion_col(n: Column, gender: str) -> Column:
    """Words of 1 to 10^9 - 1; '' for 0."""
    millions, thousands, units = F.floor(n / 10**6), F.floor(n / 1000) % 1000, n % 1000
    one, many = SCALES[1]
    return F.concat_ws(
        " ",
        F.when(millions > 0, F.concat(_below_thousand_col(millions, "neuter"), F.when(millions == 1, " " + one).otherwise(" " + many))),
        F.when(thousands == 1, THOUSAND[GENDERS.index(gender)]).when(thousands > 1, F.concat(_below_thousand_col(thousands, "feminine"), F.lit(" χιλιάδες"))),
        _below_thousand_col(units, gender),
    )


def ordinal_words_col(n: Column, gender: str = "neuter") -> Column:
    n = n.cast("bigint")
    table = F.split(F.lit("|".join(ordinal_words(i, gender) for i in range(1, 100))), r"\|")
    return F.when((n >= 1) & (n <= 99), F.element_at(table, n.cast("int"))).otherwise(number_words_col(n, gender))
