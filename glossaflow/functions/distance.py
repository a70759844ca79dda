"""Word and character error rates inside the JVM.

The token distance reuses the built-in code-point ``levenshtein``: the distinct tokens of a pair are numbered and every token
becomes one character of a fixed alphabet. Pairs with more distinct tokens than the alphabet has letters take a dynamic
programme of higher-order functions instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossaflow.functions.text import let

#: One letter per distinct token of a pair: the CJK ideographs, all of them single UTF-16 units.
ALPHABET = "".join(map(chr, range(0x4E00, 0x9FFF)))
#: Most pairs need few letters, and taking a letter costs the length of the alphabet.
SHORT_ALPHABET = ALPHABET[:128]


def tokens(text: Column) -> Column:
    """Space-separated words; none for an empty text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def _letters(words: Column, known: Column, alphabet: str) -> Column:
    return F.array_join(F.transform(words, lambda w: F.substring(F.lit(alphabet), F.array_position(known, w).cast("int"), F.lit(1))), "")


def token_distance_dp(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of two token arrays by rows of a dynamic programme, for pairs of any vocabulary."""
    start = F.transform(F.sequence(F.lit(0), F.size(hypothesis)), lambda i: i.cast("int"))

    def next_row(row: Column, word: Column) -> Column:
        above = F.zip_with(F.slice(row, 1, F.size(hypothesis)), hypothesis, lambda d, h: F.when(h == word, d).otherwise(d + 1))
        below = F.transform(F.slice(row, 2, F.size(hypothesis)), lambda v: v + 1)
        best = F.zip_with(above, below, lambda a, b: F.least(a, b))
        first = F.array(F.element_at(row, 1) + 1)
        return F.aggregate(best, first, lambda acc, v: F.concat(acc, F.array(F.least(v, F.element_at(acc, -1) + 1))))

    return F.element_at(F.aggregate(reference, start, next_row), -1)


def token_distance(reference: Column, hypothesis: Column) -> Column:
    def by_letters(known: Column) -> Column:
        spelled = lambda a: F.levenshtein(_letters(reference, known, a), _letters(hypothesis, known, a))
        size = F.size(known)
        return F.when(size <= len(SHORT_ALPHABET), spelled(SHORT_ALPHABET)).when(size <= len(ALPHABET), spelled(ALPHABET)).otherwise(token_distance_dp(reference, hypothesis))

    return let(F.array_distinct(F.concat(reference, hypothesis)), by_letters)


def word_rate(reference: Column, hypothesis: Column) -> Column:
    """Word error rate of two normalised texts; without reference words 0 or 1."""

    def rate(pair: Column) -> Column:
        ref, hyp = pair["r"], pair["h"]
        empty = F.when(F.size(hyp) == 0, F.lit(0.0)).otherwise(F.lit(1.0))
        return F.when(F.size(ref) == 0, empty).otherwise(token_distance(ref, hyp) / F.size(ref)).cast("double")

    return let(F.struct(tokens(reference).alias("r"), tokens(hypothesis).alias("h")), rate)


def char_rate(reference: Column, hypothesis: Column) -> Column:
    """Character error rate of two normalised texts, spaces left out."""

    def rate(pair: Column) -> Column:
        ref, hyp = pair["r"], pair["h"]
        empty = F.when(hyp == "", F.lit(0.0)).otherwise(F.lit(1.0))
        return F.when(ref == "", empty).otherwise(F.levenshtein(ref, hyp) / F.char_length(ref)).cast("double")

    bare = lambda t: F.replace(t, F.lit(" "), F.lit(""))
    return let(F.struct(bare(reference).alias("r"), bare(hypothesis).alias("h")), rate)
