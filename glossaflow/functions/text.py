"""Text functions as Column expressions: counting, normalising, folding, identifiers, paths.

Java's bare \\w, \\s, \\d and \\b are avoided: ``WORD`` is the class of letters, numbers and '_' without combining marks,
``SPACE`` also holds the separators U+001C-1F.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
#: Language codes that count as Greek.
GREEK_CODES = ("el", "ell", "gre", "greek")
#: Sentence boundaries: white space behind a final mark, or nothing behind an ideographic one.
BOUNDARY = r"(?<=[.!?。\uff01\uff1f।॥])[" + SPACE + r"]+|(?<=[。\uff01\uff1f।॥])(?=[^" + SPACE + "])"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Binds a value, so that an expression that uses it many times holds it once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_count(text: Column) -> Column:
    """Number of words, where ./- join their neighbours; null for null."""
    return F.size(F.regexp_extract_all(text, F.lit(rf"([{WORD}]+(?:[./-][{WORD}]+)*)"), F.lit(1))).cast("bigint")


def collapse_spaces(text: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"[{SPACE}]+", " "))


def orthographic(text: Column) -> Column:
    """Lower case, anything but words and white space to spaces, spaces collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), rf"[^{WORD}]+", " "))


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Characters that folding changes and what they become; those without a counterpart are deleted."""
    changed, kept, deleted = [], [], []
    for code in range(0x80, 0x30000):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        parts = unicodedata.normalize("NFD", ch)
        if parts == ch and not unicodedata.combining(ch):
            continue
        rest = unicodedata.normalize("NFC", "".join(p for p in parts if not unicodedata.combining(p)))
        if not rest:
            deleted.append(ch)
        elif len(rest) == 1 and rest != ch:
            changed.append(ch)
            kept.append("σ" if rest == "ς" else rest)
    return "ς" + "".join(changed + deleted), "σ" + "".join(kept)


def fold_accents(text: Column) -> Column:
    """Without diacritics, ς as σ, for every language."""
    return F.translate(text, *_folding())


def is_greek(language: Column) -> Column:
    return F.lower(F.coalesce(language, F.lit("el"))).isin(*GREEK_CODES)


def fallback(first: Column, second: Column) -> Column:
    """``first`` unless null or empty."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def safe_id(text: Column) -> Column:
    """Runs outside A-Z a-z 0-9 _ . - become '_', none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")


def path_of(*parts: Column | str) -> Column:
    return F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def candidate_id(edition: Column, page_id: Column, revision_id: Column, text: Column) -> Column:
    """'wiki_' and 24 hex digits of the digest of edition:page:revision:text."""
    key = F.concat(edition.cast("string"), F.lit(":"), page_id.cast("string"), F.lit(":"), revision_id.cast("string"), F.lit(":"), text)
    return F.concat(F.lit("wiki_"), F.substring(digest(key), 1, 24))


def has_decimal_digit(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"\p{Nd}"))


def portable_path(path: Column) -> Column:
    """Neither absolute nor from a home folder nor with '..'."""
    return ~F.regexp_like(path, F.lit(r"^/|^~|(^|/)\.\.(/|$)"))


def quoted_title(title: Column) -> Column:
    """Percent-encoded as in a URL path with nothing safe: space %20, '*' %2A, '~' kept."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.url_encode(title), r"\+", "%20"), r"\*", "%2A"), "%7E", "~")


def query_value(text: Column) -> Column:
    """Percent-encoded as a value of a query string: space '+', '*' %2A, '~' kept."""
    return F.regexp_replace(F.regexp_replace(F.url_encode(text), r"\*", "%2A"), "%7E", "~")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


# Audio types by file ending.
AUDIO_TYPES = {".wav": "audio/wav", ".mp3": "audio/mpeg", ".m4a": "audio/mp4", ".aac": "audio/aac", ".flac": "audio/flac", ".ogg": "audio/ogg", ".opus": "audio/ogg"}


def audio_type(path: Column) -> Column:
    """MIME type by ending; null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in AUDIO_TYPES.items() for x in pair]), extension(path))


def strip_edges(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def sentence_split(text: Column, boundary: str = BOUNDARY) -> Column:
    """Trimmed, non-empty pieces between boundaries."""
    return F.filter(F.transform(F.split(text, boundary), strip_edges), lambda s: s != "")
