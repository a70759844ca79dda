"""Ways in which a written number, sign or abbreviation may be spoken, to tell whether an answer says the whole of it."""

from __future__ import annotations

import re
from functools import lru_cache

from glossaflow.functions.numbers_el import GENDERS, number_words, ordinal_words

# Last words that a sign or a dotted abbreviation may be spoken as.
SPOKEN_SIGNS = {"%": ("εκατό",), "‰": ("χιλίοις",), "€": ("ευρώ",), "$": ("δολάρια", "δολάριο", "δολαρίων"), "£": ("λίρες", "λίρα", "λιρών"), "°": ("βαθμούς", "βαθμοί", "βαθμών", "μοίρες")}
SPOKEN_ABBREVIATIONS = {
    "κ.λπ": ("λοιπά",), "κλπ": ("λοιπά",), "π.χ": ("χάρη", "χάριν"), "χλμ": ("χιλιομέτρων", "χιλιόμετρα", "χιλιόμετρο"), "σελ": ("σελίδα", "σελίδες", "σελίδας"),
    "αρ": ("αριθμό", "αριθμός", "αριθμού"), "δηλ": ("δηλαδή",), "κ.ά": ("άλλα", "άλλοι"), "μ.χ": ("χριστόν",), "π.μ": ("μεσημβρίας", "μεσημβρίαν"), "μ.μ": ("μεσημβρίας", "μεσημβρίαν"),
    "εκ": ("εκατομμύρια", "εκατομμυρίων"), "δισ": ("δισεκατομμύρια", "δισεκατομμυρίων"), "τηλ": ("τηλέφωνο",), "λεωφ": ("λεωφόρος", "λεωφόρου"),
}
#: Other accepted spellings of a number word.
_SPELLINGS = {"επτά": "εφτά", "οκτώ": "οχτώ", "εννέα": "εννιά", "μία": "μια", "δεκαέξι": "δεκάξι", "δεκαεπτά": "δεκαεφτά", "δεκαοκτώ": "δεκαοχτώ", "δεκαεννέα": "δεκαεννιά", "δύο": "δυο", "χιλίων": "χίλια"}


def spoken_endings(piece: str, marks: str, before: str = "") -> list[list[str]]:
    """Endings, as lists of words, that speak the last piece of a text completely.

    piece: a word, dotted abbreviation or number; marks: what stands behind it; before: the number in front of it, if any.
    All words of a whole number must be there, in any gender. For a number with marks inside see ``number_parts``.
    """
    sign = next((m for m in marks if m in SPOKEN_SIGNS), None)
    if sign:
        return _with_number(piece, [[w] for w in SPOKEN_SIGNS[sign]], ["τοις"] if sign in "%‰" else [])
    if not piece[:1].isdecimal():
        return _with_number(before, [[w] for w in SPOKEN_ABBREVIATIONS.get(piece.lower(), ())], [])
    return _number_endings(int(piece.replace(".", ""))) if is_whole(piece) else []


# Words that may stand between the parts of a number, by the mark that parts them, and names of the months.
_LINKS = {
    ":": (("και",), ("η", "ώρα", "και"), ("ώρα", "και"), ("ώρες", "και"), ("προς",)), ",": (("κόμμα",), ("και",)), ".": (("τελεία",), ("κόμμα",), ("και",), ("του",)),
    "/": (("του",), ("προς",), ("διά",), ("κάθετος",), ("από",), ("και",)),
}
_MONTHS = (
    ("Ιανουαρίου", "Ιανουάριος", "Γενάρη"), ("Φεβρουαρίου", "Φεβρουάριος", "Φλεβάρη"), ("Μαρτίου", "Μάρτιος", "Μάρτη"), ("Απριλίου", "Απρίλιος", "Απρίλη"), ("Μαΐου", "Μάιος", "Μάη"), ("Ιουνίου", "Ιούνιος", "Ιούνη"),
    ("Ιουλίου", "Ιούλιος", "Ιούλη"), ("Αυγούστου", "Αύγουστος"), ("Σεπτεμβρίου", "Σεπτέμβριος", "Σεπτέμβρη"), ("Οκτωβρίου", "Οκτώβριος", "Οκτώβρη"), ("Νοεμβρίου", "Νοέμβριος", "Νοέμβρη"), ("Δεκεμβρίου", "Δεκέμβριος", "Δεκέμβρη"),
)
_AND_A_HALF = ("μιάμιση", "δυόμισι", "τρεισήμισι", "τεσσερισήμισι", "πεντέμισι", "εξίμισι", "επτάμισι", "οκτώμισι", "εννιάμισι", "δεκάμισι", "εντεκάμισι", "δωδεκάμισι")


def is_whole(number: str) -> bool:
    """Whether a number is whole: digits, in groups of three if dots part them."""
    return re.fullmatch(r"\d+|\d{1,3}(?:\.\d{3})+", number) is not None


@lru_cache(maxsize=1 << 14)
def number_parts(number: str, sign: str = "") -> tuple[tuple[tuple[tuple[str, ...], ...], tuple[tuple[str, ...], ...]], ...]:
    """Parts of a time, date, decimal or fraction from the last to the first: ways to say it, and links that may stand before it."""
    plain = re.sub(r"(?<![\d.,:/])\d{1,3}(?:\.\d{3})+(?=,|$)", lambda m: m.group().replace(".", ""), number)
    found = re.findall(r"([.,:/]?)(\d+)", plain)
    out = []
    for k, (mark, part) in enumerate(found):
        value = int(part)
        ways = {*_cached_endings(value)}
        if part[0] == "0" or (k and mark in ".,"):
            ways |= {tuple(number_words(int(d)) for d in part)} | {(*[number_words(0)] * (len(part) - len(part.lstrip("0"))), *w) for w in ways if value}
        links = _LINKS.get(mark, ())
        if mark and mark in "./" and k == 1 and 1 <= value <= 12:
            ways |= {(m,) for m in _MONTHS[value - 1]}
        if mark == "/" and k == len(found) - 1 and 2 < value <= 99:
            ways.add(tuple(w[:-1] + {"ο": "α", "ό": "ά"}.get(w[-1], w[-1]) for w in ordinal_words(value).split()))
        if mark == ":":
            ways |= {(*w, unit) for w in ways for unit in ("λεπτά", "λεπτό", "δευτερόλεπτα")}
        if mark == "," and sign in SPOKEN_SIGNS and sign not in "%‰°":
            ways |= {(*w, "λεπτά") for w in {*_cached_endings(value * 10 if len(part) == 1 else value)}}
            links += tuple((unit, *rest) for unit in SPOKEN_SIGNS[sign] for rest in ((), ("και",)))
        out.append((tuple(ways), ((), *links)))
    return tuple(out[::-1])


@lru_cache(maxsize=1 << 12)
def clock_endings(time: str) -> tuple[tuple[str, ...], ...]:
    """Further ways to say a time of hours and minutes: on a clock of twelve hours, to the next hour, in quarters and halves."""
    if not re.fullmatch(r"\d{1,2}:\d\d", time):
        return ()
    hour, minutes = map(int, time.split(":"))
    names = lambda h: {*_cached_endings(h), *_cached_endings(h % 12 or 12)}
    out: set[tuple[str, ...]] = set()
    past = {0: [()], 15: [("τέταρτο",)], 30: [("μισή",), ("μισό",)]}.get(minutes, []) + [*_cached_endings(minutes)]
    for h in names(hour):
        for m in past:
            rests = [("και", *m), m, ("η", "ώρα", "και", *m), ("ώρα", "και", *m), ("ώρες", "και", *m)] if m else [(), ("ακριβώς",), ("η", "ώρα"), ("η", "ώρα", "ακριβώς")]
            out |= {(*h, *rest, *unit) for rest in rests for unit in ((), ("λεπτά",)) if m or not unit}
    if minutes > 30:
        out |= {(*h, "παρά", *m, *unit) for h in names(hour + 1) for m in [*_cached_endings(60 - minutes), *[("τέταρτο",)] * (minutes == 45)] for unit in ((), ("λεπτά",))}
    if minutes == 30:
        out.add((_AND_A_HALF[(hour - 1) % 12],))
    return tuple(out)


def spoken_words(number: str, sign: str = "") -> set[str]:
    """Words that may occur in the spoken form of a number, marks inside included, and of the sign behind it."""
    parts = re.findall(r"\d+", number)
    values = {int(p) for p in parts} | {int(d) for p in parts for d in p} | {int(p) for p in re.findall(r"\d+", number.replace(".", ""))}
    parted = set() if is_whole(number) else {w for ways, links in number_parts(number, sign) for way in (*ways, *links) for w in way}
    return {w for v in values for ending in _number_endings(v) for w in ending} | {*SPOKEN_SIGNS.get(sign, ())} | parted | {w for way in clock_endings(number) for w in way}


def _with_number(number: str, units: list[list[str]], link: list[str]) -> list[list[str]]:
    whole = number.replace(".", "")
    if not whole.isdecimal():
        return units
    return [[*n, *link, *u] for n in _number_endings(int(whole)) for u in units]


@lru_cache(maxsize=4096)
def _cached_endings(n: int) -> tuple[tuple[str, ...], ...]:
    found = set()
    for gender in GENDERS:
        ws = tuple(number_words(n, gender).split())
        found |= {ws, tuple(_SPELLINGS.get(w, w) for w in ws)}
    found |= {tuple(ordinal_words(n, g).split()) for g in GENDERS if 1 <= n <= 31}
    return tuple(sorted(found))


def _number_endings(n: int) -> list[list[str]]:
    return [list(ws) for ws in _cached_endings(n)]
