"""p1: defective prompt and response pairs.

Each pair is judged from its two texts alone, in Arrow batches next to the scan (map-only):

* a pushdown parser (``markup``) reads fences, brackets, quotations, lists, emphasis, tags and labels of the answer; it gives the
  bare answer and the constructs left open at its end;
* a refusal grammar is matched against the lines of the answer; refusing words that stand there in the surroundings they have
  in the original are quoted from it and do not count;
* greedy string tiling (``tiling``) covers answer and original with common runs of words; a line that opens with an apology but
  has no refusing words counts if it lies outside the tiles for the greater part;
* script shares tell answers that are not in the expected script;
* an answer stops early if the last word or number of the original has no whole counterpart at its end, spelled out or not; if
  the original goes on behind its last tile with more words than the answer has outside the tiles; or if it leaves a construct
  open that it could not have closed behind the last word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow.llm.markup import CLOSES, EDGES, Markup, closed_behind, frames, parse_markup
from glossaflow.llm.spoken import SPOKEN_ABBREVIATIONS, SPOKEN_SIGNS, clock_endings, is_whole, number_parts, spoken_endings, spoken_words
from glossaflow.llm.tiling import greedy_tiles

# Ways to say that there is nothing.
_NOTHING = frozenset("n/a na n.a null none nil nan undefined void empty blank nothing κενό κενη κενο τίποτα τιποτα καμία καμια ουδέν".split())
_WORDS = re.compile(r"[^\W_]+")


def _bare(text: str) -> str:
    return text.lower().replace("ς", "σ")


def words(text: str) -> list[str]:
    return _WORDS.findall(_bare(text))


# The refusal grammar. A refusal is a core, before which an apology or a self-description may stand.
_APOLOGY = r"(?:συγγν[ωώ]μη|με συγχωρε[ιί]τε|λυπ[αά]μαι|λυπο[υύ]μαι|δυστυχ[ωώ]ς|ζητ[ωώ] συγγν[ωώ]μη|i'?m (?:very )?sorry|sorry|i apologi[sz]e|unfortunately|es tut mir leid|entschuldigung|leider|désolée?|je suis désolée?|malheureusement|lo siento|lamentablemente|mi dispiace|purtroppo|spiacente)"
_SELF = r"(?:ως (?:γλωσσικ[οό] μοντ[εέ]λο|τεχνητ[ηή] νοημοσ[υύ]νη|βοηθ[οό]ς)|as an? (?:ai|a\.i\.|language model|large language model|assistant|ai language model)|als (?:ki|sprachmodell)|en tant que (?:modèle|ia)|como (?:modelo|ia)|in quanto (?:modello|ia)|come (?:modello|ia))"
_CORE = r"""(?:
 (?:δεν|δε)\ (?:(?:μου|σου|μας|σας|του|της|τους|τον|την|τη|το|τα|τις)\ ){0,2}(?:μπορ[ωώ]|μπορο[υύ]με|γ[ιί]νεται|επιτρ[εέ]πεται|ε[ιί]ναι\ (?:δυνατ[οό]ν?|εφικτ[οό])|[εέ]χω\ τη(?:ν)?\ δυνατ[οό]τητα|θα\ (?:προχωρ[ηή]σω|μπορ[εέ]σω|απαντ[ηή]σω|βοηθ[ηή]σω))
 |αδυνατ[ωώ]|αρνο[υύ]μαι|θα\ προτιμο[υύ]σα\ να\ μην|προτιμ[ωώ]\ να\ μην|ξεπερν[αά]\ [οό]σα\ μου\ επιτρ[εέ]πονται|ε[ιί]ναι\ αδ[υύ]νατον?
 |(?:can'?t|cannot|can\ not|could\ not|couldn'?t|won'?t|will\ not|would\ rather\ not|am\ not\ able\ to|unable\ to|must\ decline|have\ to\ decline|decline\ to|refuse\ to|not\ allowed\ to|not\ permitted\ to|do\ not\ have\ the\ ability)
 |(?:kann|darf|werde)\ (?:ich\ )?(?:\w+\ ){0,4}nicht|nicht\ möglich|muss\ ablehnen|lehne\ \w*\ ?ab
 |ne\ (?:peux|puis|pourrai)(?:\ pas)?|je\ refuse|impossible\ de|dois\ refuser
 |no\ (?:puedo|podr[eé]|me\ es\ posible)|me\ niego|debo\ rechazar
 |non\ (?:posso|sono\ in\ grado|è\ possibile)|mi\ rifiuto|devo\ rifiutare
)"""
_REFUSAL = re.compile(rf"\b{_CORE}\b", re.X | re.I)
_OPENERS = re.compile(rf"^\W*(?:{_APOLOGY}|{_SELF})\b", re.I)
_APOSTROPHES = str.maketrans("’‘ʼ`´", "'''''")


_CLAUSE_MARKS = re.compile("[" + re.escape("".join([*CLOSES, *CLOSES.values()])) + "\";\u037e:.!?…·–—\n]")


#: The grammar lets so many words stand before the core of a refusal ("according to my rules I cannot").
LEAD = 6


def refuses(answer: str, original: str) -> bool:
    """Whether the answer declines in words that it does not take over from the original.

    A refusal counts where it opens a line of the answer: after nothing, an apology, a self-description or a lead of at most
    ``LEAD`` words. Its words are taken over if they stand in the answer in the same surroundings as in the original, not
    merely somewhere in both. An apology alone counts if most of its line lies outside the tiles and the original has none.
    """
    text, mine, tiled = answer.translate(_APOSTROPHES), None, None
    for part in re.finditer(r"[^\n.!…]+", text):
        line = part.group().strip(EDGES + "\"'«»“”*#>-")
        opener = _OPENERS.match(line)
        hits = [hit for hit in _REFUSAL.finditer(line) if opener or len(words(line[: hit.start()])) <= LEAD]
        if not hits and not opener:
            continue
        if mine is None:
            mine, source = [_fold(w) for w in words(text)], _Source(original.translate(_APOSTROPHES))
        first = len(words(text[: part.start()]))
        at = lambda end: first + len(words(line[:end]))  # noqa: B023, E731
        if any(not source.lends(mine, at(hit.start()), at(hit.end())) for hit in hits):
            return True
        if hits or source.lends(mine, first, at(opener.end())) or source.apologises:
            continue
        tiled = tiled or {j + n for _, j, k in greedy_tiles(source.words, mine) for n in range(k)}
        if 2 * sum(j in tiled for j in range(first, at(len(line)))) < len(words(line)):
            return True
    return False


class _Source:
    """The words of an original, which of them are spoken otherwise than written, and the clause each stands in."""

    def __init__(self, text: str) -> None:
        self.words, self.spoken, self.clause, end, clause = [], [], [], 0, 0
        self.places: dict[str, list[int]] = {}
        self.apologises = any(_OPENERS.match(line.strip(EDGES + "\"'«»“”*#>-")) for line in re.split(r"[\n.!…]+", text))
        for m in _PIECES.finditer(text):
            clause += bool(_CLAUSE_MARKS.search(text[end : m.start()]))
            end = m.end()
            own = [_fold(w) for w in words(m.group())]
            spoken = _in_several(_ways_to_say(m.group(), text[end : end + 3])) or text[end : end + 3].strip()[:1] in SPOKEN_SIGNS
            for n, w in enumerate(own, len(self.words)):
                self.places.setdefault(w, []).append(n)
            self.words += own
            self.spoken += [spoken] * len(own)
            self.clause += [clause] * len(own)

    def lends(self, mine: list[str], start: int, end: int) -> bool:
        """Whether the answer's words from start to end are a passage of the original, along with what stands around them.

        The common run of words around them must go beyond their clause on either side, or to where both texts begin or end,
        or to a word that is spoken otherwise than written.
        """
        size = end - start
        return any(
            self.words[i : i + size] == mine[start:end] and self._goes_on(mine, i, start, -1) and self._goes_on(mine, i + size - 1, end - 1, 1)
            for i in self.places.get(mine[start], ())
        )

    def _goes_on(self, mine: list[str], i: int, j: int, way: int) -> bool:
        clause, greek = self.clause[i], bool(_GREEK_LETTERS.search(mine[j]))
        while True:
            i, j = i + way, j + way
            mine_ends, ends = not 0 <= j < len(mine), not 0 <= i < len(self.words)
            if mine_ends or ends:
                # An answer may break off inside a passage, but not begin there.
                return mine_ends and (ends or way > 0)
            if self.words[i] == mine[j]:
                if self.clause[i] != clause:
                    return True
                continue
            # A word that is written otherwise, one that is broken off, or one that differs between equal ones.
            if self.spoken[i] or (way > 0 and j + 1 == len(mine) and self.words[i].startswith(mine[j])) or (greek and not _GREEK_LETTERS.search(self.words[i])):
                return True
            return 0 <= i + way < len(self.words) and 0 <= j + way < len(mine) and self.words[i + way] == mine[j + way]


_LETTERS, _GREEK_LETTERS = re.compile(r"[^\W\d_]+"), re.compile("[\u0370-\u03ff\u1f00-\u1fff]+")


def greek_share(text: str) -> float | None:
    """Share of Greek letters among the letters; None without letters."""
    letters = sum(map(len, _LETTERS.findall(text)))
    return min(1.0, sum(map(len, _GREEK_LETTERS.findall(text))) / letters) if letters else None


_SPOKEN = re.compile(r"\d|[%€$£¥°§&=+№²³½¼¾‰]|(?<!\w)(?:[^\W\d_]{1,5}\.){2,}|(?<!\w)(?:κ|χλμ|σελ|αρ|δηλ|βλ|τηλ|εκ|δισ|χιλ|λ|αι|οδ|λεωφ|κ\.λπ|π\.χ|κ\.ά|υπ|τ|ν|στρ|μμ|εκατ)\.(?!\w)|(?<!\w)[Α-ΩΆΈΉΊΌΎΏ]{2,}(?!\w)|(?<!\w)[^\W\d_]+\.[^\W\d_]+\.?(?=\W|$)", re.U)


def needs_speaking(original: str) -> bool:
    """Digits, signs, dotted abbreviations or Greek acronyms; in a text all in capitals a word in capitals is no acronym."""
    text = original
    if not any(ch.islower() for ch in original):
        text = original.lower()
    return bool(_SPOKEN.search(text))


_LAST = re.compile(r"([^\W\d_]+(?:\.[^\W\d_]+)*|\d+(?:[.,:/]\d+)*)([^\w]*)$", re.U)


_PIECES = re.compile(r"\d+(?:[.,:/]\d+)*(?![^\W_])|[^\W_]+(?:\.[^\W\d_]+)*")
_NUMBER_BEFORE = re.compile(r"(?<![\w.,])(\d{1,3}(?:\.\d{3})*|\d+)\s*$")
_ACRONYM = re.compile(r"[Α-ΩΆΈΉΊΌΎΏ]{2,}")


def last_piece(text: str) -> tuple[str, str] | None:
    """The last word, dotted abbreviation or number of a text, and the marks behind it."""
    found = _LAST.search(text.rstrip())
    return (found.group(1), found.group(2)) if found else None


def complete(original: str, answer: Markup) -> bool:
    """Whether the answer goes to the end of the original."""
    own = words(answer.text)
    said = [_fold(w) for w in own]
    if not _end_said(original, answer.text, said):
        return False
    left_open = _left_open(original, answer)
    theirs = words(original)
    if not own or (not left_open and _ends_once(original, theirs, own[-1])):
        return True
    if _goes_on_untiled(original, said):
        return False
    if not left_open:
        return True
    # A mark alone may be lost from a whole answer, if it is one of the original's and all of its words are said.
    known = Counter(_shape(f.kind) for f in frames(original)[0])
    ways = _piece_ways(original)
    plain = Counter(w for _, way in ways if not _in_several(way) for w in way[0])
    return not left_open - known and not plain - Counter(said)


# Marks of which one may stand for another.
_SHAPES = {"«": "quote", "“": "quote", "„": "quote", "‹": "quote", "‘": "quote", '"': "quote"}


def _shape(kind: str) -> str:
    return _SHAPES.get(kind, kind)


def _left_open(original: str, answer: Markup) -> Counter:
    """Constructs open at the answer's end that neither wrap it nor stay open in the original nor close behind its last word."""
    if not answer.open_at_end:
        return Counter()
    last = max((m.end() for m in _WORDS.finditer(original)), default=0)
    excused = [*answer.wrapping, *(f.kind for f in frames(original)[1]), *closed_behind(original, last)]
    return Counter(map(_shape, answer.open_at_end)) - Counter(map(_shape, excused))


def _end_said(original: str, answer: str, said: list[str]) -> bool:
    """Whether the last word or number of the original has a whole counterpart at the end of the answer (folded: ``said``)."""
    last = last_piece(original.strip(EDGES))
    if last is None or not said:
        return bool(said) or last is None
    piece, marks = last
    raw = words(piece)
    if [_fold(w) for w in raw] == said[-len(raw) :]:
        sign = next((m for m in marks if m in "%€$£‰°"), None)
        return sign is None or sign in answer.rstrip()[-6:]
    number = _NUMBER_BEFORE.search(original.rstrip()[: -len(piece + marks)])
    parted = piece[:1].isdecimal() and "".join(raw) == re.sub(r"\D", "", piece) and not is_whole(piece)
    sign = next((m for m in marks if m in SPOKEN_SIGNS), "") if parted else ""
    if parted and _parts_said(piece, sign, said):
        return True
    for ending in spoken_endings(piece, marks, number.group(1) if number else ""):
        if said[-len(ending) :] == [_fold(w) for w in ending] and (not parted or _parts_said(piece, sign, _without_link(said[: -len(ending)], sign))):
            return True
    if _ACRONYM.fullmatch(piece) and any(ch.islower() for ch in original):
        return _acronym_said(_fold(_bare(piece)), words(original), said)
    return False


def _without_link(said: list[str], sign: str) -> list[str]:
    return said[:-1] if sign and sign in "%‰" and said[-1:] == ["τοισ"] else said


def _folded(ways: Iterable[tuple[str, ...]]) -> list[list[str]]:
    return [[_fold(w) for w in way] for way in ways]


@lru_cache(maxsize=1 << 12)
def _folded_number(number: str, sign: str) -> tuple[list[list[str]], list[tuple[list[list[str]], list[list[str]]]]]:
    return _folded(clock_endings(number)), [(_folded(ways), _folded(links)) for ways, links in number_parts(number, sign)]


def _parts_said(number: str, sign: str, said: list[str]) -> bool:
    """Whether the words end with all parts of a time, date, decimal or fraction, and not only with its last."""
    clock, parts = _folded_number(number, sign)
    if any(said[-len(way) :] == way for way in clock):
        return True
    ends = {len(said)}
    for ways, links in parts:
        ends = _before(said, _before(said, ends, ways), links)
    return bool(ends)


def _before(said: list[str], ends: set[int], ways: list[list[str]]) -> set[int]:
    """Where the words begin that end at one of the places and say one of the ways."""
    return {end - len(way) for end in ends for way in ways if len(way) <= end and said[end - len(way) : end] == way}


@lru_cache(maxsize=1 << 14)
def _ways_to_say(piece: str, marks: str) -> tuple[frozenset[str], str]:
    """Words that may stand for a piece of the original, and the initials of others that may."""
    own = {_fold(w) for w in words(piece)}
    if piece[:1].isdecimal():
        return frozenset(own | {_fold(w) for w in spoken_words(piece, marks.strip()[:1])}), ""
    if "." in piece or piece.lower() in SPOKEN_ABBREVIATIONS or _ACRONYM.fullmatch(piece):
        return frozenset(own | {_fold(w) for e in spoken_endings(piece, "") for w in e}), _fold(_bare(piece.replace(".", "")))
    return frozenset(own), ""


def _in_several(way: tuple[frozenset[str], str]) -> bool:
    return len(way[0]) > 1 or way[1] != ""


_SHORT_FORMS = re.compile(r"[Α-ΩΆΈΉΊΌΎΏ]{2,}|[^\W\d_]+(?:\.[^\W\d_]+)+")


@lru_cache(maxsize=1)
def _number_vocabulary() -> frozenset[str]:
    """Words of which numbers, signs and listed abbreviations are spoken."""
    values = (*range(101), *range(200, 1001, 100), 101, 2000, 10**6, 2 * 10**6, 10**9, 2 * 10**9)
    other = {w for forms in (*SPOKEN_SIGNS.values(), *SPOKEN_ABBREVIATIONS.values()) for w in forms}
    return frozenset(map(_fold, other.union(*[spoken_words(str(v)) for v in values])))


def _ends_once(original: str, theirs: list[str], last: str) -> bool:
    """Whether it is plain at once that the answer's last word speaks no place of the original but its end."""
    if not theirs or theirs[-1] != last or theirs.count(last) > 1 or last[0].isdecimal() or _fold(last) in _number_vocabulary():
        return False
    initial = _fold(last[0])
    return not any(initial in _fold(m) for m in _SHORT_FORMS.findall(original))


def _piece_ways(original: str) -> list[tuple[list[str], tuple[frozenset[str], str]]]:
    """The pieces of the original: their words and the ways to say them."""
    found = list(_PIECES.finditer(original))
    return [([_fold(w) for w in words(m.group())], _ways_to_say(m.group(), original[m.end() : m.end() + 3])) for m in found]


def _goes_on_untiled(original: str, said: list[str]) -> bool:
    """Whether the original goes on behind its last tile with words that the answer does not have.

    Words outside the tiles may speak a number, sign or short form of the original, or replace one of its words; what is left
    of them must be as many as the plain words behind the last tile that the answer lacks.
    """
    pieces = _piece_ways(original)
    if not Counter(w for _, way in pieces if not _in_several(way) for w in way[0]) - Counter(said):
        return False  # no plain word is lacking anywhere
    theirs = [w for ws, _ in pieces for w in ws]
    tiles = greedy_tiles(theirs, said)
    covered, reached = set(), 0
    free = Counter(said)
    for i, _, k in tiles:
        covered.update(range(i, i + k))
        reached = max(reached, i + k)
        free.subtract(theirs[i : i + k])
    at, lacking, spoken = 0, [0, 0], []
    for ws, way in pieces:
        if not covered.issuperset(range(at, at + len(ws))):
            if _in_several(way):
                spoken.append(way)
            else:
                for w in way[0]:
                    if free[w] > 0:
                        free[w] -= 1
                    else:
                        lacking[at >= reached] += 1
        at += len(ws)
    for own, initials in spoken:
        for w in free:
            if w in own or w[0] in initials:
                free[w] = 0
    spare = sum(n for n in free.values() if n > 0) - lacking[0]
    return lacking[1] > max(0, spare)


def _acronym_said(letters: str, original: list[str], said: list[str]) -> bool:
    """Whether the end of the answer spells the acronym out behind the same word as in the original.

    Spelled out, it takes three words at least (or one for each of fewer letters), one more than letters at most, and has
    the letters in order, the first as its initial.
    """
    before = _fold(original[-2]) if len(original) > 1 else None
    for n in range(min(len(letters), 3), len(letters) + 2):
        spelled = said[-n:]
        if len(said) < n + (before is not None) or (before is not None and said[-n - 1] != before) or spelled[0][:1] != letters[0]:
            continue
        i = 0
        for ch in "".join(spelled):
            i += i < len(letters) and ch == letters[i]
        if i == len(letters):
            return True
    return False


_MARKS = str.maketrans("άέήίόύώϊϋΐΰς", "αεηιουωιυιυσ")


@lru_cache(maxsize=1 << 16)
def _fold(word: str) -> str:
    return word.lower().translate(_MARKS)


def judge(original: str | None, answer: str | None) -> tuple[str | None, str]:
    """Defect of a pair (None if it has none) and the constructs its answer leaves open."""
    if answer is None:
        return "empty", ""
    mark = parse_markup(answer)
    bare, still_open = mark.text, " ".join(mark.open_at_end)
    mine = words(bare)
    if not mine or bare.strip(EDGES + ".…-–—\"'«»()[]{}<>`*").lower() in _NOTHING:
        return "empty", still_open
    original = original or ""
    theirs = words(original)
    if refuses(bare, original):
        return "refusal", still_open
    share, own = greek_share(bare), greek_share(original)
    if share is not None and share < 0.5 and (own is None or own >= 0.5 or share < own / 2):
        return "other_language", still_open
    if "".join(mine) == "".join(theirs):
        return ("copy" if needs_speaking(original) else None), still_open
    if not complete(original, mark):
        return "truncated", still_open
    return None, still_open


def _judge_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        judged = [judge(o, a) for o, a in zip(frame["original"], frame["answer"])]
        yield pd.DataFrame(
            {"dataset_id": frame["dataset_id"], "id": frame["id"], "from_texts": [d for d, _ in judged], "left_open": [o for _, o in judged], "lost": frame["lost"]}
        )


def lost_answer(warnings: Column) -> Column:
    """What a warning says became of an answer that was replaced by the original, null if none says so."""
    said = lambda pattern: F.exists(warnings, lambda w: F.lower(w).rlike(pattern))
    return F.when(said("empty output"), "empty").when(said("possible refusal"), "refusal").when(said("too short"), "truncated")


def judged_pairs(df: DataFrame) -> DataFrame:
    """``dataset_id, id, defect, left_open`` of every pair; defect is null for a sound one.

    The latest row of a key (``ingested_at``, nulls first) is its pair. A null answer is empty, a null original counts as
    an empty text, null or empty warnings say nothing. Rows with a null key are pairs of their own key (null, id).
    """
    key = ["dataset_id", "id"]
    rows = df.select(*key, F.struct("ingested_at", "original_text", "normalized_text", "normalization_warnings").alias("row"))
    latest = rows.groupBy(*key).agg(F.max("row").alias("row"))
    same = F.coalesce(F.col("row.original_text") == F.col("row.normalized_text"), F.lit(False))
    lost = F.when(same, lost_answer(F.col("row.normalization_warnings")))
    pairs = latest.select(*key, F.col("row.original_text").alias("original"), F.col("row.normalized_text").alias("answer"), lost.alias("lost"))
    schema = "dataset_id string, id string, from_texts string, left_open string, lost string"
    done = pairs.mapInPandas(_judge_frames, schema)
    return done.select(*key, F.coalesce("lost", "from_texts").alias("defect"), "left_open")


def defective_pairs(df: DataFrame) -> DataFrame:
    return judged_pairs(df).filter("defect is not null").select("dataset_id", "id", "defect")
