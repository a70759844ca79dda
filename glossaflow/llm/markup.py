"""A pushdown parser for the markup round and inside an answer: fences, brackets, quotations, lists, emphasis, tags, labels.

Opening tokens push a frame, closing ones pop down to theirs, list items pop the item before them. What the stack holds after
the last character is open: the text broke off inside it, or lost a mark.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Closing marks by opening mark.
CLOSES = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "„": "“", "‹": "›", "‘": "’"}
# Labels that may stand before an answer.
LABELS = (
    "απάντηση", "έξοδος", "κανονικοποιημένο κείμενο", "κανονικοποιημένη πρόταση", "κείμενο", "αποτέλεσμα", "μετατροπή", "πρόταση",
    "answer", "output", "result", "response", "normalized text", "normalised text", "normalized", "text", "assistant", "antwort",
    "ausgabe", "réponse", "sortie", "respuesta", "salida", "risposta", "testo",
)
#: White space and invisible characters.
EDGES = " \t\r\n\f\v\x1c\x1d\x1e\x1f\x85\xa0\u200b\u200c\u200d\u2060\ufeff\xad\u2028\u2029"
_LABEL = re.compile(r"[\s*_#>\-•]*(?:" + "|".join(sorted(map(re.escape, LABELS), key=len, reverse=True)) + r")\s*[*_]*\s*[:\uff1a]\s*[*_]*", re.I)
_FENCE_HEAD = re.compile(r"[\w+-]*[ \t]*\n")
_TOKENS = re.compile(
    r"(?P<fence>`{3,})|(?P<item>^[ \t]*(?:[-*•·]|\d{1,2}[.)])(?=[ \t]|$))|(?P<both>\*\*|__|`|\")|(?P<tag></?[a-zA-Z][\w-]*(?:\s[^<>]*)?/?>)"
    r"|(?P<broken></?[a-zA-Z][\w-]*(?:\s[^<>]*)?\Z)|(?P<mark>[" + re.escape("".join([*CLOSES, *CLOSES.values()])) + "])",
    re.M,
)
#: Frames that may wrap a whole answer without being part of it.
_WRAPPERS = ("fence", "«", "“", "„", "‹", "‘", '"', "`", "**", "__", "tag")
#: Tags that have no end.
_EMPTY_TAGS = frozenset(("br", "hr", "img"))


@dataclass
class Frame:
    """A construct: its kind, where it and its contents start, and where its contents and it end (None while open)."""

    kind: str
    start: int
    inner: int
    stop: int | None = None
    end: int | None = None
    name: str = ""


@dataclass
class Markup:
    """The bare answer, what was stripped round it, the constructs open at its end and those of them begun before its first word."""

    text: str
    stripped: list[str] = field(default_factory=list)
    open_at_end: list[str] = field(default_factory=list)
    wrapping: list[str] = field(default_factory=list)


class _Stack:
    """Open frames; the places of each kind are kept, so that the nearest of a kind is found at once."""

    def __init__(self) -> None:
        self.open: list[Frame] = []
        self.done: list[Frame] = []
        self._places: dict[tuple[str, str], list[int]] = {}

    def push(self, frame: Frame) -> None:
        self._places.setdefault((frame.kind, frame.name), []).append(len(self.open))
        self.open.append(frame)

    def nearest(self, *kinds: str, name: str = "") -> int | None:
        found = [places[-1] for k in kinds if (places := self._places.get((k, name)))]
        return max(found, default=None)

    def close(self, depth: int, stop: int, end: int) -> None:
        """Closes a frame; what stood open above it lost its mark, and is neither closed nor open at the end."""
        while len(self.open) > depth:
            frame = self.open.pop()
            self._places[frame.kind, frame.name].pop()
        frame.stop, frame.end = stop, end
        self.done.append(frame)


#: Opening marks by closing mark.
_OPENS = {c: tuple(o for o in CLOSES if CLOSES[o] == c) for c in CLOSES.values()}


def frames(text: str) -> tuple[list[Frame], list[Frame]]:
    """Closed constructs, and the stack after the last character."""
    stack = _Stack()
    for m in _TOKENS.finditer(text):
        token, kind = m.group(), m.lastgroup
        if kind == "item":
            if (d := stack.nearest("item")) is not None:
                stack.close(d, m.start(), m.start())
            stack.push(Frame("item", m.start(), m.end()))
        elif kind in ("fence", "both"):
            own = "fence" if kind == "fence" else token
            if (d := stack.nearest(own)) is not None:
                stack.close(d, m.start(), m.end())
            else:
                head = _FENCE_HEAD.match(text, m.end()) if kind == "fence" else None
                stack.push(Frame(own, m.start(), head.end() if head else m.end()))
        elif kind == "broken":
            stack.push(Frame("tag", m.start(), m.end()))
        elif kind == "tag":
            name = re.match(r"</?([a-zA-Z][\w-]*)", token).group(1).lower()
            if token.startswith("</"):
                if (d := stack.nearest("tag", name=name)) is not None:
                    stack.close(d, m.start(), m.end())
            elif not token.endswith("/>") and name not in _EMPTY_TAGS:
                stack.push(Frame("tag", m.start(), m.end(), name=name))
        elif (d := stack.nearest(*_OPENS.get(token, ()))) is not None:
            stack.close(d, m.start(), m.end())
        elif token in CLOSES:
            stack.push(Frame(token, m.start(), m.end()))
    open_, done = stack.open, stack.done
    if (d := stack.nearest("item")) is not None and text[open_[d].inner :].strip(EDGES):
        # A list ends with its text, but an item with nothing in it broke off.
        item = open_.pop(d)
        item.stop = item.end = len(text)
        done.append(item)
    return done, open_


_BARE_TEXT = re.compile(r"[^`*_<>|" + re.escape("".join([*CLOSES, *CLOSES.values()])) + r"\"\n:\uff1a]*")
_STARTS_ITEM = re.compile(r"(?:[-*•·]|\d{1,2}[.)])(?:[ \t]|$)")


def parse_markup(text: str) -> Markup:
    """Parses an answer and peels the constructs that span it whole: labels, fences, quotations, emphasis, tags, a single item."""
    low, high = _strip(text, 0, len(text))
    if _BARE_TEXT.fullmatch(text, low, high) and not _STARTS_ITEM.match(text, low, high):
        return Markup(text[low:high])
    done, stack = frames(text)
    out = Markup("", open_at_end=[f.kind for f in stack])
    spans = {(f.start, f.end): f for f in done if f.kind in _WRAPPERS}
    items = {_strip(text, f.start, f.end)[0]: f for f in done if f.kind == "item"}
    begun = {f.start: f for f in stack if f.kind in _WRAPPERS}
    while low < high:
        if label := _LABEL.match(text, low, high):
            low, kind = label.end(), "label"
        elif frame := spans.get((low, high)):
            low, high, kind = frame.inner, frame.stop, frame.kind
        elif low in begun:
            low, kind = begun[low].inner, begun[low].kind
            out.wrapping.append(kind)
        elif (frame := items.get(low)) and _strip(text, frame.start, frame.end)[1] >= high:
            low, kind = frame.inner, "list"
        else:
            break
        low, high = _strip(text, low, high)
        out.stripped.append(kind if kind in ("label", "fence", "list", "tag") else "quotes")
    out.text = text[low:high]
    return out


def _strip(text: str, low: int, high: int) -> tuple[int, int]:
    while low < high and text[low] in EDGES:
        low += 1
    while low < high and text[high - 1] in EDGES:
        high -= 1
    return low, high


def closed_behind(text: str, at: int) -> list[str]:
    """Constructs that the text closes behind the place ``at``, that is behind its last word."""
    return [f.kind for f in frames(text)[0] if f.stop is not None and f.stop >= at and f.start < at]
