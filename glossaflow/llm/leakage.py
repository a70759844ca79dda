"""p6: held-out passages inside a training corpus.

A document leaks an item if it holds ``RUN`` consecutive words of it, or the whole item with at most ``EDITS`` words
replaced, dropped or added. Either way it holds an intact run of s words of the item, where
s = min(RUN, ceil((words - EDITS) / (EDITS + 1))): edits cut an item into at most EDITS + 1 intact runs. So item and
documents are read in windows of each item's size s; every window gets a SimHash of its weighted words, and equal windows
have equal fingerprints. Fingerprints are matched by multi-index Hamming blocks: of RADIUS + 1 blocks one at least is
untouched within RADIUS bits, so every pair of windows within the radius is a candidate, and every leak is among them.
Candidates are then verified exactly: weighted-shingle similarity first, then the longest common run and the edit distance.

The items are a stated query set. Their size is summed before any of them is collected; they come to the driver in groups of
about ``GROUP_CHARS`` characters, are indexed there once, and the index is broadcast. The documents are scanned once for every
group (once for test material of up to some four million words) in a map-only stage, and never shuffled.

Windows of a whole item's length would need a far larger radius: over the 240 items of the test tables, each with two random
edits, such windows lie 6 bits apart in the median and up to 17 of 64. Only 16 % come within 3 bits, and a radius of 17 takes
18 blocks of three or four bits, each of which every eighth fingerprint shares.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words that make a leak, words that may differ in a whole item, and the Hamming radius of the candidates.
RUN, EDITS, RADIUS = 8, 2, 3
#: Characters of the items of one index: some four million words, of which the tables take about 30 bytes a word in a worker.
GROUP_CHARS = 28_000_000
#: Words of a document fingerprinted at a time.
STRETCH = 20_000

# Letters of other scripts as the Greek ones they look like.
_ALIKE = str.maketrans(
    "abeziknotpxyhmuvwАВЕНІКМОРТУХаеікортухсѕјνгпѵи",
    "αβεζικνοτρχυημυνωΑΒΕΗΙΚΜΟΡΤΥΧαεικορτυχςsjνγπνι",
)
_WORDS = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ]")


#: Combining marks of the scripts in use.
_COMBINING = re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u05c7\u064b-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")


def plain_words(text: str) -> list[str]:
    """Words without case, accents, marks, invisible characters and look-alikes."""
    if not text.isascii():
        text = _COMBINING.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text.replace("΄", ""))))
    return _WORDS.findall(text.lower().replace("ς", "σ").translate(_ALIKE))


def weight(word: str) -> int:
    """Weight of a word as a shingle: longer words tell more."""
    return 1 if len(word) <= 3 else 2 if len(word) <= 6 else 3


def window_size(words: int) -> int:
    """Words of an item of which any leak holds one intact run."""
    return max(1, min(RUN, words, math.ceil((words - EDITS) / (EDITS + 1))))


class Votes:
    """Signed, weighted bit votes of words, one row of 64 each; rows of words seen before are kept."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1024, 64), np.int8)

    def of(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        if len(ids) > 400_000:  # keeps a worker's memory level on endless vocabularies
            ids.clear()
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            k = ids.get(w)
            if k is None:
                k = ids[w] = len(ids)
                if k >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                bits = np.unpackbits(np.frombuffer(xxhash.xxh3_64_digest(w.encode()), np.uint8)).astype(np.int8)
                self.rows[k] = (2 * bits - 1) * weight(w)
            out[i] = k
        return self.rows[out]


def running_sums(votes: np.ndarray) -> np.ndarray:
    """Votes summed from the start; the difference of two rows is the vote of the window between them."""
    sums = np.zeros((len(votes) + 1, 64), np.int32)
    np.cumsum(votes, axis=0, out=sums[1:])
    return sums


def fingerprints(sums: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of ``size`` words, as uint64."""
    if len(sums) <= size:
        return np.empty(0, np.uint64)
    return np.packbits(sums[size:] > sums[:-size], axis=1).view(">u8").ravel().astype(np.uint64)


_BLOCKS = RADIUS + 1
_BITS = 64 // _BLOCKS
#: Number of set bits of every 16-bit value.
_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _bits_set(x: np.ndarray) -> np.ndarray:
    return sum(_POPCOUNT[((x >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)].astype(np.int16) for k in range(4))


class MultiIndex:
    """Fingerprints by the value of each of their Hamming blocks."""

    def __init__(self, prints: np.ndarray, items: np.ndarray) -> None:
        pairs = np.unique(np.stack([prints, items.astype(np.uint64)]), axis=1) if len(prints) else np.empty((2, 0), np.uint64)
        self.prints, self.items, self.order, self.edges = pairs[0], pairs[1].astype(np.int32), [], []
        for b in range(_BLOCKS):
            key = self._key(self.prints, b)
            order = np.argsort(key, kind="stable").astype(np.int32)
            self.order.append(order)
            self.edges.append(np.searchsorted(key[order], np.arange((1 << _BITS) + 1)).astype(np.int32))

    @staticmethod
    def _key(prints: np.ndarray, block: int) -> np.ndarray:
        return ((prints >> np.uint64(_BITS * block)) & np.uint64((1 << _BITS) - 1)).astype(np.int64)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``prints`` and items of all pairs within the radius."""
        at, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for b in range(_BLOCKS):
            key = self._key(prints, b)
            low, high = self.edges[b][key], self.edges[b][key + 1]
            some = np.flatnonzero(high > low)
            for part in np.array_split(some, max(1, int((high[some] - low[some]).sum()) // 2_000_000 + 1)):
                n = high[part] - low[part]
                rows = np.repeat(part, n)
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                of = self.order[b][np.repeat(low[part], n) + inside]
                near = _bits_set(self.prints[of] ^ prints[rows]) <= RADIUS
                at.append(rows[near])
                items.append(self.items[of[near]])
        return np.concatenate(at), np.concatenate(items)


def longest_run(item: list[str], document: list[str]) -> int:
    """Words of the longest common run."""
    best, before = 0, {}
    where: dict[str, list[int]] = {}
    for i, w in enumerate(item):
        where.setdefault(w, []).append(i)
    for w in document:
        now = {i: before.get(i - 1, 0) + 1 for i in where.get(w, ())}
        best = max(best, max(now.values(), default=0))
        before = now
    return best


def edits_inside(item: list[str], document: list[str]) -> int:
    """Fewest words to replace, drop or add so that the item is a stretch of the document."""
    row = [0] * (len(document) + 1)
    for i, w in enumerate(item, 1):
        diagonal, row[0] = row[0], i
        for j, d in enumerate(document, 1):
            diagonal, row[j] = row[j], min(diagonal + (w != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def shingle_similarity(item: list[str], stretch: list[str]) -> float:
    """Share of the item's weighted single-word shingles that the stretch holds."""
    left: dict[str, int] = {}
    for w in stretch:
        left[w] = left.get(w, 0) + 1
    held = total = 0
    for w in item:
        total += weight(w)
        if left.get(w, 0) > 0:
            left[w] -= 1
            held += weight(w)
    return held / total if total else 0.0


def verify(item: list[str], document: list[str], hits: list[int], size: int) -> tuple[bool, float, int]:
    """Exact check around the windows that matched: leak or not, similarity and longest run.

    Any leak lies within an item's length (and the edits) of one of its intact windows, so only there is it looked for.
    """
    reach, leaked, similar, run = len(item) + EDITS, False, 0.0, 0
    heaviest = sum(sorted((weight(w) for w in item), reverse=True)[:EDITS])
    least = 1.0 - heaviest / max(1, sum(map(weight, item)))
    end = -1
    for hit in sorted(hits):
        if hit < end:  # inside the stretch read last
            continue
        low, end = max(0, hit - reach), hit + size
        stretch = document[low : hit + size + reach]
        own_run, own = longest_run(item, stretch), shingle_similarity(item, stretch)
        run, similar = max(run, own_run), max(similar, own)
        if own_run >= min(RUN, len(item)) or (own >= least - 1e-9 and edits_inside(item, stretch) <= EDITS):
            leaked = True
    return leaked, similar, run


def _stretches(texts: list[list[str]]) -> Iterator[list[int]]:
    """Documents in runs of some ``STRETCH`` words, which are fingerprinted together; a longer one stands alone."""
    run, held = [], 0
    for d, words in enumerate(texts):
        if run and held + len(words) > STRETCH:
            yield run
            run, held = [], 0
        run.append(d)
        held += len(words)
    if run:
        yield run


def _hits(docs: list[int], texts: list[list[str]], votes: Votes, index: dict[int, MultiIndex], overlap: int) -> dict[tuple[int, int], set[int]]:
    """Window starts of each document within the radius of a window of each item, by (document, item)."""
    found: dict[tuple[int, int], set[int]] = {}
    ends = np.cumsum([len(texts[d]) for d in docs])
    flat = texts[docs[0]] if len(docs) == 1 else [w for d in docs for w in texts[d]]
    for start in range(0, max(1, len(flat) - overlap + 1), STRETCH):
        sums = running_sums(votes.of(flat[start : start + STRETCH + overlap - 1]))
        for size, multi in index.items():
            at, items = multi.within(fingerprints(sums, size))
            at = at + start
            inside = np.searchsorted(ends, at, side="right")
            for a, n, k in zip(at.tolist(), inside.tolist(), items.tolist()):
                if a + size <= ends[n]:  # a window across two documents is none
                    found.setdefault((docs[n], k), set()).add(a - int(ends[n] - len(texts[docs[n]])))
    return found


class ItemIndex:
    """The index of a group of items: their words and, for every window size among them, their fingerprints."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        votes, by_size = Votes(), {}
        self.ids, self.words = [], []
        for item_id, text in items:
            ws = plain_words(text)
            if not ws:
                continue
            prints = fingerprints(running_sums(votes.of(ws)), window_size(len(ws)))
            own = by_size.setdefault(window_size(len(ws)), ([], []))
            own[0].append(prints)
            own[1].append(np.full(len(prints), len(self.ids)))
            self.ids.append(item_id)
            self.words.append(" ".join(ws))
        self.by_size = {s: MultiIndex(np.concatenate(p), np.concatenate(k)) for s, (p, k) in by_size.items()}


def _finder(shared: Broadcast):
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        votes, index = Votes(), shared.value
        overlap = max(index.by_size, default=1)
        for frame in frames:
            rows = []
            ids, texts = frame["doc_id"].tolist(), [plain_words(t) for t in frame["text"]]
            for docs in _stretches(texts):
                for (d, k), at in _hits(docs, texts, votes, index.by_size, overlap).items():
                    ws = index.words[k].split(" ")
                    leaked, similar, run = verify(ws, texts[d], list(at), window_size(len(ws)))
                    if leaked:
                        rows.append((ids[d], index.ids[k], similar, run))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "similarity", "longest_run"])

    return find


def leaks(documents: DataFrame, items: DataFrame, group_chars: int = GROUP_CHARS) -> DataFrame:
    """``doc_id, item_id, similarity, longest_run``: one row per document and item it leaks.

    Null ids or texts leak nothing, nor do items without a word; an item shorter than ``RUN`` words leaks where it stands
    whole (or, from four words on, with the edits allowed). Repeated rows of a document or item add nothing. The driver
    holds one group of items at a time, of some ``group_chars`` characters and at least one item.
    """
    queries = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id is not null and text is not null").distinct()
    size = queries.agg(F.sum(F.char_length("text"))).first()[0] or 0
    groups = max(1, -(-size // group_chars))
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    parts = []
    for g in range(groups):
        own = queries.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        shared = items.sparkSession.sparkContext.broadcast(ItemIndex(sorted(map(tuple, own.collect()))))
        parts.append(docs.mapInPandas(_finder(shared), "doc_id bigint, item_id bigint, similarity double, longest_run int"))
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.max("longest_run").alias("longest_run"))


def leaked_items(found: DataFrame) -> DataFrame:
    """``item_id, n_documents, longest_run``: which test items leaked and how far."""
    return found.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("longest_run").alias("longest_run"))
