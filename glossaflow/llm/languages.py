"""p8: the language of every document and of each segment of a mixed one, with a confidence.

Error-correcting output codes: every language has a codeword of ``BITS`` bits; for each bit a binary classifier over hashed
character n-grams tells on which side a sentence lies. Decoding sums a loss per bit, weighted by how well that bit's
classifier separates its sides, and takes the codeword with the least; a near second one makes the sentence ambiguous.

The classifiers are fitted on a bounded sample of labelled rows: one document of each label and hash bucket, so at most
``DOCS_PER_LABEL`` a label, and ``SENTENCES_PER_DOC`` sentences of each. Labels are noisy, so sentences that a first fit
contradicts are dropped before the second. Greek in Latin letters has a codeword of its own, fitted on romanised Greek
sentences, and is reported as Greek. The weights have a fixed size (2^18 x BITS floats) and are broadcast to the map-only
labelling stage. The documents are read twice, to sample and to label; labels travel with their texts, so nothing is joined.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow.llm.sampling import unit_interval

LANGUAGES = ("el", "en", "de", "fr", "es", "it")
#: Classes with a codeword; the last is Greek in Latin letters.
CLASSES = (*LANGUAGES, "el-Latn")
BITS = 15
#: Bounds of the training sample.
DOCS_PER_LABEL, SENTENCES_PER_DOC = 300, 5
FEATURES = 1 << 18
#: A sentence has at least so many words; one whose decoding margin is lower is ambiguous.
WHOLE_WORDS, MARGIN = 4, 0.02
#: Loss of the nearest codeword beyond which a segment is flagged, as it may be in a language that has none. Of 21,391 sentences
#: of the test tables that the fit had not seen none lies over 0.32; sentences in Dutch, Portuguese, Turkish, Russian, Swedish
#: and Polish lie at 0.35 to 0.63.
FAR = 0.33
#: Slope of the squashed mean log odds of a bit, steepness of the loss and of the confidence.
SLOPE, LOSS, SURE = 0.3, 4.0, 6.0
GRAMS = (1, 2, 3, 4)

# Codes and names of the languages.
_NAMES = {
    "el": "el ell gre gr greek ελληνικά ελληνικα ελληνική modern_greek",
    "en": "en eng english anglais englisch inglés inglese αγγλικά",
    "de": "de deu ger german deutsch allemand alemán tedesco γερμανικά",
    "fr": "fr fra fre french français francais französisch francés francese γαλλικά",
    "es": "es spa spanish español espanol castellano spanisch espagnol spagnolo ισπανικά",
    "it": "it ita italian italiano italienisch italien ιταλικά",
}
_CODE_OF = {name: code for code, names in _NAMES.items() for name in names.split()}


def named_language(label: Column) -> Column:
    """The one of ``LANGUAGES`` that a label names in any spelling; null for anything else."""
    plain = F.lower(F.trim(label))
    table = F.create_map(*[F.lit(x) for pair in _CODE_OF.items() for x in pair])
    return F.coalesce(F.try_element_at(table, plain), F.try_element_at(table, F.substring_index(F.regexp_replace(plain, "[-_. (].*$", ""), "-", 1)))


_ENDS = re.compile(r"(?<=[.!?;\u037e\uff01\uff1f…。])[\"'»”)\]]*(?:\[[^\]\s]{1,3}\])?\s+|\s*\n\s*\n\s*|\s*(?:^|\n)\s*[•*\-#>]+\s+|\s*[•]\s*|(?<=[.!?;\u037e\uff01\uff1f…»\])])\s*\n\s*|\s*\[[….]+\]\s*")
_WORDS = re.compile(r"[^\W\d_]+")
_FINAL = re.compile(r"[.!?;\u037e\uff01\uff1f…。][\"'»”)\]\s]*$")


def ends_whole(sentence: str, words: list[str]) -> bool:
    """Whether a stretch of any length begins and ends as a sentence; pieces of abbreviations (under three letters) do not."""
    first = _WORDS.search(sentence)
    return first is not None and first.group()[0].isupper() and sum(map(len, words)) >= 3 and _FINAL.search(sentence) is not None


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of every sentence-like stretch; a line break ends one only behind a final mark or before a bullet."""
    out, at = [], 0
    for m in _ENDS.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def sentence_words(sentence: str) -> list[str]:
    return _WORDS.findall(unicodedata.normalize("NFC", html.unescape(sentence)).lower())


# Common romanisations of Greek; each line is one convention, digraphs first.
_ROMAN = (
    "ου ou,αυ au,ευ eu,αι ai,ει ei,οι oi,μπ b,ντ nt,γκ gk,γγ gg,θ th,χ h,ψ ps,ξ ks,φ f,υ u,ω o,η i",
    "ου ou,αυ av,ευ ev,αι e,ει i,οι i,μπ mp,ντ d,γκ g,γγ ng,θ th,χ ch,ψ ps,ξ x,φ ph,υ y,ω o,η i",
    "ου ou,αυ ay,ευ ey,αι ai,ει ei,οι oi,μπ mp,ντ nt,γκ gk,γγ gg,θ 8,χ x,ψ ps,ξ 3,φ f,υ y,ω w,η h",
    "ου u,αυ af,ευ ef,αι e,ει i,οι i,μπ b,ντ d,γκ g,γγ g,θ th,χ kh,ψ ps,ξ x,φ f,υ i,ω o,η i",
)
_SIMPLE = str.maketrans("αβγδεζηθικλμνξοπρστυφχψως", "avgdezitiklmnxoprstyfxpos")


def romanised(text: str, convention: int) -> str:
    """Greek text in Latin letters by one of four conventions."""
    low = "".join(ch for ch in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(ch))
    for pair in _ROMAN[convention % len(_ROMAN)].split(","):
        greek, latin = pair.split()
        low = low.replace(greek, latin)
    return low.translate(_SIMPLE)


def _hash(gram: str) -> int:
    return zlib.crc32(gram.encode()) & (FEATURES - 1)


@lru_cache(maxsize=100_000)
def word_features(word: str) -> list[int]:
    """Hashed n-grams of a word with its borders, and the word itself."""
    padded = f" {word} "
    return [_hash(padded[i : i + n]) for n in GRAMS for i in range(len(padded) - n + 1)] + [_hash("=" + word)]


def codewords(seed: int = 11) -> np.ndarray:
    """``CLASSES`` x ``BITS`` of +1 and -1: the random draw with the greatest least distance, no column constant."""
    rng, best, code = np.random.default_rng(seed), -1, None
    for _ in range(3000):
        c = rng.integers(0, 2, (len(CLASSES), BITS)) * 2 - 1
        if (abs(c.sum(0)) == len(CLASSES)).any():
            continue
        distance = min((c[i] != c[j]).sum() for i in range(len(c)) for j in range(i))
        if distance > best:
            best, code = distance, c
    return code


@dataclass
class Model:
    """Weights of the bit classifiers, codewords and the bits' weights in the loss."""

    weights: np.ndarray
    code: np.ndarray
    trust: np.ndarray

    def word_score(self, word: str) -> np.ndarray:
        f = word_features(word)
        return np.append(self.weights[f].sum(0), len(f)).astype(np.float32)

    def decode(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class, confidence, margin to the second and loss of rows of n-gram score sums (last column: number of n-grams)."""
        margins = np.tanh(sums[:, :-1] / np.maximum(sums[:, -1:], 1) * SLOPE)
        loss = (self.trust * np.log1p(np.exp(-LOSS * margins[:, None, :] * self.code[None]))).sum(2) / self.trust.sum()
        order = np.argsort(loss, axis=1)
        rows = np.arange(len(loss))
        likely = np.exp(-SURE * (loss - loss[rows, order[:, 0]][:, None]))
        return order[:, 0], 1.0 / likely.sum(1), loss[rows, order[:, 1]] - loss[rows, order[:, 0]], loss[rows, order[:, 0]]


def fit(samples: list[tuple[list[str], int]], rounds: int = 2) -> Model:
    """Bit classifiers from (words, class) pairs: log odds of every n-gram between the two sides of each bit."""
    code = codewords()
    featured = [(np.array([f for w in ws for f in word_features(w)], np.int64), c) for ws, c in samples if ws]
    kept, model = featured, None
    for r in range(rounds):
        counts = np.zeros((len(CLASSES), FEATURES), np.float32)
        for c in range(len(CLASSES)):
            own = [f for f, k in kept if k == c]
            if own:
                counts[c] = np.bincount(np.concatenate(own), minlength=FEATURES)
        share = (counts + 0.02) / (counts.sum(1, keepdims=True) + 0.02 * FEATURES)
        weights = np.zeros((FEATURES, BITS), np.float32)
        for b in range(BITS):
            up, down = share[code[:, b] > 0].mean(0), share[code[:, b] < 0].mean(0)
            weights[:, b] = np.log(up) - np.log(down)
        weights[counts.sum(0) == 0] = 0
        model = Model(weights, code, np.ones(BITS))
        if kept:
            sums = np.stack([np.append(weights[f].sum(0), len(f)) for f, _ in kept])
            right = (np.sign(sums[:, :-1]) == code[[c for _, c in kept]]).mean(0)
            model.trust = np.clip(right, 0.5, 1.0) - 0.49
        if r + 1 < rounds and featured:
            got, *_ = model.decode(np.stack([np.append(weights[f].sum(0), len(f)) for f, _ in featured]))
            kept = [x for x, g in zip(featured, got) if g == x[1]]
    return model


def _greek(words: list[str]) -> bool:
    letters = sum(map(len, words))
    return letters > 0 and 2 * sum("Ͱ" <= ch <= "Ͽ" or "ἀ" <= ch <= "῿" for w in words for ch in w) > letters


def training_model(documents: DataFrame, salt: str = "p8-train") -> Model:
    """Fits the model on the bounded sample of ``documents`` (``doc_id, text, lang``).

    The document with the least hash stands for its label and bucket: a map-side combined minimum, one pass over the table.
    """
    labelled = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", named_language(F.col("lang")).alias("lang")).filter("lang is not null and text is not null")
    placed = labelled.withColumn("u", unit_interval(F.coalesce("doc_id", F.lit("")), salt)).withColumn("bucket", F.floor(F.col("u") * DOCS_PER_LABEL))
    drawn = placed.groupBy("lang", "bucket").agg(F.min(F.struct("u", "doc_id", "text")).alias("d")).select("lang", "d.doc_id", "d.text")

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text, lang in zip(frame["doc_id"], frame["text"], frame["lang"]):
                found = [w for a, b in sentences(text) if len(w := sentence_words(text[a:b])) >= WHOLE_WORDS]
                found.sort(key=lambda w: zlib.crc32((str(doc_id) + " ".join(w[:40])).encode()))
                rows += [(lang, " ".join(w[:60])) for w in found[:SENTENCES_PER_DOC]]
            yield pd.DataFrame(rows, columns=["lang", "words"])

    samples: list[tuple[list[str], int]] = []
    # Sorted, so that the fit is the same in every layout; at most labels x DOCS_PER_LABEL x SENTENCES_PER_DOC rows.
    for k, (lang, joined) in enumerate(sorted(drawn.mapInPandas(pick, "lang string, words string").collect())):
        ws = joined.split(" ")
        if _greek(ws):
            samples.append((ws, 0))
            samples.append(([w for w in romanised(joined, k).split(" ") if w], len(CLASSES) - 1))
        elif lang != "el":
            samples.append((ws, LANGUAGES.index(lang)))
    return fit(samples)


def _labeller(shared: Broadcast, shape: Callable[[pd.DataFrame, list[list[tuple]]], pd.DataFrame]):
    """Labels batches of ``doc_id, text, ...``; ``shape`` makes the result of a batch out of it and its documents' segments."""

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        scores: dict[str, np.ndarray] = {}
        for frame in frames:
            spans, sums = [], []
            for k, text in enumerate(frame["text"]):
                for a, b in sentences(text):
                    ws = sentence_words(text[a:b])
                    if not ws:
                        continue
                    total = np.zeros(BITS + 1, np.float32)
                    for w in ws:
                        s = scores.get(w)
                        if s is None:
                            if len(scores) > 200_000:
                                scores.clear()
                            s = scores[w] = model.word_score(w)
                        total += s
                    spans.append((k, a, b, len(ws), len(ws) >= WHOLE_WORDS or ends_whole(text[a:b], ws)))
                    sums.append(total)
            yield shape(frame, _segments(len(frame), spans, *model.decode(np.stack(sums))) if spans else [[] for _ in range(len(frame))])

    return label


def _segments(documents: int, spans: list, got: np.ndarray, sure: np.ndarray, margin: np.ndarray, loss: np.ndarray) -> list[list[tuple]]:
    """Segments of each document: neighbouring sentences of one language joined; fragments and ambiguous ones go with their neighbours.

    A segment is (start, end, language, confidence, sentences, ambiguous). Its sentences are the whole, unambiguous ones; a
    document that has none is one segment of its likeliest language. Such a segment is ambiguous, and one whose sentences lie
    far from every codeword.
    """
    names = [c.split("-")[0] for c in CLASSES]
    out: list[list[tuple]] = [[] for _ in range(documents)]
    i = 0
    while i < len(spans):
        j = i
        while j < len(spans) and spans[j][0] == spans[i][0]:
            j += 1
        own, rows = range(i, j), out[spans[i][0]]
        whole = [k for k in own if spans[k][4] and margin[k] >= MARGIN]
        if not whole:
            best = max(own, key=lambda k: (spans[k][3], margin[k]))
            rows.append((spans[i][1], spans[j - 1][2], names[got[best]], float(sure[best]), 0, True))
        else:
            start, members = spans[i][1], [whole[0]]
            for k, after in zip(whole, [*whole[1:], None]):
                if after is not None and names[got[after]] == names[got[k]]:
                    members.append(after)
                    continue
                end = spans[after - 1][2] if after is not None else spans[j - 1][2]
                rows.append((start, end, names[got[k]], float(np.mean(sure[members])), len(members), bool(np.mean(loss[members]) > FAR)))
                if after is not None:
                    start, members = spans[after][1], [after]
        i = j
    return out


def _labelled(documents: DataFrame, model: Model | None, shape: Callable, schema: str) -> DataFrame:
    model = model or training_model(documents)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", named_language(F.col("lang")).alias("named")).filter("doc_id is not null and text is not null")
    return docs.mapInPandas(_labeller(documents.sparkSession.sparkContext.broadcast(model), shape), schema)


def language_segments(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, segment, start, end, lang, confidence, n_sentences, ambiguous``: the language of every segment.

    Null, empty and letterless texts have no segment. The text is read whole; repeated rows of a doc_id give repeated
    segments, so pass distinct documents where they may occur.
    """

    def shape(frame: pd.DataFrame, found: list[list[tuple]]) -> pd.DataFrame:
        rows = [(d, n, *s) for d, segments in zip(frame["doc_id"], found) for n, s in enumerate(segments)]
        return pd.DataFrame(rows, columns=["doc_id", "segment", "start", "end", "lang", "confidence", "n_sentences", "ambiguous"])

    return _labelled(documents, model, shape, "doc_id bigint, segment int, start int, end int, lang string, confidence double, n_sentences int, ambiguous boolean")


def document_languages(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, lang, confidence, n_languages``: the language with most whole sentences, then of most text, then by name.

    The confidence is the mean over the segments of that language. Repeated rows of a doc_id give repeated rows.
    """

    def shape(frame: pd.DataFrame, found: list[list[tuple]]) -> pd.DataFrame:
        rows = []
        for d, segments in zip(frame["doc_id"], found):
            by_lang: dict[str, list] = {}
            for start, end, lang, sure, n, _ in segments:
                own = by_lang.setdefault(lang, [0, 0, []])
                own[0] += n
                own[1] += end - start
                own[2].append(sure)
            if by_lang:
                lang = max(by_lang, key=lambda x: (by_lang[x][0], by_lang[x][1], x))
                rows.append((d, lang, float(np.mean(by_lang[lang][2])), max(1, sum(n > 0 for n, *_ in by_lang.values()))))
        return pd.DataFrame(rows, columns=["doc_id", "lang", "confidence", "n_languages"])

    return _labelled(documents, model, shape, "doc_id bigint, lang string, confidence double, n_languages int")


def mislabelled(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, true_lang``: every language with a whole sentence, of documents whose label misses or errs or that mix.

    A document without a whole, unambiguous sentence counts with its likeliest language. Repeated rows add nothing: only the
    rows found are made distinct, and nothing else is shuffled.
    """

    def shape(frame: pd.DataFrame, found: list[list[tuple]]) -> pd.DataFrame:
        rows = []
        for d, named, segments in zip(frame["doc_id"], frame["named"], found):
            spoken = {s[2] for s in segments}
            if spoken and spoken != {named}:
                rows += [(d, lang) for lang in sorted(spoken)]
        return pd.DataFrame(rows, columns=["doc_id", "true_lang"])

    return _labelled(documents, model, shape, "doc_id bigint, true_lang string").distinct()
