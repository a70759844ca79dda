"""Candidate corpora out of saved web pages: paragraphs, sentences, filters, first-seen dedup, stable ids, counters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow.functions.text import BOUNDARY, candidate_id, digest, has_decimal_digit, sentence_split, strip_edges, word_count
from glossaflow.operators.ranking import join_groups

# Elements and classes whose text is no prose, elements that spoil a paragraph, elements without an end.
BLOCKED = frozenset("table ul ol dl script style figure nav aside".split())
BLOCKED_CLASSES = frozenset("reference reflist mw-editsection hatnote navbox infobox metadata thumb sidebar noprint toc".split())
SPOILING = frozenset("math code pre img sup sub".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Prose(HTMLParser):
    """Paragraph texts of a page; ``done`` holds (text, kept), where spoiled paragraphs are not kept.

    Open elements are a list of names; ``_silent`` is the place of the outermost one whose contents are no prose.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.done: list[tuple[str, bool]] = []
        self._path: list[str] = []
        self._silent: int | None = None
        self._pieces: list[str] | None = None
        self._clean = True

    def _reading(self) -> bool:
        return self._pieces is not None and self._silent is None

    def handle_data(self, data: str) -> None:
        if self._reading():
            self._pieces.append(data)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        classes = {c for name, value in attrs if name == "class" and value for c in value.split()}
        if self._reading():
            self._clean &= tag not in SPOILING or "reference" in classes
            if tag == "br":
                self._pieces.append(" ")
        silences = tag in BLOCKED or not BLOCKED_CLASSES.isdisjoint(classes)
        if tag == "p" and self._silent is None and not silences:
            self._pieces, self._clean = [], True  # a paragraph left open before it is lost
        if tag in EMPTY:
            return
        if silences and self._silent is None:
            self._silent = len(self._path)
        self._path.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and self._pieces is not None:
            text = " ".join("".join(self._pieces).split())
            self._pieces = None
            if text or not self._clean:
                self.done.append((text, self._clean))
        if tag in self._path:
            while self._path.pop() != tag:
                pass
            if self._silent is not None and self._silent >= len(self._path):
                self._silent = None


def page_paragraphs(html: str) -> list[tuple[str, bool]]:
    parser = _Prose()
    parser.feed(html)
    parser.close()
    return parser.done


def paragraphs(pages: DataFrame) -> DataFrame:
    """``page_id, paragraph_index, text, kept`` of pages (``page_id, html``); the index counts kept paragraphs, from 0."""

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page, html in zip(frame["page_id"], frame["html"]):
                index = 0
                for text, kept in page_paragraphs(html) if html else ():
                    rows.append((page, index if kept else -1, text, kept))
                    index += kept
            yield pd.DataFrame(rows, columns=["page_id", "paragraph_index", "text", "kept"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "html").mapInPandas(extract, "page_id bigint, paragraph_index int, text string, kept boolean")


def tampered(pages: DataFrame) -> DataFrame:
    """Pages whose HTML does not have the digest saved with it."""
    return pages.filter(~digest(F.col("html")).eqNullSafe(F.col("html_sha256"))).select("page_id")


def chunks(texts: DataFrame, *, by_sentence: bool = True, boundary: str = BOUNDARY) -> DataFrame:
    """Adds ``chunk_index, chunk``: the sentences of ``text``, or the whole text.

    The outer form of the generator keeps the optimizer from adding a size filter that would split every text again.
    """
    pieces = sentence_split(F.col("text"), boundary) if by_sentence else F.filter(F.array(strip_edges(F.col("text"))), lambda s: s != "")
    return texts.select("*", F.posexplode_outer(pieces).alias("chunk_index", "chunk")).filter("chunk is not null")


def checked_options(*, boundary: str = BOUNDARY, min_chars: int = 25, max_chars: int = 300, min_words: int = 0, max_words: int = 0, max_sentences: int = 200, dataset_id: str = "candidates", scenario: str = "unreviewed", include: str | None = None, exclude: str | None = None) -> None:
    """Refuses options of a candidate build that cannot work, before anything runs (ValueError)."""
    problems = [
        (not re.fullmatch("[A-Za-z0-9][A-Za-z0-9_-]*", dataset_id), "the data set's id may hold letters, digits, _ and -"), (not scenario.strip(), "the scenario is empty"),
        (min_chars < 1 or max_chars < min_chars, "bad bounds of characters"), (min_words < 0 or max_words < 0 or 0 < max_words < min_words, "bad bounds of words"), (max_sentences < 1, "bad number of sentences"),
    ]
    for name, pattern in (("boundary", boundary), ("include", include), ("exclude", exclude)):
        try:
            compiled = regex.compile(pattern or "x")
        except regex.error as e:
            raise ValueError(f"bad {name} pattern: {e}") from e
        problems.append((name == "boundary" and (compiled.groups > 0 or compiled.search("") is not None), "a boundary may neither capture nor match nothing"))
    for wrong, what in problems:
        if wrong:
            raise ValueError(what)


def judged_candidates(pieces: DataFrame, order: list[str], *, min_chars: int = 25, max_chars: int = 300, min_words: int = 0, max_words: int = 0, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """``reason, n, row``: chunks by what becomes of them.

    A chunk that breaks a rule counts under the first such rule; its row is one of them. Of all others the first of each text,
    in ``order``, is kept (reason null), and n - 1 are its duplicates. One pass and one map-side combined aggregation, so a
    text that makes up a third of all chunks leaves every task as one row, and nothing is joined.
    """
    words = word_count(F.col("chunk"))
    size = F.char_length("chunk")
    early = F.when((size < min_chars) | (size > max_chars), "character_length").when((words < min_words) | ((words > max_words) if max_words else F.lit(False)), "rough_word_length")
    if include:
        early = early.when(~F.regexp_like("chunk", F.lit(include)), "include_pattern")
    if exclude:
        early = early.when(F.regexp_like("chunk", F.lit(exclude)), "exclude_pattern")
    ruled = pieces.select(F.struct(*pieces.columns, words.alias("words")).alias("row"), F.struct(*order).alias("at"), early.alias("reason"), digest(F.col("chunk")).alias("key"))
    grouped = ruled.groupBy("reason", F.when(F.col("reason").isNull(), F.col("key")).alias("key"))
    return grouped.agg(F.count("*").alias("n"), F.min_by("row", "at").alias("row")).select("reason", "n", "row")


def kept_candidates(judged: DataFrame) -> DataFrame:
    """The chunks that are kept, with their columns and ``words``."""
    return judged.filter("reason is null").select("row.*")


def candidates(kept: DataFrame, edition: str) -> DataFrame:
    """Candidate rows of kept chunks (``page_id, revision_id, chunk, words``) with their stable ids.

    ``provenance`` holds what is known of the page a chunk comes from and its place there; ``source_url`` is the page's
    revision. Columns that the chunks lack are null.
    """
    text, have = F.col("chunk"), set(kept.columns)
    known = lambda c, kind="string": (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
    told = [known("title"), known("page_id", "bigint"), known("revision_id", "bigint"), known("revision_timestamp"), known("article_url"), known("history_url"), known("html_sha256"), known("paragraph_index", "int")]
    return kept.select(
        candidate_id(F.lit(edition), F.col("page_id"), F.col("revision_id"), text).alias("id"), text.alias("text"), known("revision_url").alias("source_url"), F.col("words").alias("word_count"),
        has_decimal_digit(text).alias("has_digit"), F.lit("needs_language_review").alias("review_status"), "page_id", "revision_id", digest(text).alias("text_sha256"),
        F.struct(*told, digest(text).alias("text_sha256")).alias("provenance"),
    )


def collection_counts(judged: DataFrame, paragraphs: DataFrame | None = None, selected: int | None = None) -> DataFrame:
    """``counter, n``: candidates, every reason that occurred, duplicates and the eligible ones.

    With ``paragraphs`` (``kept``) also the paragraphs read and those rejected for their mark-up, and the number selected if
    it is given.
    """
    eligible = F.col("reason").isNull()
    counter = lambda name, n: F.struct(name.alias("counter"), n.cast("bigint").alias("n"))
    parts = F.array(
        counter(F.lit("candidates"), F.col("n")), counter(F.coalesce("reason", F.lit("eligible_unique")), F.when(eligible, 1).otherwise(F.col("n"))),
        counter(F.lit("duplicate_text"), F.when(eligible & (F.col("n") > 1), F.col("n") - 1)),
    )
    out = judged.select(F.explode(parts).alias("p")).filter("p.n is not null").groupBy("p.counter").agg(F.sum("p.n").alias("n"))
    spark = judged.sparkSession
    explicit = spark.createDataFrame([("candidates", 0), ("eligible_unique", 0), *([("selected", selected)] if selected is not None else [])], "counter string, n bigint")
    if paragraphs is not None:
        read = paragraphs.agg(F.count_if("kept").alias("paragraphs"), F.count_if(~F.col("kept")).alias("markup_paragraphs_rejected"))
        explicit = explicit.unionByName(read.unpivot([], ["paragraphs", "markup_paragraphs_rejected"], "counter", "n"))
    return out.unionByName(explicit).groupBy("counter").agg(F.sum("n").alias("n"))


def page_reasons(pages: DataFrame) -> DataFrame:
    """Adds ``reason`` to requested pages (``pos, title, page_id, namespace, disambiguation``): why a page is skipped.

    Missing or invalid pages, other namespaces, disambiguation pages, and pages resolved before under another title. A page
    that holds a large part of all rows is met map-side, and rows that are skipped anyway meet nothing.
    """
    early = F.when(F.col("page_id").isNull(), "missing_or_invalid").when(F.col("namespace") != 0, "not_an_article").when(F.coalesce("disambiguation", F.lit(False)), "disambiguation")
    ruled = pages.withColumn("_early", early).withColumn("_page", F.when(F.col("_early").isNull(), F.col("page_id")))
    first = ruled.filter("_page is not null").groupBy("_page").agg(F.count("*").alias("n"), F.min("pos").alias("_first"))
    joined = join_groups(ruled, first, "_page")
    return joined.withColumn("reason", F.coalesce("_early", F.when(F.col("pos") > F.col("_first"), "duplicate_page"))).drop("_early", "_page", "_first")


def merged_titles(given: DataFrame, listed: DataFrame, most: int) -> DataFrame:
    """``title``: given titles first, then listed ones (both ``pos, title``), each once, ``most`` of them in that order."""
    both = given.select(F.lit(0).alias("source"), "pos", "title").unionByName(listed.select(F.lit(1).alias("source"), "pos", "title"))
    first = both.groupBy("title").agg(F.min(F.struct("source", "pos")).alias("at"))
    return first.orderBy("at").limit(most).select("title")
