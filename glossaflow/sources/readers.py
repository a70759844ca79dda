"""Readers: data sets, manifests, transcripts, hash inventories, binary files, page snapshots and a paged HTTP source."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from glossaflow.functions.answers import transcript_text

SENTENCES = "array<struct<id:string,text:string,source_url:string,word_count:bigint,characteristics:map<string,string>,original_text:string,normalized_text:string,normalization_warnings:array<string>>>"
DATASET = f"dataset_id string, scenario string, language string, total_sentences bigint, source string, sentences {SENTENCES}"
SYNTHESIS = "utterance_id string, dataset_id string, dataset_file string, scenario string, sentence_id string, language string, preprocessing_method string, tts_system_id string, tts_family string, tts_display_name string, source_text string, synthesis_text string, source_token_count int, synthesis_token_count int, source_url string, audio_path string, metadata struct<model_ref:string,voice:string,sample_rate_hz:int>"


def plain_path(path):
    """A file path without its scheme, percent-decoded, so that listings and manifests meet."""
    return F.try_url_decode(F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), r"\\+", "%2B"))


def json_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, value``: whole texts of the JSON files of a folder, not of its subfolders; sort by path for their order."""
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def dataset_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of all data sets of a folder, in long form with ``sentence_index``; elements that are no objects are skipped."""
    docs = spark.read.schema(DATASET).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    rows = docs.select(F.col("_metadata.file_name").alias("dataset_file"), "dataset_id", "scenario", "language", F.posexplode("sentences").alias("sentence_index", "s"))
    return rows.filter("s is not null").select("dataset_file", "dataset_id", "scenario", "language", "sentence_index", "s.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON Lines file; blank lines are skipped, a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def document(spark: SparkSession, path: str) -> dict:
    """A small JSON document, {} if there is none at the path; anything but an object is refused."""
    try:
        text = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    value = json.loads(text[0]) if text else {}
    if not isinstance(value, dict):
        raise ValueError(f"no JSON object in {path}")
    return value


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """``path, hypothesis`` of the transcript files below a folder."""
    docs = spark.read.schema("text string, segments array<struct<text:string>>").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    return docs.select(F.col("_metadata.file_path").alias("path"), transcript_text(F.col("text"), F.col("segments")).alias("hypothesis"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """``sha256, path`` of an inventory with two spaces between them."""
    parts = F.split("value", "  ", 2)
    return spark.read.text(path).filter("value <> ''").select(parts[0].alias("sha256"), parts[1].alias("path"))


def binary_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)


def hashed_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path, length, sha256`` of every file below a folder."""
    return binary_files(spark, folder, glob).select("path", "length", F.sha2("content", 256).alias("sha256"))


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path`` of the files below a folder; contents are not read."""
    return binary_files(spark, folder, glob).select("path")


def snapshot_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a saved snapshot with its edition and language."""
    page = "struct<requested_title:string,title:string,page_id:bigint,revision_id:bigint,revision_timestamp:string,article_url:string,revision_url:string,history_url:string,html:string,html_sha256:string>"
    doc = spark.read.schema(f"schema string, edition string, language string, retrieved_at string, pages array<{page}>").option("multiLine", True).json(path)
    return doc.select("edition", "language", F.posexplode("pages").alias("page_pos", "p")).select("edition", "language", "page_pos", "p.*")


class PagedSource(DataSource):
    """``spark.read.format('paged')``: items of a paged HTTP API, read serially by one task.

    The fetching function (``fetch(token) -> (items, next token)``) is set with ``register``; it holds the politeness rules
    of the service. There is no network where this is tested, so tests register a fixture.
    """

    fetch: Callable[[str | None], tuple[list[dict], str | None]] | None = None

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "item string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(type(self).fetch, int(self.options.get("limit", "0")))


class _PagedReader(DataSourceReader):
    def __init__(self, fetch: Callable | None, limit: int) -> None:
        self.fetch, self.limit = fetch, limit

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        token, seen = None, 0
        while True:
            items, token = self.fetch(token)
            for item in items:
                if self.limit and seen >= self.limit:
                    return
                seen += 1
                yield (json.dumps(item, ensure_ascii=False),)
            if token is None:
                return


def register_paged(spark: SparkSession, fetch: Callable[[str | None], tuple[list[dict], str | None]]) -> None:
    source = type("RegisteredPagedSource", (PagedSource,), {"fetch": staticmethod(fetch)})
    spark.dataSource.register(source)


# Statuses and errors of a busy service, and the seconds it wants after such an error.
BUSY_STATUSES, BUSY_ERRORS, LAG_WAIT = (429, 500, 502, 503, 504), ("maxlag", "ratelimited"), 5.0


def retry_after(header: str | None, now: float) -> float:
    """Seconds that a Retry-After header asks for: a number or a date; 0 for anything else."""
    try:
        return float(header or 0)
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(header).timestamp() - now)
    except (ValueError, TypeError, OverflowError):
        return 0.0


def polite(call: Callable[[], tuple[int, dict, dict]], *, sleep: Callable[[float], None], attempts: int = 4, longest_wait: float = 30.0, clock: Callable[[], float] = time.time) -> dict:
    """The JSON of a call that is tried again when the service is busy.

    call gives status, headers and payload, or raises OSError where the network fails. The wait doubles and is never under
    what the service asks for; more than ``longest_wait`` gives up. Warnings and payloads that are no object are failures,
    as a collection must not go on with part of its data.
    """
    for n in range(attempts):
        try:
            status, headers, payload = call()
        except OSError as e:
            status, headers, payload = 503, {}, {"error": {"code": str(e)}}
        if not isinstance(payload, dict):
            raise RuntimeError("the answer is no object")
        error = (payload.get("error") or {}).get("code")
        if status < 400 and not error:
            if payload.get("warnings"):
                raise RuntimeError(f"warning: {payload['warnings']}")
            return payload
        if not (status in BUSY_STATUSES or error in BUSY_ERRORS):
            raise RuntimeError(f"request failed: {status} {error}")
        asked = retry_after(headers.get("Retry-After"), clock()) if status >= 400 else LAG_WAIT
        if asked > longest_wait or n + 1 == attempts:
            break
        sleep(max(2.0 ** (n + 1), asked))
    raise RuntimeError("service stays busy")
