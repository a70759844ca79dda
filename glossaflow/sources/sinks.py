"""Writers: JSON Lines with sorted keys, appends, writes that refuse to overwrite, inventories, handoffs, small documents."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Columns in alphabetical order, nulls written."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    write_json_lines(df, path, "append")


def write_once(df: DataFrame, path: str) -> None:
    """Fails if the target exists."""
    df.write.mode("errorifexists").parquet(path)


def write_variants(df: DataFrame, path: str) -> None:
    """Variants by method, so that a reader of one method reads its folder only."""
    df.write.mode("overwrite").partitionBy("method").parquet(path)


def write_handoff(index: DataFrame, path: str) -> None:
    """One folder per system with its numbered one-line texts, in files of consecutive numbers."""
    index.select("tts_system_id", "handoff_index", "utterance_id", "handoff_text").repartitionByRange("tts_system_id", "handoff_index").sortWithinPartitions("tts_system_id", "handoff_index").write.mode("errorifexists").partitionBy("tts_system_id").json(path)


def copy_returned(plan: DataFrame) -> dict[str, int]:
    """Copies the existing sources of a copy plan (``source, target, exists``) on the executors; counts both kinds.

    Sources and targets are paths that every executor sees.
    """
    import shutil
    from collections.abc import Iterator

    import pandas as pd

    def copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, target in zip(frame["source"], frame["target"]):
                Path(target).parent.mkdir(parents=True, exist_ok=True)
                shutil.copyfile(source, target)
            yield pd.DataFrame({"n": [len(frame)]})

    copied = plan.filter("exists").select("source", "target").mapInPandas(copy, "n bigint").agg(F.sum("n")).first()[0] or 0
    return {"copied": copied, "missing": plan.filter("not exists").count()}


def write_inventory(files: DataFrame, path: str) -> None:
    """``sha256  path`` lines in path order."""
    files.select(F.concat_ws("  ", "sha256", "path").alias("value"), "path").orderBy("path").select("value").write.mode("errorifexists").text(path)


def write_document(document: dict, path: str, overwrite: bool = True) -> None:
    """A small document, pretty-printed with a final newline; parents are made."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("w" if overwrite else "x", encoding="utf-8") as f:
        f.write(json.dumps(document, ensure_ascii=False, indent=2) + "\n")


def summary_document(summary: DataFrame, **counters: int) -> dict:
    """A grouped summary (a few rows per system and scenario) as a nested document."""
    out: dict = dict(counters)
    for row in summary.collect():
        values = {k: v for k, v in row.asDict().items() if k not in ("grouping", "key")}
        if row["grouping"] == "overall":
            out["overall"] = values
        else:
            out.setdefault(row["grouping"], {})[row["key"]] = values
    return {k: dict(sorted(v.items())) if isinstance(v, dict) and k != "overall" else v for k, v in out.items()}
