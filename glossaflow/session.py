"""Session settings shared by tests, bench and jobs."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession


def first_env(names: Sequence[str], environ: Mapping[str, str] = os.environ) -> str | None:
    """The first of some environment variables that is set and not empty."""
    return next((environ[n] for n in names if environ.get(n)), None)


def local_session(cores: str = "8", partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("glossaflow")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
