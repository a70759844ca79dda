"""WAV files: reading their headers and samples in Arrow batches, and quality checks."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the checks: seconds, peak of silence, peak of full scale.
SHORTEST, LONGEST, SILENCE, FULL_SCALE = 0.3, 20.0, 0.01, 0.999
_PCM, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE


@dataclass
class Wave:
    """What a WAV file holds; ``peak`` is None where samples are not judged (8 and 24 bit, no samples)."""

    rate: int
    channels: int
    bits: int
    is_float: bool
    duration: float
    peak: float | None
    finite: bool


def read_wave(content: bytes) -> Wave:
    """Walks the RIFF chunks (odd ones are padded); raises ValueError for anything that is no readable WAV."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    at, form, data, short = 12, None, None, ""
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        body = content[at + 8 : at + 8 + size]
        short = short or (len(body) < size and name.decode("latin-1").strip())
        if name == b"fmt ":
            if len(body) < 16:
                raise ValueError("short fmt chunk")
            form = list(struct.unpack_from("<HHIIHH", body))
            if form[0] == _EXTENSIBLE and len(body) >= 26:
                form[0] = struct.unpack_from("<H", body, 24)[0]
        elif name == b"data":
            data, declared = body, size
        at += 8 + size + size % 2
        if form is not None and data is not None:
            break
    if form is not None and form[0] == _FLOAT and short:
        raise ValueError(f"truncated {short} chunk")
    if form is None or data is None:
        raise ValueError("fmt or data chunk missing")
    kind, channels, rate, _, frame_bytes, bits = form
    if kind not in (_PCM, _FLOAT) or not channels or not rate or not frame_bytes:
        raise ValueError("unsupported coding")
    # A PCM file lasts as long as its header says, even if its samples break off.
    duration = ((len(data) if kind == _FLOAT else declared) // frame_bytes) / rate
    if kind == _FLOAT:
        if bits not in (32, 64):
            raise ValueError("unsupported float width")
        width = bits // 8
        samples = np.frombuffer(data[: len(data) // width * width], "<f4" if bits == 32 else "<f8").astype(np.float64)
        finite = bool(np.isfinite(samples).all())
        peak = float(np.abs(samples[np.isfinite(samples)]).max(initial=0.0))
        return Wave(rate, channels, bits, True, duration, peak, finite)
    peak = None
    if bits == 16 and len(data) >= frame_bytes:
        samples = np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.int32)
        peak = float(np.abs(samples).max(initial=0)) / 32768.0
    return Wave(rate, channels, bits, False, duration, peak, True)


def waves(files: DataFrame) -> DataFrame:
    """``path, sample_rate, channels, bits, is_float, duration_s, peak, finite, error`` of binary files (path, content)."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    w = read_wave(bytes(content or b""))
                    rows.append((path, w.rate, w.channels, w.bits, w.is_float, w.duration, w.peak, w.finite, None))
                except ValueError as e:
                    rows.append((path, None, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "channels", "bits", "is_float", "duration_s", "peak", "finite", "error"]).astype({"sample_rate": "Int64", "channels": "Int64", "bits": "Int64"})

    return files.select("path", "content").mapInPandas(read, "path string, sample_rate bigint, channels bigint, bits bigint, is_float boolean, duration_s double, peak double, finite boolean, error string")


def issues(duration: Column, peak: Column, rate: Column, expected_rate: Column, *, shortest: float = SHORTEST, longest: float = LONGEST, silence: float = SILENCE) -> Column:
    """The checks that fail, in fixed order; a null measurement is not judged."""
    level = F.when(peak < silence, F.format_string("near-silent (peak %.4f)", peak)).when(peak >= FULL_SCALE, F.lit("possible clipping (peak at full scale)"))
    rates = F.concat(F.lit("sample rate "), rate.cast("string"), F.lit(" != configured "), expected_rate.cast("string"))
    return F.array_compact(F.array(
        F.when(duration < shortest, F.format_string("too short (%.2fs)", duration)), F.when(duration > longest, F.format_string("too long (%.2fs)", duration)),
        level, F.when((expected_rate > 0) & (rate != expected_rate), rates),
    ))


def quality(manifest: DataFrame, measured: DataFrame, **limits: float) -> DataFrame:
    """The manifest's clips with their measurements and issues; a clip without a file has the one issue 'missing'."""
    m = measured.withColumnRenamed("path", "audio_path").withColumn("_there", F.lit(True))
    joined = manifest.join(m, "audio_path", "left")
    # Float files are judged as reported (seconds to three places, peaks to four), PCM files as measured.
    duration = F.when(F.col("is_float"), F.round("duration_s", 3)).otherwise(F.col("duration_s"))
    peak = F.when(F.col("is_float"), F.round("peak", 4)).otherwise(F.col("peak"))
    judged = issues(duration, peak, F.col("sample_rate"), F.col("metadata.sample_rate_hz"), **limits)
    odd = F.when(~F.col("finite"), F.concat(F.array(F.lit("contains non-finite samples")), judged)).otherwise(judged)
    found = F.when(F.col("error").isNotNull(), F.array(F.concat(F.lit("unreadable: "), "error"))).otherwise(odd)
    return joined.withColumn("issues", F.when(F.col("_there").isNull(), F.array(F.lit("missing"))).otherwise(found)).drop("_there")
