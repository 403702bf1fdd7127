"""The kernels as DataFrame operators over binary and array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.kernels import pcm, spectral


def wav_headers(files: DataFrame) -> DataFrame:
    """path, rate, channels, frames, width, seconds of binaryFile rows; null values for what is no WAV."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"]):
                try:
                    x, rate, width = pcm.read_wav(content)
                    rows.append((path, rate, x.shape[1], len(x), width, len(x) / rate))
                except (ValueError, KeyError):
                    rows.append((path, None, None, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "rate", "channels", "frames", "width", "seconds"])

    return files.select("path", "content").mapInPandas(run, "path string, rate bigint, channels bigint, frames bigint, width bigint, seconds double")


def audio_blocks(files: DataFrame, block_frames: int = 65_536) -> DataFrame:
    """path, block, rate, samples (mono) of WAV files, block by block."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                x, rate, _ = pcm.read_wav(content)
                mono = pcm.to_mono(x)
                for i in range(0, len(mono), block_frames):
                    yield pd.DataFrame({"path": [path], "block": [i // block_frames], "rate": [rate], "samples": [mono[i : i + block_frames].tolist()]})

    return files.select("path", "content").mapInPandas(run, "path string, block bigint, rate bigint, samples array<double>")


def level_series(files: DataFrame, hop_sec: float = 0.02) -> DataFrame:
    """path, i, level: RMS level in dB of each hop of WAV files."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                x, rate, _ = pcm.read_wav(content)
                levels, _ = pcm.hop_levels(pcm.to_mono(x), rate, hop_sec)
                yield pd.DataFrame({"path": path, "i": np.arange(len(levels)), "level": levels})

    return files.select("path", "content").mapInPandas(run, "path string, i bigint, level double")


def feature_series(files: DataFrame) -> DataFrame:
    """path, name, i, value: the frame features of WAV files that are single numbers."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                x, rate, _ = pcm.read_wav(content)
                for name, values in spectral.frame_features(pcm.to_mono(x), rate).items():
                    if values.ndim == 1:
                        yield pd.DataFrame({"path": path, "name": name, "i": np.arange(len(values)), "value": values})

    return files.select("path", "content").mapInPandas(run, "path string, name string, i bigint, value double")


def kernel(function, result: str = "array<double>"):
    """A column function of an array column from a function of a numpy vector; null for null."""

    @F.pandas_udf(result)
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else np.asarray(function(np.asarray(v, float))).tolist())

    return run
