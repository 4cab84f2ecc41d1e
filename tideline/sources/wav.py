"""WAV files as tables: a file is one row of Spark's binaryFile source, its samples many rows."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SAMPLES = 1 << 16  # a row batch


def _values(part: bytes, width: int) -> np.ndarray:
    """Samples of one to four bytes in -1..1; those of three bytes become the upper ones of four."""
    if width == 3:
        wide = np.zeros((len(part) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(part[: len(part) // 3 * 3], np.uint8).reshape(-1, 3)
        part, width = wide.tobytes(), 4
    kind = {1: np.uint8, 2: np.int16, 4: np.int32}[width]
    x = np.frombuffer(part[: len(part) // width * width], kind).astype(np.float64)
    return (x - 128) / 128 if width == 1 else x / float(1 << 8 * width - 1)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(media_id, rate, i, v): samples in -1..1, channels averaged. Files that are no PCM WAV give no
    rows. A file is decoded by one task, in pieces, so only its bytes are held whole."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with wave.open(io.BytesIO(raw)) as f:
                        width, channels, rate, at = f.getsampwidth(), f.getnchannels(), f.getframerate(), 0
                        while part := f.readframes(SAMPLES):
                            x = _values(part, width).reshape(-1, channels).mean(1)
                            n = len(x)
                            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.full(n, rate, np.int32)), pa.array(np.arange(at, at + n)), pa.array(x)], names=["media_id", "rate", "i", "v"])
                            at += n
                except (wave.Error, EOFError):
                    continue  # no PCM WAV file

    files = spark.read.format("binaryFile").load(path)
    return files.selectExpr("regexp_extract(path, '([^/]+?)(?:[.][^./]*)?$', 1) AS media_id", "content").mapInArrow(run, "media_id string, rate int, i bigint, v double")
